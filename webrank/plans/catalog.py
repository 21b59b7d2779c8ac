"""Named queries over the test tables, with the SQL that gives the same rows.

Documents are indexed by the plain analyzer, whose results SQL can express; doubles are rounded alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webrank.config import BLOCKED_EXTENSIONS, DOMAIN_STOP_WORDS, STOP_WORDS, TRAP_PATHS, TRAP_QUERY_KEYS, Settings
from webrank.functions import text as X
from webrank.functions import urls as U
from webrank.functions.html import extract_fields, next_links, visible_text
from webrank.operators import analytics, crawl, dedup, graph, index, search
from webrank.sources import pages as P
from webrank.sources.scratch import bounded_batches, materialize

QUERIES = [(0, "the of and"), (1, "in the en la"), (2, "thand the thin"), (3, "der die und"), (4, "password token license"), (5, "the the of the")]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return bounded_batches(spark.read.parquet(f"{d}/pages.parquet"))


def query_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, text string")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return index.body_tokens(documents(spark, d))


def tokenize_stats(spark, d):
    t = X.tokenize(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("terms"))


def term_postings(spark, d):
    return index.body_postings(documents(spark, d)).select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def dictionary_df(spark, d):
    return tokens(spark, d).select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def doc_lengths(spark, d):
    counts = index.body_counts(documents(spark, d))
    return index.doc_lengths(documents(spark, d), counts).select("doc_id", F.round("length", 6).alias("length"))


def body_bigrams(spark, d):
    docs = documents(spark, d)
    return index.counted(index.pair_items(docs), "bigram") if index.whole(docs) else index.body_bigrams(docs).groupBy("doc_id", "bigram").agg(F.count("*").alias("n"))


def exact_duplicates(spark, d):
    """Documents have no URL of their own, so keep-first by hash is a minimum."""
    empty = F.lit("")
    rows = documents(spark, d).select("doc_id", F.unhex(F.sha1(dedup.exact_text(empty, empty, empty, F.col("text")))).alias("hash"))
    rows = materialize(rows, "text-hashes")  # both sides of the join would collapse all texts
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("kept_doc_id"))
    return rows.join(first, "hash").filter("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id")


def keep_first_pages(spark, d):
    """The sequential rule on pages by host (as the URL) and title-less text length (as the hash), which collide often."""
    rows = pages(spark, d).select(F.col("page_id").alias("rank"), F.coalesce(U.hostname(F.col("url")), F.lit("")).alias("url"), F.pmod(F.length("html"), F.lit(97)).cast("string").alias("hash"))
    return dedup.keep_first(rows).select("rank", "state", "kept_rank")


def fingerprints(spark, d):
    return index.body_fingerprints(documents(spark, d))


def simhash_fingerprints(spark, d):
    return fingerprints(spark, d).select("doc_id", dedup.unsigned(F.col("fingerprint")).alias("fingerprint"))


def near_duplicates(spark, d):
    return dedup.near_duplicates(fingerprints(spark, d)).select("doc_id", "prior_doc_id", F.col("distance").cast("long").alias("distance"))


def near_duplicates_kept(spark, d):
    prints = fingerprints(spark, d).join(exact_duplicates(spark, d).select("doc_id"), "doc_id", "left_anti")
    return dedup.near_duplicates(prints).select("doc_id", "prior_doc_id", F.col("distance").cast("long").alias("distance"))


def part_edges(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_returnflag = 'R'")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return rows.select(F.col("l_partkey").alias("src"), after.alias("dst")).filter("dst is not null and src <> dst").distinct()


def pagerank_parts(spark, d):
    nodes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("doc_id"))
    return graph.pagerank(part_edges(spark, d), nodes).select("doc_id", F.round("score", 9).alias("score"))


def out_degrees(spark, d):
    return part_edges(spark, d).groupBy("src").agg(F.count("*").alias("degree"))


def search_tfidf(spark, d):
    rows = search.score(query_table(spark), index.index_documents(documents(spark, d)))
    return rows.select("query_id", "doc_id", F.round("tfidf", 6).alias("tfidf"), F.col("matched").cast("long").alias("matched"))


def search_full(spark, d):
    return search.search(query_table(spark), index.index_documents(documents(spark, d)), digits=6).select("query_id", F.col("place").cast("long").alias("place"), "doc_id", "url", "score")


def search_benchmark(spark, d):
    """Every benchmark item as a query."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return search.search(items, index.index_documents(documents(spark, d)), digits=6).select("query_id", F.col("place").cast("long").alias("place"), "doc_id", "score")


def phrase_docs(spark, d):
    rows = search.score(query_table(spark), index.index_documents(documents(spark, d)))
    return rows.filter("phrase_hits > 0").select("query_id", "doc_id", F.col("phrase_hits").cast("long").alias("hits"))


def bigram_docs(spark, d):
    rows = search.score(query_table(spark), index.index_documents(documents(spark, d)))
    return rows.filter("bigram_hits > 0").select("query_id", "doc_id", F.col("bigram_hits").cast("long").alias("hits"))


def url_normalize_index(spark, d):
    return pages(spark, d).select("page_id", U.normalize_index(F.col("url")).alias("url"))


def url_normalize_crawl(spark, d):
    return pages(spark, d).select("page_id", U.normalize_crawl(F.col("url")).alias("url"))


def url_normalize_frontier(spark, d):
    return pages(spark, d).select("page_id", U.normalize_frontier(F.col("url")).alias("url"))


def url_host(spark, d):
    return pages(spark, d).select("page_id", U.host_for_count(F.col("url")).alias("host"))


def url_hash(spark, d):
    return pages(spark, d).select("page_id", U.url_hash(F.col("url")).alias("hash"))


def url_file_name(spark, d):
    return pages(spark, d).select("page_id", U.file_name(F.col("url")).alias("name"))


def url_validity(spark, d):
    return pages(spark, d).select("page_id", crawl.reject_reason(F.col("url")).isNull().alias("valid"), crawl.host_allowed(U.hostname(F.col("url")), ["example.com", "example.org"]).alias("allowed"))


def url_variants(spark, d):
    """Pages of one host are given one path, so that variants add up."""
    rows = pages(spark, d).select("page_id", F.concat(F.lit("http://x/p"), F.when(U.part(F.col("url"), U.QUERY) != "", F.concat(F.lit("?v="), F.pmod("page_id", F.lit(40)))).otherwise("")).alias("url"))
    return crawl.too_many_variants(rows, "page_id").select("page_id", F.col("variants").cast("long").alias("variants"), "too_many")


def parsed(spark, d):
    return pages(spark, d).select("page_id", "url", extract_fields("url", "html").alias("f"))


def html_title(spark, d):
    return parsed(spark, d).select("page_id", F.col("f.title").alias("title"))


def html_headings(spark, d):
    return parsed(spark, d).select("page_id", F.col("f.headings").alias("headings"))


def html_bold(spark, d):
    return parsed(spark, d).select("page_id", F.col("f.bold").alias("bold"))


def html_links(spark, d):
    # an inner posexplode would get a filter on the arrays' size below it, in which each page is parsed again by workers of its own
    rows = parsed(spark, d).select("page_id", F.posexplode_outer("f.links").alias("i", "l")).filter("i is not null")
    return rows.select("page_id", F.col("i").cast("long").alias("i"), "l.target", "l.text")


def html_visible_text(spark, d):
    return pages(spark, d).select("page_id", visible_text("html").alias("text"))


def html_next_links(spark, d):
    return pages(spark, d).select("page_id", F.explode(next_links("url", "html")).alias("url"))


def page_weighted_tf(spark, d):
    docs = parsed(spark, d).select(F.col("page_id").alias("doc_id"), "f.*")
    return index.weighted_counts(index.field_tokens(docs, stem=False)).select(F.col("doc_id").alias("page_id"), "term", "weight")


def derived_links(spark, d):
    """rank, target, text: page i links to pages 3i + 1 and i itself, with its title as the text."""
    n = pages(spark, d).count()
    rows = parsed(spark, d).select(F.col("page_id").alias("rank"), F.col("f.title").alias("text"))
    return rows.select("rank", F.explode(F.array("rank", F.pmod(F.col("rank") * 3 + 1, F.lit(n)))).alias("to"), "text").select("rank", F.concat(F.lit("p"), "to").alias("target"), "text")


def anchor_terms(spark, d):
    kept = pages(spark, d).select(F.col("page_id").alias("doc_id"), F.col("page_id").alias("rank"), F.concat(F.lit("p"), "page_id").alias("url"))
    return index.anchor_terms(index.anchors_in_order(derived_links(spark, d), kept), stem=False)


def orphan_anchors(spark, d):
    kept = pages(spark, d).select(F.col("page_id").alias("rank"), F.concat(F.lit("p"), "page_id").alias("url"))
    return index.orphans(derived_links(spark, d), kept)


def link_graph_edges(spark, d):
    names = pages(spark, d).select(F.col("page_id").alias("doc_id"), F.concat(F.lit("http://p/"), "page_id").alias("url"))
    links = derived_links(spark, d).select(F.concat(F.lit("http://p/"), "rank").alias("source"), F.concat(F.lit("http://p/"), F.substring("target", 2, 20)).alias("target"))
    return graph.link_graph(links, names)


def page_index_summary(spark, d):
    """The whole build over pages: fields, keep-first, stems, anchors, duplicates."""
    return index.build_index(P.from_table(pages(spark, d))).summary


def page_search(spark, d):
    built = index.build_index(P.from_table(pages(spark, d)), stem=False)
    ranks = graph.pagerank(graph.link_graph(built.links, built.doc_table), built.doc_table)
    return search.search(query_table(spark), built, ranks, digits=6).withColumn("place", F.col("place").cast("long"))


def stemmed_terms(spark, d):
    return X.stemmed(tokens(spark, d).select("term").distinct()).groupBy("term").agg(F.count("*").alias("words"))


def crawl_rounds(spark, d):
    """A crawl from every page of the table, until the frontier is empty."""
    return crawl.crawl(spark, pages(spark, d).select("url"), P.table_fetcher(pages(spark, d))).select("url", "status", "depth")


def analytics_pages(spark, d):
    """Documents as pages of 40 hosts below the suffix; every tenth repeats an earlier URL."""
    rows = documents(spark, d).withColumn("k", F.when(F.pmod("doc_id", F.lit(10)) == 9, F.col("doc_id") - 9).otherwise(F.col("doc_id")))
    url = F.concat(F.lit("http://www.h"), F.pmod("k", F.lit(40)), F.lit(".uci.edu/d/"), F.col("k"))
    return analytics.unique_pages(rows.select(url.alias("url"), "text", F.col("doc_id").alias("arrival")))


def analytics_unique_pages(spark, d):
    return analytics_pages(spark, d).select("canon", "arrival")


def analytics_longest_page(spark, d):
    return analytics.longest_page(analytics_pages(spark, d))


def analytics_top_words(spark, d):
    return analytics.top_words(analytics_pages(spark, d))


def analytics_top_stop_words(spark, d):
    return analytics.top_stop_words(analytics_pages(spark, d))


def analytics_hosts(spark, d):
    return analytics.hosts(analytics_pages(spark, d))


def content_words(spark, d):
    t = X.tokenize_content(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).cast("long").alias("content"), F.size(X.tokenize_with_stop_words(F.col("text"))).cast("long").alias("words"))


# --- SQL ---------------------------------------------------------------------------------------

TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
T = f"t AS MATERIALIZED (SELECT doc_id, unnest({TOK.format('text')}) AS term, generate_subscripts({TOK.format('text')}, 1) - 1 AS pos FROM documents)"
LENGTHS = "len AS (SELECT doc_id, sqrt(sum(pow(1 + log10(n), 2))) AS length FROM (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL) GROUP BY doc_id)"
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}', ' ', 'g'))"


HASHES = "h AS (SELECT doc_id, sha1(" + _collapse("lower('   ' || coalesce(text, ''))") + ") AS hash FROM documents), k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY hash) AS kept_doc_id FROM h)"
PRINTS = (
    T
    + ", c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT DISTINCT term, ('0x' || sha1(term)[25:40])::UBIGINT AS h FROM c), w AS (SELECT doc_id, n, h FROM c JOIN v USING (term)), s AS (SELECT doc_id, "
    + ", ".join(f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN n ELSE -n END) AS b{i}" for i in range(64))
    + " FROM w GROUP BY doc_id), f AS MATERIALIZED (SELECT d.doc_id, "
    + " | ".join(f"(CASE WHEN b{i} > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))
    + " AS fp FROM documents d LEFT JOIN s USING (doc_id))"
)
NEAR = "SELECT b.doc_id, a.doc_id AS prior_doc_id, bit_count(xor(a.fp, b.fp))::BIGINT AS distance FROM {0} a JOIN {0} b ON a.fp >> 52 = b.fp >> 52 AND a.doc_id < b.doc_id WHERE bit_count(xor(a.fp, b.fp)) <= 3"
EDGES = "e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_returnflag = 'R') WHERE dst IS NOT NULL AND src <> dst)"


def _pagerank_sql(nodes: str = "SELECT p_partkey FROM part", edges: str = EDGES) -> str:
    """CTEs up to r20(v, s) over nodes and e(src, dst)."""
    steps = [edges, f"nodes(v) AS ({nodes})", "nn AS (SELECT count(*) AS nodes FROM nodes)", "o AS MATERIALIZED (SELECT src, count(*) AS c FROM e GROUP BY src)", "r0 AS MATERIALIZED (SELECT v, 1.0::DOUBLE / nodes AS s FROM nodes, nn)"]
    for i in range(20):
        got = f"SELECT dst AS v, sum(s / c) AS g FROM e JOIN o USING (src) JOIN r{i} ON r{i}.v = src GROUP BY dst"
        lost = f"(SELECT coalesce(sum(s), 0) FROM r{i} WHERE v NOT IN (SELECT src FROM o))"
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT r{i}.v, 0.15 / nodes + 0.85 * (coalesce(g, 0) + {lost} / nodes) AS s FROM nn, r{i} LEFT JOIN ({got}) q ON q.v = r{i}.v)")
    return ", ".join(steps)


def _values(rows) -> str:
    return ", ".join(f"({i}, '{text}')" for i, text in rows)


def _adjacent(name: str, rows: str) -> str:
    pairs = f"SELECT DISTINCT doc_id, t1, t2 FROM (SELECT doc_id, term AS t1, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS t2 FROM {rows}) WHERE t2 IS NOT NULL"
    return f"{name}_ad AS MATERIALIZED ({pairs}), {name} AS (SELECT query_id, doc_id, sum(times)::BIGINT AS hits FROM pr JOIN {name}_ad USING (t1, t2) GROUP BY ALL)"


def _scores(asked: str, tokens: str = f"{T}, {LENGTHS}", body: str = "t", table: str = "documents", rank: str = "0") -> str:
    """z(query_id, doc_id, tfidf, matched, bh, rk, score) of the queries `asked`; `body` has the rows of t that bigrams are made of."""
    return (
        f"q(query_id, text) AS ({asked}), {tokens}, "
        f"p AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), total AS (SELECT count(*) AS n FROM {table}), "
        f"qt AS (SELECT query_id, unnest({TOK.format('text')}) AS term, generate_subscripts({TOK.format('text')}, 1) AS pos FROM q), "
        "w AS (SELECT query_id, term, (1 + log10(qtf)) * log10(n / df) AS weight, row_number() OVER (PARTITION BY query_id ORDER BY log10(n / df) DESC, first) AS rk FROM (SELECT query_id, term, count(*) AS qtf, min(pos) AS first FROM qt GROUP BY ALL) JOIN df USING (term), total), "
        "hits AS MATERIALIZED (SELECT query_id, doc_id, term, weight, rk, tf FROM w JOIN p USING (term)), "
        "g AS (SELECT query_id, doc_id, sum((1 + log10(tf)) * weight) AS dot, count(*) AS matched, min(rk) AS rk FROM hits GROUP BY ALL), "
        "pr AS (SELECT query_id, t1, t2, count(*) AS times FROM (SELECT query_id, term AS t1, lead(term) OVER (PARTITION BY query_id ORDER BY pos) AS t2 FROM qt) WHERE t2 IS NOT NULL GROUP BY ALL), "
        f"{_adjacent('bi', body)}, {_adjacent('ph', 't')}, "
        f"z AS (SELECT query_id, doc_id, dot / length AS tfidf, matched, coalesce(bi.hits, 0) AS bh, rk, dot / length + 0.05 * matched + {Settings().bigram_bonus} * coalesce(bi.hits, 0) + {Settings().phrase_bonus} * coalesce(ph.hits, 0) + {Settings().rank_weight} * {rank} AS score "
        "FROM total, g JOIN len USING (doc_id) LEFT JOIN bi USING (query_id, doc_id) LEFT JOIN ph USING (query_id, doc_id))"
    )


PLACES = "y AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, rk, doc_id) AS place FROM z)"
SCORES = _scores(f"VALUES {_values(QUERIES)}")
SCHEME, NETLOC, PATH, QUERY, FRAGMENT = (rf"coalesce(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', {i}), '')" for i in range(1, 6))
HOST = f"lower(regexp_extract({NETLOC}, '^[^:]*'))"
BASE = f"lower({SCHEME}) || '://' || lower({NETLOC})"
RTRIM = f"CASE WHEN rtrim({PATH}, '/') = '' THEN '/' ELSE rtrim({PATH}, '/') END"
KEYS = f"list_transform(string_split({QUERY}, '&'), lambda x: lower(split_part(x, '=', 1)))"
QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)
KEPT_QUERY = f"array_to_string(list_sort(list_filter(list_filter(string_split({QUERY}, '&'), lambda x: contains(x, '=') AND split_part(x, '=', 2) <> ''), lambda x: NOT list_contains([{QUOTED(TRAP_QUERY_KEYS)}], lower(split_part(x, '=', 1)))))[1:6], '&')"
UNESCAPE = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
CUT = r"regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs')"
BARE = "regexp_replace(html, '<!--.*?-->|" + "|".join(f"<{x}[ >].*?</{x}>" for x in ("script", "style", "noscript", "header", "footer", "nav", "aside")) + "', '<>', 'gs')"
PAGES = "u AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN doc_id - 9 ELSE doc_id END AS k, text FROM documents), a AS MATERIALIZED (SELECT k, min(doc_id) AS arrival, arg_min(coalesce(text, ''), doc_id) AS text FROM u GROUP BY k), aw AS MATERIALIZED (SELECT k, arrival, list_filter(" + TOK.format("text") + ", lambda t: NOT regexp_full_match(t, '[0-9]+')) AS w FROM a)"
CANON = "'http://www.h' || (k % 40) || '.uci.edu/d/' || k"
DERIVED = "ti AS (SELECT page_id AS rank, coalesce(" + _collapse(UNESCAPE.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")) + ", '') AS text FROM pages), n AS (SELECT count(*) AS n FROM pages), li AS (SELECT rank, unnest([rank, (rank * 3 + 1) % n]) AS dst, text FROM ti, n)"

FIELDS = f"""a AS (SELECT page_id, {CUT} AS h FROM pages), b AS (SELECT page_id, h, regexp_replace(regexp_replace(regexp_replace(h, '<title>.*?</title>', ' ', 'gs'), '<h1>.*?</h1>', ' ', 'gs'), '<b>[^<]*<br>', ' ', 'g') AS rest FROM a),
    f AS (SELECT page_id, 1 AS k, 3.0 AS w, regexp_extract(h, '<title>(.*?)</title>', 1, 's') AS x FROM b UNION ALL SELECT page_id, 2, 2.0, regexp_extract(h, '<h1>(.*?)</h1>', 1, 's') FROM b UNION ALL SELECT page_id, 3, 1.5, array_to_string(regexp_extract_all(h, '<b>([^<]*)<br>', 1), ' ') FROM b UNION ALL SELECT page_id, 4, 1.0, regexp_replace(rest, '<[^>]*>', ' ', 'g') FROM b)"""
FIELD_TOKENS = f"ft AS MATERIALIZED (SELECT page_id, k, w, unnest({TOK.format(UNESCAPE.format('x'))}) AS term, generate_subscripts({TOK.format(UNESCAPE.format('x'))}, 1) AS j FROM f)"

LINKS = f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS i FROM pages) SELECT page_id, i, {BASE} || CASE WHEN rtrim(href, '/') = '' THEN '/' ELSE rtrim(href, '/') END AS target, {_collapse(UNESCAPE.format('text'))} AS text FROM l"""
#: The first page of each URL is kept (no page repeats another's text); anchors count where their page isn't scanned after its target.
PAGE_TOKENS = (
    f"{FIELDS}, {FIELD_TOKENS}, raw AS (SELECT page_id, sha1(url) AS path, {BASE} || {RTRIM} || CASE WHEN {QUERY} <> '' THEN '?' || {QUERY} ELSE '' END AS url FROM pages), ids AS MATERIALIZED (SELECT page_id, url, row_number() OVER (ORDER BY path) - 1 AS doc_id FROM (FROM raw QUALIFY row_number() OVER (PARTITION BY url ORDER BY path) = 1)), "
    f"links AS MATERIALIZED (SELECT s.doc_id AS src, d.doc_id AS dst, text FROM ({LINKS}) JOIN ids s USING (page_id) JOIN ids d ON d.url = target WHERE text <> ''), "
    + _pagerank_sql("SELECT doc_id FROM ids", "e AS MATERIALIZED (SELECT DISTINCT src, dst FROM links WHERE src <> dst)")
    + ", t AS MATERIALIZED (SELECT doc_id, k, w, term, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS pos FROM ft JOIN ids USING (page_id)), "
    + f"anchors AS (SELECT dst AS doc_id, unnest({TOK.format('text')}) AS term, 2.0 AS w FROM links WHERE src <= dst), "
    + "len AS (SELECT doc_id, sqrt(sum(pow(1 + log10(n), 2))) AS length FROM (SELECT doc_id, term, sum(w)::DOUBLE AS n FROM (SELECT doc_id, term, w FROM t UNION ALL FROM anchors) GROUP BY ALL) GROUP BY doc_id)"
)


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize_stats": f"SELECT doc_id, len({TOK.format('text')})::BIGINT AS tokens, len(list_distinct({TOK.format('text')}))::BIGINT AS terms FROM documents",
        "term_postings": f"WITH {T} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM t GROUP BY term, doc_id",
        "dictionary_df": f"WITH {T} SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term",
        "doc_lengths": f"WITH {T}, {LENGTHS} SELECT d.doc_id, round(coalesce(length, 0), 6) AS length FROM documents d LEFT JOIN len USING (doc_id)",
        "body_bigrams": f"WITH {T} SELECT doc_id, a || '_' || b AS bigram, count(*) AS n FROM (SELECT doc_id, term AS a, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM t) WHERE b IS NOT NULL GROUP BY ALL",
        "exact_duplicates": f"WITH {HASHES} SELECT doc_id, kept_doc_id FROM k WHERE doc_id <> kept_doc_id",
        "keep_first_pages": f"""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY page_id) AS i, page_id AS rank, {HOST} AS url, (length(html) % 97)::VARCHAR AS hash FROM pages),
            s AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS rank, '' AS state, NULL::BIGINT AS kept_rank, []::VARCHAR[] AS urls, []::VARCHAR[] AS hashes, []::BIGINT[] AS kept
            UNION ALL SELECT r.i, r.rank, CASE WHEN list_contains(urls, url) THEN 'url' WHEN list_contains(hashes, hash) THEN 'hash' ELSE 'kept' END,
            CASE WHEN list_contains(urls, url) THEN kept[list_position(urls, url)] WHEN list_contains(hashes, hash) THEN kept[list_position(hashes, hash)] ELSE r.rank END,
            CASE WHEN list_contains(urls, url) OR list_contains(hashes, hash) THEN urls ELSE list_append(urls, url) END, CASE WHEN list_contains(urls, url) OR list_contains(hashes, hash) THEN hashes ELSE list_append(hashes, hash) END,
            CASE WHEN list_contains(urls, url) OR list_contains(hashes, hash) THEN kept ELSE list_append(kept, r.rank) END FROM s JOIN r ON r.i = s.i + 1) SELECT rank, state, kept_rank FROM s WHERE i > 0""",
        "simhash_fingerprints": f"WITH {PRINTS} SELECT doc_id, fp::VARCHAR AS fingerprint FROM f",
        "near_duplicates": f"WITH {PRINTS} {NEAR.format('f')}",
        "near_duplicates_kept": f"WITH {PRINTS}, {HASHES}, fk AS MATERIALIZED (SELECT f.* FROM f JOIN k USING (doc_id) WHERE doc_id = kept_doc_id) {NEAR.format('fk')}",
        "pagerank_parts": f"WITH {_pagerank_sql()} SELECT v AS doc_id, round(s, 9) AS score FROM r20",
        "out_degrees": f"WITH {EDGES} SELECT src, count(*) AS degree FROM e GROUP BY src",
        "search_tfidf": f"WITH {SCORES} SELECT query_id, doc_id, round(tfidf, 6) AS tfidf, matched FROM z",
        "search_full": f"WITH {SCORES}, {PLACES} SELECT query_id, place, doc_id, 'doc:' || doc_id AS url, score FROM y WHERE place <= 15",
        "search_benchmark": f"WITH {_scores('SELECT item_id, text FROM benchmark')}, {PLACES} SELECT query_id, place, doc_id, score FROM y WHERE place <= 15",
        "phrase_docs": f"WITH {SCORES} SELECT query_id, doc_id, bh AS hits FROM z WHERE bh > 0",
        "bigram_docs": f"WITH {SCORES} SELECT query_id, doc_id, bh AS hits FROM z WHERE bh > 0",
        "url_normalize_index": f"SELECT page_id, {BASE} || {RTRIM} || CASE WHEN {QUERY} <> '' THEN '?' || {QUERY} ELSE '' END AS url FROM pages",
        "url_normalize_crawl": f"SELECT page_id, {BASE} || {RTRIM} || CASE WHEN {KEPT_QUERY} <> '' THEN '?' || {KEPT_QUERY} ELSE '' END AS url FROM pages",
        "url_normalize_frontier": "SELECT page_id, rtrim(url, '/') AS url FROM pages",
        "url_host": f"SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS host FROM pages",
        "url_hash": f"SELECT page_id, sha256({NETLOC} || '/' || {PATH} || '//' || {QUERY} || '/' || {FRAGMENT}) AS hash FROM pages",
        "url_file_name": "SELECT page_id, sha1(url) || '.json' AS name FROM pages",
        "url_validity": f"""SELECT page_id, NOT (NOT {SCHEME} IN ('http', 'https') OR {HOST} = '' OR regexp_matches(lower({PATH}), '{'|'.join(TRAP_PATHS)}') OR len(list_intersect({KEYS}, [{QUOTED(TRAP_QUERY_KEYS)}])) > 0 OR regexp_matches(lower({PATH}), '\\.({'|'.join(BLOCKED_EXTENSIONS)})$')) AS valid, regexp_matches({HOST}, '(^|\\.)example\\.(com|org)$') AS allowed FROM pages""",
        "url_variants": f"WITH p AS (SELECT page_id, CASE WHEN {QUERY} <> '' THEN page_id % 40 END AS q FROM pages), f AS (SELECT *, CASE WHEN q IS NOT NULL AND row_number() OVER (PARTITION BY q ORDER BY page_id) = 1 THEN 1 ELSE 0 END AS first FROM p), s AS (SELECT page_id, CASE WHEN q IS NULL THEN 0 ELSE sum(first) OVER (ORDER BY page_id) END::BIGINT AS variants FROM f) SELECT page_id, variants, variants > 20 AS too_many FROM s",
        "html_title": f"SELECT page_id, {_collapse(UNESCAPE.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))} AS title FROM pages",
        "html_headings": f"SELECT page_id, {_collapse(UNESCAPE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"))} AS headings FROM pages",
        "html_bold": f"SELECT page_id, {_collapse(UNESCAPE.format("array_to_string(regexp_extract_all(html, '<b>([^<]*)<br>', 1), ' ')"))} AS bold FROM pages",
        "html_links": LINKS,
        "html_next_links": f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT DISTINCT page_id, {SCHEME} || '://' || {NETLOC} || regexp_replace({UNESCAPE.format('trim(href)')}, '#.*', '') AS url FROM l WHERE trim(href) <> ''""",
        "html_visible_text": f"WITH h AS (SELECT page_id, {BARE} AS h FROM pages), s AS (SELECT page_id, list_filter(list_transform(string_split_regex(h, '<[^>]*>'), lambda x: regexp_replace({UNESCAPE.format('x')}, '^{BLANK}|{BLANK}$', '', 'g')), lambda x: x <> '') AS x FROM h) SELECT page_id, array_to_string(x, ' ') AS text FROM s",
        "anchor_terms": f"WITH {DERIVED}, x AS (SELECT dst, unnest({TOK.format('text')}) AS term FROM li WHERE rank <= dst) SELECT dst AS doc_id, term, 2.0 * count(*) AS weight FROM x GROUP BY ALL",
        "orphan_anchors": f"WITH {DERIVED} SELECT DISTINCT 'p' || dst AS url FROM li WHERE rank > dst",
        "link_graph_edges": f"WITH {DERIVED} SELECT DISTINCT rank AS src, dst FROM li WHERE rank <> dst",
        "analytics_unique_pages": f"WITH {PAGES} SELECT {CANON} AS canon, arrival FROM a",
        "analytics_longest_page": f"WITH {PAGES} SELECT {CANON} AS url, len(w)::BIGINT AS words FROM aw ORDER BY len(w) DESC, arrival LIMIT 1",
        "analytics_top_words": f"WITH {PAGES} SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM aw) WHERE length(word) >= 2 AND word NOT IN ({QUOTED([*STOP_WORDS, *DOMAIN_STOP_WORDS])}) GROUP BY word ORDER BY n DESC, word LIMIT 50",
        "analytics_top_stop_words": f"WITH {PAGES} SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM aw) WHERE word IN ({QUOTED(STOP_WORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 50",
        "analytics_hosts": f"WITH {PAGES} SELECT 'h' || (k % 40) || '.uci.edu' AS host, count(*) AS pages FROM a GROUP BY ALL",
        "content_words": f"SELECT doc_id, len(list_filter(w, lambda t: NOT list_contains([{QUOTED(STOP_WORDS)}], t)))::BIGINT AS content, len(w)::BIGINT AS words FROM (SELECT doc_id, list_filter({TOK.format('text')}, lambda t: NOT regexp_full_match(t, '[0-9]+')) AS w FROM documents)",
        "page_weighted_tf": f"WITH {FIELDS}, {FIELD_TOKENS} SELECT page_id, term, sum(w)::DOUBLE AS weight FROM ft GROUP BY ALL",
        "page_search": f"WITH {_scores(f'VALUES {_values(QUERIES)}', PAGE_TOKENS, '(SELECT * FROM t WHERE k = 4)', 'ids', '(SELECT s FROM r20 WHERE v = doc_id)')}, {PLACES} SELECT query_id, place, doc_id, url, score FROM y JOIN ids USING (doc_id) WHERE place <= 15",
    }


def queries() -> dict:
    own = [
        tokenize_stats, term_postings, dictionary_df, doc_lengths, body_bigrams, exact_duplicates, keep_first_pages, simhash_fingerprints, near_duplicates, near_duplicates_kept, pagerank_parts, out_degrees,
        search_tfidf, search_full, search_benchmark, phrase_docs, bigram_docs, url_normalize_index, url_normalize_crawl, url_normalize_frontier, url_host, url_hash, url_file_name, url_validity, url_variants,
        html_title, html_headings, html_bold, html_links, html_visible_text, html_next_links, page_weighted_tf, anchor_terms, orphan_anchors, link_graph_edges, page_index_summary, page_search, stemmed_terms, crawl_rounds,
        analytics_unique_pages, analytics_longest_page, analytics_top_words, analytics_top_stop_words, analytics_hosts, content_words,
    ]
    return {f.__name__: f for f in own}
