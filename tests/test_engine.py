import dataclasses
import json
import math
import random
import time
import urllib.error

import pytest
from pyspark.sql import functions as F

from webrank.operators import crawl, dedup, graph, index, search
from webrank.operators.index import IndexTables
from webrank.plans import catalog
from webrank.sources import pages
from webrank.sources.pages import download, read_json, table_fetcher
from webrank.streaming.incremental import compact, index_stream


def greedy(pages):
    urls, hashes, kept = {}, {}, {}
    for rank, url, hash_ in sorted(pages):
        if url in urls:
            kept[rank] = ("url", urls[url])
        elif hash_ in hashes:
            kept[rank] = ("hash", hashes[hash_])
        else:
            urls[url] = hashes[hash_] = rank
            kept[rank] = ("kept", rank)
    return kept


def test_keep_first_is_the_sequential_rule(spark):
    rng = random.Random(1)
    pages = [(i, f"u{rng.randrange(9)}", f"h{rng.randrange(9)}") for i in range(40)]
    got = dedup.keep_first(spark.createDataFrame(pages, "rank long, url string, hash string")).collect()
    assert {r["rank"]: (r.state, r.kept_rank) for r in got} == greedy(pages)


@pytest.mark.parametrize(("n", "edges", "want"), [(2, [(0, 1)], [0.350877198, 0.649122802]), (3, [(0, 1), (0, 2), (1, 2)], [0.197579649, 0.281551000, 0.520869351])])
def test_pagerank(spark, n, edges, want):
    got = graph.pagerank(spark.createDataFrame(edges, "src long, dst long"), spark.range(n).withColumnRenamed("id", "doc_id"))
    got = [r.score for r in got.orderBy("doc_id").collect()]
    assert got == pytest.approx(want, abs=1e-8) and sum(got) == pytest.approx(1)


def test_search(spark):
    docs = spark.createDataFrame([(0, "red fox"), (1, "red red dog"), (2, None)], "doc_id long, text string")
    built = index.index_documents(docs.filter("doc_id < 2"))
    ranks = spark.createDataFrame([(0, 0.5), (1, 0.5)], "doc_id long, score double")
    queries = spark.createDataFrame([(7, "red fox"), (8, "nothing"), (9, None)], "query_id int, text string")
    got = [(r.query_id, r.doc_id, r.score) for r in search.search(queries, built, ranks).orderBy("place").collect()]
    assert [x[:2] for x in got] == [(7, 0), (7, 1)]
    assert [x[2] for x in got] == pytest.approx([math.log10(2) / math.sqrt(2) + 1.7, 0.15])
    assert index.index_documents(docs).doc_lengths.filter("doc_id = 2").first().length == 0


def test_variants(spark):
    urls = [f"http://x/p?q={i}" for i in range(21)] + ["http://x/p?q=0", "http://x/p"]
    rows = spark.createDataFrame(list(enumerate(urls)), "arrival long, url string")
    got = [r.too_many for r in crawl.too_many_variants(rows).orderBy("arrival").collect()]
    assert got == [False] * 20 + [True, True, False]


def test_rules(spark):
    cases = {"http://a.com/x": None, "ftp://a.com/x": "scheme", "http://a.com/calendar/1": "trap_path", "http://a.com/x?do=1": "trap_query", "http://a.com/x.PDF": "extension", "http://b.org/": "domain", "http://s.a.com/": None}
    rows = spark.createDataFrame([(x,) for x in cases], "url string").select("url", crawl.reject_reason(F.col("url"), ["a.com"]).alias("why"))
    assert {r.url: r.why for r in rows.collect()} == cases


@pytest.fixture(scope="module")
def site(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    text = " ".join(f"word{i}" for i in range(60))
    pages = {"http://a.com/": f"<title>Start</title><p>{text} <a href='/b'>blue door</a> <a href='/c'>blue</a>", "http://a.com/b": f"<p>{text} other <a href='/'>home</a>", "http://a.com/c": f"<p>{text} other <a href='/'>home</a>"}
    for i, (url, html) in enumerate(pages.items()):
        (folder / f"{i}.json").write_text(json.dumps({"url": url, "content": html}))
    (folder / "x.json").write_text("{broken")
    (folder / "y.json").write_text(json.dumps({"url": "", "content": "no url"}))
    return str(folder), pages


def test_build_save_and_search(spark, site, tmp_path):
    built = index.build_index(read_json(spark, site[0]))
    built.save(str(tmp_path))
    built = IndexTables.load(spark, str(tmp_path))
    assert {r.url for r in built.doc_table.collect()} == {"http://a.com/", "http://a.com/b"}
    assert [(r.url, r.kept_url) for r in built.exact_duplicates.collect()] == [("http://a.com/c", "http://a.com/b")]
    assert built.near_duplicates.count() in (0, 1) and {r.table for r in index.size_report(spark, str(tmp_path)).collect()} >= {"postings", "dictionary"}
    edges = graph.link_graph(built.links, built.doc_table)
    assert edges.count() == 2
    assert search.search_one("start", built, graph.pagerank(edges, built.doc_table)) == ["http://a.com/"]


def test_crawl_reaches_all(spark, site):
    pages = spark.createDataFrame(list(site[1].items()), "url string, html string")
    got = crawl.crawl(spark, spark.createDataFrame([("http://a.com/",)], "url string"), table_fetcher(pages), max_rounds=3).collect()
    assert {(r.url, r.depth) for r in got} == {("http://a.com", 0), ("http://a.com/b", 1), ("http://a.com/c", 1)}


@pytest.fixture
def chain(spark, monkeypatch):
    """Fetches of p0 ... p(n - 1), each with a link to the next; the scraping rules, tested above, are left out."""
    monkeypatch.setattr(crawl, "scrape", lambda responses, *_: responses.filter("status = 200").select(F.col("url").alias("source"), F.decode("body", "UTF-8").alias("url"), F.lit(True).alias("ok")))
    monkeypatch.setattr(crawl, "bad_urls", lambda responses: responses.select("url").limit(0))
    for name, rule in {"url_hash": F.sha1, "normalize_frontier": lambda url: url, "hostname": lambda url: F.lit("a.com"), "valid_seed": lambda url: url.isNotNull()}.items():
        monkeypatch.setattr(crawl.U, name, rule)
    monkeypatch.setattr(crawl, "allowed_domains", lambda seeds: seeds.select(F.lit("a.com").alias("domain")))
    monkeypatch.setattr(crawl, "valid", lambda rows, *_, **__: rows.filter("url not like '%/invalid'"))
    status = lambda n: F.when(F.substring_index("url", "/p", -1).cast("int") < n, 200).otherwise(404)
    after = F.concat(F.lit("http://a.com/p"), F.substring_index("url", "/p", -1).cast("int") + 1)
    return lambda n: lambda urls: urls.select("url", status(n).alias("status"), F.encode(after, "UTF-8").alias("body"))


def test_crawl_goes_on_until_the_frontier_is_empty(spark, chain):
    got = crawl.crawl(spark, spark.createDataFrame([("http://a.com/p0",)], "url string"), chain(11)).collect()
    assert {(r.url, r.depth, r.status) for r in got} == {(f"http://a.com/p{i}", i, 200 if i < 11 else 404) for i in range(12)}


def test_crawl_resumes(spark, chain, tmp_path):
    fetch, asked = chain(3), []

    def noted(urls):
        asked.extend(r.url for r in urls.collect())
        return fetch(urls)

    seeds = spark.createDataFrame([("http://a.com/p0",)], "url string")
    crawl.crawl(spark, seeds, noted, max_rounds=2, state=str(tmp_path))
    got = crawl.crawl(spark, seeds, noted, state=str(tmp_path)).collect()
    want = {f"http://a.com/p{i}": i for i in range(4)}
    assert {r.url: r.depth for r in got} == want and sorted(asked) == sorted(want) and len(got) == len(want)


def test_politeness(spark):
    urls = spark.createDataFrame([(f"http://127.0.0.1:9/{i}",) for i in range(3)], "url string").coalesce(1)
    start = time.monotonic()
    assert download(urls, "x", politeness=1.5).filter("status = 601").count() == 3 and time.monotonic() - start >= 3


def test_stream_equals_batch(spark, site, tmp_path):
    index_stream(spark, site[0], f"{tmp_path}/part", f"{tmp_path}/check", files_per_batch=1).awaitTermination()
    compact(spark, f"{tmp_path}/part", f"{tmp_path}/whole")
    terms = {r.term: r.df for r in spark.read.parquet(f"{tmp_path}/whole/dictionary").collect()}
    assert terms["word1"] == 3 and terms["other"] == 2 and spark.read.parquet(f"{tmp_path}/whole/doc_table").count() == 3


def test_variants_count_over_rounds(spark):
    """20 distinct queries of a host and path are accepted in a whole crawl, in whatever rounds they come."""
    rows = lambda xs: crawl.with_variant(spark.createDataFrame([(f"http://a.com/p?x={x}" if x else "http://a.com/p", i) for i, x in enumerate(xs)], "url string, arrival int"))
    ok = lambda xs, seen=None: [r.ok for r in crawl.within_limit(rows(xs), "arrival", 20, seen).orderBy("arrival").collect()]
    first = [*range(1, 16), 3]
    assert all(ok(first))
    seen = rows(first).select("_k", "_q").distinct()
    assert ok([16, 3, 17, 18, 19, 20, 0, 21, 16, 0], seen) == [True] * 7 + [False, False, True]
    seen = rows(range(1, 23)).select("_k", "_q").distinct()
    assert ok([1, 0, 30], seen) == [False, True, False]
    both = crawl.too_many_variants(rows([*range(1, 30), 2, 0]).select("url", "arrival")).orderBy("arrival").collect()
    assert [not r.too_many for r in both] == ok([*range(1, 30), 2, 0])


def test_pages_of_a_crawl_are_read_by_the_index(spark, tmp_path):
    rows = [("http://a.com/1", "old", 1), ("http://a.com/1", "new", 2), ("http://a.com/2", "two", 1)]
    pages.write_pages(spark.createDataFrame(rows, "url string, content string, arrival int"), str(tmp_path))
    pages.write_pages(spark.createDataFrame([("http://a.com/2", "later", 3)], "url string, content string, arrival int"), str(tmp_path))
    got = {r.url: r.content for r in pages.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"http://a.com/1": "new", "http://a.com/2": "later"}


def test_failures_have_their_statuses():
    assert [pages.failure(e) for e in (TimeoutError(), urllib.error.URLError(TimeoutError()), urllib.error.URLError("refused"), ConnectionResetError(), ValueError())] == [602, 602, 601, 601, 603]


def test_fingerprints_meet_by_blocks(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(5)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(prints)], "doc_id long, fingerprint long")
    got = {tuple(r) for r in dedup.near_duplicates(rows).collect()}
    want = {(i, j, bin(x ^ y).count("1")) for i, x in enumerate(prints) for j, y in enumerate(prints[:i]) if x >> 52 == y >> 52 and bin(x ^ y).count("1") <= 3}
    assert got == want and len(want) > 20


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 4], [0, 1, 0, 3, 3]])
def test_documents_are_counted_within_their_rows(spark, ids):
    texts = ["b a b a a", "", None, "One 1 one", "z"]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    tokens = index.body_tokens(docs)
    rows = lambda df: sorted(str(r) for r in df.collect())
    for got, want in [(index.body_postings(docs).drop("length"), index.postings(tokens)), (index.body_counts(docs), index.weighted_counts(tokens))]:
        assert rows(got) == rows(want.select(got.columns)) and ("Exchange" in plan(got)) == (len(set(ids)) < len(ids))
    whole = [(i, t) for i, t in zip(ids, texts) if ids.count(i) == 1]
    whole = spark.createDataFrame(whole, "doc_id long, text string")
    assert rows(index.body_bigrams(whole)) == rows(index.bigrams(index.body_tokens(whole)))
    assert rows(index.counted(index.pair_items(whole), "bigram")) == rows(index.bigrams(index.body_tokens(whole)).groupBy("doc_id", "bigram").agg(F.count("*").alias("n")))


def test_pairs_of_fingerprints_are_dealt_by_rows(spark, monkeypatch):
    """Keys take few bytes, so their partitions must not be sized by these; two blocks must agree, not one."""
    monkeypatch.setattr(dedup, "ROWS_A_PART", 10)
    rows = spark.createDataFrame([(i, i) for i in range(64)], "doc_id long, fingerprint long")
    near = dedup.near_duplicates(rows)
    assert "repartition_by_num" in plan(near).lower() and "(bucket#" in plan(near)
    assert near.count() == sum(bin(i ^ j).count("1") <= 3 for i in range(64) for j in range(i))


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 4, 5], [0, 1, 0, 3, 3, 5]])
def test_fingerprints_are_summed_within_rows(spark, ids):
    """The same as by counted rows, for more terms than are added at once, for none, and for an even split of bits; nothing is shuffled."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(70_000)), "", None, "One 1 one, " * 200, "abc", " ".join(f"w{i}" for i in range(511))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    prints = docs.select("doc_id").join(dedup.simhash(index.weighted_counts(index.body_tokens(docs))), "doc_id", "left").fillna(0, ["fingerprint"])
    got = index.body_fingerprints(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, prints.select("doc_id", "fingerprint").collect()))
    assert ("Exchange" in plan(got)) == (len(set(ids)) < len(ids))


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_pairs_are_expanded_where_they_meet(spark, monkeypatch, broadcast):
    """Copies and hot keys are dealt in pieces, no pair is lost or doubled, and pairs aren't shuffled to meet their documents."""
    monkeypatch.setattr(dedup, "DOCS", 3)
    monkeypatch.setattr(dedup, "LISTS", 4)
    monkeypatch.setattr(dedup, "HOT", broadcast)
    rng = random.Random(6)
    prints = [0] * 20 + [sum(1 << i for i in rng.sample(range(52), rng.randrange(1, 3))) for _ in range(60)] + [-1, -2, -2]
    near = dedup.near_duplicates(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint long"))
    above = plan(near).split("Join [bucket")[0]
    assert "Generate explode" in above and "Exchange" not in above
    want = [(i, j, d) for i, x in enumerate(prints) for j, y in enumerate(prints[:i]) if (d := bin((x ^ y) & (1 << 64) - 1).count("1")) <= 3 and (x ^ y) >> 52 == 0]
    assert sorted(map(tuple, near.collect())) == sorted(want) and len(want) > 300


def test_texts_are_hashed_once_for_both_sides_of_a_join(spark):
    assert "sha1" not in plan(catalog.exact_duplicates(spark, "/root/testdata/sf0.001"))


def test_bodies_alone_need_no_positions(spark):
    """Where the body is the only field, phrases are bigrams: same rows as by positions, which aren't read; nor are token rows shuffled."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c", "b a", "c a a", "", None, "d"])], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b c"), (2, "a a"), (3, "b x a"), (4, "d d")], "query_id int, text string")
    built = index.index_documents(docs)
    fast = search.score(queries, built)
    slow = search.score(queries, dataclasses.replace(built, bodies_only=False))
    rows = lambda df: sorted(str(r) for r in df.collect())
    assert rows(fast) == rows(slow) and fast.filter("phrase_hits > 0").count() == 2
    assert "positions" not in plan(fast) and "Window" not in plan(built.bigrams)


def test_rows_of_one_url_are_scanned_by_page_id(spark):
    rows = spark.createDataFrame([(10, "http://a.com/x", "ten"), (9, "http://a.com/x", "nine")], "page_id long, url string, html string")
    assert [r.content for r in pages.from_table(rows).orderBy("path").collect()] == ["nine", "ten"] and pages.from_table(rows).select("path").distinct().count() == 2


def test_fetched_urls_meet_pages_by_a_column(spark):
    from webrank.sources.pages import table_fetcher

    pages = spark.createDataFrame([("http://a.com/x/", "<p>x"), ("http://a.com/y", None)], "url string, html string")
    got = table_fetcher(pages)(spark.createDataFrame([("http://A.com/x",), ("http://a.com/y",), ("http://a.com/z",)], "url string"))
    assert {(r.url, r.status, bytes(r.body).decode()) for r in got.collect()} == {("http://A.com/x", 200, "<p>x"), ("http://a.com/y", 200, ""), ("http://a.com/z", 404, "")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if ("Join" in x or "Sort [" in x) and "regexp" in x]


@pytest.mark.parametrize("stem", [False, True])
def test_fields_are_counted_within_their_rows(spark, stem):
    """The same postings, counts and bigrams as by token rows, which a task would hold in hash tables and sorts that grow with the table."""
    rows = [(0, "Running dogs", "dog", None, "dogs run the runs dogs run"), (1, "", None, "", None), (2, None, "", "bold b", "b a"), (3, "t", "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, headings string, bold string, body string")
    anchors = index.anchor_terms(spark.createDataFrame([(0, "dogs home"), (0, "dogs"), (1, "way"), (2, ",")], "doc_id long, text string"), stem)
    terms, tokens = index.field_terms(docs, stem), index.field_tokens(docs, stem)
    counts = index.weighted_counts(tokens).union(anchors).groupBy("doc_id", "term").agg(F.sum("weight").alias("weight"))
    rows = lambda df: sorted(str(r) for r in df.collect())
    for got, want in [(index.field_postings(terms), index.postings(tokens)), (index.field_bigrams(terms), index.bigrams(tokens)), (index.field_counts(terms, anchors), counts)]:
        assert rows(got) == rows(want.select(got.columns)) and len(rows(got)) > 3
    assert "Exchange" not in plan(index.field_postings(terms)) + plan(index.field_bigrams(terms))


def test_build_index_makes_no_token_rows_and_parses_once(spark, site, monkeypatch):
    monkeypatch.setattr(index, "field_tokens", None)
    written = {}
    monkeypatch.setattr(index, "materialize", lambda df, name, f=index.materialize: written.setdefault(name, plan(df)) and f(df, name))
    built = index.build_index(read_json(spark, site[0]))
    assert sum(p.count("ArrowEvalPython") for name, p in written.items() if name != "tokens" and name != "weighted-counts") == 1
    assert "ArrowEvalPython" in written["extracted"] and "Exchange" not in written["postings"] + written["extracted"] and built.postings.count() > 60
