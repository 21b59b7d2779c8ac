"""The index: token rows, postings, dictionary, lengths, bigrams, duplicates, anchors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webrank.config import Settings
from webrank.functions.html import extract_fields
from webrank.functions.text import stem_words, stemmed, tokenize
from webrank.operators import dedup
from webrank.sources.pages import documents
from webrank.sources.scratch import bounded_batches, materialize


@dataclass
class IndexTables:
    doc_table: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    doc_lengths: DataFrame
    stats: DataFrame
    bigrams: DataFrame
    exact_duplicates: DataFrame
    near_duplicates: DataFrame
    links: DataFrame
    summary: DataFrame
    #: Whether the body is the only field, so that a phrase is a bigram; a loaded index doesn't know.
    bodies_only: bool = False

    @classmethod
    def tables(cls) -> list:
        return [f for f in fields(cls) if f.name != "bodies_only"]

    def save(self, folder: str) -> None:
        """One Parquet table each; postings and dictionary are sorted by term, so a term's filter skips row groups."""
        for f in self.tables():
            df = getattr(self, f.name)
            if f.name in ("postings", "dictionary", "bigrams"):
                key = "bigram" if f.name == "bigrams" else "term"
                df = df.repartitionByRange(key).sortWithinPartitions(key)
            df.write.mode("overwrite").parquet(f"{folder}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> IndexTables:
        return cls(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in cls.tables()})


def field_tokens(docs: DataFrame, stem: bool, settings: Settings = Settings()) -> DataFrame:
    """doc_id, term, weight, pos, body_pos: a row per token; positions run on through title, headings, bold and body.

    body_pos counts body tokens alone, and is null elsewhere.
    """

    def placed(name: str, weight: float, offset: Column) -> Column:
        body = F.lit(name == "body")
        return F.transform(f"_{name}", lambda t, i: F.struct(t.alias("term"), F.lit(weight).alias("weight"), (offset + i).alias("pos"), F.when(body, i).alias("body_pos")))

    offset, parts = F.lit(0), []
    rows = docs.withColumns({f"_{name}": tokenize(F.col(name)) for name in settings.weights})
    for name, weight in settings.weights.items():
        parts.append(placed(name, weight, offset))
        offset = offset + F.size(f"_{name}")
    rows = rows.select("doc_id", F.inline(F.concat(*parts)))
    return stemmed(rows) if stem else rows


def field_terms(docs: DataFrame, stem: bool, settings: Settings = Settings()) -> DataFrame:
    """doc_id, terms, ends: field_tokens() as a row per document, and where each field ends among its terms."""
    rows = docs.select("doc_id", *(tokenize(F.col(name)).alias(f"_{name}") for name in settings.weights))
    sizes, names = [F.size(f"_{name}") for name in settings.weights], [f"_{name}" for name in settings.weights]
    ends = [reduce(Column.__add__, sizes[: i + 1]) for i in range(len(sizes))]
    rows = rows.select("doc_id", F.concat(*names).alias("terms"), F.array(*ends).alias("ends"))
    return rows.withColumn("terms", stem_words("terms")) if stem else rows


def field_postings(rows: DataFrame) -> DataFrame:
    """postings() of field_terms(): within their rows, so that no task holds more than a document's terms."""
    return runs(rows).select("doc_id", F.inline(positions())).select("term", "doc_id", F.size("positions").alias("tf"), "positions")


def field_counts(rows: DataFrame, anchors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """weighted_counts() of field_terms() and anchor_terms() together: an anchor's terms come to their document's row as a list of distinct ones."""
    lists = anchors.groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight")).alias("_anchors"))
    ends = [F.get("ends", F.lit(i)) for i in range(len(settings.weights))]
    weight = lambda i: F.coalesce(*(F.when(i < end, w) for end, w in zip(ends, settings.weights.values())))
    own = F.transform("terms", lambda t, i: F.struct(t.alias("term"), weight(i).alias("weight")))
    items = F.concat(own, F.coalesce("_anchors", F.array().cast("array<struct<term:string,weight:double>>")))
    rows = rows.join(lists, "doc_id", "left").select("doc_id", F.sort_array(items).alias("_sorted")).select("*", run_starts("_sorted", lambda x: x["term"]).alias("_starts"))
    total = lambda b, j: F.aggregate(F.slice("_sorted", b + 1, run_ends(j) - b), F.lit(0.0), lambda x, y: x + y["weight"])
    return rows.select("doc_id", F.inline(F.transform("_starts", lambda b, j: F.struct(F.get("_sorted", b)["term"].alias("term"), total(b, j).alias("weight")))))


def field_bigrams(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """bigrams() of field_terms(), within their rows."""
    at = list(settings.weights).index("body")
    before = F.get("ends", F.lit(at - 1)) if at else F.lit(0)
    body = rows.select("doc_id", F.slice("terms", before + 1, F.get("ends", F.lit(at)) - before).alias("_t"))
    return adjacent_terms(body).select("doc_id", F.explode_outer("items").alias("bigram")).filter("bigram is not null")


def body_tokens(docs: DataFrame) -> DataFrame:
    """The token rows of documents(doc_id, text) whose only field is the body."""
    return docs.select("doc_id", F.posexplode(tokenize(F.col("text"))).alias("pos", "term")).select("doc_id", "term", F.lit(1.0).alias("weight"), "pos", F.col("pos").alias("body_pos"))


def whole(docs: DataFrame) -> bool:
    """Whether no two rows share a doc_id, so that all of a document can be counted within its row, without a shuffle."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()


def run_starts(items: str, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """The places in a sorted array where a key begins."""
    new = lambda x, i: F.when((i == 0) | ~key(x).eqNullSafe(key(F.get(items, i - 1))), i)
    return F.array_compact(F.transform(items, new))


def run_ends(j: Column) -> Column:
    return F.coalesce(F.get("_starts", j + 1), F.size("_sorted"))


def runs(rows: DataFrame) -> DataFrame:
    """doc_id, _sorted, _starts: the terms of rows(doc_id, terms) with their places, sorted, and where each term begins."""
    placed = F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    return rows.select("doc_id", F.sort_array(placed).alias("_sorted")).select("*", run_starts("_sorted", lambda x: x["term"]).alias("_starts"))


def positions() -> Column:
    """term, positions of each of runs()."""
    return F.transform("_starts", lambda b, j: F.struct(F.get("_sorted", b)["term"].alias("term"), F.transform(F.slice("_sorted", b + 1, run_ends(j) - b), lambda x: x["pos"]).alias("positions")))


def counted(rows: DataFrame, name: str) -> DataFrame:
    """doc_id, `name`, n: how often rows(doc_id, items) have each item."""
    rows = rows.select("doc_id", F.sort_array("items").alias("_sorted")).select("*", run_starts("_sorted").alias("_starts"))
    return rows.select("doc_id", F.inline(F.transform("_starts", lambda b, j: F.struct(F.get("_sorted", b).alias(name), (run_ends(j) - b).cast("long").alias("n")))))


def body_counts(docs: DataFrame) -> DataFrame:
    """weighted_counts() of documents(doc_id, text): within their rows, unless rows share a doc_id."""
    if not whole(docs):
        return weighted_counts(body_tokens(docs))
    return counted(docs.select("doc_id", tokenize(F.col("text")).alias("items")), "term").select("doc_id", "term", F.col("n").cast("double").alias("weight"))


def body_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of documents(doc_id, text): within their rows, uncounted, unless rows share a doc_id."""
    if not whole(docs):
        return docs.select("doc_id").join(dedup.simhash(weighted_counts(body_tokens(docs))), "doc_id", "left").fillna(0, ["fingerprint"])
    return bounded_batches(docs).select("doc_id", dedup.simhash_of(tokenize(F.col("text"))).alias("fingerprint"))


def body_postings(docs: DataFrame) -> DataFrame:
    """postings() of documents(doc_id, text): within their rows, and with each document's length, unless rows share a doc_id."""
    if not whole(docs):
        return postings(body_tokens(docs))
    rows = runs(docs.select("doc_id", tokenize(F.col("text")).alias("terms")))
    squares = F.transform("_starts", lambda b, j: F.pow(1 + F.log10(run_ends(j) - b), F.lit(2)))
    # a select of its own, or it would be summed again for each row of inline()
    rows = rows.select("*", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda x, y: x + y)).alias("length"))
    return rows.select("doc_id", "length", F.inline(positions())).select("term", "doc_id", F.size("positions").alias("tf"), "positions", "length")


def pair_items(docs: DataFrame) -> DataFrame:
    """doc_id, items: the adjacent pairs of each text of documents(doc_id, text)."""
    return adjacent_terms(docs.select("doc_id", tokenize(F.col("text")).alias("_t")))


def adjacent_terms(rows: DataFrame) -> DataFrame:
    """doc_id, items: the adjacent pairs of rows(doc_id, _t)."""
    return rows.select("doc_id", F.array_compact(F.transform("_t", lambda t, i: F.when(i + 1 < F.size("_t"), F.concat(t, F.lit("_"), F.get("_t", i + 1))))).alias("items"))


def body_bigrams(docs: DataFrame) -> DataFrame:
    """bigrams() of documents(doc_id, text): within their rows, unless rows share a doc_id."""
    if not whole(docs):
        return bigrams(body_tokens(docs))
    # an inner explode would get a filter on the arrays' size below it, in which each pair tokenizes its text again
    return pair_items(docs).select("doc_id", F.explode_outer("items").alias("bigram")).filter("bigram is not null")


def postings(tokens: DataFrame) -> DataFrame:
    rows = tokens.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return rows.select("term", "doc_id", F.size("positions").alias("tf"), "positions")


def dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def weighted_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "term").agg(F.sum("weight").alias("weight"))


def doc_lengths(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, length: the norm of 1 + log10(weighted tf); 0 for a document without terms."""
    length = F.sqrt(F.sum(F.pow(1 + F.log10("weight"), 2)))
    return docs.select("doc_id").join(counts.groupBy("doc_id").agg(length.alias("length")), "doc_id", "left").fillna(0.0, ["length"])


def bigrams(tokens: DataFrame) -> DataFrame:
    """doc_id, bigram: a row per pair of adjacent body tokens."""
    rows = tokens.filter(F.col("body_pos").isNotNull())
    after = F.lead("term").over(Window.partitionBy("doc_id").orderBy("body_pos"))
    return rows.select("doc_id", F.concat_ws("_", "term", after).alias("bigram"), after.alias("after")).filter("after is not null").drop("after")


def anchor_terms(anchors: DataFrame, stem: bool, settings: Settings = Settings()) -> DataFrame:
    """doc_id, term, weight of anchor texts(doc_id, text): they weigh in lengths and fingerprints, but have no positions."""
    terms = tokenize(F.col("text"))
    # an inner explode would get a filter on the arrays' size below it, in which words are stemmed again
    rows = anchors.select("doc_id", F.explode_outer(stem_words(terms) if stem else terms).alias("term")).filter("term is not null")
    return rows.groupBy("doc_id", "term").agg((F.count("*") * settings.anchor_weight).alias("weight"))


def anchors_in_order(links: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, text: anchors of links(rank, target, text) whose page isn't scanned after the target kept(doc_id, rank, url)."""
    sources = links.select(F.col("rank").alias("from"), F.col("target").alias("url"), "text")
    return sources.join(kept, "url").filter(F.col("from") <= F.col("rank")).select("doc_id", "text")


def orphans(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Distinct targets with an anchor that no kept page has taken: pages that aren't kept, or anchors that came later."""
    rows = links.select(F.col("rank").alias("from"), F.col("target").alias("url")).join(kept.select("url", "rank"), "url", "left")
    return rows.filter(F.col("rank").isNull() | (F.col("from") > F.col("rank"))).select("url").distinct()


def build_index(pages: DataFrame, stem: bool = True, settings: Settings = Settings()) -> IndexTables:
    """All index tables of pages(path, url, content), scanned in the order of paths.

    Parsing is the costly step, so its result is written before ranges of paths are sampled, and only
    what keep-first needs is sorted and joined before the texts meet their ids.  Terms are counted and
    placed within a document's row.  Pages that repeat a kept page's URL are skipped; those that repeat
    its content are logged and still give their anchors.
    """
    rows = bounded_batches(documents(pages)).filter("url <> ''").withColumn("f", extract_fields("url", "html"))
    rows = rows.select("path", "url", "f.title", "f.headings", "f.bold", "f.body", "f.links")
    text = dedup.exact_text(F.col("title"), F.col("headings"), F.col("bold"), F.col("body"))
    rows = materialize(rows.withColumns({"hash": F.sha1(text), "row": F.monotonically_increasing_id()}), "extracted")
    ranks = materialize(dedup.dense_ids(rows.select("row", "path", "url", "hash"), "path", "rank"), "ranks")
    state = materialize(dedup.keep_first(ranks.select("rank", "url", "hash")), "kept")
    kept = dedup.dense_ids(state.filter("state = 'kept'").select("rank", "url"), "rank", "doc_id")
    kept = materialize(kept, "doc-table")
    ids = ranks.select("row", "rank").join(state.select("rank", "state"), "rank").join(kept.select("rank", "doc_id"), "rank", "left")
    parsed = materialize(rows.drop("path", "hash").join(ids, "row"), "parsed")
    tokens = materialize(field_terms(parsed.filter("doc_id is not null"), stem, settings), "tokens")

    links = parsed.select("rank", "url", "state", F.posexplode("links").alias("i", "l")).select("rank", "url", "state", "i", "l.target", "l.text")
    links = materialize(links, "links")
    usable = links.filter("state <> 'url'")
    anchors = anchors_in_order(usable, kept)
    counts = materialize(field_counts(tokens, anchor_terms(anchors, stem, settings), settings), "weighted-counts")
    prints = kept.select("doc_id").join(dedup.simhash(counts), "doc_id", "left").fillna(0, ["fingerprint"])
    near = dedup.near_duplicates(prints, settings)
    names = kept.select("doc_id", "url")
    near = near.join(names, "doc_id").join(names.toDF("prior_doc_id", "prior_url"), "prior_doc_id")
    exact = state.filter("state = 'hash'").join(kept.select(F.col("rank").alias("kept_rank"), F.col("doc_id").alias("kept_doc_id"), F.col("url").alias("kept_url")), "kept_rank")
    post = materialize(field_postings(tokens), "postings")
    stats = kept.agg(F.lit("total_docs").alias("key"), F.count("*").alias("value"))
    summary = stats.union(post.agg(F.lit("postings"), F.count("*"))).union(orphans(usable, kept).agg(F.lit("orphan_anchor_targets"), F.count("*")))
    terms = dictionary(post)
    summary = summary.union(terms.agg(F.lit("distinct_terms"), F.count("*")))
    return IndexTables(
        names, post, terms, doc_lengths(names, counts), stats, field_bigrams(tokens, settings), exact.select("url", "kept_doc_id", "kept_url"),
        near.select("doc_id", "url", "prior_doc_id", "prior_url", "distance"), links.select(F.col("url").alias("source"), "target", "text"), summary,
    )


def index_documents(docs: DataFrame, ranks: DataFrame | None = None) -> IndexTables:
    """The index of plain documents(doc_id, text) as bodies, every document kept, by the plain analyzer."""
    post = materialize(body_postings(docs), "postings")
    counts = post.select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
    names = docs.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"))
    none = docs.sparkSession.createDataFrame
    stats = docs.agg(F.lit("total_docs").alias("key"), F.count("*").alias("value"))
    return IndexTables(
        names, post, dictionary(post), doc_lengths(docs, counts), stats, body_bigrams(docs), none([], "url string, kept_doc_id long, kept_url string"),
        none([], "doc_id long, url string, prior_doc_id long, prior_url string, distance int"), none([], "source string, target string, text string"), stats, bodies_only=True,
    )


def size_report(spark: SparkSession, folder: str) -> DataFrame:
    """table, files, bytes of a saved index, as the file system lists them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(name.alias("table")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def merge_postings(parts: DataFrame) -> DataFrame:
    """Partial postings merged: the positions of a term and document in all parts, in order."""
    rows = parts.groupBy("term", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return rows.select("term", "doc_id", F.size("positions").alias("tf"), "positions")
