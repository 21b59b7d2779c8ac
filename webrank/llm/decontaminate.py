"""Benchmark decontamination by a distributed positional inverted index.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrank.llm.common import lower_az, materialize, row_id, row_key, small

#: Words of a window, and places by which the words of a proximity match may be off.
SIZE, SLOP = 13, 2
#: Bounds on the tables that are broadcast; beyond them the same joins shuffle.
TERMS, CANDIDATES = 500_000, 500_000


def item_words(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased; none for a null."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _key, _text: _id and _key tell texts apart."""
    return docs.select("doc_id", row_id().alias("_id"), row_key().alias("_key"), F.col("text").alias("_text"))


def windows(benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Phrases (wid, win: the words of a window) and their owners (wid, item_id), both stored.

    A window is `size` consecutive words of an item, or all words of a shorter one.
    """
    rows = benchmark.select("item_id", item_words(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)))
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("win"))
    rows = materialize(rows.distinct(), "bench-windows")
    phrases = materialize(rows.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "bench-phrases")
    return phrases, materialize(rows.join(phrases, "win").select("wid", "item_id"), "bench-owners")


def tokens(rows: DataFrame) -> DataFrame:
    """_id, _key, pos, word, term (the word's hash): a row per word of keyed() rows."""
    rows = rows.select("_id", "_key", F.posexplode(item_words(F.col("_text"))).alias("pos", "word"))
    return rows.withColumn("term", F.xxhash64("word"))


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and cf, its number of occurrences in all documents, for terms that occur."""
    rows = keyed(docs).select(F.explode(item_words(F.col("_text"))).alias("word")).select(F.xxhash64("word").alias("term"))
    return materialize(rows.join(small(terms, TERMS), "term", "left_semi").groupBy("term").agg(F.count("*").alias("cf")), "bench-frequencies")


def anchors(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """wid, n (words), t1, o1, t2, o2: a phrase's two rarest terms and their offsets; t2 is null in one-word phrases.

    A phrase with a term that no document has is left out.
    """
    cf = frequencies(docs, terms.select("term").distinct())
    order = Window.partitionBy("wid").orderBy("cf", "off")
    ranked = terms.join(cf, "term").withColumn("rank", F.row_number().over(order))
    of = lambda name, rank: F.max(F.when(F.col("rank") == rank, F.col(name)))
    rows = ranked.groupBy("wid").agg(F.max("n").alias("n"), F.max("rank").alias("there"), of("term", 1).alias("t1"), of("off", 1).alias("o1"), of("term", 2).alias("t2"), of("off", 2).alias("o2"))
    return materialize(rows.filter("there = n").drop("there"), "bench-anchors")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, _id, _key, pos: the positional index of the documents for these terms, stored in the shared folder."""
    rows = tokens(keyed(docs)).select("term", "_id", "_key", "pos")
    return materialize(rows.join(small(terms, TERMS), "term", "left_semi"), "bench-postings")


def near(rows: DataFrame, other: DataFrame, on: list[str], slop: int) -> DataFrame:
    """The pairs of rows(want, ...) and other(pos, ...) that agree in `on` and lie within `slop` places.

    Places are cut into cells of 2 * slop + 1: what a row wants lies in two cells at most, so both
    sides meet by equality and no pair is made twice.
    """
    width = 2 * slop + 1
    cell = lambda at: F.floor(at / width)
    rows = rows.withColumn("cell", F.explode(F.sequence(cell(F.col("want") - slop), cell(F.col("want") + slop))))
    return rows.join(other.withColumn("cell", cell(F.col("pos"))), [*on, "cell"]).filter(F.abs(F.col("pos") - F.col("want")) <= slop)


def aligned(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """_id, _key, wid, n, start: where the lists of a phrase's two rarest terms, less their offsets, meet within `slop`.

    `start` is the first word's place by the rarest term.
    """
    one = index.join(small(phrases.withColumnRenamed("t1", "term"), TERMS), "term")
    one = one.select("_id", "_key", "wid", "n", (F.col("pos") - F.col("o1")).alias("start"), "t2", (F.col("pos") - F.col("o1") + F.col("o2")).alias("want"))
    columns = ["_id", "_key", "wid", "n", "start"]
    both = near(one.filter("t2 is not null"), index.withColumnRenamed("term", "t2"), ["t2", "_id", "_key"], slop)
    return both.select(columns).union(one.filter("t2 is null").select(columns)).distinct()


def phrase_matches(docs: DataFrame, phrases: DataFrame, slop: int = SLOP) -> DataFrame:
    """_id, _key, wid, n, start, exact: every match of phrases(wid, win) in the documents' words.

    The lists of the two rarest terms give candidates.  Those of all terms are then read for the
    documents that have candidates, and intersected with them word by word.  A match has every word of
    the phrase within `slop` places of where the rarest term puts it; it is exact if all are in place.
    """
    rows = phrases.select("wid", F.size("win").alias("n"), F.posexplode("win").alias("off", "word"))
    terms = materialize(rows.withColumn("term", F.xxhash64("word")), "bench-terms")
    found = anchors(terms, docs)
    rarest = found.select(F.explode(F.array("t1", "t2")).alias("term")).filter("term is not null").distinct()
    candidates = materialize(aligned(postings(docs, rarest), found, slop), "bench-candidates")
    texts = small(candidates.select("_id", "_key").distinct(), CANDIDATES)
    index = tokens(keyed(docs).join(texts, ["_id", "_key"], "left_semi"))
    index = index.join(small(terms.select("term").distinct(), TERMS), "term", "left_semi").select("_id", "_key", "word", "pos")
    want = candidates.join(small(terms.select("wid", "off", "word"), TERMS), "wid").withColumn("want", F.col("start") + F.col("off"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("off"))
    rows = near(want, index, ["_id", "_key", "word"], slop).groupBy("_id", "_key", "wid", "n", "start")
    rows = rows.agg(F.bit_or(bit).alias("near"), F.bit_or(F.when(F.col("pos") == F.col("want"), bit).otherwise(F.lit(0).cast("long"))).alias("there"))
    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1
    rows = rows.filter(F.col("near") == every).select("_id", "_key", "wid", "n", "start", (F.col("there") == every).alias("exact"))
    return materialize(rows, "bench-matches")


def marked(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: int = 20, slop: int = SLOP) -> DataFrame:
    """What decontaminate() returns, with _id and _key, which tell rows apart."""
    if not 1 <= size <= 60:
        raise ValueError("a window has 1 to 60 words")
    phrases, owners = windows(benchmark, size)
    matches = phrase_matches(docs, phrases, slop)
    hits = matches.filter("exact")
    before = Window.partitionBy("_id", "_key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    counts = hits.withColumn("new", new).groupBy("_id", "_key").agg(F.sum("new").alias("n_hit"))
    by_window = matches.groupBy("_id", "_key", "wid").agg(F.max("exact").alias("exact"))
    near_only = by_window.filter("not exact").groupBy("_id", "_key").agg(F.count("*").alias("n_near"))
    items = by_window.filter("exact").join(small(owners, TERMS), "wid")
    items = items.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_text = materialize(counts.join(items, ["_id", "_key"], "left").join(near_only, ["_id", "_key"], "full"), "bench-hits")
    rows = keyed(docs).select("doc_id", "_id", "_key", F.size(item_words(F.col("_text"))).cast("long").alias("n_words"))
    rows = rows.join(small(per_text, 200_000), ["_id", "_key"], "left").fillna(0, ["n_hit", "n_near"])
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "_id", "_key", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest, bad.alias("contaminated"), F.col("n_near").cast("long").alias("n_near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near: a row per row of docs.

    n_hit counts the words inside any exact occurrence of a window of the benchmark, overlaps once; a
    document is contaminated if they are one in `share` of its words or more.  n_near counts the
    windows that it holds in proximity only: all words, each within `slop` places of its own, but not
    the phrase.

    Nulls: a null text has no words; items with a null text or no words have no windows; a null
    item_id hits but isn't listed; a null doc_id is carried through.  Repeated rows get a row each.
    An empty benchmark leaves every document clean; an empty table gives no rows.
    """
    return marked(docs, benchmark, **options).drop("_id", "_key")
