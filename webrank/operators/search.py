"""Batches of ranked free-text queries over an index."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrank.config import Settings
from webrank.functions.text import stemmed, tokenize
from webrank.operators.index import IndexTables
from webrank.sources.scratch import materialize


def phrase(p1: Column, p2: Column) -> Column:
    """Whether a position of the first list is followed by one of the second."""
    return F.arrays_overlap(F.transform(p1, lambda x: x + 1), p2)


def query_terms(queries: DataFrame, stem: bool) -> DataFrame:
    """query_id, pos, term for queries(query_id, text)."""
    rows = queries.select("query_id", F.posexplode(tokenize(F.col("text"))).alias("pos", "term"))
    return stemmed(rows) if stem else rows


def adjacent(terms: DataFrame) -> DataFrame:
    """query_id, t1, t2, times: adjacent pairs of all query tokens, known or not."""
    after = F.lead("term").over(Window.partitionBy("query_id").orderBy("pos"))
    return terms.select("query_id", F.col("term").alias("t1"), after.alias("t2")).filter("t2 is not null").groupBy("query_id", "t1", "t2").agg(F.count("*").alias("times"))


def weights(terms: DataFrame, index: IndexTables) -> DataFrame:
    """query_id, term, weight, term_rank: (1 + log10 qtf) * log10(N / df) of the terms that the index has.

    term_rank orders a query's terms by idf, then by first appearance; it breaks ties of documents.
    """
    total = index.stats.filter("key = 'total_docs'").select(F.col("value").alias("total"))
    rows = terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"), F.min("pos").alias("first"))
    rows = rows.join(index.dictionary, "term").filter("df > 0").join(F.broadcast(total))  # one row
    idf = F.log10(F.col("total") / F.col("df"))
    order = Window.partitionBy("query_id").orderBy(F.desc("idf"), "first")
    return rows.withColumn("idf", idf).select("query_id", "term", ((1 + F.log10("qtf")) * F.col("idf")).alias("weight"), F.row_number().over(order).alias("term_rank"))


def phrases(index: IndexTables, known: DataFrame, pairs: DataFrame, side: Callable[[DataFrame, bool], DataFrame], few: bool) -> DataFrame:
    """query_id, doc_id, times: a row per pair of known query terms that stand side by side in a document."""
    both = pairs.join(known.select("query_id", F.col("term").alias("t1")), ["query_id", "t1"], "left_semi").join(known.select("query_id", F.col("term").alias("t2")), ["query_id", "t2"], "left_semi")
    both = both.groupBy("t1", "t2").agg(F.collect_list(F.struct("query_id", "times")).alias("asked"))
    met = both.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    places = materialize(index.postings.select("term", "doc_id", "positions").join(side(met, few), "term", "left_semi"), "query-places")
    a, b = places.toDF("t1", "doc_id", "p1"), places.toDF("t2", "doc_id", "p2")
    runs = a.join(side(both, few), "t1").join(b, ["t2", "doc_id"]).filter(phrase(F.col("p1"), F.col("p2")))
    return runs.select("doc_id", F.inline("asked"))


#: Query terms, or pairs of them, up to which the index is filtered by a broadcast table.
FEW = 1_000_000


def score(queries: DataFrame, index: IndexTables, ranks: DataFrame | None = None, stem: bool = False, settings: Settings = Settings()) -> DataFrame:
    """query_id, doc_id, tfidf, matched, bigram_hits, phrase_hits, rank, score, first_term: all documents with a known term.

    The queries' own tables are written and counted: as long as they have FEW rows they are broadcast,
    so that postings and bigrams are filtered where they are read and only what queries meet is
    shuffled.  Positions are read for the terms of adjacent pairs alone, and not at all where bodies
    are the only field: their bigrams are the pairs of positions.
    """
    terms = materialize(query_terms(queries, stem), "query-terms")
    known = materialize(weights(terms, index), "query-weights")
    pairs = materialize(adjacent(terms), "query-pairs")
    few_terms, few_pairs = known.count() <= FEW, pairs.count() <= FEW
    side = lambda df, few: F.broadcast(df) if few else df
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    own = "length" in index.postings.columns  # else a join brings it, for which all rows are shuffled again
    hits = index.postings.select("term", "doc_id", "tf", F.col("length") if own else F.lit(None).cast("double").alias("length")).join(side(known, few_terms), "term")
    hits = hits.select("query_id", "doc_id", ((1 + F.log10("tf")) * F.col("weight")).alias("dot"), "term_rank", zero.alias("bigram"), zero.alias("phrase"), "length")
    named = pairs.withColumn("bigram", F.concat_ws("_", "t1", "t2"))
    grams = index.bigrams.select("bigram", "doc_id").join(side(named.select("bigram").distinct(), few_pairs), "bigram", "left_semi").distinct()
    grams = grams.join(side(named, few_pairs), "bigram")
    parts = [hits, grams.select("query_id", "doc_id", F.lit(None).cast("double"), none, "times", F.col("times") if index.bodies_only else zero, F.lit(None).cast("double"))]
    if not index.bodies_only:
        parts.append(phrases(index, known, pairs, side, few_pairs).select("query_id", "doc_id", F.lit(None).cast("double"), none, zero, "times", F.lit(None).cast("double")))
    # one aggregation brings hits, bigrams and phrases together; what queries and documents share is summed before the shuffle
    rows = reduce(DataFrame.union, parts).groupBy("query_id", "doc_id").agg(
        F.sum("dot").alias("dot"), F.count("dot").alias("matched"), F.min("term_rank").alias("first_term"), F.sum("bigram").alias("bigram_hits"), F.sum("phrase").alias("phrase_hits"), F.max("length").alias("length")
    ).filter("matched > 0")
    rows = rows if own else rows.drop("length").join(index.doc_lengths, "doc_id", "left")
    if ranks is None:
        rows = rows.withColumn("rank", F.lit(0.0))
    else:
        rows = rows.join(ranks.select("doc_id", F.col("score").alias("rank")), "doc_id", "left").fillna(0.0, ["rank"])
    rows = rows.fillna(1.0, ["length"])
    tfidf = F.when(F.col("length") > 0, F.col("dot") / F.col("length")).otherwise(F.col("dot"))
    rows = rows.withColumn("tfidf", tfidf)
    total = F.col("tfidf") + settings.coverage * F.col("matched") + settings.bigram_bonus * F.col("bigram_hits") + settings.phrase_bonus * F.col("phrase_hits") + settings.rank_weight * F.col("rank")
    return rows.select("query_id", "doc_id", "tfidf", "matched", "bigram_hits", "phrase_hits", "rank", total.alias("score"), "first_term")


def search(queries: DataFrame, index: IndexTables, ranks: DataFrame | None = None, k: int = 15, stem: bool = False, settings: Settings = Settings(), digits: int | None = None) -> DataFrame:
    """query_id, place, doc_id, url, score: the k best documents of each query.

    Ties go to the document that the rarest term reaches first, then to the smaller doc_id.  A
    document without a URL takes its place but isn't returned.  With `digits` scores are compared
    after rounding, so that the order doesn't depend on the order of additions.
    """
    rows = score(queries, index, ranks, stem, settings)
    key = F.round("score", digits) if digits is not None else F.col("score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(key), "first_term", "doc_id"))
    top = rows.withColumn("place", place).filter(F.col("place") <= k)
    return top.join(index.doc_table, "doc_id", "left").filter(F.coalesce("url", F.lit("")) != "").select("query_id", "place", "doc_id", "url", key.alias("score"))


def search_one(text: str, index: IndexTables, ranks: DataFrame | None = None, k: int = 15, stem: bool = True) -> list[str]:
    spark = index.postings.sparkSession
    rows = search(spark.createDataFrame([(0, text)], "query_id int, text string"), index, ranks, k, stem)
    return [r.url for r in rows.orderBy("place").collect()]  # at most k
