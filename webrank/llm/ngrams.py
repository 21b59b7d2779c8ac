"""Hashed uni- and bigram multinomials of a trusted target and of the raw corpus (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrank.llm.common import materialize

#: Runs of letters and digits, and runs of anything else but white space.
TOKENS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


def with_pairs(rows: DataFrame, text: str) -> DataFrame:
    """Explode each row's token pairs to columns a, b; a row without a token stays once, with nulls."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(TOKENS), F.lit(0))
    rows = rows.withColumn("_a", tokens).withColumn("_b", F.slice("_a", 2, F.greatest(F.size("_a"), F.lit(1))))
    rows = rows.withColumn("_ab", F.explode_outer(F.arrays_zip("_a", "_b")))
    return rows.withColumns({"a": F.col("_ab._a"), "b": F.col("_ab._b")}).drop("_a", "_b", "_ab", text)


def buckets(n: int) -> tuple[Column, Column]:
    """Buckets of the unigram a and of the bigram a b.  Bigrams that repeat one token share one reserved bucket, n."""
    single = F.pmod(F.xxhash64("a"), F.lit(n)).cast("int")
    double = F.when(F.col("a") == F.col("b"), F.lit(n)).otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(n)).cast("int"))
    return single, double


def fit(docs: DataFrame, trusted: DataFrame, n: int, prior: float) -> DataFrame:
    """(bucket, llr) for all n + 1 buckets: log of target over raw probability.

    The raw model counts every document.  The target counts the trusted ones, distinct doc_id of a
    bounded number.  Each bucket of the target gets `prior` pseudo-counts and
    of the raw model as many for the sizes' ratio, so a bucket with few counts has a ratio near 0 and,
    without labels, all have.
    """
    trusted = F.broadcast(trusted).withColumn("_trusted", F.lit(1))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = with_pairs(rows.join(trusted, "doc_id", "left").drop("doc_id"), "_text").filter(F.col("a").isNotNull())
    single, double = buckets(n)
    rows = rows.select(F.explode(F.array(single, double)).alias("bucket"), "_trusted")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
    counts = materialize(counts, "ngram-counts")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    every = docs.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("bucket"))
    every = every.join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    share = float(total[1]) / float(total[0] or 1)
    return every.select("bucket", F.log((F.col("target") + prior) / (F.col("raw") * share + prior)).alias("llr"))


def score(rows: DataFrame, keep: list[str], text: str, model: DataFrame, n: int) -> DataFrame:
    """rows' columns `keep`, n_grams and llr (the sum over a text's uni- and bigrams), a row each.

    The model has n + 1 rows, so it is broadcast; each text's sum is made within the task that read it.
    """
    single, double = buckets(n)
    rows = rows.select(*keep, text).withColumn("_row", F.monotonically_increasing_id())
    rows = with_pairs(rows, text).select(*keep, "_row", single.alias("_s"), double.alias("_d"), F.col("a").isNotNull().cast("int").alias("_n"))
    for key, value in (("_s", "_ls"), ("_d", "_ld")):
        side = F.broadcast(model.select(F.col("bucket").alias(key), F.col("llr").alias(value)))
        rows = rows.join(side, key, "left")
    total = F.sum(F.when(F.col("_n") == 1, F.col("_ls") + F.col("_ld")))
    out = rows.groupBy("_row", *keep).agg((2 * F.sum("_n")).alias("n_grams"), F.coalesce(total, F.lit(0.0)).alias("llr"))
    return out.drop("_row")
