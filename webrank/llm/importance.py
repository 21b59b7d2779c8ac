"""Quality classifier by importance resampling: hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrank.llm import ngrams
from webrank.llm.common import kth_largest, labelled_ids, materialize, row_id, row_key

def importance_weights(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, prior: float = 20.0, damping: float = 32.0) -> DataFrame:
    """doc_id, _id, _key (which tell rows apart), n_grams, log_ratio: a row per row of docs."""
    model = ngrams.fit(docs, trusted, buckets, prior)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), row_id().alias("_id"), row_key().alias("_key"))
    rows = ngrams.score(rows, ["doc_id", "_id", "_key"], "_text", model, buckets).fillna(0, ["n_grams"])
    return rows.withColumn("log_ratio", F.col("llr") / (F.col("n_grams") + damping)).drop("llr")


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the key and the seed, so that a rerun draws the same."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def accepted(rows: DataFrame, held: DataFrame, quantile: float) -> int:
    """How many rows(doc_id, log_weight) rejection sampling would be expected to accept.

    A row is accepted with its weight over a bound, or 1 at most.  The bound is the weight that all but
    the share `quantile` of the held-out trusted documents reach; without such documents it is a weight of 1.
    """
    own = rows.select("doc_id", "log_weight").join(F.broadcast(held), "doc_id", "left_semi")
    n = own.count()
    bound = kth_largest(own, "log_weight", max(1, math.ceil(n * (1 - quantile)))) if n else 0.0
    total = rows.agg(F.sum(F.exp(F.least(F.lit(0.0), F.col("log_weight") - F.lit(bound))))).first()[0]
    return round(total or 0)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, length: float = 20.0, quantile: float = 0.01, seed: int = 17, max_labelled: int = 200_000, **model) -> DataFrame:
    """doc_id, _id, _key, n_grams (long), log_ratio, log_weight, gumbel_key (double), kept: a row per row of docs.

    The importance weight of a document is the target's over the raw model's probability of its
    n-grams, tempered to a common length of `length` n-grams, so that long texts don't crowd out short
    ones and the noise, of a standard deviation of 1.3, is not lost beside the weights.  kept marks the
    k largest of log weight + Gumbel noise: a sample without replacement in proportion to the weights,
    another for each seed.

    The target is four fifths of the trusted documents (quality 1; at most max_labelled of them), by a
    hash of doc_id.  Without k, as many are drawn as rejection sampling against the others, which
    the models haven't seen, would accept (see accepted()).

    Nulls: a null text is empty, with log_ratio 0; a null doc_id is carried through.  Rows tied at
    the k-th key (exact repetitions of a row) are all kept.  An empty table gives no rows.
    """
    trusted = labelled_ids(labels, 1, max_labelled).withColumn("_held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0)
    rows = importance_weights(docs, trusted.filter("not _held").select("doc_id"), **model).withColumn("log_weight", F.col("log_ratio") * length)
    rows = materialize(rows.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("_key"), seed)), "importance")
    if k is None:
        k = accepted(rows, trusted.filter("_held").select("doc_id"), quantile)
    least = kth_largest(rows, "gumbel_key", k)
    return rows.withColumn("kept", F.col("gumbel_key") >= F.lit(math.inf if least is None else least))
