"""Quality rules: surface rules and a hashed n-gram log-likelihood ratio.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrank.llm import ngrams
from webrank.llm.common import SPACE, labelled_ids, words

WINDOW = 8


def surface(docs: DataFrame) -> DataFrame:
    """doc_id, _text and the surface counts of every row.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (words inside 8-word windows that
    occur twice or more in the text).  A null or empty text has zeros.  All work is done within the row:
    windows are compared by 64-bit hash, sorted, in n log n steps, so long texts need no shuffle.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumns({"_w": words(F.col("_text")), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))})
    rows = rows.withColumns({"_n": F.size("_w"), "_h": F.transform("_w", lambda x: F.xxhash64(x))})
    window = F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(F.slice("_h", i + 1, WINDOW)))
    rows = rows.withColumn("_win", F.when(F.col("_n") > WINDOW, window))
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    rows = rows.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get("_sorted", i - 1)["h"], F.get("_sorted", i + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    rows = rows.withColumn("_pos", F.sort_array(F.transform(F.filter("_sorted", twice), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_pos", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return rows.select(
        "doc_id",
        "_text",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, prior: float = 20.0, threshold: float = -0.1, damping: float = 32.0, max_labelled: int = 200_000) -> DataFrame:
    """One row per row of docs: the surface counts, base_failed, llr_score and kept.

    llr_score is the sum of log(target / raw) over the text's hashed uni- and bigrams, divided by
    their number plus `damping`; kept is llr_score >= threshold and not base_failed, the same for
    every run over the same tables.  The target multinomial comes from at most `max_labelled`
    documents of quality 1; the raw one from every document.

    Nulls: a null text counts as empty (score 0, base_failed); a null doc_id is carried through.
    Without labels every score is 0.  Repeated rows get a row each; empty tables give none.
    """
    model = ngrams.fit(docs, labelled_ids(labels, 1, max_labelled), buckets, prior)
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = ngrams.score(surface(docs), counts, "_text", model, buckets)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("llr_score", F.col("llr") / (F.coalesce("n_grams", F.lit(0)) + damping)).withColumn("base_failed", failed)
    return rows.select(*counts, "base_failed", "llr_score", (~F.col("base_failed") & (F.col("llr_score") >= threshold)).alias("kept"))
