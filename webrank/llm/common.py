"""Shared helpers: input tables, tables written in the cluster's shared folder, word expressions.

Conventions kept by every operator of this subpackage:

* a null text is an empty text; rows are never dropped because of a null, a tie or a repetition;
* rows that repeat a ``doc_id`` are kept as rows of their own;
* extra columns of an input are ignored, whatever their names, because an operator first
  selects the columns that it needs.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webrank.sources.scratch import bounded_batches, materialize, new_path  # noqa: F401


#: ASCII white space: the separators of words in all operators here.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What one operator keeps in this Python worker between its tasks, by the operator's name.
_kept: dict[str, object] = {}

#: Bins of a histogram, and values few enough to sort on the driver, in kth_largest().
BINS, FEW = 4096, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it has been counted to at most this many rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def worker_memory(owner: str, make: Callable[[], object] | None = None) -> object:
    """What `owner` keeps in this Python worker, made at its first task here; others' goes first.

    Workers outlive queries, so without this one operator would hold its memory while the next works.
    """
    if owner not in _kept:
        _kept.clear()
        give_back()
        _kept[owner] = make() if make else None
    return _kept[owner]


def give_back() -> None:
    """Return memory that this worker has freed to the system, where the C library and Arrow can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def runs(sizes: Iterable[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of rows whose sizes sum up to about `most`, or of one larger row, which are held together."""
    start = held = end = 0
    for end, size in enumerate(sizes, 1):
        held += size
        if held > most:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z alone.  lower() does just that on ASCII, and is much faster than translate()."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def row_id(doc_id: str = "doc_id") -> Column:
    """doc_id, with a number of its own for nulls, so that rows without an id can be joined."""
    return F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).cast("long")


def row_key(text: str = "text") -> Column:
    """A hash of doc_id and text: with row_id() it tells rows apart that share a doc_id."""
    return F.xxhash64("doc_id", F.coalesce(text, F.lit("")))


def packed(docs: DataFrame) -> DataFrame:
    """_id, _key, _row: every row of docs whole, as a struct, so that no column of its own can clash."""
    return docs.select(row_id().alias("_id"), row_key().alias("_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def keep_rows(docs: DataFrame, decisions: DataFrame, once: bool = False) -> DataFrame:
    """docs without the rows that decisions(_id, _key, kept) reject; a row without a decision stays.

    Decisions are made by doc_id and text together, a null doc_id included, or by doc_id alone if
    they have no _key.  With `once`, rows equal in both leave one; only texts that occur more than
    once are shuffled for it.
    """
    on = [c for c in ("_id", "_key") if c in decisions.columns]
    bad = materialize(decisions.filter("not kept").select(on).distinct(), "rejected")
    rows = packed(docs).join(small(bad, 2_000_000), on, "left_anti")
    if once:
        again = rows.groupBy("_id", "_key").agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_key")
        again = materialize(again, "repeated")
        if again.limit(1).count():
            side = small(again, 2_000_000)
            one = rows.join(side, ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.any_value("_row").alias("_row"))
            rows = rows.join(side, ["_id", "_key"], "left_anti").unionByName(one)
    return rows.select("_row.*")


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a column, exactly, by repeated histograms of at most BINS + 1 bins.

    None if k < 1.  With fewer than k rows it is the smallest.  Only histograms, and in the end at
    most FEW values, come to the driver.
    """
    rows, value = rows.select(key).filter(F.col(key).isNotNull()), F.col(key)
    while k > 0:
        low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
        if not n or k >= n or low == high:
            return low
        if n <= FEW:
            return sorted((r[0] for r in rows.collect()), reverse=True)[k - 1]
        place = F.floor((value - low) * F.lit(BINS / (high - low)))
        for place_, count in sorted(rows.groupBy(place.alias("p")).count().collect(), reverse=True):
            if k <= count:
                rows = rows.filter(place == place_)
                break
            k -= count
    return None


def labelled_ids(labels: DataFrame, quality: int, limit: int) -> DataFrame:
    """Distinct doc_id with this quality; if more than `limit`, those of the smallest hashes, which bounds what is broadcast.

    The cut is found by histogram, so no task and not the driver gets all ids.
    """
    ids = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    if ids.count() <= limit:
        return ids
    ids = materialize(ids.withColumn("_rank", -F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double")), "labelled")
    return ids.filter(F.col("_rank") >= kth_largest(ids, "_rank", limit)).select("doc_id")
