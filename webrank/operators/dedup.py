"""Exact and near duplicates, and the keep-first rule of the index."""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha1
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrank.config import Settings
from webrank.functions.text import REMEMBERED, collapse
from webrank.sources.scratch import materialize


def exact_text(title: Column, headings: Column, bold: Column, body: Column) -> Column:
    """The text that makes two pages equal: all fields, lower-cased, white space collapsed."""
    return collapse(F.lower(F.concat_ws(" ", title, headings, bold, body)))


def keep_first(pages: DataFrame) -> DataFrame:
    """rank, url, hash, state ('kept', 'url' or 'hash') and kept_rank, for pages(rank, url, hash).

    In the order of ranks, a page is kept unless an earlier kept page has its URL or its hash.  The
    same set is reached in rounds: pages that are first of both their URL and their hash among the
    undecided are kept, pages that share either with them are decided, and the rest goes on.
    """
    undecided, kept = materialize(pages.select("rank", "url", "hash"), "keep-first"), None
    while undecided.limit(1).count():
        by_url = undecided.groupBy("url").agg(F.min("rank").alias("u"))
        by_hash = undecided.groupBy("hash").agg(F.min("rank").alias("h"))
        first = undecided.join(by_url, "url").join(by_hash, "hash").filter("rank = u and rank = h").select("rank", "url", "hash")
        first = materialize(first, "keep-first-kept")
        kept = first if kept is None else kept.unionByName(first)
        left = undecided.join(first.select("url"), "url", "left_anti").join(first.select("hash"), "hash", "left_anti")
        undecided = materialize(left, "keep-first")
    if kept is None:
        return pages.select("rank", "url", "hash", F.lit("kept").alias("state"), F.col("rank").alias("kept_rank"))
    urls, hashes = kept.select("url", F.col("rank").alias("u")), kept.select("hash", F.col("rank").alias("h"))
    rows = pages.select("rank", "url", "hash").join(urls, "url", "left").join(hashes, "hash", "left")
    state = F.when(F.col("rank") == F.col("u"), "kept").when(F.col("u") < F.col("rank"), "url").otherwise("hash")
    rows = rows.withColumn("state", state)
    return rows.select("rank", "url", "hash", "state", F.when(F.col("state") == "hash", F.col("h")).otherwise(F.col("u")).alias("kept_rank"))


def token_hash(term: Column) -> Column:
    """The low 64 bits of a term's SHA-1."""
    digest = F.sha1(term)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(25), 32).bitwiseOR(half(33))


def simhash(terms: DataFrame) -> DataFrame:
    """doc_id, fingerprint for terms(doc_id, term, weight), a row per document and term.

    One hash aggregation with a signed sum a bit; a bit is set if its sum is above 0.
    """
    rows = terms.select("doc_id", token_hash(F.col("term")).alias("h"), "weight")
    sums = [F.sum(F.when(F.getbit("h", F.lit(i)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{i}") for i in range(64)]
    bits = [F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    value = bits[0]
    for bit in bits[1:]:
        value = value.bitwiseOR(bit)
    return rows.groupBy("doc_id").agg(*sums).select("doc_id", value.alias("fingerprint"))


@lru_cache(REMEMBERED)
def remembered_hash(term: str) -> int:
    """token_hash(), in Python."""
    return int.from_bytes(sha1(term.encode()).digest()[-8:], "big")


#: Terms whose bits, a byte each, add up without a carry, and blocks of them that are added at once.
BLOCK, BLOCKS = 255, 256


@F.arrow_udf(T.LongType())
def simhash_of(terms: pa.Array) -> pa.Array:
    """simhash() of arrays of terms, each occurrence of weight 1: a bit is set if over half of an array's hashes have it; 0 for no terms."""
    offsets = terms.offsets.to_numpy().astype(np.int64)
    offsets, coded = offsets - offsets[0], terms.flatten().dictionary_encode()
    hashes = np.fromiter(map(remembered_hash, coded.dictionary.to_pylist()), ">u8", len(coded.dictionary))
    bits, codes = np.unpackbits(hashes.view(np.uint8)).view(np.uint64).reshape(-1, 8), coded.indices.to_numpy()
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    starts = np.append(np.repeat(offsets[:-1] - BLOCK * first, blocks) + BLOCK * np.arange(blocks.sum()), offsets[-1])
    sums = np.zeros((len(starts) - 1, 8), np.uint64)
    for at in range(0, len(sums), BLOCKS):
        own = starts[at : at + BLOCKS + 1]
        sums[at : at + BLOCKS] = np.add.reduceat(bits[codes[own[0] : own[-1]]], own[:-1] - own[0], axis=0)
    out, some = np.zeros(len(sizes), np.int64), sizes > 0
    if some.any():
        ones = np.add.reduceat(sums.view(np.uint8), first[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > sizes[some, None], axis=1).view(">i8")[:, 0]
    return pa.array(out)


def unsigned(fingerprint: Column) -> Column:
    return F.conv(F.hex(fingerprint), 16, 10)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bucket(fingerprint: Column, bits: int = 12) -> Column:
    return F.shiftrightunsigned(fingerprint, 64 - bits)


def near_duplicates(fingerprints: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, prior_doc_id, distance of documents of one bucket that differ in few bits.

    Equal fingerprints are compared once, as lists of at most DOCS documents, which their keys carry:
    pairs are expanded where they meet, and not shuffled.  The bits outside the bucket are cut into two
    blocks more than bits may differ, so two fingerprints within the distance agree in two blocks: pairs
    meet by bucket and two blocks, and a pair is taken at the first two in which it agrees.  Lists of a
    key with more than LISTS are dealt into slots, and two slots meet in a cell of their own.  Keys take
    few bytes for the pairs they make, so their partitions are set by rows.
    """
    docs = fingerprints.groupBy("fingerprint").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("docs") - 1) / DOCS).cast("int")), lambda k: F.slice("docs", k * DOCS + 1, DOCS))
    lists = materialize(docs.select("fingerprint", F.posexplode(pieces).alias("piece", "docs")), "fingerprints")  # read three times
    free, blocks = 64 - settings.bucket_bits, settings.hamming + 2
    ends = [free * i // blocks for i in range(blocks + 1)]
    masks = [((1 << ends[i + 1]) - (1 << ends[i])) | ((1 << ends[j + 1]) - (1 << ends[j])) for i, j in combinations(range(blocks), 2)]
    part = lambda f, mask: f.bitwiseAND(F.lit(mask))
    parts = 1 + min(lists.count() // ROWS_A_PART, 4000)
    key = ["bucket", "i", "block"]
    keyed = lists.select("*", bucket(F.col("fingerprint"), settings.bucket_bits).alias("bucket"), F.posexplode(F.array(*(part(F.col("fingerprint"), m) for m in masks))).alias("i", "block"))
    hot = materialize(keyed.groupBy(key).agg((1 + F.floor(F.count("*") / LISTS)).alias("slots")).filter("slots > 1"), "hot-keys")
    keyed = keyed.join(F.broadcast(hot) if hot.count() <= HOT else hot, key, "left").fillna(1, ["slots"])
    keyed = keyed.withColumn("slot", F.pmod(F.xxhash64("fingerprint", "piece"), F.col("slots")))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), lambda u: F.struct(F.least("slot", u).alias("x"), F.greatest("slot", u).alias("y")))
    keyed = keyed.select(*key, "fingerprint", "piece", "docs", "slot", F.inline(cells)).repartition(parts, *key, "x", "y")
    names = ["fingerprint", "piece", "docs", "slot"]
    a, b = (keyed.withColumnsRenamed({name: f"{side}_{name}" for name in names}) for side in "ab")
    differ = F.col("a_fingerprint").bitwiseXOR(F.col("b_fingerprint"))
    first = F.coalesce(*(F.when(part(differ, m) == 0, F.lit(i)) for i, m in enumerate(masks)))
    ordered = F.expr("a_fingerprint < b_fingerprint or (a_fingerprint = b_fingerprint and a_piece <= b_piece)")
    pairs = a.join(b, [*key, "x", "y"]).filter(ordered & F.expr("x = y or a_slot <> b_slot"))
    pairs = pairs.withColumn("distance", hamming(F.col("a_fingerprint"), F.col("b_fingerprint"))).filter((F.col("distance") <= settings.hamming) & (first == F.col("i")))
    pairs = pairs.select("distance", "b_docs", F.expr("a_fingerprint = b_fingerprint and a_piece = b_piece").alias("same"), F.explode("a_docs").alias("a"))
    pairs = pairs.select("distance", "same", "a", F.explode("b_docs").alias("b")).filter("not same or a < b")
    return pairs.select(F.greatest("a", "b").alias("doc_id"), F.least("a", "b").alias("prior_doc_id"), F.col("distance").cast("int").alias("distance"))


#: Lists of documents whose keys are compared in one task, documents of a list, lists of a key that are compared at once.
ROWS_A_PART, DOCS, LISTS = 2000, 256, 1000
#: Keys of more lists, up to which they are broadcast.
HOT = 100_000


def dense_ids(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with dense ids from 0 in the order of a column: sorted by ranges, then shifted by the sizes of the ranges before."""
    parts = rows.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    parts = materialize(parts, "dense-ids")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_shift", before - F.col("_low")).select("_part", "_shift")  # a row a partition
    return parts.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
