"""Near duplicates: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.llm.common import bounded_batches, give_back, lower_az, materialize, runs, small, words, worker_memory

REGISTERS, ROWS = 128, 4
EMPTY = np.uint32(0xFFFFFFFF)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Elements whose ranks are drawn at a time.
CHUNK = 400_000
#: Members of a bucket whose pairs are made as rows; members and shingles of a block in larger buckets.
SMALL, BLOCK, ELEMENTS = 32, 1024, 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text's word hashes; a shorter text is one shingle."""
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * GOLDEN + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def superminhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of m registers per set (all EMPTY for an empty set).

    Every element draws, round by round, the next place of a random permutation of the registers
    (Fisher-Yates, so an element fills each register once) and a random fraction; the register keeps
    the least round + fraction.  A set stops after the first round that leaves no register empty:
    later rounds could only bring larger values.
    """
    out = np.full((len(sets), m), EMPTY, np.uint32)
    sizes = np.array([len(x) for x in sets], np.int64)
    at = 0
    while at < len(sets):
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
        _fill(out[at:to], np.concatenate(sets[at:to]) if sizes[at:to].sum() else np.zeros(0, np.uint64), np.repeat(np.arange(to - at), sizes[at:to]), m)
        at = to
    return out


def _fill(sig: np.ndarray, element: np.ndarray, owner: np.ndarray, m: int) -> None:
    flat, drawn, perm = sig.reshape(-1), [], None
    for j in range(m):
        if not len(element):
            return
        x = mix(element + np.uint64((j + 1) * int(GOLDEN) & (1 << 64) - 1))
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = k
        elif j == 1:
            place = np.where(k == drawn[0], 0, k)
        else:
            every = np.arange(len(element))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
                for t, kt in enumerate(drawn):
                    perm[every, t], perm[every, kt] = perm[every, kt], perm[every, t].copy()
            place = perm[every, k].astype(np.int64)
            perm[every, k] = perm[every, j]
        np.minimum.at(flat, owner * m + place, (np.uint32(j << 24) | (x >> np.uint64(40)).astype(np.uint32)))
        if perm is None:
            drawn.append(k)
        open_ = (sig == EMPTY).any(axis=1)[owner]
        if not open_.all():
            element, owner = element[open_], owner[open_]
            drawn = [d[open_] for d in drawn]
            perm = None if perm is None else perm[open_]


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        key = mix(key * GOLDEN + parts[:, :, i])
    return key.view(np.int64)


def each_list(batch: pa.RecordBatch):
    """Slices of a batch with their lists of hashes, of about CHUNK hashes or of one text."""
    column = batch.column("h")
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for start, to in runs(np.diff(ends).tolist(), CHUNK):
        yield batch.slice(start, to - start), [values[a:b] for a, b in zip(ends[start:to], ends[start + 1 : to + 1])]


def hashed(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select("doc_id", F.transform(words(lower_az(F.coalesce("text", F.lit("")))), lambda w: F.xxhash64(w)).alias("h"))


def name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), sig, bands: a row per row of docs."""

    def work(batches):
        worker_memory("minhash")
        for batch, lists in (x for whole in batches for x in each_list(whole)):
            sets = [shingles(h, n) for h in lists]
            sig = superminhash(sets)
            keys = band_keys(sig)
            bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1], keys.reshape(-1))
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([name(s) for s in sets], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), bands]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "sig", "bands"])
        give_back()

    return hashed(docs).mapInArrow(work, "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>")


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, digest, elements: the whole shingle sets."""

    def work(batches):
        worker_memory("minhash")
        for batch, lists in (x for whole in batches for x in each_list(whole)):
            sets = [shingles(h, n) for h in lists]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([name(s) for s in sets], pa.binary()), lists], names=["doc_id", "digest", "elements"])
        give_back()

    return hashed(docs).mapInArrow(work, "doc_id long, digest binary, elements array<long>")


def plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose sizes allow a similarity of `least` percent and whose signatures don't exclude it.

    A signature estimates a similarity of 0.85 with a standard deviation below 0.032; pairs of less
    than 6 deviations under `least` go.
    """
    a = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    b = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    size = (100 * F.col("na") >= least * F.col("nb")) & (100 * F.col("nb") >= least * F.col("na"))
    rows = pairs.join(a, "a").join(b, "b").filter(size).select("a", "b", "sa", "sb")
    enough = int(REGISTERS * (least / 100 - 6 * (least / 100 * (1 - least / 100) / REGISTERS) ** 0.5))

    def work(batches):
        worker_memory("minhash")
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            good = pa.array((left == right).sum(axis=1) >= enough)
            yield batch.select(["a", "b"]).filter(good)

    return rows.mapInArrow(work, "a long, b long")


def sets_of(some: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """node, elements of some(node): their shingle sets, made anew from the texts of those nodes alone."""
    needed = materialize(some.join(nodes.select("node", "doc_id", "digest"), "node"), "dup-needed")
    texts = docs.select("doc_id", "text").join(small(needed.select("doc_id").distinct(), 2_000_000), "doc_id", "left_semi")
    sets = whole_sets(texts, n).join(small(needed, 500_000), ["doc_id", "digest"]).select("node", "elements").dropDuplicates(["node"])
    return materialize(sets, "dup-sets")


def linked(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Which sets of a and b have 100 * intersection >= least * union: a matrix product over the elements of both sides."""
    every, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    sizes = np.array([len(x) for x in (*a, *b)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = row < len(a)
    common = np.zeros(len(every), bool)
    common[place[left]] = True
    common &= np.bincount(place[~left], minlength=len(every)) > 0
    both = np.zeros((len(a), len(b)), np.float32)
    number = np.cumsum(common) - 1
    row, column = row[common[place]], number[place[common[place]]]
    for at in range(0, int(common.sum()), 2048):
        part = (column >= at) & (column < at + 2048)
        dense = np.zeros((len(sizes), 2048), np.float32)
        dense[row[part], column[part] - at] = 1
        both += dense[: len(a)] @ dense[len(a) :].T
    union = sizes[: len(a), None] + sizes[None, len(a) :] - both
    return 100 * both >= least * union


def links_of_hot(member: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: links between components inside buckets of more than SMALL members, enough to join all that are linked.

    A bucket is dealt into blocks of about BLOCK members and ELEMENTS shingles at most (or of one
    member); each pair of blocks is one group, compared exactly on whole sets.  Only links that join two components come out, fewer than members.
    """

    def compare(rows):
        i, j = rows.i.iloc[0], rows.j.iloc[0]
        a = rows[rows.block == i].reset_index(drop=True)
        b = rows[rows.block == j].reset_index(drop=True)
        if not len(a) or not len(b):
            return rows[["node", "label"]].iloc[:0].set_axis(["a", "b"], axis=1)
        la, lb = a.label.to_numpy(), b.label.to_numpy()
        found = linked(list(a.elements), list(b.elements), least) & (la[:, None] != lb[None, :])
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        out = []
        for x, y in np.argwhere(found):
            u, v = top(int(la[x])), top(int(lb[y]))
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((int(a.node[x]), int(b.node[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    size = materialize(member.groupBy("key").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")), "dup-hot-sizes")
    member = member.join(small(size, 500_000), "key")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / ELEMENTS)).cast("int")
    rows = member.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")
    return rows.join(sets, "node").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs whose whole sets have 100 * intersection >= least * union.  Sets are made anew for the pairs' nodes alone."""
    pairs = materialize(plausible(pairs, nodes, least), "dup-pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, n)
    rows = pairs.join(sets.withColumnsRenamed({"node": "a", "elements": "ea"}), "a").join(sets.withColumnsRenamed({"node": "b", "elements": "eb"}), "b")
    rows = rows.select("a", "b", (F.size("ea") + F.size("eb")).alias("total"), F.size(F.array_intersect("ea", "eb")).alias("both"))
    return materialize(rows.filter(100 * F.col("both") >= least * (F.col("total") - F.col("both"))).select("a", "b"), "dup-links")


def components(edges: DataFrame) -> DataFrame:
    """v, label (the smallest vertex reachable) for the vertices of edges(a, b).

    Union-find as DataFrame steps: every vertex takes the least label around it, then its label's
    label, until nothing changes.  Each step is written to the shared folder; nothing but the number
    of changes comes to the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least"))
    labels = materialize(labels.select("v", F.least("v", "least").alias("label")), "cc-labels")
    while True:
        around = both.join(labels, F.col("a") == F.col("v")).groupBy(F.col("b").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(around, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = step.select(F.col("v").alias("label"), F.col("label").alias("root"))
        step = materialize(step.join(root, "label", "left").select("v", "old", F.least("label", F.coalesce("root", "label")).alias("label")), "cc-labels")
        labels = step.select("v", "label")
        if not step.filter("old <> label").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, n: int = 3, least: float = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs.

    Documents of equal sets are represented by the smallest doc_id.  Representatives that share a
    band are candidates: first each with its bucket's first member; then, in buckets whose members
    are still in different components, all pairs across components: as rows in small buckets, in
    blocks of a matrix product in large ones, which send no pairs but links.  So a large group of
    copies costs rows in proportion to its size, and every link between components is still found on
    whole sets.  A pair of similarity 0.85 shares none of the
    32 bands with a probability below 1e-10.

    Nulls: a null or empty text has no shingles, links to nothing and is kept; a null doc_id gets a
    null component, links to nothing and is kept.  Rows of equal doc_id are one document that has the
    links of all of them.  An empty table gives no rows.
    """
    rows = materialize(signatures(docs, n), "dup-signatures")
    live = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = live.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps, "dup-reps")
    nodes = live.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"])
    # A doc_id of several different texts: all but one of its nodes get numbers below zero.
    several = live.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first <> last")
    several = materialize(several.select("doc_id", "first"), "dup-several")
    own = F.when(F.col("first").isNull() | (F.col("first") == F.col("digest")), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "digest").bitwiseOR(F.lit(-(1 << 63))))
    nodes = nodes.join(small(several, 500_000), "doc_id", "left")
    nodes = materialize(nodes.select(own.alias("node"), "doc_id", "digest", "n_shingles", "sig", "bands").dropDuplicates(["node"]), "dup-nodes")

    bands = nodes.select("node", F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    bands = materialize(bands.join(hubs, "key"), "dup-bands")
    pairs = bands.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(pairs, nodes, docs, n, least)

    ids = nodes.select("node", "doc_id")
    by_id = lambda links: links.join(ids.toDF("a", "da"), "a").join(ids.toDF("b", "db"), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    shared = live.join(small(several.select("doc_id"), 500_000), "doc_id", "left_semi").join(reps, "digest")
    edges = by_id(links).union(shared.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))).filter("a <> b")
    labels = components(edges)

    own = labels.select(F.col("v").alias("doc_id"), "label")
    member = bands.filter("n > 2").join(ids.join(own, "doc_id", "left").select("node", F.coalesce("label", "doc_id").alias("label")), "node")
    open_ = member.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    open_ = materialize(open_, "dup-open-keys")
    member = materialize(member.join(open_, "key").join(nodes.select("node", "n_shingles"), "node").filter("node <> hub"), "dup-open")
    few = member.filter(F.col("n") <= SMALL)
    left, right = few.select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n_shingles").alias("na")), few.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("nb"))
    sizes = (100 * F.col("na") >= least * F.col("nb")) & (100 * F.col("nb") >= least * F.col("na"))
    across = left.join(right, (left.key == right.key) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & sizes).select("a", "b").distinct()
    hot = member.filter(F.col("n") > SMALL)
    more = []
    if few.limit(1).count():
        more.append(verified(across, nodes, docs, n, least))
    if hot.limit(1).count():
        more.append(materialize(links_of_hot(hot, sets_of(hot.select("node").distinct(), nodes, docs, n), least), "dup-hot-links"))
    for found in more:
        edges = edges.unionByName(by_id(found))
    if more:
        labels = components(edges)

    out = rows.select("doc_id", "n_shingles", "digest").join(reps, "digest", "left").join(labels.withColumnsRenamed({"v": "rep"}), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
