"""Best-fit packing of tokenised documents, certified by dual-feasible-function lower bounds."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.llm.common import bounded_batches, give_back, materialize, runs, worker_memory

CAPACITY = 4096
END = 1
#: Bound on the words that a Python worker remembers.
REMEMBERED = 350_000
#: Letters that neither normalisation nor the pre-tokeniser splits, and marks that stay together after them.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = ".,;:!?"


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Encoder(dict):
    """Token ids of words, as little-endian 32-bit bytes.

    The vocabulary's normaliser and pre-tokeniser never join characters across white space, so the
    ids of a text are those of its words in turn.  New words are encoded together: a plain word's ids
    end with the only one that closes a word, so many plain words can go through the tokenizer as one
    text.  A word of letters and marks has the ids of the letters, then those of the marks, and is not
    itself remembered.  A worker keeps a bounded number of words.
    """

    @classmethod
    def of(cls, path: str) -> Encoder:
        return worker_memory(f"packing {path}", lambda: cls(path))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would keep memory of their own
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text ends among them.

        Words are numbered by Arrow, so Python handles each distinct word of the texts once.
        """
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # as the normaliser does, but for special tokens
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary)
        forms = self.forms(pc.binary_join(distinct, " ")[0].as_py().split(" ")) if len(numbered) else []
        word = numbered.indices.to_numpy()
        data = np.frombuffer(b"".join(forms), dtype="<u4")
        size = np.fromiter(map(len, forms), np.int64, len(forms)) // 4
        begin = np.cumsum(size) - size
        n = size[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = data[np.arange(ends[-1]) + np.repeat(begin[word] - ends[:-1], n)]
        return ids, ends[np.cumsum(pc.list_value_length(split).to_numpy())]

    def forms(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words."""
        out = list(map(self.get, words))
        plain, other = {}, {}
        places, bodies, tails = [], [], []  # lists of tuples would cost the garbage collector time
        for i, form in enumerate(out):
            if form is None:
                word = words[i]
                body = word.rstrip(MARKS)
                if (body.isascii() and body.isalpha()) or LETTERS.fullmatch(body):
                    tail, body = word[len(body) :], body.lower()
                    plain[body] = None
                else:
                    tail, body = word, ""
                other[tail] = None
                places.append(i)
                bodies.append(body)
                tails.append(tail)
        self.setdefault("", b"")
        plain = [w for w in plain if w not in self]
        other = [w for w in other if w not in self]
        ids = np.array(self.ids([" ".join(plain)])[0], dtype="<u4")
        ends = (4 * (np.flatnonzero(self.closing[ids]) + 1)).tolist()
        data = ids.tobytes()
        self.update((w, data[a:b]) for w, a, b in zip(plain, [0, *ends], ends, strict=False))
        self.update(zip(other, map(as_bytes, self.ids(other)), strict=True))
        for i, body, tail in zip(places, bodies, tails, strict=True):
            out[i] = self[body] + self[tail]
        if len(self) > REMEMBERED:
            for w in plain + other:
                del self[w]
        return out


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row, piece, start, length, ids: the pieces of every row of docs.

    ids are a piece's tokens as little-endian unsigned 32-bit integers.  Each text is followed by
    token 1; only texts of more than `capacity` ids are cut.  `row` tells rows of equal doc_id apart
    within a run.  A null text is empty and gives a piece of one id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for start, to in runs(pc.utf8_length(batch.column("text")).to_pylist()):
                part = batch.slice(start, to - start)
                ids, ends = encoder.encode(part.column("text"))
                ids = np.insert(ids, ends, END)
                length = np.diff(ends, prepend=0) + 1
                pieces = -(-length // capacity)
                owner = np.repeat(np.arange(len(pieces)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = piece * capacity
                length = np.minimum(length[owner] - begin, capacity)
                at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
                binary = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                own = part.select(["doc_id", "row"]).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(piece.astype(np.int32)), pa.array(begin), pa.array(length), binary], names=columns)
        give_back()

    columns = ["doc_id", "row", "piece", "start", "length", "ids"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    out = bounded_batches(rows).mapInArrow(cut, "doc_id string, row long, piece int, start long, length long, ids binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins by these dual feasible functions, for every useful parameter.

    The classic two: rounding to multiples of 1 / (k + 1) (u_k), and the threshold function that
    counts lengths above capacity - e as 1 and those below e as 0 (U_e).  Both work on the histogram.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * size).sum()) // capacity)
    # U_e: lengths over capacity - e fill a bin; those of at least e count in proportion.
    count, total = np.cumsum(n), np.cumsum(n * size)
    e = np.arange(1, capacity // 2 + 1)
    big = count[capacity] - count[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    best = max(best, int((big - (-middle // capacity)).max()))
    for k in range(1, 21):  # u_k: x (k+1) / capacity if whole, else its floor over k
        whole = size * (k + 1) % capacity == 0
        units = np.where(whole, size * (k + 1) // capacity * k, size * (k + 1) // capacity * (k + 1))
        best = max(best, -(-int((n * units).sum()) // (k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins.

    Bins are kept by free space; a bit set of free spaces gives the tightest fit in one step.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i in order.tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            b, free = n, capacity
            n += 1
        bins[i], offsets[i] = b, capacity - free
        free -= size
        if free:
            by_free[free].append(b)
            mask |= 1 << free
    return bins, offsets, n


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = 20_000, rounds: int = 3) -> DataFrame:
    """row, piece, sequence_id, offset and round, bins, bound (of the partition that placed it) for pieces(row, piece, length).

    Pieces of full length are sequences by themselves.  The rest is dealt by hash to partitions of
    about `per_partition` pieces, each packed best-fit decreasing and compared with its lower bound.
    A partition that meets its bound is certified, and done.  From those that don't, the fullest
    sequences stay and the others' pieces are exchanged: dealt anew among all such partitions and
    packed again, for at most `rounds` rounds.  A round that needs more sequences than it took apart is
    undone, and ends the exchange.  A partition holds the lengths of a bounded number of pieces.
    """
    nothing = F.lit(0).cast("long")
    columns = ["row", "piece", "round", "part", "bin", "offset", "bins", "bound"]
    out = pieces.filter(F.col("length") >= capacity).select("row", "piece", F.lit(-1).alias("round"), F.lit(0).alias("part"), F.monotonically_increasing_id().alias("bin"), nothing.alias("offset"), nothing.alias("bins"), nothing.alias("bound"))
    schema = "row long, piece int, length long, round int, part int, bin long, offset long, bins long, bound long, again boolean"

    def run(round_: int):
        def work(rows: pd.DataFrame) -> pd.DataFrame:
            sizes = rows.length.to_numpy(np.int64)
            bins, offsets, n = best_fit_decreasing(sizes, capacity)
            bound = lower_bound(sizes, capacity)
            rows = rows.assign(bin=bins, offset=offsets, bins=n, bound=bound, round=round_, again=False)
            if n > bound and round_ < rounds - 1:
                filled = np.bincount(bins, weights=sizes, minlength=n)
                rows["again"] = (filled < capacity * 0.98)[bins]
            return rows[["row", "piece", "length", "round", "part", "bin", "offset", "bins", "bound", "again"]]

        return work

    def used(rows: DataFrame) -> int:
        return rows.select("part", "bin").distinct().count()

    left, held = pieces.filter(F.col("length") < capacity).select("row", "piece", "length"), None
    for round_ in range(rounds):
        n = left.count()
        if not n:
            break
        parts = -(-n // per_partition)
        rows = left.withColumn("part", F.pmod(F.xxhash64("row", "piece", F.lit(round_)), F.lit(parts)).cast("int"))
        rows = materialize(rows.groupBy("part").applyInPandas(run(round_), schema), "packed")
        if held is not None and used(rows) > used(held):
            break
        out = out.unionByName(rows.filter(~F.col("again")).select(columns))
        held = rows.filter("again")
        left = held.select("row", "piece", "length")
    if held is not None:
        out = out.unionByName(held.select(columns))
    numbered = (F.col("part").cast("long") * (2 * per_partition) + F.col("bin")) * rounds + F.col("round")
    return out.withColumn("sequence_id", F.when(F.col("round") < 0, -1 - F.col("bin")).otherwise(numbered)).select("row", "piece", "sequence_id", "offset", "round", "bins", "bound")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences themselves, from tokenise()'s pieces and pack()'s places."""
    rows = pieces.join(placed, ["row", "piece"]).groupBy("sequence_id")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.agg(F.sum("length").alias("length"), joined.alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, round, bins, bound: where each piece of each row of docs goes.

    bins is the number of sequences of the partition that placed the piece, in the exchange's `round`,
    and bound its lower bound: where they are equal, no packing of the partition has fewer sequences.
    A piece of full length is placed in round -1, with 0 for both.
    Token ids are written nowhere: their checksums and lengths are made as the texts are read, and only
    those narrow rows are stored and joined.  See tokenise() for nulls; an empty table gives no rows.
    """
    pieces = tokenise(docs, path, capacity)
    narrow = pieces.select("doc_id", "row", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    narrow = materialize(narrow, "pieces")
    out = narrow.join(pack(narrow, capacity), ["row", "piece"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "bins", "bound")
