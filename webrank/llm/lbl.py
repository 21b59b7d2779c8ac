"""LM scoring: a log-bilinear model of two levels trained in numpy by noise-contrastive estimation."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrank.llm.common import bounded_batches, give_back, kth_largest, lower_az, materialize, new_path, row_id, row_key, runs, words, worker_memory

#: Dimensions; noise classes and noise words of a token; tokens of a step.
DIM, NOISE, INNER, BATCH = 12, 48, 48, 1 << 14
#: Noise that a step looks at: the most frequent classes, and as many others or words of a class.
EVERY, SOME = 12, 28
#: Words farther back than two, up to WINDOW, count by their mean.
WINDOW = 24
#: A word of this count has vectors of its own, and so have about the HEAD most frequent ones; if more than OWN_MOST words have the count, about so many.
FLOOR, HEAD, OWN_MOST = 2000, 2000, 50_000
#: Rarer words share vectors by the hash of their last SUFFIX characters.
BUCKETS, SUFFIX = 1024, 3
#: The most frequent words, about so many at most, whose counts are broadcast; all others' are joined.
FREQUENT = 200_000
#: Training tokens of a partition, about; tokens that a worker holds at a time.
PART, HELD = 12_000_000, 1 << 16
#: Rows of a run from which on its sum is a matrix product.
LONG = 16
LN10 = np.log(10.0)


@dataclass
class Vocabulary:
    """Counts of the frequent words, sorted by hash, and their symbols; sums over all training tokens.

    The symbols are the words with vectors of their own, the buckets of rarer words and the end, by
    falling count.  The lowest bits of a word's hash are its bucket.
    """

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    buckets: np.ndarray
    bottoms: np.ndarray
    sizes: np.ndarray
    end: int
    totals: dict[str, float]

    @property
    def start(self) -> int:
        return len(self.sizes)

    def own(self) -> Vocabulary:
        """The same symbols, without the counts of words that have no vectors of their own, which training needs not."""
        some = self.bottoms[self.symbols] == 0
        return replace(self, hashes=self.hashes[some], counts=self.counts[some], symbols=self.symbols[some])

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, symbol) of word hashes: count -1 for words that aren't frequent."""
        symbol = self.buckets[h & (BUCKETS - 1)]
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64), symbol
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        there = self.hashes[at] == h
        return np.where(there, self.counts[at], -1), np.where(there, self.symbols[at], symbol)


def width_of(n: int) -> int:
    return max(1, int(np.ceil(np.sqrt(n))))


@dataclass
class Model:
    """P(w | context) = P(class of w | context) P(w | its class, context), each a softmax of q . r + bias.

    The context's vector q is the sum of the word before by one table, the word before that by a
    second, and the mean of those farther back by a third.  `rows` has, for each symbol and for the
    start, its three context vectors, its own vector r and its bias; `classes` has r and bias of each
    class.  A class is `width` symbols of neighbouring counts.
    """

    rows: np.ndarray
    classes: np.ndarray
    width: int

    @classmethod
    def initial(cls, unigram: np.ndarray, dim: int = DIM, seed: int = 5, width: int | None = None) -> Model:
        rng, n = np.random.default_rng(seed), len(unigram)
        width = width or width_of(n)
        mass = class_mass(unigram, width)
        rows = rng.normal(0, 0.1, (n + 1, 4 * dim + 1)).astype(np.float32)
        rows[:n, -1], rows[n, -1] = np.log(unigram), 0
        classes = rng.normal(0, 0.1, (len(mass), dim + 1)).astype(np.float32)
        classes[:, -1] = np.log(mass)
        return cls(rows, classes, width)

    @property
    def dim(self) -> int:
        return self.classes.shape[1] - 1

    def contexts(self, text: Texts) -> np.ndarray:
        """q of every token of the texts, and a last column of ones for the bias."""
        d, s, t = self.dim, text.symbols, text.target
        q = np.ones((len(t), d + 1), np.float32)
        q[:, :d] = picked(self.rows[:, :d], s[t - 1])
        q[:, :d] += picked(self.rows[:, d : 2 * d], s[t - 2])
        far = np.zeros((len(s) + 1, d))
        np.cumsum(picked(self.rows[:, 2 * d : 3 * d], s), axis=0, dtype=np.float64, out=far[1:])
        mean = picked(far, text.to)
        mean -= picked(far, text.since)
        mean *= text.share[:, None]
        q[:, :d] += mean
        return q

    def log_probability(self, text: Texts) -> np.ndarray:
        """Natural logarithms of P(w | context) of every token, by matrix products over the classes and over each class's symbols."""
        q, w, d = self.contexts(text), text.symbols[text.target], self.dim
        own = np.ascontiguousarray(self.rows[:-1, 3 * d :])
        of = (w // self.width).astype(np.int32)
        got = np.einsum("ij,ij->i", q, picked(self.classes, of)) + np.einsum("ij,ij->i", q, picked(own, w))
        got -= log_z(q, self.classes)
        order = np.argsort(of.astype(np.uint16) if len(self.classes) < 1 << 16 else of, kind="stable")
        bounds = np.append(np.flatnonzero(np.diff(of[order], prepend=-1)), len(of))
        by_class, z = picked(q, order), np.empty_like(got)
        for i, j in zip(bounds[:-1], bounds[1:]):
            c = of[order[i]] * self.width
            z[i:j] = log_z(by_class[i:j], own[c : c + self.width])
        got[order] -= z
        return got


def picked(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """table[rows]; numpy takes rows that lie in one piece several times faster than it indexes others."""
    return np.take(np.ascontiguousarray(table), rows, axis=0)


def log_z(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """log of the sum of exp(q . r) over the rows of r; scores are small, and if they aren't, the largest is taken out first."""
    out = np.empty(len(q), np.float32)
    step = max(64, (1 << 20) // max(1, len(r)))
    ones = np.ones(len(r), np.float32)
    for i in range(0, len(q), step):
        s = q[i : i + step] @ r.T
        top = float(np.abs(s).max())
        if top < 60:
            out[i : i + step] = np.log(np.exp(s, out=s) @ ones)
        else:
            high = s.max(axis=1, keepdims=True)
            s -= high
            out[i : i + step] = high[:, 0] + np.log(np.exp(s, out=s) @ ones)
    return out


def class_mass(unigram: np.ndarray, width: int) -> np.ndarray:
    return np.add.reduceat(unigram, np.arange(0, len(unigram), width))


@dataclass
class Texts:
    """Symbols of texts in a row, each with two start symbols before and an end after, and where each token's context lies.

    The mean of farther words covers places since..to - 1 of the same text, `share` being one over their number.
    """

    symbols: np.ndarray
    target: np.ndarray
    since: np.ndarray
    to: np.ndarray
    share: np.ndarray
    owner: np.ndarray
    count: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, size: np.ndarray, v: Vocabulary) -> Texts:
        """count is that of the token, -1 if not frequent and -2 for an end; place is that of the word in h, -1 for an end."""
        count, symbol = v.look_up(h)
        owner = np.repeat(np.arange(len(size)), size + 3)
        base = np.cumsum(size + 3) - (size + 3)
        within = np.arange(len(owner)) - base[owner]
        inside = (within >= 2) & (within < size[owner] + 2)
        symbols = np.full(len(owner), v.start, np.int64)
        symbols[inside] = symbol
        symbols[base + size + 2] = v.end
        counts, place = np.full(len(owner), -2, np.int64), np.full(len(owner), -1, np.int64)
        counts[inside], place[inside] = count, np.arange(len(h))
        target = np.flatnonzero(within >= 2)
        return cls.at(symbols, target, base[owner[target]] + 2, owner[target], counts[target], place[target])

    @classmethod
    def at(cls, symbols: np.ndarray, target: np.ndarray, first: np.ndarray, owner=None, count=None, place=None) -> Texts:
        to = np.maximum(target - 2, first)
        since = np.maximum(target - WINDOW, first)
        return cls(symbols, target, since, to, (1 / np.maximum(to - since, 1)).astype(np.float32), owner, count, place)

    def __len__(self) -> int:
        return len(self.target)


def squash(s: np.ndarray) -> np.ndarray:
    """The logistic function, in place; a very low score overflows to infinity and so gives 0."""
    np.negative(s, out=s)
    with np.errstate(over="ignore"):
        np.exp(s, out=s)
    s += 1
    return np.reciprocal(s, out=s)


def against_noise(q: np.ndarray, r: np.ndarray, log_noise: np.ndarray) -> np.ndarray:
    """squash(q @ r.T - log_noise) for contexts q, whose last column is one and so takes in the noise."""
    r = -r
    r[:, -1] += log_noise
    s = q @ r.T
    with np.errstate(over="ignore"):
        np.exp(s, out=s)
    s += 1
    return np.reciprocal(s, out=s)


def run_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """np.add.reduceat(rows, first): the sums of the runs that begin at `first`, those of LONG ones as matrix products, which are much faster."""
    size = np.diff(first, append=len(rows))
    out = picked(rows, first)
    ones = np.ones(int(size.max(initial=0)), rows.dtype)
    for k in np.flatnonzero(size >= LONG):
        out[k] = ones[: size[k]] @ rows[first[k] : first[k] + size[k]]
    some = np.flatnonzero((size > 1) & (size < LONG))
    if len(some):
        size = size[some]
        start = np.cumsum(size) - size
        out[some] = np.add.reduceat(picked(rows, np.repeat(first[some] - start, size) + np.arange(size.sum())), start, axis=0)
    return out


def spread_back(grad: np.ndarray, text: Texts, n: int) -> np.ndarray:
    """For each of n places, the sum of the gradients of the tokens whose window of farther words covers it.

    A window adds at its begin, which early tokens of a text share, and takes away at its end, which is
    its own; running sums do the rest.
    """
    some = np.flatnonzero(text.to > text.since)
    steps = np.zeros((n + 1, grad.shape[1]))
    since, grad = text.since[some], picked(grad, some)
    steps[text.to[some]] = -grad
    first = np.flatnonzero(np.diff(since, prepend=-1))
    steps[since[first]] += run_sums(grad, first) if len(first) else 0
    return np.cumsum(steps, axis=0)[:-1]


def gathered(index: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of `index`, which may repeat, once each, the sums of their gradients and how often each came."""
    order = np.argsort(index.astype(np.uint16) if index.max(initial=0) < 1 << 16 else index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.diff(index, prepend=-1))
    return index[first], run_sums(picked(grad, order), first), np.diff(first, append=len(index))


class Trainer:
    """AdaGrad on the noise-contrastive objective of both levels, with a rate for each vector of a row.

    NOISE noise classes stand against each token's class and INNER noise words of that class against
    the word.  Their expectation is taken over the noise distribution by matrix products that a step's
    tokens share: over the EVERY most frequent classes, and over a new random SOME, in each step, of the other
    classes and of the words of a class, which stand for all of them.
    """

    def __init__(self, model: Model, unigram: np.ndarray, rate: float = 0.1):
        self.m, self.rate, self.rng = model, rate, np.random.default_rng(11)
        n, width = len(unigram), model.width
        mass = class_mass(unigram, width)
        of = np.arange(n) // width
        self.mass = (NOISE * mass / mass.sum()).astype(np.float32)
        self.log_class = np.log(self.mass)
        self.noise = (INNER * unigram / mass[of]).astype(np.float32)
        self.log_noise = np.log(self.noise)
        d = model.dim
        self.blocks = [(i * d, (i + 1) * d) for i in range(4)] + [(4 * d, 4 * d + 1)]
        self.squares = np.full((n + 1, 5), 0.1, np.float32)
        self.class_squares = np.full((len(mass), 2), 0.1, np.float32)
        self.times = np.zeros(n + 1, np.int64)

    def some_of(self, first: int, end: int, every: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows from first to end - 1, all or the first `every` and SOME others, and how many of them each stands for."""
        n = end - first
        if n <= every + SOME:
            return np.arange(first, end), np.ones(n, np.float32)
        others = first + every + (self.rng.integers(0, n - every) + np.arange(SOME) * (n - every) // SOME) % (n - every)
        return np.concatenate([np.arange(first, first + every), others]), np.repeat(np.array([1, (n - every) / SOME], np.float32), [every, SOME])

    def apply(self, table, squares, rows, total: np.ndarray, blocks) -> None:
        """Add to these rows of a table their gradients, each block by its rate."""
        for k, (a, b) in enumerate(blocks):
            part = total[:, a:b]
            square = squares[rows, k] + np.einsum("ij,ij->i", part, part) / (b - a)
            squares[rows, k] = square
            table[rows, a:b] += part * (self.rate / np.sqrt(square))[:, None]

    def step(self, text: Texts) -> None:
        """One step on the tokens of `text`; its symbols may hold more than these."""
        m, d, s, t = self.m, self.m.dim, text.symbols, text.target
        q, w = m.contexts(text), s[t]
        of = w // m.width
        dq = np.zeros_like(q)
        if len(self.mass) > 1:
            noise, times = self.some_of(0, len(self.mass), EVERY)
            r = m.classes[noise]
            met = picked(m.classes, of)
            up = 1 - squash(np.einsum("ij,ij->i", q, met) - self.log_class[of])
            down = against_noise(q, r, self.log_class[noise])
            down *= self.mass[noise] * times
            dq += up[:, None] * met
            dq -= down @ r
            minus = np.zeros_like(m.classes)
            minus[noise] = -(down.T @ q)
            rows, total, _ = gathered(of, up[:, None] * q)
            minus[rows] += total
            self.apply(m.classes, self.class_squares, slice(None), minus, [(0, d), (d, d + 1)])
        grad = np.zeros((len(s), 4 * d + 1), np.float32)
        own = m.rows[:, 3 * d :]
        met = picked(own, w)
        up = 1 - squash(np.einsum("ij,ij->i", q, met) - self.log_noise[w])
        dq += up[:, None] * met
        own_grad = up[:, None] * q
        order = np.argsort(of.astype(np.uint16) if len(self.mass) < 1 << 16 else of, kind="stable")
        bounds = np.append(np.flatnonzero(np.diff(of[order], prepend=-1)), len(of))
        against, pushed = [], []
        by_class, change = picked(q, order), picked(dq, order)
        for i, j in zip(bounds[:-1], bounds[1:]):
            first = of[order[i]] * m.width
            noise, times = self.some_of(first, min(first + m.width, len(self.noise)), 0)
            r, qk = own[noise], by_class[i:j]
            down = against_noise(qk, r, self.log_noise[noise])
            down *= self.noise[noise] * times
            change[i:j] -= down @ r
            against.append(noise)
            pushed.append(down.T @ qk)
        dq[order] = change
        dq = np.ascontiguousarray(dq[:, :d])
        grad[t - 1, :d] = dq
        grad[t - 2, d : 2 * d] = dq
        grad[t, 3 * d :] = own_grad
        grad[:, 2 * d : 3 * d] = spread_back(dq * text.share[:, None], text, len(s))
        rows, total, times = gathered(s, grad)
        self.times[rows] += times
        self.apply(m.rows, self.squares, rows, total[:, : 3 * d], self.blocks[:3])
        both, total, _ = gathered(np.concatenate([rows, *against]), np.concatenate([total[:, 3 * d :], *(-x for x in pushed)]))
        self.apply(own, self.squares[:, 3:], both, total, [(0, d), (d, d + 1)])


def flat_lists(column) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends).astype(np.int64)


def groups(batches, most: int):
    """Slices of batches of about `most` tokens, or of one text, which bound what a worker holds."""
    for batch in batches:
        for i, j in runs(np.diff(batch.column("h").offsets.to_numpy()).tolist(), most):
            yield batch.slice(i, j - i)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, _deal, h: the words' hashes of every row; a null doc_id counts as training.

    A hash's lowest bits are a hash of the word's last SUFFIX characters, the bucket of a rare word.
    """

    def code(w: Column) -> Column:
        return F.xxhash64(w).bitwiseAND(F.lit(-BUCKETS)).bitwiseOR(F.xxhash64(F.right(w, F.lit(SUFFIX))).bitwiseAND(F.lit(BUCKETS - 1)))

    text = words(lower_az(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", held_out().alias("held_out"), F.xxhash64(row_id(), row_key()).alias("_deal"), F.transform(text, code).alias("h"))


def word_counts(tokens: DataFrame) -> DataFrame:
    """h, c: the count of every word (by hash) in the training documents, stored in the shared folder."""

    def work(batches):
        worker_memory("lm")
        for batch in groups(batches, 1 << 19):
            h, c = np.unique(flat_lists(batch.column("h"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], names=["h", "n"])

    rows = tokens.filter("not held_out").select("h").mapInArrow(work, "h long, n long")
    return materialize(rows.groupBy("h").agg(F.sum("n").alias("c")), "lm-counts")


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most about `most` words have: those of the next higher one fit."""
    cut = kth_largest(counts.select(F.col("c").cast("double").alias("c")), "c", most + 1)
    return 1 if cut is None else int(cut)


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """Ends are counted as a word of their own, one a training document.

    Words come to the driver by a threshold on their count that at most FREQUENT (or OWN_MOST) pass.
    """
    n, v, above, own_n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") > 1, 1)), F.count(F.when(F.col("c") >= FLOOR, 1))).first()
    floor = FLOOR if HEAD <= own_n <= OWN_MOST else 1 + least_count(counts, OWN_MOST if own_n > OWN_MOST else HEAD)
    frequent = 1 if v <= FREQUENT else 2 if above <= FREQUENT else least_count(counts, FREQUENT) + 1
    top = counts.filter(F.col("c") >= min(floor, frequent)).toArrow()
    h, c = top["h"].to_numpy(), top["c"].to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    own = int((c >= floor).sum())
    rare = counts.filter(F.col("c") < floor).groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    rare_n, rare_v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rare_n[rare["b"].to_numpy()], rare_v[rare["b"].to_numpy()] = rare["n"].to_numpy(), rare["v"].to_numpy()
    sizes = np.concatenate([c[:own], rare_n, [n_docs]])
    by_count = np.argsort(-sizes, kind="stable")
    symbol = np.empty(len(sizes), np.int64)
    symbol[by_count] = np.arange(len(sizes))
    bottoms = np.concatenate([np.zeros(own), rare_n + 0.5 * (rare_v + 1), [0]])[by_count]
    buckets = symbol[own:-1]
    symbols = buckets[h & (BUCKETS - 1)]
    symbols[:own] = symbol[:own]
    order = np.argsort(h)
    totals = {"n": float(n + n_docs), "v": float(v + (n_docs > 0)), "end": float(n_docs)}
    return Vocabulary(h[order], c[order], symbols[order], buckets, bottoms, sizes[by_count], int(symbol[-1]), totals)


def unigram(v: Vocabulary) -> np.ndarray:
    n = v.sizes + 0.5
    return n / n.sum()


def learn(batches, v: Vocabulary, model: Model) -> Trainer:
    """Train on all tokens of Arrow batches of h, in their order, by steps of about BATCH tokens, each of whole texts' parts."""
    trainer = Trainer(model, unigram(v))
    for batch in groups(batches, BATCH):
        text = Texts.of(*flat_lists(batch.column("h")), v)
        for i in range(0, len(text), 2 * BATCH):  # one text may be long
            part = slice(i, min(i + 2 * BATCH, len(text)))
            low = int(min(text.since[part].min(), text.target[part.start] - 2))
            high = int(text.target[part.stop - 1]) + 1
            trainer.step(Texts(text.symbols[low:high], text.target[part] - low, text.since[part] - low, text.to[part] - low, text.share[part], None, None, None))
    return trainer


def train(tokens: DataFrame, v: Vocabulary, rounds: int = 1) -> Model:
    """The model after `rounds` passes over all training documents of hashed() rows.

    Documents are dealt by a hash of the row to partitions of about PART tokens, in the order of the
    hash, so neither files nor the cluster decide the result.  Each partition trains from the same
    start over all of its tokens; a symbol's row is averaged by its uses over the partitions that met it
    as a grouped sum, so only one model comes to the driver.
    """
    first = Model.initial(unigram(v))
    width = first.rows.shape[1]
    names = [f"x{i}" for i in range(width)]
    parts = max(1, round(v.totals["n"] / PART))
    rows = tokens.filter("not held_out").repartition(parts, "_deal").sortWithinPartitions("_deal").select("h")
    for _ in range(rounds):
        shared = tokens.sparkSession.sparkContext.broadcast((v.own(), first))

        def work(batches, shared=shared):
            worker_memory("lm")
            v, start = shared.value
            model = Model(start.rows.copy(), start.classes.copy(), start.width)
            trainer = learn(batches, v, model)
            classes = np.zeros((len(model.classes), width), np.float32)
            classes[:, : model.classes.shape[1]] = model.classes
            times = np.concatenate([trainer.times, np.full(len(classes), max(1, trainer.times.sum()))])
            for base, table in ((0, model.rows), (len(model.rows), classes)):
                used = np.flatnonzero(times[base : base + len(table)])
                for i in range(0, len(used), 1 << 13):
                    u = used[i : i + (1 << 13)]
                    yield pa.RecordBatch.from_arrays([pa.array((base + u).astype(np.int32)), pa.array(times[base + u].astype(np.int64)), *map(pa.array, np.ascontiguousarray(table[u].T))], names=["i", "n", *names])

        sums = rows.mapInArrow(work, "i int, n long, " + ", ".join(f"{x} float" for x in names))
        got = sums.groupBy("i").agg(*((F.sum(F.col(x) * F.col("n")) / F.sum("n")).cast("float").alias(x) for x in names)).toArrow()
        at = got["i"].to_numpy()
        first = Model(first.rows.copy(), first.classes.copy(), first.width)
        own, n = at < len(first.rows), len(first.rows)
        for k, x in enumerate(names):
            column = got[x].to_numpy()
            first.rows[at[own], k] = column[own]
            if k < first.classes.shape[1]:
                first.classes[at[~own] - n, k] = column[~own]
        shared.unpersist()
    return first


def scored(tokens: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base, score, uh, utf (h, tf arrays): all but the words that aren't frequent.

    base and score lack what belongs to the words of `uh`, whose counts must be joined.
    """
    shared = tokens.sparkSession.sparkContext.broadcast((v, model))

    def work(batches):
        worker_memory("lm")
        v, m = shared.value
        bottom_log = np.log10(np.where(v.bottoms > 0, v.bottoms, 1.0))
        end_log = np.log10(v.totals["end"] + 0.5)
        base_log = np.log10(v.totals["n"] + 0.5 * (v.totals["v"] + 1))
        for batch in groups(batches, HELD):
            h, size = flat_lists(batch.column("h"))
            text = Texts.of(h, size, v)
            w, owner, count, docs_n = text.symbols[text.target], text.owner, text.count, len(size)
            token = np.empty(len(w))
            for i in range(0, len(w), HELD):
                j = min(i + HELD, len(w))
                low = int(min(text.since[i:j].min(), text.target[i] - 2))
                part = Texts(text.symbols[low : text.target[j - 1] + 1], text.target[i:j] - low, text.since[i:j] - low, text.to[i:j] - low, text.share[i:j], None, None, None)
                token[i:j] = m.log_probability(part)
            token /= LN10
            known = count > 0
            log_c = np.where(known, np.log10(np.maximum(count, 1) + 0.5), np.where(count == -2, end_log, 0.0))
            token += np.where(v.bottoms[w] > 0, log_c - bottom_log[w], 0.0)
            sums = lambda x: np.bincount(owner, weights=x, minlength=docs_n)
            n_tokens = np.bincount(owner, minlength=docs_n)
            n_known = sums(known) + (v.totals["end"] > 0)
            lost = np.flatnonzero(count == -1)
            order = lost[np.lexsort((h[text.place[lost]], owner[lost]))]
            lh, lo = h[text.place[order]], owner[order]
            first = np.ones(len(order), bool)
            first[1:] = (lh[1:] != lh[:-1]) | (lo[1:] != lo[:-1])
            at = np.flatnonzero(first)
            tf = np.diff(np.append(at, len(order)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(lo[at], minlength=docs_n))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (lh[at].astype(np.int64), tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known.astype(np.int64)), pa.array(sums(log_c) - n_tokens * base_log), pa.array(sums(token)), *lists], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "uh", "utf"])
        give_back()

    return tokens.select("doc_id", "held_out", "h").mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, uh array<long>, utf array<int>")


def score(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of docs.

    score is the log10 probability of a text: the log-bilinear model's for the symbols of its tokens
    (the words of FLOOR occurrences or of the HEAD, the end, and buckets by the last characters for rarer
    words), and for a word of a bucket also that of the word in it, (c + 0.5) / (n + 0.5 * (v + 1)) by its count.
    Words with vectors grow in number with the corpus, up to OWN_MOST, which bounds the model in memory.

    Counts cover all training documents.  Those of the FREQUENT words, and of all with vectors of
    their own, are broadcast; other words of a text leave as (hash, frequency) and meet their counts in a join.

    Nulls: a null text is empty and has its end alone; a null doc_id counts as training.  Repeated
    rows get a row each.  Without training documents all words are unknown; an empty table gives no rows.
    """
    path = new_path(docs.sparkSession, "lm-tokens")
    hashed(bounded_batches(docs)).write.option("parquet.dictionary.page.size", 16 << 20).parquet(path)  # most hashes repeat: a dictionary keeps them small
    tokens = docs.sparkSession.read.parquet(path)
    counts = word_counts(tokens)
    v = vocabulary(counts, tokens.filter("not held_out").count())
    rows = materialize(scored(tokens, v, train(tokens, v, rounds)).withColumn("_row", F.monotonically_increasing_id()), "lm-scores")
    lost = rows.select("_row", F.explode(F.arrays_zip("uh", "utf")).alias("u")).select("_row", F.col("u.uh").alias("h"), F.col("u.utf").alias("tf"))
    lost = lost.join(counts, "h", "left").groupBy("_row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf"))).alias("known"))
    out = rows.drop("uh", "utf").join(lost, "_row", "left").fillna(0, ["more", "known"])
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(int(v.totals["n"])).cast("long").alias("train_tokens"), (F.col("base") + F.col("more")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"))
