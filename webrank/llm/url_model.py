"""URL filters: rules by host suffix and path prefix, and a character language-model ratio for the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrank.llm.common import LOWER, UPPER, bounded_batches, materialize, runs

#: Longest context of a character; a context counts if it has been seen FEWEST times, else the next shorter one does.
ORDER, FEWEST = 6, 4
#: Cells of each order's table; longer contexts are hashed to them.
CELLS = 1 << 18
PRIME = np.uint64(0x9E3779B97F4A7C15)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does."""
    found = []
    for verdict, rule in sorted(rules, key=lambda x: -len(x[1])):
        domain, slash, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def cells(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, contexts, characters) of every byte of the URLs, an end mark included.

    contexts[k] is the cell of the k bytes before, and characters[k] that of them and the byte itself.
    A context doesn't reach beyond a URL's begin, which is a mark like the end.
    """
    size = np.array([len(x) + 1 + ORDER for x in urls], dtype=np.int64)
    pad = b"\xff" * ORDER
    code = np.frombuffer(b"".join(pad + x + b"\xff" for x in urls), dtype=np.uint8).astype(np.uint64)
    inside = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size) >= ORDER
    row = np.repeat(np.arange(len(size)), size)[inside]
    contexts = np.zeros((ORDER + 1, int(inside.sum())), np.int64)
    characters = np.zeros_like(contexts)
    mixed = np.zeros(len(code), np.uint64)
    for k in range(ORDER + 1):
        if k:
            back = np.zeros(len(code), np.uint64)
            back[k:] = code[:-k]
            mixed = (mixed + back + np.uint64(1)) * PRIME
            mixed ^= mixed >> np.uint64(29)
        contexts[k] = (mixed[inside] >> np.uint64(7)) % np.uint64(CELLS)
        both = (mixed + (code + np.uint64(257))) * PRIME
        both ^= both >> np.uint64(31)
        characters[k] = both[inside] % np.uint64(CELLS)
    return row, contexts, characters


def in_parts(urls: pd.Series):
    """(from, to, bytes of the lower-cased URLs) for runs of URLs of about a quarter of a million characters."""
    data = [x.lower().encode("utf-8", "replace") for x in urls]
    for start, to in runs(map(len, data), 1 << 18):
        yield start, to, data[start:to]


def log_probability(contexts: np.ndarray, characters: np.ndarray, seen: np.ndarray, beta: float) -> np.ndarray:
    """log P(character | what is before it), of every character.

    seen[0] counts contexts and seen[1] characters after them, by order and cell.  From the shortest
    context on, each that was seen FEWEST times is smoothed by beta pseudo-counts of the next shorter
    one's probability; the first that wasn't ends the walk, so each character has its own order.
    """
    p = np.full(contexts.shape[1], 1 / 256)
    going = np.ones(contexts.shape[1], bool)
    for k in range(ORDER + 1):
        n = seen[0, k][contexts[k]]
        going &= n >= FEWEST
        p = np.where(going, (seen[1, k][characters[k]] + beta * p) / (n + beta), p)
    return np.log(p)


def fit(urls: DataFrame) -> np.ndarray:
    """Counts by class (rejected, accepted), kind (context, character), order and cell, from urls(url, accepted).

    Counts cover all rows; a partition sends one row for each cell it has seen, so what meets is
    bounded by 4 * (ORDER + 1) * CELLS = 7.3 million counts at any input size.
    """
    shape = (2, 2, ORDER + 1, CELLS)

    def count(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            accepted = batch.accepted.to_numpy().astype(bool)
            for start, to, data in in_parts(batch.url):
                row, *both = cells(data)
                good = accepted[start:to][row]
                for side in (0, 1):
                    for kind in (0, 1):
                        for k in range(ORDER + 1):
                            total[side, kind, k] += np.bincount(both[kind][k][good == side], minlength=CELLS)
        cell = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cell, "n": total.reshape(-1)[cell]})

    rows = urls.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(shape, np.float32)
    counts.reshape(-1)[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return counts


def scored(rows: DataFrame, counts: np.ndarray, beta: float) -> DataFrame:
    """rows with `score`: the mean of log P_accepted - log P_rejected over a URL's characters; null for a null url."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def add(batches):
        for batch in batches:
            scores = []
            for _, _, data in in_parts(batch.url.fillna("")):
                row, contexts, characters = cells(data)
                ratio = log_probability(contexts, characters, shared.value[1], beta) - log_probability(contexts, characters, shared.value[0], beta)
                scores.append(np.bincount(row, weights=ratio, minlength=len(data)) / np.bincount(row, minlength=len(data)))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield batch.assign(score=pd.Series(score, index=batch.index).where(batch.url.notna()))

    names = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInPandas(add, f"{names}, score double")


def calibrate(rows: DataFrame) -> float:
    """The threshold of best balanced accuracy on rows(score, accepted), to a hundredth; 0 if a class is missing."""
    place = F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") * 100)))
    got = rows.groupBy(place.alias("p")).agg(F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum((~F.col("accepted")).cast("long")).alias("no"))
    got = sorted((r for r in got.collect() if r.p is not None), key=lambda r: r.p)
    yes, no = sum(r.yes for r in got), sum(r.no for r in got)
    if not yes or not no:
        return 0.0
    best, below_yes, below_no = (0.0, 0, 0), 0, 0
    for r, after in zip(got, [*got[1:], None]):
        below_yes, below_no = below_yes + r.yes, below_no + r.no
        right = (yes - below_yes) / yes + below_no / no
        if right > best[0]:
            best = (right, r.p + 1, after.p if after else r.p + 1)
    return (best[1] + best[2]) / 200


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], beta: float = 4.0) -> DataFrame:
    """page_id, host, path, rule, score, threshold, verdict: a row per row of pages.

    URLs that a rule decides train the models: accepted ones one, rejected ones the other.  A fifth
    of them, chosen by a hash of the URL, is held out and calibrates the threshold.  A URL without a
    rule is allowed if its mean log-likelihood difference a character, of two variable-order Markov
    models, reaches the threshold.

    Nulls: a null url, or one without ://, has an empty host and path; a null url without a rule has
    no score and is blocked.  Without rules of both kinds the ratio is one-sided and the threshold 0.
    Repeated rows get a row each; an empty table gives none.
    """
    host, path = host_and_path(F.col("url"))
    rows = bounded_batches(pages).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict"))
    rows = rows.withColumn("_held", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0)
    known = rows.filter(F.col("_verdict").isNotNull()).withColumn("accepted", F.col("_verdict") == "allow")
    counts = fit(known.filter(~F.col("_held")).select("url", "accepted"))
    out = materialize(scored(rows, counts, beta), "url-scores")
    held = out.filter(F.col("_held") & F.col("_verdict").isNotNull())
    threshold = calibrate(held.select("score", (F.col("_verdict") == "allow").alias("accepted")))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", "score", F.lit(threshold).alias("threshold"), F.coalesce("_verdict", by_model).alias("verdict"))
