"""Brute-force versions that the operators are compared with."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter, defaultdict

import regex
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_components(docs, n, least):
    sets = defaultdict(set)
    owner = []
    for doc_id, text in docs:
        w = words((text or "").translate(LOWER))
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        owner.append((doc_id, frozenset(s)))
    parent = {d: d for d, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(owner):
        for b, t in owner[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= least * len(s | t):
                u, v = sorted((top(a), top(b)))
                parent[v] = u
    return {d: top(d) for d, _ in docs}


def repeat_words(w, size=8):
    count = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    hit = set()
    for i in range(len(w) - size + 1):
        if count[tuple(w[i : i + size])] > 1:
            hit |= set(range(i, i + size))
    return len(hit)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def hash64(*values, seed=42):
    """Spark's xxhash64 of strings, longs (ints) and nulls, in turn."""
    for x in values:
        if x is not None:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<q", x), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def n_grams(text, n):
    """The hashed uni- and bigrams of a text; a token without a successor has a bigram of its own."""
    tokens, out = regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+", text or ""), []
    for a, b in zip(tokens, [*tokens[1:], None]):
        out += [hash64(a) % n, n if a == b else hash64(a, b) % n]
    return out


def log_ratios(docs, trusted, n, prior, damping):
    """For each text, the mean log of the target's over the raw model's probability of its n-grams."""
    grams = [n_grams(t, n) for _, t in docs]
    raw, target = Counter(), Counter()
    for (i, _), g in zip(docs, grams):
        raw.update(g)
        if i in trusted:
            target.update(g)
    share = sum(target.values()) / (sum(raw.values()) or 1)
    llr = {g: math.log((target[g] + prior) / (raw[g] * share + prior)) for g in raw}
    return [sum(llr[x] for x in g) / (len(g) + damping) for g in grams]


def gumbel(doc_id, text, seed):
    """Noise by row and seed; Spark hashes the seed as a number of four bytes."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), hash64(hash64(doc_id, text or "")) % (1 << 64))
    u = ((h >> 11) + 0.5) / (1 << 53)
    return -math.log(-math.log(u))


def resampled(docs, trusted, n, prior, damping=32.0, length=20.0, quantile=0.01, k=None, seed=17):
    """Whether importance resampling keeps each row."""
    held = {i for i in trusted if hash64(i, "held") % 5 == 0}
    weights = [length * x for x in log_ratios(docs, trusted - held, n, prior, damping)]
    if k is None:
        own = sorted((w for (i, _), w in zip(docs, weights) if i in held), reverse=True)
        bound = own[max(1, math.ceil(len(own) * (1 - quantile))) - 1] if own else 0.0
        k = round(sum(math.exp(min(0.0, w - bound)) for w in weights))
    keys = [w + gumbel(i, t, seed) for (i, t), w in zip(docs, weights)]
    least = sorted(keys, reverse=True)[min(k, len(keys)) - 1] if k > 0 else math.inf
    return [x >= least for x in keys]


def benchmark_words(text):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if x]


def benchmark_windows(bench, size=13):
    return {(i, tuple(w[k : k + size])) for i, t in bench if (w := benchmark_words(t)) for k in range(max(1, len(w) - size + 1))}


def benchmark_hits(text, windows):
    """Words inside windows, and the items."""
    w, hit, items = benchmark_words(text), set(), set()
    for item_id, win in windows:
        for k in range(len(w) - len(win) + 1):
            if tuple(w[k : k + len(win)]) == win:
                hit |= set(range(k, k + len(win)))
                items.add(str(item_id))
    return w, hit, items


def near_windows(docs, windows, slop):
    """Per document, how many windows have every word within slop places of where their rarest word puts it, and no exact match."""
    every = [benchmark_words(t) for _, t in docs]
    count, out = Counter(x for w in every for x in w), []
    for w in every:
        found = 0
        for win in {win for _, win in windows}:
            rare = min(range(len(win)), key=lambda o: (count[win[o]], o))
            starts = [p - rare for p, x in enumerate(w) if x == win[rare]]
            near = any(all(any(w[p] == x for p in range(max(0, s + o - slop), min(len(w), s + o + slop + 1))) for o, x in enumerate(win)) for s in starts)
            found += near and not any(tuple(w[k : k + len(win)]) == win for k in range(len(w)))
        out.append(found)
    return out


def redacted(text):
    """A text with its base and secret spans replaced by their kinds."""
    spans = [(a, b, k) for k, a, b in base_spans(text)] + [(m.start(), m.end(), "secret") for m in re.finditer(r"(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])", text or "")]
    out, at = "", 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if b > at:
            out += text[at : max(a, at)] + f"<{k}>"
            at = b
    return None if text is None else out + text[at:]


def url_score(urls, url, order, fewest, beta):
    """Mean difference of the logarithms of two variable-order models, fitted to urls of (bytes, accepted), over a URL's bytes."""

    def pairs(x):
        x = x + b"\xff"
        for i in range(len(x)):
            padded = b"\xff" * order + x[:i]
            yield [padded[len(padded) - k :] for k in range(order + 1)], x[i]

    total = 0.0
    for accepted, sign in ((True, 1), (False, -1)):
        context, after = Counter(), Counter()
        for u, a in urls:
            if a == accepted:
                for contexts, c in pairs(u):
                    context.update(contexts)
                    after.update((x, c) for x in contexts)
        for contexts, c in pairs(url):
            p = 1 / 256
            for x in contexts:
                if context[x] < fewest:
                    break
                p = (after[x, c] + beta * p) / (context[x] + beta)
            total += sign * math.log(p)
    return total / (len(url) + 1)


def scored_patterns(edges, rounds, least, support):
    """Contexts of a graph's edges (ctx, inst, seed) whose final score is at least `least`."""
    inst_of, ctx_of, seeds = defaultdict(set), defaultdict(set), {i for _, i, s in edges if s}
    for c, i, _ in edges:
        inst_of[c].add(i)
        ctx_of[i].add(c)
    score = {i: float(i in seeds) for i in ctx_of}
    for _ in range(rounds):
        p = {c: sum(score[i] for i in x) / (len(x) + 1) for c, x in inst_of.items() if len(x) >= support}
        score = {i: 1.0 if i in seeds else 1 - math.prod(1 - 0.95 * p.get(c, 0.0) for c in x) for i, x in ctx_of.items()}
    return {c: x for c, x in p.items() if x >= least}
