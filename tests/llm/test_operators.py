"""Each operator against brute force on a small fixture with nulls, ties, repeated rows and clashing columns."""

import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from webrank.llm import chat, common, decontaminate, importance, lbl, minhash, packing, pii, quality_rules, queries, url_model, warc

DOC = "doc_id long, text string, lang string, _key string, _text string, h int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "k", "t", 1) for i, t in rows], DOC)


def prose(rng, n=60):
    return " ".join(rng.choice(["the", "red", "fox", "of", "and", f"w{rng.randrange(300)}"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    rows = [(i, prose(rng)) for i in range(30)]
    rows += [(100 + i, " ".join(f"{x}$$$" for x in prose(rng).split())) for i in range(8)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "a"), (0, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (None, None), (204, "x y z\nq\nq\n" + "one two three four five six seven eight nine " * 40), (205, "z" * 30000)]
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, 0) for i in range(0, 30, 2)] + [(100, 0, 0), (101, 0, 0), (None, 1, 0), (0, 1, 0), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_rules(spark, docs, labels):
    got = quality_rules.quality_rules(frame(spark, docs), labels, buckets=1 << 12, prior=0.5).collect()
    assert len(got) == len(docs)
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t or "")
    for r in got:
        ok = False
        for t in texts[r.doc_id]:
            w, lines = brute.words(t), [x for x in t.split("\n") if brute.words(x)]
            want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), brute.repeat_words(w))
            ok |= want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) and r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert ok, r
    want = brute.log_ratios(docs, {i for i in range(0, 30, 2)}, 1 << 12, 0.5, 32.0)
    assert sorted(round(r.llr_score, 9) for r in got) == pytest.approx(sorted(want), abs=1e-8)
    score = {r.doc_id: r.llr_score for r in got}
    assert min(score[i] for i in range(30)) > max(score[100 + i] for i in range(8))


def test_quality_rules_on_nothing(spark, labels):
    assert quality_rules.quality_rules(frame(spark, []), labels, buckets=16).count() == 0


def test_resample(spark, docs, labels):
    trusted = set(range(0, 30, 2))
    kept = {}
    for k, seed in ((None, 17), (None, 18), (12, 3), (12, 4), (0, 1), (999, 1)):
        got = importance.resample(frame(spark, docs), labels, k=k, seed=seed, buckets=1 << 12, prior=0.5).collect()
        want = brute.resampled(docs, trusted, 1 << 12, 0.5, k=k, seed=seed)
        assert sorted((str(r.doc_id), r._key, r.kept) for r in got) == sorted((str(i), brute.hash64(i, t or ""), x) for (i, t), x in zip(docs, want))
        kept[k, seed] = {r._key for r in got if r.kept}
    assert kept[12, 3] != kept[12, 4] and 9 <= len(kept[12, 3]) <= 14
    assert importance.resample(frame(spark, []), labels, buckets=16).count() == 0


def test_inclusion_follows_the_weights(spark):
    """Over many seeds, how often a row is among the top k agrees with draws without replacement by weight."""
    weights = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0]
    rows = spark.createDataFrame([(s, i, w) for s in range(3000) for i, w in enumerate(weights)], "seed int, i long, w double")
    noise = F.expr("-log(-log((shiftrightunsigned(xxhash64(i, seed), 11) + 0.5) / 9007199254740992))")
    one = rows.filter("seed = 7").select(importance.gumbel(F.col("i"), 7).alias("a"), noise.alias("b")).collect()
    assert all(r.a == pytest.approx(r.b) for r in one)
    got = rows.withColumn("key", noise + F.col("w")).groupBy("seed").agg(F.slice(F.sort_array(F.collect_list(F.struct("key", "i")), asc=False), 1, 2).alias("top"))
    often = {r.i: r.n / 3000 for r in got.select(F.explode("top.i").alias("i")).groupBy("i").agg(F.count("*").alias("n")).collect()}
    e = np.exp(weights)
    p = e / e.sum()
    for i in range(len(e)):
        want = p[i] + sum(p[j] * e[i] / (e.sum() - e[j]) for j in range(len(e)) if j != i)
        assert often[i] == pytest.approx(want, abs=0.035)


def test_kth_largest(spark, monkeypatch):
    rows = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 3, 2, 2, 9]], "x double")
    assert [common.kth_largest(rows, "x", k) for k in (0, 1, 3, 4, 7, 99)] == [None, 9, 3, 2, 1, 1]
    monkeypatch.setattr(common, "FEW", 0)
    assert [common.kth_largest(rows, "x", k) for k in (1, 2, 3, 5, 6)] == [9, 5, 3, 2, 1]
    ids = spark.createDataFrame([(i % 50, 1) for i in range(99)] + [(None, 1), (70, 0)], "doc_id long, quality int")
    some = {r.doc_id for r in common.labelled_ids(ids, 1, 20).collect()}
    want = sorted(range(50), key=lambda i: brute.hash64(i) % (1 << 64) >> 11)[:20]
    assert some == set(want) and common.labelled_ids(ids, 1, 50).count() == 50


def test_rows_are_kept_by_row(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (None, "a"), (None, None), (2, "c")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, _row string, _id int, _key int")
    decide = common.packed(docs).select("_id", "_key", ((F.col("_row.text") != "b") | F.col("_row.text").isNull()).alias("kept"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in common.keep_rows(docs, decide, once=True).collect()))) == sorted(map(str, [(1, "a"), (None, "a"), (None, None), (2, "c")]))
    by_id = common.packed(docs).select("_id", (F.col("_id") != 1).alias("kept"))
    assert common.keep_rows(docs, by_id).count() == 3 and common.keep_rows(docs, by_id).columns == docs.columns


def test_packing(spark, docs):
    rows = [*docs, (300, "word " * 9000), (301, "Élan's 42<|endoftext|> don't stop…" * 20)]
    got = packing.pack_documents(frame(spark, rows), queries.vocabulary_path()).collect()
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 4096
    assert len(bins) <= packing.lower_bound(np.array([w[3] for w in want]), 4096) + 1


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(0)
    for high in (30, 60, 101):
        sizes = rng.integers(1, high, 300)
        bins, offsets, n = packing.best_fit_decreasing(sizes, 100)
        assert (np.bincount(bins, weights=sizes) <= 100).all() and packing.lower_bound(sizes, 100) <= n
        assert n <= packing.lower_bound(sizes, 100) * 1.1 + 1
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 7), 100) == 4


def test_exchange_rounds(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, 0, rng.choice([1400, 1500, 1100, 700, 2300, 300])) for i in range(400)], "row long, piece int, length long")
    used = {}
    for rounds in (1, 3):
        placed = packing.pack(rows, per_partition=20, rounds=rounds)
        got = placed.join(rows, ["row", "piece"]).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.max("round").alias("round")).collect()
        assert sum(r.n for r in got) == sum(r.length for r in rows.collect()) and all(r.n == r.end <= 4096 for r in got)
        used[rounds], last = len(got), max(r.round for r in got)
    assert last >= 1 and used[3] < used[1]
    assert all(r.bins >= r.bound for r in placed.collect())


def test_sequences(spark):
    pieces = packing.tokenise(frame(spark, [(1, "red fox"), (2, "dog")]), queries.vocabulary_path()).cache()
    got = packing.sequences(pieces, packing.pack(pieces.select("row", "piece", "length"))).collect()
    assert len(got) == 1 and len(got[0].ids) == 4 * got[0].length == 4 * 5


def test_warc(spark):
    big = "<p>é" + "x" * 2000
    rows = [(1, "http://a/\r\nx", big), (2, "http://b", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "n", big), (9, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archive(pages.repartition(3))
    got = warc.read(index).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and i not in (9, None)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert warc.archive(pages.filter("false")).count() == 0


def test_a_capture_cut_at_the_end_of_a_record_is_an_error():
    whole = zlib.compressobj(1, zlib.DEFLATED, 31)
    cut = whole.compress(b"record one\r\n\r\n" * 900) + whole.flush(zlib.Z_SYNC_FLUSH)
    assert b"".join(warc.inflate(io.BytesIO(cut + whole.flush()))) == b"record one\r\n\r\n" * 900
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(cut)))


def test_urls(spark):
    rng = random.Random(1)
    rows = [(i, f"http://{rng.choice(['good', 'nice'])}{i % 7}.com/en/{i}") for i in range(60)] + [(100 + i, f"http://spam{i % 7}.net/fr/casino{i}") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "no-scheme.com/x"), (203, "HTTP://WWW.Example.com/en/1?x#y"), (204, "http://example.com/en/2"), (205, "http://notexample.com/en/2"), (206, "http://casino.net/zz/casino"), (207, "http://nice.org/en/1"), (207, "http://nice.org/en/1"), (208, "http://x.com"), (None, "http://a.net/es/1")]
    got = url_model.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[203].host, by[203].path, by[203].rule, by[203].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[204].rule == "example.com/en/" and by[204].verdict == "block" and by[205].rule == "com/"
    assert by[200].verdict == "block" and by[200].host == "" and by[202].rule is None and by[208].rule is None
    assert by[206].verdict == "block" and by[207].verdict == "allow" and by[None].rule == "net/es/"
    known = [(u.lower().encode(), by[i].verdict == "allow") for i, u in rows if u is not None and by[i].rule and zlib.crc32(u.encode()) % 5]
    for i in (203, 206, 207, 208, 3, 103, 201):
        url = dict(rows)[i].lower().encode()
        assert by[i].score == pytest.approx(brute.url_score(known, url, url_model.ORDER, url_model.FEWEST, 4.0), abs=2e-3), i
    assert url_model.filter_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


def test_pii(spark):
    cards = "4111 1111 1111 1111, 4111-1111-1111-1112 "
    rows = [(1, f"mail a.b@c.de_x@y.zz é {cards} +1 (555) 010-9999 ip 1.2.3.4.5.6.7.8 999.1.1.1 00255.1.1.1"), (2, None), (3, "call me +49 30 1234567 now"), (4, "@" * 50 + "1" * 20000), (5, "a" * 20000 + "@"), (3, "call me +49 30 1234567 now"), (None, "x@y.z")]
    rows += [(10 + i, f"my key number user{i}@example.org is") for i in range(12)] + [(40, "my key number (AB123456C), is here"), (41, "another word AB123456C"), (42, f"token {'0a' * 20} x")]
    got = pii.digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base = brute.base_spans(texts[r.doc_id])
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r, want)
        assert (r.n_secret or r.spans.startswith(want)) and r.n_email == sum(k == "email" for k, _, _ in base)
    by = {r.doc_id: r.spans for r in got}
    assert by[40] == "context:15:24" and by[41] == "" and by[42] == "secret:6:46"
    masked = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert masked[3] == "call me <phone> now" and masked[40] == "my key number (<context>), is here" and masked[2] is None
    own = spark.createDataFrame([(1, "mail x@y.zz", "keepme", 7, [1], "row")], "doc_id long, text string, _key string, _id int, _parts array<int>, _row string")
    assert pii.redact(own).collect()[0] == (1, "mail <email>", "keepme", 7, [1], "row")
    assert pii.digest(frame(spark, [])).count() == 0 and pii.redact(frame(spark, [])).count() == 0


def test_patterns_are_scored_by_the_graph(spark):
    rng = random.Random(8)
    edges = {(c, rng.randrange(60)) for c in range(12) for _ in range(rng.randrange(1, 14))}
    edges = [(c, i, int(i < 25 + c)) for c, i in edges]
    edges = [(c, i, int(i < 25)) for c, i, _ in edges]
    got = {r.ctx: r.p for r in pii.bootstrap(spark.createDataFrame(edges, "ctx long, inst long, seed int"), 3, 0.4, 3).collect()}
    want = brute.scored_patterns(edges, 3, 0.4, 3)
    assert set(got) == set(want) and want and all(got[c] == pytest.approx(want[c]) for c in want)


def test_near_duplicates(spark):
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(120):
        w = list(base) if i % 4 else [f"x{rng.randrange(400)}" for _ in range(50)]
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(5000)}"
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "a"), (503, "A"), (504, "a b"), (505, rows[0][1]), (505, rows[0][1]), (505, rows[7][1]), (None, "zz")]
    small, block = minhash.SMALL, minhash.BLOCK
    minhash.SMALL, minhash.BLOCK = 8, 32
    got = minhash.near_duplicates(frame(spark, rows), 3, 85).collect()
    minhash.SMALL, minhash.BLOCK = small, block
    want = brute.near_components(rows, 3, 85)
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id) for r in got if r.doc_id is not None)


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = np.concatenate([a[:250], rng.integers(0, 1 << 63, 50).astype(np.uint64)])
    small = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    sig = minhash.superminhash([a, b, small, small[:0], small])
    assert abs((sig[0] == sig[1]).mean() - 250 / 350) < 0.15 and (sig[2] == sig[4]).all() and (sig[2] != minhash.EMPTY).all() and (sig[3] == minhash.EMPTY).all()


def test_chat(spark):
    text = "</s>[INST] ok [/INST] \\ [IMAGE:0]"
    rows = [(1, 1, "assistant", text), (1, 0, "user", None), (1, 1, "assistant", text), (2, None, None, "x"), (None, 0, "[/INST]", "y"), (-1, 0, "system", "é\n")]
    rows += [(3, 0, "user", "see ![a](x/a.png) and [b](c.pdf)[IMAGE:0]"), (3, 1, "assistant", "[s](t.mp3)![](</s>.png)\\"), (3, 2, "user", "![no](a.txt) [x](y z.png)")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.typed_parts(F.col("text")))
    segments = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -1}
    assert got[1].turns_sha256 == sha(f"user\n\nassistant\n{text}\nassistant\n{text}\n") and got[1].loss_sha256 == sha(text * 2) and got[1].loss_chars == 2 * len(text)
    assert got[2].turns_sha256 == sha("\nx\n") and got[None].turns_sha256 == sha("[/INST]\ny\n") and got[-1].n_turns == 1
    assert got[3].turns_sha256 == sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows if r[0] == 3)) and got[3].loss_sha256 == sha(rows[7][3])
    assert (got[3].n_attachments, got[3].expanded_tokens) == (4, 256 + 512 + 750 + 256)
    one = segments.filter("conv_id = 3").orderBy("turn").collect()
    assert one[0].formatted == "<s>[INST]user[/INST]see [IMAGE:0] and [DOCUMENT:1]\\[IMAGE:0]</s>" and [(a.kind, a.ref) for a in one[0].attachments] == [("image", "x/a.png"), ("document", "c.pdf")]
    assert chat.read_back(segments.filter("false")).count() == 0


def test_visitor():
    part = lambda kind, **x: {"type": kind, "text": None, "ref": None, "size": None} | x
    out, attached = chat.Visitor().visit([part("text", text="see [IMAGE:0]"), part("image", ref="a.png", size=3 << 20), part("audio", ref="b.wav", size=2000), part("document", ref="c.pdf", size=2)])
    assert out == "see \\[IMAGE:0][IMAGE:0][AUDIO:1][DOCUMENT:2]" and [a[:3] for a in attached] == [("image", "a.png", 768), ("audio", "b.wav", 50), ("document", "c.pdf", 1024)]
    with pytest.raises(ValueError):
        chat.Visitor().visit([part("video")])


def test_parser_finds_turns_in_any_pieces():
    """Hostile conversations, cut at random places, give the turns that were written."""
    rng = random.Random(9)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[IMAGE:0]", "[AUDIO:12]", "a", "é\n", "<", "s>", "[", "/INST]", "\\\\</s>"]
    for _ in range(60):
        turns = [("".join(rng.choices(bits, k=rng.randrange(0, 5))), "".join(rng.choices(bits, k=rng.randrange(0, 30))), rng.random() < 0.5) for _ in range(rng.randrange(1, 6))]
        stream, attached = "", []
        for role, text, image in turns:
            stream += f"<s>[INST]{chat.escape(role)}[/INST]{chat.escape(text)}{'[IMAGE:0]' if image else ''}</s>"
            attached += [{"kind": "image", "ref": "r", "tokens": 5, "source": "![](r.png)"}] * image
        parser, at = chat.Parser(), 0
        parser.attached.extend(attached)
        while at < len(stream):
            to = at + rng.randrange(1, 70)
            parser.feed(stream[at:to])
            at = to
        parser.feed("", last=True)
        want = "".join(f"{role}\n{text}{'![](r.png)' if image else ''}\n" for role, text, image in turns)
        assert parser.turns == len(turns) and parser.digest.hexdigest() == hashlib.sha256(want.encode()).hexdigest() and parser.tokens == 5 * len(attached)
    for bad in ("x", "<s>", "<s>[INST]u</s>", "<s>[INST]u[/INST]x<s>", "<s>[INST]u[/INST]x</s>y", "<s>[INST]u[/INST][IMAGE:0]</s>"):
        with pytest.raises((ValueError, IndexError)):
            chat.Parser().feed(bad, last=True)


def test_lm(spark, docs, monkeypatch):
    for name, value in (("FREQUENT", 20), ("FLOOR", 9), ("HEAD", 8), ("HELD", 700), ("BATCH", 256)):
        monkeypatch.setattr(lbl, name, value)
    got = lbl.score(frame(spark, docs)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = lambda t: [*brute.words((t or "").translate(brute.LOWER)), 0]
    count = defaultdict(int)
    for i, t in docs:
        if not held(i):
            for w in toks(t):
                count[w] += 1
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(toks(t)), sum(w in count for w in toks(t)), round(sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t)), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.held_out == held(r.doc_id) for r in got) and all(r.score < 0 for r in got)
    assert lbl.score(frame(spark, [])).count() == 0


def some_model(n=40, width=7, dim=8):
    rng = np.random.default_rng(0)
    uni = np.arange(n, 0, -1) / (n * (n + 1) / 2)
    model = lbl.Model.initial(uni, dim, width=width)
    trainer = lbl.Trainer(model, uni)
    for _ in range(8):
        symbols = np.concatenate([[n, n], rng.integers(0, n, 300)])
        trainer.step(lbl.Texts.at(symbols, np.arange(2, 302), np.full(300, 2)))
    return model


def direct(model, symbols, i):
    """log P(symbols[i] | the symbols before), all sums written out; the text begins after two start symbols."""
    n, d, rows = len(model.rows) - 1, model.dim, model.rows.astype(float)
    q = rows[symbols[i - 1], :d] + rows[symbols[i - 2], d : 2 * d]
    far = symbols[max(2, i - lbl.WINDOW) : max(2, i - 2)]
    if len(far):
        q = q + rows[far, 2 * d : 3 * d].mean(axis=0)
    w, of = symbols[i], symbols[i] // model.width
    inside = np.arange(of * model.width, min(n, (of + 1) * model.width))
    c, r = model.classes[:, :d] @ q + model.classes[:, d], rows[inside, 3 * d : 4 * d] @ q + rows[inside, 4 * d]
    return c[of] - np.log(np.exp(c).sum()) + r[w - inside[0]] - np.log(np.exp(r).sum())


def test_lm_probabilities_against_sums_written_out():
    model, rng = some_model(), np.random.default_rng(3)
    symbols = np.concatenate([[40, 40], rng.integers(0, 40, 90)])
    text = lbl.Texts.at(symbols, np.arange(2, 92), np.full(90, 2))
    assert model.log_probability(text) == pytest.approx([direct(model, symbols, i) for i in range(2, 92)], abs=2e-4)
    total = 0.0
    for w in range(40):
        symbols[60] = w
        total += np.exp(direct(model, symbols, 60))
    assert total == pytest.approx(1, abs=1e-6)


def test_lm_gradient_of_the_far_window():
    """A step moves the rows of far words as one sum per place, written out, would."""
    rng = np.random.default_rng(1)
    symbols = np.concatenate([[30, 30], rng.integers(0, 30, 60)])
    text = lbl.Texts.at(symbols, np.arange(2, 62), np.full(60, 2))
    spread = rng.normal(size=(60, 3))
    spread[text.to <= text.since] = 0
    want = np.zeros((62, 3))
    for k in range(60):
        want[text.since[k] : text.to[k]] += spread[k]
    assert lbl.spread_back(spread, text, 62) == pytest.approx(want, abs=1e-5)


def test_lm_sums_of_runs_and_noise_are_those_of_plain_numpy():
    rng = np.random.default_rng(3)
    size = np.array([1, 2, 40, 1, lbl.LONG, lbl.LONG - 1, 300, 1])
    first = np.cumsum(size) - size
    rows = rng.normal(size=(size.sum(), 5)).astype(np.float32)
    assert lbl.run_sums(rows, first) == pytest.approx(np.add.reduceat(rows, first, axis=0), abs=1e-4)
    index = np.repeat([4, 70_000, 9], [30, 3, 1])
    at, total, times = lbl.gathered(index, rows[:34])
    assert at.tolist() == [4, 9, 70_000] and times.tolist() == [30, 1, 3] and total[1] == pytest.approx(rows[33])
    q, r, noise = np.append(rows[:9], np.ones((9, 1), np.float32), axis=1), rng.normal(size=(7, 6)).astype(np.float32), rng.normal(size=7).astype(np.float32)
    assert lbl.against_noise(q, r, noise) == pytest.approx(lbl.squash(q @ r.T - noise), abs=1e-5)


def test_lm_learns():
    rng = np.random.default_rng(0)
    uni = np.full(6, 1 / 6)
    model = lbl.Model.initial(uni, 8, width=6)
    trainer = lbl.Trainer(model, uni, rate=0.3)
    for _ in range(60):
        symbols = np.concatenate([[6, 6], (rng.integers(0, 6) + np.arange(512)) % 6])
        trainer.step(lbl.Texts.at(symbols, np.arange(2, 514), np.full(512, 2)))
    symbols = np.array([6, 6, 1, 2, 3, 4, 5, 0])
    assert np.exp(model.log_probability(lbl.Texts.at(symbols, np.array([7]), np.array([2]))))[0] > 0.9


def test_lm_scores_beat_the_base_where_contexts_tell(spark, monkeypatch):
    """Held-out texts of two invented languages: the model beats the unigram by 0.2 a token, and right pairs beat wrong ones."""
    monkeypatch.setattr(lbl, "HEAD", 100)
    rng = random.Random(5)
    pairs = [[(f"a{i}x{k}", f"b{i}y{k}") for i in range(12)] for k in range(2)]
    rows = [(i, " ".join(" ".join([*rng.choices([f"c{j}z{i % 2}" for j in range(40)], k=4), *rng.choice(pairs[i % 2])]) for _ in range(60))) for i in range(800)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows += [(held[0], " ".join(f"c0z0 a{i}x0 b{i}y0" for i in range(12))), (held[1], " ".join(f"c0z0 a{i}x0 b{(i + 5) % 12}y0" for i in range(12)))]
    got = lbl.score(frame(spark, rows), rounds=2).collect()
    own = {r.doc_id: r for r in got}
    assert own[held[0]].score > own[held[1]].score + 2
    out = [r for r in got if r.held_out and r.doc_id < 800]
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.2


def test_decontamination(spark):
    rng = random.Random(6)
    item = [f"b{i}" for i in range(20)]
    rows = [(i, prose(rng)) for i in range(6)]
    rows += [(10, "x " + " ".join(item).upper() + " y"), (11, " ".join(item[:13])), (12, " ".join(item[:12])), (13, "- tiny, Item! - and fox" * 2), (14, None), (11, " ".join(item[:13])), (None, " ".join(item[3:17])), (15, "b0 b2 b1 " * 9), (16, " ".join([*item[:5], item[6], item[5], *item[7:15]]))]
    bench = [(1, " ".join(item)), (2, "tiny item"), (10, " ".join(item[2:16])), (3, None), (4, "!!"), (1, " ".join(item))]
    docs, benchmark = frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.decontaminate(docs, benchmark).collect()
    windows, want = brute.benchmark_windows(bench), []
    for (i, t), near in zip(rows, brute.near_windows(rows, windows, decontaminate.SLOP)):
        w, hit, items = brute.benchmark_hits(t, windows)
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), near))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want)) and max(x[-1] for x in want) >= 1
    assert decontaminate.decontaminate(frame(spark, []), benchmark).count() == 0
    clean = decontaminate.decontaminate(docs, benchmark.filter("false")).collect()
    assert len(clean) == len(rows) and not any(r.contaminated or r.n_near for r in clean)


def test_proximity_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(9)]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 7)))) for i in range(12)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))) for i in range(40)]
    got = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), size=4, slop=1).collect()
    windows = brute.benchmark_windows(bench, 4)
    near = brute.near_windows(rows, windows, 1)
    want = {i: (len(brute.benchmark_hits(t, windows)[1]), n) for (i, t), n in zip(rows, near)}
    assert {r.doc_id: (r.n_hit, r.n_near) for r in got} == want and sum(near) >= 20


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages on a small table: who is left after each decision, and the tokens of what is packed."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]
    rng = random.Random(12)
    words = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage = " ".join(f"exam{i}" for i in range(20))
    rows = [(i, say(80)) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(6)] + [(5, rows[5][1]), (None, say(60)), (None, None), (200, ""), (7, say(50))]
    rows += [(300 + i, f"{say(700)} {passage} {say(700)}") for i in range(3)] + [(310, f"{say(30)} {' '.join(passage.split()[:12])} {say(30)}")]
    rows += [(400 + i, " ".join(f"{x}$$$" for x in say(120).split())) for i in range(12)]
    rows += [(500, f"{say(30)} write to jo.doe{1}@example.com or +1 (555) 010-9999 {say(30)}"), (501, f"{say(30)} 10.0.0.1 {'4f' * 20} {say(9)}"), (502, say(9000))]
    bench = [(1, passage), (2, None)]
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(400, 0, 0), (401, 0, 0), (None, 1, 0)]
    make = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    make([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    make(labels, "doc_id long, quality int, toxic int", "labels")
    make(bench, "item_id long, text string", "benchmark")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = brute.resampled(rows, {i for i, q, _ in labels if q == 1 and i is not None}, 1 << 16, 20.0)
    left = [r for r, k in zip(rows, kept) if k]
    clean = [k for r, k in zip(rows, kept) if r[0] is None or not 400 <= r[0] < 500]
    assert sum(clean) >= 0.97 * len(clean) and not any(400 <= (r[0] or 0) < 500 for r in left)
    groups = brute.near_components(left, 5, 80)
    left = list(dict.fromkeys(r for r in left if r[0] is None or groups[r[0]] == r[0]))
    windows = brute.benchmark_windows(bench)
    left = [r for r in left if not brute.benchmark_hits(r[1], windows)[1]]
    assert not {100, 300, 301, 302} & {r[0] for r in left} and 310 in {r[0] for r in left}
    tokenizer, want = Tokenizer.from_file(queries.vocabulary_path()), []
    for i, t in left:
        ids = [*tokenizer.encode(brute.redacted(t) or "", add_special_tokens=False).ids, 1]
        want += [(str(i), p, at, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.ids_crc32) for r in got) == sorted(want)


def test_nothing_in_nothing_out(spark):
    none = frame(spark, [])
    assert packing.pack_documents(none, queries.vocabulary_path()).count() == 0
    assert minhash.near_duplicates(none).count() == 0
