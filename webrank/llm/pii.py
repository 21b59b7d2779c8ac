"""Personal data: fixed patterns, and bootstrapped contextual extraction.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrank.llm.common import materialize, packed, row_id, row_key, small

#: Bound on the patterns that are broadcast; beyond it the same joins shuffle.
PATTERNS = 500_000
KINDS = ["email", "ip", "card", "phone", "secret", "context"]
#: Kinds of the base; the method adds the others.
BASE = KINDS[:4]
#: Each pattern starts where the plain one's leftmost match would; a look-behind and possessive
#: repeats keep the search linear in texts with very long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Seeds of credentials: access keys of a fixed form, and 40 lower-case hexadecimal digits.
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])"
WORD = r"[^\x20\x09-\x0D]+"
#: What stands around an identifier in its word, and isn't part of it.
LEAD, TRAIL = r"^[\"'(\[{<]+", r"[\"')\]}>.,;:!?#*$%&|]+$"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    values = F.reverse(F.transform(F.split(number, ""), lambda x: x.cast("int")))
    value = F.transform(values, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """Whether a match of this kind holds."""
    number = digits(match)
    part = F.forall(F.split(match, r"\."), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    card = F.length(number).between(16, 19) & luhn(F.when(F.length(number).between(16, 19), number))
    return (
        F.when(kind == "ip", part)
        .when(kind == "card", card)
        .when(kind == "phone", F.length(number).between(8, 15))
        .otherwise(F.lit(True))
    )


def matches(rows: DataFrame) -> DataFrame:
    """_id, _key, kind, start, end (code points): the matches of all fixed patterns.

    Spark has no function for the places of matches.  A text's pieces between matches give them: a
    match starts after all pieces and matches before it, a running sum over the rows of a text.
    """
    text = F.col("_text")

    def found(kind: str, pattern: str, when: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), gaps.alias("gap"))
        return F.when(when, F.struct(F.lit(kind).alias("kind"), zipped.alias("found")))

    digit = text.rlike("[0-9]")
    every = F.array(
        found("email", EMAIL, text.contains("@")),
        found("ip", IP, text.rlike(r"[0-9]\.[0-9]")),
        found("card", CARD, digit),
        found("phone", PHONE, text.rlike(r"\+[0-9]")),
        found("secret", SECRET, digit & text.rlike(SECRET)),
    )
    rows = rows.filter(text.rlike("[0-9@]")).select("_id", "_key", F.monotonically_increasing_id().alias("_n"), F.explode(every).alias("k"))
    rows = rows.select("_id", "_key", "_n", "k.kind", F.posexplode("k.found").alias("i", "f"))
    rows = rows.select("_id", "_key", "_n", "kind", "i", F.col("f.match").alias("match"), F.col("f.gap").alias("gap"))
    rows = rows.withColumn("n", F.coalesce(F.length("match"), F.lit(0)))
    order = Window.partitionBy("_n", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("end", end).filter(F.col("match").isNotNull() & passes(F.col("kind"), F.col("match")))
    return rows.select("_id", "_key", "kind", (F.col("end") - F.col("n")).alias("start"), "end").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _key, _text: _id and _key tell texts apart; rows that are equal in both have equal results."""
    return docs.select("doc_id", row_id().alias("_id"), row_key().alias("_key"), F.coalesce("text", F.lit("")).alias("_text"))


def slots(rows: DataFrame, some: Column | None = None) -> DataFrame:
    """_id, _key, i, word, ctx: the contexts of every word of keyed() rows, or of `some` of them.

    A context is the word before, the two before, the word after, or the words on both sides, by hash,
    lower-cased and with digits as 0; those that would reach beyond the text are left out.
    """
    found = lambda text: F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = rows.select("_id", "_key", found(F.col("_text")).alias("_w"), found(F.translate(F.lower("_text"), "123456789", "000000000")).alias("_h"))
    # Neighbours are zipped as shifted arrays: a look-up by index would be folded into a lambda that finds all words again for each.
    none = F.lit(None).cast("string")
    shifted = F.arrays_zip(F.col("_w").alias("word"), F.concat(F.array(none), "_h").alias("a"), F.concat(F.array(none, none), "_h").alias("b"), F.slice("_h", 2, F.greatest(F.size("_h"), F.lit(1))).alias("c"))
    rows = rows.select("_id", "_key", F.posexplode(shifted).alias("i", "p")).select("_id", "_key", "i", "p.*").filter("word is not null")
    if some is not None:
        rows = rows.filter(some)
    both = lambda kind, x, y: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.xxhash64(F.lit(kind), x, y))
    every = F.array(both(1, "a", "a"), both(2, "b", "a"), both(3, "c", "c"), both(4, "a", "c"))
    return rows.select("_id", "_key", "i", "word", F.explode(every).alias("ctx")).filter("ctx is not null")


def seed(word: Column) -> Column:
    """Whether a word holds an entity of a fixed pattern."""
    number = F.regexp_extract(word, "[0-9]{16,19}", 0)
    phone = F.regexp_extract(word, PHONE, 0)
    card = (F.length(number) > 0) & ~word.rlike("[0-9]{20}") & luhn(number)
    ip = F.regexp_extract(word, IP, 0)
    some = word.rlike(EMAIL) | word.rlike(SECRET) | ((F.length(ip) > 0) & passes(F.lit("ip"), ip)) | card | ((phone != "") & F.length(digits(phone)).between(8, 15))
    return F.when(word.rlike("[0-9@]"), some).otherwise(F.lit(False))


def induced(docs: DataFrame, support: int, floor: float) -> DataFrame:
    """ctx: the contexts of at least `support` different seeds that fill at least the share `floor` of their places in the corpus."""
    rows = keyed(docs)
    seeds = slots(rows.filter(F.col("_text").rlike("[0-9@]")), seed(F.col("word"))).groupBy("ctx", F.xxhash64("word").alias("inst")).agg(F.count("*").alias("n"))
    seeds = seeds.groupBy("ctx").agg(F.count("*").alias("insts"), F.sum("n").alias("seeds")).filter(F.col("insts") >= support)
    seeds = materialize(seeds, "pii-induced")
    if not seeds.limit(1).count():
        return seeds.select("ctx")
    filled = slots(rows).select("ctx").join(small(seeds.select("ctx"), PATTERNS), "ctx", "left_semi").groupBy("ctx").agg(F.count("*").alias("fills"))
    return materialize(seeds.join(filled, "ctx").filter(F.col("seeds") >= floor * F.col("fills")).select("ctx"), "pii-patterns")


def bootstrap(edges: DataFrame, rounds: int, least: float, support: int) -> DataFrame:
    """ctx, p: the patterns of a score of at least `least`, from edges(ctx, inst, seed), distinct by ctx and inst.

    Seeds score 1.  Each round, a pattern's score is the sum of its instances' over their number plus
    one, and a new instance's is the noisy-or of its patterns'.  Patterns of fewer than `support`
    instances don't count.
    """
    score = edges.groupBy("inst").agg(F.max("seed").cast("double").alias("s"))
    patterns = None
    for _ in range(rounds):
        patterns = edges.join(score, "inst").groupBy("ctx").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
        patterns = materialize(patterns.filter(F.col("n") >= support).select("ctx", (F.col("s") / (F.col("n") + 1)).alias("p")), "pii-scores")
        either = 1 - F.exp(F.sum(F.log(1 - 0.95 * F.coalesce("p", F.lit(0.0)))))
        score = edges.join(patterns, "ctx", "left").groupBy("inst").agg(F.when(F.max("seed") == 1, 1.0).otherwise(either).alias("s"))
    return patterns.filter(F.col("p") >= least)


def placed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """_id, _key, start, end: where the words found(_id, _key, i) stand, without the marks around them."""
    texts = keyed(docs).join(small(found.select("_id", "_key").distinct(), 500_000), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    gaps = F.transform(F.split("_text", WORD, -1), lambda x: F.length(x))
    rows = texts.select("_id", "_key", F.posexplode(F.arrays_zip(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("word"), gaps.alias("gap"))).alias("i", "x"))
    n = F.coalesce(F.length("x.word"), F.lit(0))
    order = Window.partitionBy("_id", "_key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("_id", "_key", "i", "x.word", n.alias("n"), F.sum(F.col("x.gap") + n).over(order).alias("stop"))
    rows = rows.join(found.select("_id", "_key", "i").distinct(), ["_id", "_key", "i"])
    lead = F.length(F.regexp_extract("word", LEAD, 0))
    inner = F.length(F.regexp_replace(F.regexp_replace("word", LEAD, ""), TRAIL, ""))
    start = F.col("stop") - F.col("n") + lead
    return rows.select("_id", "_key", start.alias("start"), (start + inner).alias("end")).filter("end > start")


def clear_of(new: DataFrame, fixed: DataFrame) -> DataFrame:
    """The rows (_id, _key, start, end) of `new` that overlap none of `fixed`, by running extremes over a text's spans."""
    columns = ["_id", "_key", "start", "end"]
    rows = fixed.select(*columns, F.lit(0).alias("own")).unionByName(new.select(*columns, F.lit(1).alias("own")))
    order = Window.partitionBy("_id", "_key").orderBy("start", "own", "end")
    before = F.max(F.when(F.col("own") == 0, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("own") == 0, F.col("start"))).over(Window.partitionBy("_id", "_key").orderBy(F.desc("start"), F.desc("own"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"before": before, "after": after}).filter("own = 1")
    return rows.filter((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))).select(columns)


def find(docs: DataFrame, rounds: int = 3, least: float = 0.7, support: int = 3, floor: float = 0.05) -> DataFrame:
    """_id, _key, kind, start, end: every span of personal data, by fixed patterns and by context.

    Words that hold an entity of a fixed pattern are seeds and induce contexts.  A graph of the contexts
    and all words that fill them anywhere in the corpus is scored in rounds; a word in the place of a
    high-confidence context that overlaps no other span becomes a `context` span.  Contexts that seeds
    fill in fewer than the share `floor` of places are left out of the graph, which so has at most
    1 / floor times the seeds' places as edges.  Rows of equal doc_id and text share their spans.
    """
    fixed = materialize(matches(keyed(docs)), "pii-found")
    columns = ["_id", "_key", "kind", "start", "end"]
    patterns = induced(docs, support, floor)
    if not patterns.limit(1).count():
        return fixed.select(columns)
    fills = slots(keyed(docs)).join(small(patterns, PATTERNS), "ctx").withColumn("inst", F.xxhash64("word")).withColumn("seed", seed(F.col("word")).cast("int"))
    fills = materialize(fills.select("_id", "_key", "i", "ctx", "inst", "seed"), "pii-fills")
    edges = materialize(fills.groupBy("ctx", "inst").agg(F.max("seed").alias("seed")), "pii-edges")
    good = bootstrap(edges, rounds, least, support)
    new = materialize(fills.filter("seed = 0").join(small(good, PATTERNS), "ctx", "left_semi").select("_id", "_key", "i").distinct(), "pii-new")
    if not new.limit(1).count():
        return fixed.select(columns)
    new = clear_of(placed(docs, new), fixed).withColumn("kind", F.lit("context"))
    return materialize(fixed.select(columns).unionByName(new.select(columns)), "pii-spans")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_context, base_sha256, spans: a row per row of docs.

    Nulls: a null text is empty and has no spans; a null doc_id is carried through.  Repeated rows get
    a row each, with the same spans.  Only spans are joined, never texts.  An empty table gives no rows.
    """
    spans = find(docs, **options)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    rows = spans.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.struct(number.alias("k"), "start", "end"))).alias("all"))
    count = lambda k: F.coalesce(F.size(F.filter("all", lambda s: s["k"] == k)), F.lit(0)).cast("long")
    out = keyed(docs).select("doc_id", "_id", "_key").join(rows, ["_id", "_key"], "left")
    out = out.withColumn("all", F.coalesce("all", F.array().cast("array<struct<k:int,start:bigint,end:bigint>>")))
    counts = [count(i + 1).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    base = F.filter("all", lambda s: s["k"] <= len(BASE))
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of its text replaced by <kind>; all columns stay, n_chars follows where it exists.

    Overlapping spans are cut to what the earlier ones leave.  The spans of a text are put in order by
    a window over their own rows; texts are joined with them once.  A row goes through the join as a
    struct, so columns of docs may have any names.
    """
    spans = find(docs, **options).distinct()
    order = Window.partitionBy("_id", "_key").orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(order), F.lit(0)))).filter("end > from")
    parts = spans.groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct("from", "end", "kind"))).alias("_parts"))
    parts = materialize(parts, "pii-parts")
    rows = packed(docs).join(small(parts, 500_000), ["_id", "_key"], "left")
    text = F.col("_row.text")
    at = lambda i: F.coalesce(F.get("_parts", i - 1)["end"], F.lit(0)).cast("int")
    piece = F.transform("_parts", lambda x, i: F.concat(F.substring(text, at(i) + 1, x["from"].cast("int") - at(i)), F.lit("<"), x["kind"], F.lit(">")))
    rest = F.substring(text, at(F.size("_parts")) + 1, F.length(text))
    rows = rows.select("_row", "_parts", F.when(F.col("_parts").isNull(), text).otherwise(F.concat(F.array_join(piece, ""), rest)).alias("_text"))
    out = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_parts").isNull(), out["n_chars"]).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(x.alias(c) for c, x in out.items()))
