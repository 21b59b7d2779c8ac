"""Crawl rules and level-by-level crawl rounds over an injectable fetcher."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webrank.config import BLOCKED_ACTIONS, BLOCKED_EXTENSIONS, TRAP_PATHS, TRAP_QUERY_KEYS, Settings
from webrank.functions import urls as U
from webrank.functions.html import next_links, visible_text
from webrank.functions.text import to_text, tokenize_with_stop_words
from webrank.sources.scratch import materialize, new_path

BAD_STATUS = [404, 410, 403, *range(600, 608)]


def allowed_domains(seeds: DataFrame) -> DataFrame:
    """Distinct lower-case network locations of seeds(url)."""
    return seeds.select(F.lower(U.part(F.col("url"), U.NETLOC)).alias("domain")).filter("domain <> ''").distinct()


def host_allowed(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one: one of its own suffixes is in the list."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.coalesce(F.arrays_overlap(suffixes, F.array(*map(F.lit, domains)).cast("array<string>")), F.lit(False))


def has_trap_query(query: Column) -> Column:
    keys = F.array(*map(F.lit, TRAP_QUERY_KEYS))
    return F.exists(U.query_pairs(query), lambda p: F.array_contains(keys, p["key"]))


def has_trap_path(path: Column) -> Column:
    out = F.lit(False)
    for trap in TRAP_PATHS:
        out = out | F.lower(path).contains(trap)
    return out


def events_trap(path: Column) -> Column:
    p = F.lower(path)
    return p.contains("/events/") & (p.contains("/day/") | p.contains("/list") | p.contains("/month"))


def wiki_trap(path: Column, query: Column) -> Column:
    value = lambda key: F.element_at(F.filter(U.query_pairs(query, keep_case=True), lambda p: p["key"] == key), -1)["value"]
    bad = F.coalesce(value("do").isin(*BLOCKED_ACTIONS), F.lit(False)) | value("rev").isNotNull() | (value("idx").isNotNull() & value("id").isNull())
    return F.lower(path).contains("doku.php") & bad


def blocked_extension(path: Column) -> Column:
    return F.lower(path).rlike(rf"(?-s)\A.*\.({'|'.join(BLOCKED_EXTENSIONS)})$")


def reject_reason(url: Column, domains: list[str] | None = None) -> Column:
    """The first rule that rejects a URL; null if it is valid.  Bad URLs and query variants are tables: see valid()."""
    scheme, path, query = U.part(url, U.SCHEME), U.part(url, U.PATH), U.part(url, U.QUERY)
    host = U.hostname(url)
    rules = [("unparsable", url.isNull() | U.unparsable(url)), ("scheme", ~scheme.isin("http", "https")), ("host", host.isNull())]
    if domains:
        rules.append(("domain", ~host_allowed(host, domains)))
    rules += [("trap_path", has_trap_path(path)), ("trap_query", has_trap_query(query)), ("events", events_trap(path)), ("wiki", wiki_trap(path, query)), ("extension", blocked_extension(path))]
    return F.coalesce(*[F.when(rule, name) for name, rule in rules])


def too_many_variants(rows: DataFrame, order: str = "arrival", limit: int = 20) -> DataFrame:
    """rows(url, ...) with `variants` (distinct queries seen so far at its host and path) and `too_many`.

    A URL's own query counts before the test, so from the first query beyond the limit on, every URL
    with a query is too much there.  URLs without a query never are.
    """
    rows = rows.withColumns({"_q": U.part(F.col("url"), U.QUERY), "_k": F.lower(F.concat_ws("\n", U.part(F.col("url"), U.NETLOC), U.part(F.col("url"), U.PATH)))})
    first = F.when(F.row_number().over(Window.partitionBy("_k", "_q").orderBy(order)) == 1, 1).otherwise(0)
    rows = rows.withColumn("_first", F.when(F.col("_q") != "", first).otherwise(0))
    seen = F.sum("_first").over(Window.partitionBy("_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("variants", F.when(F.col("_q") != "", seen).otherwise(F.lit(0)))
    return rows.withColumn("too_many", F.col("variants") > limit).drop("_q", "_k", "_first")


def with_variant(rows: DataFrame) -> DataFrame:
    """rows(url) with _k, the host and path, and _q, the query."""
    key = F.lower(F.concat_ws("\n", U.part(F.col("url"), U.NETLOC), U.part(F.col("url"), U.PATH)))
    return rows.withColumns({"_q": U.part(F.col("url"), U.QUERY), "_k": key})


def within_limit(rows: DataFrame, order: str, limit: int, seen: DataFrame | None = None) -> DataFrame:
    """rows of with_variant() with `ok`: whether too_many_variants() would accept them after what seen(_k, _q) has.

    Only where the limit is met counts: the place of the first query beyond it at each host and path.
    It is found among distinct queries, in two steps of which the first is salted, so no task gets
    all of a host's URLs.
    """
    new = rows.filter("_q <> ''").groupBy("_k", "_q").agg(F.min(order).alias("_first"))
    old = rows.sparkSession.createDataFrame([], "_k string, _before long")
    if seen is not None:
        new = new.join(seen, ["_k", "_q"], "left_anti")
        old = seen.groupBy("_k").agg(F.count("*").alias("_before"))
    salted = Window.partitionBy("_k", F.pmod(F.xxhash64("_q"), F.lit(64))).orderBy("_first")
    new = new.withColumn("_at", F.row_number().over(salted)).filter(F.col("_at") <= limit + 1)
    new = new.withColumn("_at", F.row_number().over(Window.partitionBy("_k").orderBy("_first"))).join(old, "_k", "left")
    cut = new.filter(F.col("_at") == limit + 1 - F.coalesce("_before", F.lit(0))).select("_k", F.col("_first").alias("_cut"))
    rows = rows.join(cut, "_k", "left").join(old, "_k", "left")
    many = (F.coalesce("_before", F.lit(0)) > limit) | F.coalesce(F.col(order) >= F.col("_cut"), F.lit(False))
    return rows.withColumn("ok", (F.col("_q") == "") | ~many).drop("_cut", "_before")


def without_bad(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """rows(url) whose canonical URL isn't in bad(url)."""
    rows = rows.withColumn("_n", U.normalize_crawl(F.col("url")))
    return rows.join(bad.select(F.col("url").alias("_n")).distinct(), "_n", "left_anti").drop("_n")


def judged(rows: DataFrame, domains: list[str] | None = None, bad: DataFrame | None = None, order: str = "arrival", limit: int = 20, seen: DataFrame | None = None) -> DataFrame:
    """rows(url, arrival) that pass the rules before that of variants, with `ok` (whether all rules accept them), _k and _q."""
    late = ("events", "wiki", "extension")
    # written, or the filters and joins below would each work out all rules again
    rows = materialize(rows.withColumn("_why", reject_reason(F.col("url"), domains)), "judged").filter(F.col("_why").isNull() | F.col("_why").isin(*late))
    rows = without_bad(rows, bad) if bad is not None else rows
    return within_limit(with_variant(rows), order, limit, seen).withColumn("ok", F.col("ok") & F.col("_why").isNull()).drop("_why")


def valid(rows: DataFrame, domains: list[str] | None = None, bad: DataFrame | None = None, order: str = "arrival", limit: int = 20, seen: DataFrame | None = None) -> DataFrame:
    """rows(url, arrival) that every rule accepts; only URLs that pass the earlier rules count as variants."""
    return judged(rows, domains, bad, order, limit, seen).filter("ok").drop("ok", "_k", "_q")


def bad_urls(responses: DataFrame) -> DataFrame:
    """url (canonical) of responses of a bad status that carry a body."""
    bad = responses.filter(F.col("status").isin(*BAD_STATUS) & F.col("body").isNotNull())
    return bad.select(U.normalize_crawl(F.regexp_replace(F.coalesce("final_url", "url"), "#.*", "")).alias("url")).distinct()


def readable(responses: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """url, final_url, html, text of HTML responses of status 200 with enough words."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    rows = responses.filter((F.col("status") == 200) & F.col("body").isNotNull() & ((kind == "") | kind.contains("text/html")))
    rows = rows.withColumn("html", to_text("body")).withColumn("text", visible_text("html"))
    return rows.filter(F.size(tokenize_with_stop_words(F.col("text"))) >= settings.min_words).select("url", F.coalesce("final_url", "url").alias("final_url"), "html", "text")


def scrape(responses: DataFrame, domains: list[str] | None = None, bad: DataFrame | None = None, settings: Settings = Settings(), seen: DataFrame | None = None) -> DataFrame:
    """source, url, ok: the canonical links of readable responses that the rules before that of variants accept.

    ok tells whether the others do, too, given the variants seen(_k, _q) before.
    """
    rows = readable(responses, settings).select(F.col("url").alias("source"), F.posexplode(next_links("final_url", "html")).alias("i", "link"))
    # written, so that pages are parsed once and no rule holds the expression of the canonical URL in place of the URL
    rows = materialize(rows.select("source", "i", U.normalize_crawl(F.col("link")).alias("url")), "scraped").filter("url <> ''")
    rows = rows.withColumn("arrival", F.struct("source", "i", "url"))
    return judged(rows, domains, bad, limit=settings.max_variants, seen=seen).select("source", "url", "ok")


def last_round(spark: SparkSession, root: str) -> int:
    """The number of the last round stored whole under root; -1 without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/round-*/done/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(x.getPath().getParent().getParent().getName()[len("round-") :]) for x in found), default=-1)


def crawl(spark: SparkSession, seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_rounds: int | None = None, max_pages: int | None = None, state: str | None = None, settings: Settings = Settings(), threads: int | None = None) -> DataFrame:
    """url, depth, round responses of a crawl from seeds(url), level by level, until the frontier is empty.

    A round fetches the frontier, dealt by host (to `threads` tasks, if given), stores the responses,
    and adds links whose hash is unseen.  What each round adds is stored in the shared folder, or under
    `state`: its responses, new bad URLs, the query variants it met and the frontier it leaves.  A crawl with a `state` resumes
    after its last whole round, from the frontier's URLs that are still valid, and gives the earlier
    rounds' responses too.  max_rounds and max_pages limit one call; what they leave stays in the frontier.
    """
    domains = [r.domain for r in allowed_domains(seeds).collect()]  # as many as the operator gives seeds
    root = state.rstrip("/") if state else new_path(spark, "crawl")
    last = last_round(spark, root)
    at = lambda i: f"{root}/round-{i:06d}"
    stored = lambda name, first=0: spark.read.parquet(*(f"{at(i)}/{name}" for i in range(first, last + 1)))

    def store(rows: DataFrame, name: str) -> DataFrame:
        path = f"{at(last + 1)}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def end_round() -> None:
        nonlocal last
        store(spark.range(1), "done")
        last += 1

    if last < 0:
        first = seeds.filter(U.valid_seed(F.col("url"))).select(U.normalize_frontier(F.col("url")).alias("url"))
        frontier = store(first.withColumn("hash", U.url_hash(F.col("url"))).dropDuplicates(["hash"]).select("url", "hash", F.lit(0).alias("depth")), "frontier")
        end_round()
    else:
        frontier = stored("frontier", last)
        bad = stored("bad", 1).distinct() if last > 0 else None
        if last > 0:
            frontier = valid(frontier.withColumn("arrival", F.col("url")), domains, bad, limit=settings.max_variants).drop("arrival")
        frontier = materialize(frontier, "frontier")
    # round 0 is the seeds'; a round's `bad` and `responses` begin at 1
    n = done = 0
    while frontier.limit(1).count() and (max_rounds is None or done < max_rounds) and (max_pages is None or n < max_pages):
        todo = materialize(frontier.limit(max_pages - n), "todo") if max_pages is not None else frontier
        host = U.hostname(F.col("url"))
        dealt = todo.select("url").repartition(threads, host) if threads else todo.select("url").repartition(host)
        responses = fetch(dealt).join(todo.select("url", "depth"), "url")
        responses = store(responses, "responses")
        n, done = n + responses.count(), done + 1
        store(bad_urls(responses), "bad")
        bad = spark.read.parquet(*(f"{at(i)}/bad" for i in range(1, last + 2))).distinct()
        seen = spark.read.parquet(*(f"{at(i)}/variants" for i in range(1, last + 1))).distinct() if last else None
        links = materialize(scrape(responses, domains, bad, settings, seen), "links")
        store(with_variant(links).filter("_q <> ''").select("_k", "_q").distinct(), "variants")
        links = links.filter("ok").select("source", U.normalize_frontier(F.col("url")).alias("url"))
        links = links.join(responses.select(F.col("url").alias("source"), "depth").distinct(), "source")
        links = links.withColumn("hash", U.url_hash(F.col("url"))).groupBy("hash").agg(F.min("url").alias("url"), (F.min("depth") + 1).alias("depth"))
        links = links.join(stored("frontier").select("hash"), "hash", "left_anti").select("url", "hash", "depth")
        if max_pages is not None:
            links = frontier.join(todo.select("hash"), "hash", "left_anti").select("url", "hash", "depth").union(links)
        frontier = store(links, "frontier")
        end_round()
    if last < 1:
        return fetch(frontier.select("url").limit(0)).withColumn("depth", F.lit(0))
    return stored("responses", 1)
