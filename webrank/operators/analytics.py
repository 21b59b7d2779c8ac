"""Crawl analytics: the first page of each canonical URL counts, others don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.config import DOMAIN_STOP_WORDS, STOP_WORDS, Settings
from webrank.functions import urls as U
from webrank.functions.text import tokenize_content, tokenize_with_stop_words


def unique_pages(pages: DataFrame) -> DataFrame:
    """canon, text, arrival: the first of pages(url, text, arrival) of each canonical URL."""
    rows = pages.select(U.canonical_for_count(F.col("url")).alias("canon"), "text", "arrival")
    return rows.groupBy("canon").agg(F.min_by("text", "arrival").alias("text"), F.min("arrival").alias("arrival"))


def longest_page(pages: DataFrame) -> DataFrame:
    """url, words of the unique page of most words; the first to arrive wins a tie."""
    rows = pages.select("canon", "arrival", F.size(tokenize_with_stop_words(F.col("text"))).cast("long").alias("words")).filter("words > 0")
    return rows.orderBy(F.desc("words"), "arrival").limit(1).select(F.col("canon").alias("url"), "words")


def top_words(pages: DataFrame, k: int = 50) -> DataFrame:
    rows = pages.select(F.explode(tokenize_content(F.col("text"))).alias("word"))
    rows = rows.filter((F.length("word") >= 2) & ~F.col("word").isin(*DOMAIN_STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "word").limit(k)


def top_stop_words(pages: DataFrame, k: int = 50) -> DataFrame:
    rows = pages.select(F.explode(tokenize_with_stop_words(F.col("text"))).alias("word")).filter(F.col("word").isin(*STOP_WORDS))
    return rows.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def hosts(pages: DataFrame, suffix: str = Settings().host_suffix) -> DataFrame:
    """host, pages: distinct pages of each host below the suffix, www. not counted."""
    rows = pages.select(U.host_for_count(F.col("canon")).alias("host"), "canon").filter(F.col("host").endswith(suffix))
    return rows.groupBy("host").agg(F.countDistinct("canon").alias("pages")).orderBy("host")


def report(pages: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    unique = unique_pages(pages)
    return {"unique": unique.agg(F.count("*").alias("pages")), "longest": longest_page(unique), "words": top_words(unique), "stop_words": top_stop_words(unique), "hosts": hosts(unique, settings.host_suffix)}
