"""Incremental indexing: a stream of page files makes partial postings, a job merges them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webrank.functions.html import extract_fields
from webrank.operators.index import dictionary, field_tokens, merge_postings, postings
from webrank.sources.pages import documents, stream_json


def index_stream(spark: SparkSession, source: str, folder: str, checkpoint: str, stem: bool = False, files_per_batch: int = 1000) -> StreamingQuery:
    """Index page files as they come; each micro-batch is one partition of partial postings.

    A document's id is a hash of its URL, so a batch needs nothing from others.  A batch that is run
    again replaces its own partition, so each page counts once.
    """

    def batch(pages: DataFrame, number: int) -> None:
        docs = documents(pages).filter("url <> ''").dropDuplicates(["url"]).withColumn("f", extract_fields("url", "html"))
        docs = docs.select(F.xxhash64("url").alias("doc_id"), "url", "f.*").persist()
        part = postings(field_tokens(docs, stem))
        part.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        docs.select("doc_id", "url").write.mode("overwrite").parquet(f"{folder}/docs/batch={number}")
        docs.unpersist()

    rows = stream_json(spark, source, files_per_batch)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Merge the partial postings of all batches into one table sorted by term, and its dictionary.

    Of a URL that came in several batches the last version counts.
    """
    docs = spark.read.parquet(f"{folder}/docs").groupBy("doc_id").agg(F.max("batch").alias("batch"), F.first("url").alias("url"))
    parts = spark.read.parquet(f"{folder}/postings").join(docs.select("doc_id", "batch"), ["doc_id", "batch"])
    merged = merge_postings(parts)
    merged.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{target}/postings")
    dictionary(spark.read.parquet(f"{target}/postings")).sort("term").write.mode("overwrite").parquet(f"{target}/dictionary")
    docs.select("doc_id", "url").write.mode("overwrite").parquet(f"{target}/doc_table")
