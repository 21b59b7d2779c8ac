"""Sources and sinks of pages: directories of JSON files, and tables."""

from __future__ import annotations

import http.client
import re
import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrank.functions.urls import file_name, normalize_index

RAW = T.StructType([T.StructField("url", T.StringType()), T.StructField("content", T.StringType()), T.StructField("_corrupt_record", T.StringType())])
RESPONSE = "url string, final_url string, status int, content_type string, body binary, error string"


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """path, url, content of every *.json below a folder; unreadable files and pages without a URL are left out.

    A null content is empty.  Sorted paths are the scan order.
    """
    rows = spark.read.schema(RAW).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "url", "content", "_corrupt_record")
    rows = rows.filter(F.col("_corrupt_record").isNull() & (F.coalesce("url", F.lit("")) != ""))
    return rows.select("path", "url", F.coalesce("content", F.lit("")).alias("content"))


def stream_json(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.schema(RAW).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.filter(F.coalesce("url", F.lit("")) != "").select(file_name(F.col("url")).alias("path"), "url", F.coalesce("content", F.lit("")).alias("content"))


def documents(pages: DataFrame) -> DataFrame:
    """path, url (canonical), html from pages(path, url, content)."""
    return pages.select("path", normalize_index(F.col("url")).alias("url"), F.coalesce("content", F.lit("")).alias("html"))


def from_table(pages: DataFrame) -> DataFrame:
    """path, url, content of a pages table (page_id, url, html): the path begins with the name that its file would have.

    File names are equally long, so page_id orders rows of one URL, and their scan doesn't depend on partitions.
    """
    path = F.concat_ws("/", file_name(F.col("url")), F.format_string("%020d", F.col("page_id")))
    return pages.filter(F.coalesce("url", F.lit("")) != "").select(path.alias("path"), "url", F.coalesce("html", F.lit("")).alias("content"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Store url, content by file name with their arrival (now, if pages have none); the last version of a URL wins."""
    rows = pages.withColumn("path", file_name(F.col("url")))
    if "arrival" not in pages.columns:
        rows = rows.withColumn("arrival", F.current_timestamp())
    rows = rows.groupBy("path", "url").agg(F.max_by("content", "arrival").alias("content"), F.max("arrival").alias("arrival"))
    rows.select("path", "url", "content", "arrival").write.mode("append").parquet(path)


def latest(pages: DataFrame) -> DataFrame:
    """path, url, content of pages(path, url, content, arrival): each URL's last version."""
    last = F.max_by(F.struct("path", "content"), "arrival").alias("x")
    return pages.groupBy("url").agg(last).select("x.path", "url", "x.content")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """path, url, content of a folder of pages: those that write_pages() stored, or JSON files."""
    tables = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return latest(spark.read.parquet(folder)) if tables.select("path").limit(1).count() else read_json(spark, folder)


class _Plain(http.client.HTTPConnection):
    read = 15.0

    def connect(self):
        super().connect()
        self.sock.settimeout(self.read)


class _Secure(http.client.HTTPSConnection):
    read = 15.0

    def connect(self):
        super().connect()
        self.sock.settimeout(self.read)


class _Handler(urllib.request.HTTPHandler, urllib.request.HTTPSHandler):
    """Opens connections whose time-out is another once they stand."""

    def __init__(self, read: float):
        super().__init__()
        self.kinds = [type("Timed", (kind,), {"read": read}) for kind in (_Plain, _Secure)]

    def http_open(self, request):
        return self.do_open(self.kinds[0], request)

    def https_open(self, request):
        return self.do_open(self.kinds[1], request)


def failure(e: Exception) -> int:
    """The status of a failed fetch: 600 too many redirects, 601 connection, 602 time-out, 603 anything else."""
    reason = getattr(e, "reason", None)
    if isinstance(e, TimeoutError) or isinstance(reason, TimeoutError):
        return 602
    return 601 if isinstance(e, (urllib.error.URLError, ConnectionError, http.client.HTTPException)) else 603


def download(urls: DataFrame, user_agent: str, connect: float = 5.0, politeness: float = 0.0, read: float = 15.0) -> DataFrame:
    """Fetch urls(url), with a time-out for the connection and one for each read; failure() gives errors their statuses.

    A host's fetches in a task are at least `politeness` seconds apart.
    """

    def fetch(batches):
        ended, opener = {}, urllib.request.build_opener(_Handler(read))
        for batch in batches:
            rows = []
            for url in batch.url:
                host = re.sub(r"^[^:/?#]*://|[/?#].*", "", url).lower()
                if host in ended:
                    time.sleep(max(0.0, ended[host] + politeness - time.monotonic()))
                try:
                    with opener.open(urllib.request.Request(url, headers={"User-Agent": user_agent}), timeout=connect) as r:
                        rows.append((url, r.geturl(), r.status, r.headers.get("Content-Type"), r.read(), None))
                except urllib.error.HTTPError as e:
                    if 300 <= e.code < 400 and "redirect" in str(e.msg).lower():
                        rows.append((url, url, 600, None, None, str(e)))
                    else:
                        rows.append((url, e.geturl(), e.code, e.headers.get("Content-Type"), e.read(), None))
                except Exception as e:  # noqa: BLE001  whatever a server does is a status
                    rows.append((url, url, failure(e), None, None, str(e)))
                ended[host] = time.monotonic()
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "content_type", "body", "error"])

    return urls.select("url").mapInPandas(fetch, RESPONSE)


def table_fetcher(pages: DataFrame):
    """A fetcher over a table (url, html) in place of the network; absent URLs are 404."""

    def fetch(urls: DataFrame) -> DataFrame:
        known = pages.select(normalize_index(F.col("url")).alias("_key"), F.col("html").alias("_html")).dropDuplicates(["_key"])
        # a key that is an expression would be worked out again whenever the join's sort compares two rows
        rows = urls.select("url", normalize_index(F.col("url")).alias("_key")).join(known.withColumn("_there", F.lit(True)), "_key", "left")
        there = F.col("_there").isNotNull()
        return rows.select("url", F.col("url").alias("final_url"), F.when(there, 200).otherwise(404).alias("status"), F.lit("text/html").alias("content_type"), F.encode(F.coalesce("_html", F.lit("")), "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"))

    return fetch
