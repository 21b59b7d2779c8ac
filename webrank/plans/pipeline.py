"""The whole flow over a folder of pages: crawl, index, merge, graph, rank, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webrank.config import Settings
from webrank.operators import graph, search
from webrank.operators.index import IndexTables, build_index
from webrank.sources.pages import read_pages


def ready(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds a whole index with its ranks, as their readers see it."""
    try:
        IndexTables.load(spark, folder)
        spark.read.parquet(f"{folder}/pagerank")
    except Exception:  # noqa: BLE001  whatever a store says of a missing table
        return False
    return True


def build(spark: SparkSession, source: str, folder: str, stem: bool = True, settings: Settings = Settings(), again: bool = False) -> None:
    """Index the pages below `source` into `folder`, the link graph and PageRank included; nothing if that is there already."""
    if not again and ready(spark, folder):
        return
    build_index(read_pages(spark, source), stem, settings).save(folder)
    rank(spark, folder, settings)


def rank(spark: SparkSession, folder: str, settings: Settings = Settings()) -> None:
    index = IndexTables.load(spark, folder)
    edges = graph.link_graph(index.links, index.doc_table)
    edges.write.mode("overwrite").parquet(f"{folder}/graph_edges")
    graph.pagerank(spark.read.parquet(f"{folder}/graph_edges"), index.doc_table, settings.alpha, settings.iterations).write.mode("overwrite").parquet(f"{folder}/pagerank")


def query(spark: SparkSession, folder: str, queries: DataFrame, k: int = 15, stem: bool = True) -> DataFrame:
    return search.search(queries, IndexTables.load(spark, folder), spark.read.parquet(f"{folder}/pagerank"), k, stem)
