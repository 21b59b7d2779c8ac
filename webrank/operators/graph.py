"""The link graph and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.functions.urls import normalize_index
from webrank.sources.scratch import materialize


def link_graph(links: DataFrame, doc_table: DataFrame) -> DataFrame:
    """src, dst: distinct links(source, target) between indexed pages, without self-links."""
    src, dst = doc_table.toDF("src", "source"), doc_table.toDF("dst", "target")
    rows = links.select(normalize_index(F.col("source")).alias("source"), "target")
    return rows.join(src, "source").join(dst, "target").filter("src <> dst").select("src", "dst").distinct()


def valid_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.filter(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)).dropDuplicates(["src", "dst"])


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.85, iterations: int = 20) -> DataFrame:
    """doc_id, score after a fixed number of steps from the uniform start, for edges(src, dst) and nodes(doc_id).

    A step is a join and a grouped sum; the mass of nodes without links comes from a grouped total
    of one row, spread evenly.  Every fifth step is written, so lineage stays short.  No nodes, no rows.
    """
    n = nodes.count()
    if not n:
        return nodes.select("doc_id", F.lit(0.0).alias("score"))
    degree = edges.groupBy("src").agg(F.count("*").alias("out"))
    out = materialize(edges.join(degree, "src"), "pagerank-edges")
    state = nodes.select("doc_id").join(degree.withColumnRenamed("src", "doc_id"), "doc_id", "left").select("doc_id", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("score"))
    state = materialize(state, "pagerank")
    fixed = state.select("doc_id", "dangling")
    for step in range(1, iterations + 1):
        lost = state.agg(F.sum(F.when(F.col("dangling"), F.col("score")).otherwise(0.0)).alias("lost"))
        got = out.join(state.select(F.col("doc_id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.sum(F.col("score") / F.col("out")).alias("got"))
        score = F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        state = fixed.join(got, "doc_id", "left").join(F.broadcast(lost)).select("doc_id", "dangling", score.alias("score"))
        if step % 5 == 0 or step == iterations:
            state = materialize(state, "pagerank")
    return state.select("doc_id", "score")
