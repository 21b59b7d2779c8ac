"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, and all but the last return the columns of documents.
Near duplicates are found by five-word shingles at a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrank.llm import decontaminate, importance, minhash, packing, pii
from webrank.llm.common import keep_rows, materialize, row_id, table
from webrank.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return keep_rows(docs, importance.resample(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group, and one of equal rows."""
    return keep_rows(docs, minhash.near_duplicates(docs, n=5, least=80).withColumn("_id", row_id()), once=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any whole window of the benchmark, however small a share of their words it is."""
    marked = decontaminate.marked(docs, table(spark, sf_dir, "benchmark"))
    return keep_rows(docs, marked.select("_id", "_key", (F.col("n_hit") == 0).alias("kept")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the packed sequences."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("PII", personal_data), ("best-fit packing", pack)]

#: Hashed models, token ids and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
