"""Tables written in the folder that driver and executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of texts or hashes.
BATCH_BYTES = 4 << 20

_own_dirs: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster.

    Executors of a cluster would each write to a disk of their own, and later reads would miss rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="webrank-shared-")
        _written.append(_own_dirs[app])
    return f"file://{_own_dirs[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches limited to BATCH_BYTES: ten thousand rows of texts would be held several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(df.sparkSession.conf.get(key, "64m")).lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if not 0 < int(now.rstrip("kmg")) << scale <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


@atexit.register
def cleanup() -> None:
    """Remove written tables; those in a remote folder are left to its life-cycle rules."""
    while _written:
        url = urlparse(_written.pop())
        if url.scheme in ("", "file"):
            shutil.rmtree(url.path, ignore_errors=True)
