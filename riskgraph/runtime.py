"""Where intermediate tables live and how large an input is allowed to be before it is broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest planner size estimate (bytes) of a side that may be broadcast without further proof.
BROADCAST_BYTES = 32 << 20

#: A join key with more rows than this is "hot": its rows are joined map-side instead of shuffled.
#: At most total_rows / HOT_ROWS keys can be hot, which bounds the broadcast of their lookup rows.
HOT_ROWS = 2_000_000

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    Taken from ``spark.checkpoint.dir`` (or the checkpoint folder already set on the context).
    Only a local-mode session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts lineage of iterative plans, survives lost executors, pins values that a re-run could change
    (partition ids after a range partitioning) and gives the planner real sizes.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """The planner's size estimate of ``df``; for scans this is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for work on a scan that has fewer splits than there are cores.

    Only small or unsplittable inputs are redistributed; a scan with enough splits is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)
