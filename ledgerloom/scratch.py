"""Written intermediate tables.

A lineage cut is a Parquet table below the folder named by
``spark.checkpoint.dir``: it survives the loss of executors and keeps column
pruning, which an RDD checkpoint does not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; a local session may make its own."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{SETTING} must name a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, removed when the session ends."""
    path = f"{scratch_root(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a configuration table after counting it.

    Beyond ``max_rows`` the frame is returned as it is and Spark picks the join.
    """
    counted = df.limit(max_rows + 1).count()
    return F.broadcast(df) if counted <= max_rows else df
