"""Shared pieces of the text operators: written intermediate tables and whole-frame ranks."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Hash ranges a frame is cut into before rows are numbered; a task numbers one range of one group.
RANGES = 4096


@functools.lru_cache(maxsize=None)
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="text-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of the session, removed when the session ends.

    A session without ``spark.checkpoint.dir`` gets a temporary folder if it is local and fails otherwise.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{SETTING} must name a folder all executors can reach")
        root = _local_root(spark.sparkContext.applicationId)
    path = f"{root.rstrip('/')}/text/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, group: list[str], order: Column, bucket: Column, ties: list[Column], out: str) -> DataFrame:
    """Add ``out``, the 0-based rank of each row inside its group, and ``<out>_total``, the group's rows.

    ``bucket`` must be an integer in [0, RANGES) that never falls as ``order`` rises. Rows are
    sorted only within (group, bucket), and a small table of counts turns those places into ranks, so a
    group with a third of all rows is spread over RANGES tasks.
    """
    cut = df.withColumn("_bucket", bucket)
    per = [*group, "_bucket"]
    counts = cut.groupBy(*per).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *per,
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias(f"{out}_total"),
    )
    if not group:
        offsets = F.broadcast(offsets)  # at most RANGES rows
    place = F.row_number().over(Window.partitionBy(*per).orderBy(order, *ties))
    ranked = cut.withColumn("_place", place.cast("long")).join(offsets, per)
    return ranked.withColumn(out, F.col("_before") + F.col("_place") - 1).drop("_bucket", "_place", "_before")


def hash_bucket(h: Column) -> Column:
    """Bucket of a signed 64-bit hash by its top 12 bits, in the order of the hash."""
    return (F.shiftright(h, 52) + RANGES // 2).cast("int")


def source_key(source: str = "source") -> Column:
    """The source of a row as a key that is never null: ``=name``, or ``-`` for a missing one."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))


def slices(batches, rows: int = 500):
    """Arrow batches in pieces of ``rows`` rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
