"""Archiving, retention and the calendar of month partitions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Split(NamedTuple):
    keep: DataFrame
    archive: DataFrame


def split_by_age(df: DataFrame, day: str, as_of: Column, days: int = 1095) -> Split:
    """Rows to keep and rows older than ``days`` (a NULL date is kept)."""
    old = F.coalesce(F.col(day) < F.date_sub(as_of, days), F.lit(False))
    return Split(df.where(~old), df.where(old))


def rows_of_runs(df: DataFrame, runs: DataFrame, status: str = "FAILED") -> DataFrame:
    """Rows that belong to runs with ``status``."""
    return df.join(runs.where(F.col("status") == status).select("run_id"), "run_id", "left_semi")


def staging_archive(df: DataFrame, batch_id: str) -> Split:
    mine = F.coalesce(F.col("batch_id") == batch_id, F.lit(False))
    return Split(df.where(~mine), df.where(mine))


def months_between(start: Column, end: Column) -> Column:
    """First days of all months from ``start`` to ``end``."""
    return F.sequence(F.trunc(start, "MM").cast("date"), F.trunc(end, "MM").cast("date"), F.expr("interval 1 month"))


def month_span(df: DataFrame, day: str) -> DataFrame:
    """One row per calendar month between the first and the last date."""
    return df.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(
        F.explode(months_between(F.col("a"), F.col("b"))).alias("month")
    )


def missing_months(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Calendar months without a partition, with their name and bounds."""
    return (
        wanted.join(existing.select("month").distinct(), "month", "left_anti")
        .withColumn("partition_name", F.date_format("month", "yyyyMM"))
        .withColumn("next_month", F.add_months("month", 1))
    )


def expired_months(existing: DataFrame, as_of: Column, keep_months: int = 12) -> DataFrame:
    """Partition months before the retention cutoff."""
    cutoff = F.add_months(F.trunc(as_of, "MM").cast("date"), -keep_months)
    return existing.select("month").distinct().where(F.col("month") < cutoff)


def without_months(df: DataFrame, month: str, expired: DataFrame) -> DataFrame:
    return df.join(expired.select(F.col("month").alias(month)), month, "left_anti")


def copy_partitioned(frames: dict[str, tuple[DataFrame, str]], cutoff: Column, target: str) -> DataFrame:
    """Copy the rows of each table (frame, day column) from ``cutoff`` on into month partitions; report what is there.

    Rows are dealt by month and day, so a large month is written by several tasks.
    """
    copied = {}
    for name, (df, day) in frames.items():
        rows = df.where(F.col(day) >= cutoff).withColumn("month", F.trunc(day, "MM").cast("date"))
        path = f"{target}/{name}"
        rows.repartitionByRange("month", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "month"
        ).parquet(path)
        copied[name] = df.sparkSession.read.parquet(path)
    return copy_report(copied)


def copy_report(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows copied per table."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows_copied"))
        out = one if out is None else out.unionByName(one)
    return out
