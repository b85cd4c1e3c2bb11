"""Gap and duplicate checks on document sequences, without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.numbering import join_keys, spread


def with_previous(
    df: DataFrame, order: Sequence[str], value: str, column: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Each row with ``value`` of the row before it in its key (NULL for the first).

    Works like ``lag`` but a hot key spreads over many tasks.
    """
    keys = list(keys)
    laid = spread(df, keys, order)
    w = Window.partitionBy(*keys, "_part").orderBy("_pos")
    local = laid.withColumn("_local", F.lag(value).over(w)).withColumn("_rank", F.row_number().over(w))
    ends = laid.groupBy(*keys, "_part").agg(F.max_by(value, "_pos").alias("_end"))
    # One row per key and range partition.
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part")
    heads = ends.select(*keys, "_part", F.lag("_end").over(across).alias("_carry"))
    if not keys:
        heads = F.broadcast(heads)
    return (
        join_keys(local, heads, [*keys, "_part"])
        .withColumn(column, F.when(F.col("_rank") == 1, F.col("_carry")).otherwise(F.col("_local")))
        .select(*df.columns, column)
    )


def missing_ranges(df: DataFrame, seq: str) -> DataFrame:
    """Every run of missing numbers as one row."""
    return (
        with_previous(df.select(seq), [seq], seq, "prev_seq")
        .where(F.col(seq) - F.col("prev_seq") > 1)
        .select(
            (F.col("prev_seq") + 1).alias("first_missing"),
            (F.col(seq) - 1).alias("last_missing"),
            (F.col(seq) - F.col("prev_seq") - 1).alias("missing"),
        )
    )


def sequence_check(df: DataFrame, seq: str) -> DataFrame:
    """One row: rows, bounds, gaps, missing numbers and duplicates."""
    step = F.col(seq) - F.col("prev_seq")
    return with_previous(df.select(seq), [seq], seq, "prev_seq").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(seq).alias("first_seq"),
        F.max(seq).alias("last_seq"),
        F.count_if(step > 1).alias("gap_count"),
        F.coalesce(F.sum(F.when(step > 1, step - 1)), F.lit(0).cast("bigint")).alias("missing_count"),
        F.count_if(step == 0).alias("duplicate_count"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
