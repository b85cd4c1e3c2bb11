"""Distinct values as text lists, in a form a caller asks for, and modal values.

A list of more than ``max_items`` values is spread over several rows, each with its ``part_no``; together the rows
hold every value. Reports give values as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.numbering import join_keys


def distinct_list_parts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    column: str,
    max_items: int,
    separator: str = ",",
) -> DataFrame:
    """(keys, part_no, n_values, list) with values sorted inside each part."""
    keys = list(keys)
    uniq = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    # Only keys with an oversized list are joined back to their values.
    sizes = uniq.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_items)
    sizes = sizes.withColumn("_parts", F.ceil(F.col("_n") / F.lit(max_items))).drop("_n")
    placed = join_keys(uniq, sizes, keys, "left").withColumn(
        "part_no", F.pmod(F.xxhash64(value), F.coalesce("_parts", F.lit(1).cast("bigint"))).cast("int")
    )
    # The explicit repartition puts the parts of one key into different tasks.
    return (
        placed.repartition(*keys, "part_no")
        .groupBy(*keys, "part_no")
        .agg(
            F.count(F.lit(1)).alias(f"n_{column}"),
            F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), separator).alias(column),
        )
    )


def modal_value(df: DataFrame, keys: Sequence[str], value: str, column: str) -> DataFrame:
    """Most frequent value per key, smallest value on ties (NULLs ignored)."""
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    return counted.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(column)
    )
