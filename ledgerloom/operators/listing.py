"""Filtered, paged and ranked listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_journals(
    journals: DataFrame,
    start: date | None = None,
    end: date | None = None,
    journal_types: Sequence[str] | None = None,
    vouchered: bool | None = None,
) -> DataFrame:
    """Journals by optional date, type and voucher state."""
    if start is not None:
        journals = journals.where(F.col("journal_date") >= F.lit(start))
    if end is not None:
        journals = journals.where(F.col("journal_date") <= F.lit(end))
    if journal_types:
        journals = journals.where(F.col("journal_type").isin(list(journal_types)))
    if vouchered is not None:
        test = F.col("voucher_id").isNotNull()
        journals = journals.where(test if vouchered else ~test)
    return journals


def page(df: DataFrame, order: Sequence[Column | str], offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def top(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows; Spark keeps k rows per task instead of sorting everything."""
    return df.orderBy(*order).limit(k)


def deletable(journals: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining journals, and the requests refused with their reason."""
    wanted = ids.select("id").distinct()
    free = journals.where(F.col("voucher_id").isNull()).select("id")
    gone = wanted.join(free, "id", "left_semi")
    known = journals.select("id", "voucher_id")
    refused = (
        wanted.join(free, "id", "left_anti")
        .join(known, "id", "left")
        .select("id", F.when(F.col("voucher_id").isNotNull(), "HAS_VOUCHER").otherwise("NOT_FOUND").alias("reason"))
    )
    return journals.join(gone, "id", "left_anti"), refused


def day_results(days: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row per requested day with its outcome; absent days are failures.

    ``outcome``: journal_date, journals, vouchers, error.
    """
    return days.join(outcome, days["day"] == outcome["journal_date"], "left").select(
        "day",
        F.coalesce("journals", F.lit(0).cast("bigint")).alias("journals"),
        F.coalesce("vouchers", F.lit(0).cast("bigint")).alias("vouchers"),
        (F.col("journal_date").isNotNull() & F.col("error").isNull()).alias("success"),
        F.when(F.col("journal_date").isNull(), "no data").otherwise(F.col("error")).alias("error_message"),
    )
