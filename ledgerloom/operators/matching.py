"""Lookups and reconciliations between sources."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.codes import DEFAULT_LOCATION_CODE, lookup_or_default
from ledgerloom.operators.numbering import join_keys, spread


def _per_reference(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("reference").agg(
        F.sum("amount").alias(f"{name}_amount"), F.count(F.lit(1)).alias(f"{name}_count")
    )


def reconcile(
    journals: DataFrame, bank: DataFrame, sources: DataFrame, tolerance: Decimal = Decimal("0.01")
) -> DataFrame:
    """Three-way match of (reference, amount) frames, one row per reference.

    Sides are totalled per reference first, so a frequent reference is joined
    once and pairs do not multiply.
    """
    j, b, s = _per_reference(journals, "journal"), _per_reference(bank, "bank"), _per_reference(sources, "source")
    joined = j.join(b, "reference", "full_outer").join(s, "reference", "full_outer")

    def apart(x: str, y: str) -> Column:
        return F.abs(F.col(f"{x}_amount") - F.col(f"{y}_amount")) > F.lit(tolerance)

    reason = (
        F.when(F.col("journal_amount").isNull(), "MISSING_JOURNAL")
        .when(F.col("bank_amount").isNull(), "MISSING_BANK")
        .when(F.col("source_amount").isNull(), "MISSING_SOURCE")
        .when(apart("journal", "bank"), "AMOUNT_DIFFERS_BANK")
        .when(apart("journal", "source"), "AMOUNT_DIFFERS_SOURCE")
    )
    return joined.withColumn("exception", reason).withColumn("matched", F.col("exception").isNull())


def known_code_or_default(
    df: DataFrame, code: str, codes: DataFrame, dimension: str, default: str = DEFAULT_LOCATION_CODE
) -> DataFrame:
    """Replace codes missing from (analysis_dimension, analysis_code) by the default."""
    known = (
        codes.where(F.col("analysis_dimension") == dimension)
        .select(F.col("analysis_code").alias("_known"))
        .distinct()
    )
    return (
        df.join(known, F.col(code) == F.col("_known"), "left")
        .withColumn(code, lookup_or_default(F.col(code), F.col("_known"), default))
        .drop("_known")
    )


def as_of(
    facts: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    fact_time: str,
    valid_from: str,
    values: Sequence[str],
    fact_id: Sequence[str],
) -> DataFrame:
    """Facts with the values of the latest version valid at their time.

    Both sides are laid out once by (keys, time); the last version travels down
    each range and over to the next one, so a hot key is not one task's work.
    """
    keys, fact_id = list(keys), list(fact_id)
    v = versions.select(
        *keys,
        F.col(valid_from).alias("_t"),
        F.lit(0).alias("_kind"),
        *[F.lit(None).cast(facts.schema[c].dataType).alias(f"_f_{c}") for c in facts.columns],
        F.struct(*values).alias("_v"),
    )
    f = facts.select(
        *keys,
        F.col(fact_time).alias("_t"),
        F.lit(1).alias("_kind"),
        *[F.col(c).alias(f"_f_{c}") for c in facts.columns],
        F.lit(None).cast(v.schema["_v"].dataType).alias("_v"),
    )
    laid = spread(v.unionByName(f), keys, ["_t", "_kind", *[f"_f_{c}" for c in fact_id]])
    w = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    ends = local.groupBy(*keys, "_part").agg(F.max_by("_last", "_pos").alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    return (
        join_keys(local, heads, [*keys, "_part"])
        .where("_kind = 1")
        .withColumn("_x", F.coalesce("_last", "_carry"))
        .select(*[F.col(f"_f_{c}").alias(c) for c in facts.columns], *[F.col("_x")[c].alias(c) for c in values])
    )


def effective_dated(
    facts: DataFrame, versions: DataFrame, keys: Sequence[str], day: str, start: str, end: str
) -> DataFrame:
    """Facts with the version whose [start, end) holds their day (at most one)."""
    renamed = versions.select(*[F.col(k).alias(f"_v_{k}") for k in keys], *[c for c in versions.columns if c not in keys])
    cond = (F.col(start) <= F.col(day)) & (F.col(day) < F.col(end))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_v_{k}"))
    return facts.join(renamed, cond, "left").drop(*[f"_v_{k}" for k in keys])
