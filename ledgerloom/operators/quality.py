"""Data-quality rules as columns, their report and the scores."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the quality dimensions.
DIMENSION_WEIGHTS = {"completeness": "0.3", "accuracy": "0.4", "consistency": "0.2", "timeliness": "0.1"}

PERCENT = "decimal(9,4)"


def takaful_balanced() -> Column:
    """Components add up to the gross amount of their transaction type."""
    t, g = F.col("tabarru_amount"), F.col("gross_amount")
    inv, admin = F.col("invest_amount"), F.col("admin_amount")
    return (
        F.when(
            F.col("txn_type") == "PREMIUM_RECEIPT",
            g == t + F.col("tanahud_amount") + inv + F.col("ujroh_amount") + admin,
        )
        .when(F.col("txn_type") == "CLAIM_PAID", g == t + inv - admin)
        .otherwise(F.lit(True))
    )


def debit_xor_credit() -> Column:
    d, c = F.col("debit_amount") > 0, F.col("credit_amount") > 0
    return (d & (F.col("credit_amount") == 0)) | (c & (F.col("debit_amount") == 0))


def gl_rules() -> dict[str, Column]:
    return {
        "account_present": F.col("acc_debit").isNotNull() | F.col("acc_credit").isNotNull(),
        "amount_not_negative": F.col("amount") >= 0,
        "one_sided": F.col("acc_debit").isNull() | F.col("acc_credit").isNull(),
    }


def rule_report(df: DataFrame, rules: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """All rules in one pass: rule, checked, failed, pass_rate. NULL fails."""
    ok = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checked"), *[F.count_if(~c).alias(f"r_{n}") for n, c in ok.items()]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r_{n}").alias("failed")) for n in ok])
    rate = F.try_divide(
        ((F.col("checked") - F.col("failed")) * 100).cast("decimal(20,0)"), F.col("checked").cast("decimal(20,0)")
    )
    return (
        counts.withColumn("r", F.explode(rows))
        .select(*keys, "r.rule", "checked", "r.failed")
        .withColumn("pass_rate", F.coalesce(rate, F.lit(0)).cast(PERCENT))
    )


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    )
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def quality_score(df: DataFrame, valid: Column, keys: Sequence[str]) -> DataFrame:
    """Valid rows in percent of all rows."""
    ok = F.count_if(F.coalesce(valid, F.lit(False)))
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total_records"), ok.alias("valid_records"))
        .withColumn("invalid_records", F.col("total_records") - F.col("valid_records"))
        .withColumn(
            "quality_score",
            ((F.col("valid_records") * 100).cast("decimal(20,0)") / F.col("total_records").cast("decimal(20,0)")).cast(PERCENT),
        )
    )


def weighted_score(df: DataFrame, dimensions: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Weighted share of rows that satisfy each quality dimension."""
    n = F.count(F.lit(1)).cast("decimal(20,0)")
    shares = {
        name: (F.count_if(F.coalesce(rule, F.lit(False))).cast("decimal(20,0)") / n).cast("decimal(12,8)")
        for name, rule in dimensions.items()
    }
    out = df.groupBy(*keys).agg(*[c.alias(name) for name, c in shares.items()])
    total = F.lit(0).cast("decimal(12,8)")
    for name in dimensions:
        total = total + F.col(name) * F.lit(DIMENSION_WEIGHTS[name]).cast("decimal(2,1)")
    return out.withColumn("score", total.cast("decimal(12,8)"))


def journal_validity(lines: DataFrame, keys: Sequence[str], journals: DataFrame | None = None) -> DataFrame:
    """Balanced, not empty and not zero, per journal (see ``lines`` dc/amount).

    ``journals`` holds ``keys`` of every journal, those without lines included.
    """
    zero = F.lit(0).cast("decimal(20,2)")
    d = F.sum(F.when(F.col("dc") == "D", F.col("amount")).otherwise(zero))
    c = F.sum(F.when(F.col("dc") == "D", zero).otherwise(F.col("amount")))
    out = lines.groupBy(*keys).agg(
        d.alias("debits"), c.alias("credits"), F.count(F.col("dc")).alias("line_count")
    )
    if journals is not None:
        out = journals.select(*keys).join(out, list(keys), "left").select(
            *keys,
            F.coalesce("debits", zero).cast(out.schema["debits"].dataType).alias("debits"),
            F.coalesce("credits", zero).cast(out.schema["credits"].dataType).alias("credits"),
            F.coalesce("line_count", F.lit(0).cast("bigint")).alias("line_count"),
        )
    return out.withColumn(
        "error",
        F.when(F.col("line_count") == 0, "NO_LINES")
        .when(F.col("debits") == 0, "ZERO_TOTAL")
        .when(F.abs(F.col("debits") - F.col("credits")) > F.lit(Decimal("0")), "UNBALANCED"),
    )
