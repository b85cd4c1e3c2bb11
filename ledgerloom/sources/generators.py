"""Reproducible synthetic transactions, made by Spark tasks (for load tests)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"
AMOUNT = "decimal(20,6)"


def _choice(u: Column, options: list[tuple[str, float]]) -> Column:
    """First option whose cumulated share exceeds the uniform number."""
    out, edge = None, 0.0
    for name, share in options[:-1]:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return out.otherwise(options[-1][0])


def synthetic_transactions(spark: SparkSession, rows: int, year: int, month: int, seed: int = 42) -> DataFrame:
    """80/20 premiums and claims with component ratios; invest is the residual."""
    first = F.lit(date(year, month, 1))
    days = F.dayofmonth(F.last_day(first))
    base = spark.range(rows).select(
        F.concat(F.lit("TXN-"), F.lpad((F.col("id") + 1).cast("string"), 12, "0")).alias("source_rowid"),
        _choice(F.rand(seed), [("PREMIUM_RECEIPT", 0.8), ("CLAIM_PAID", 0.2)]).alias("txn_type"),
        F.concat(F.lit("POL-"), F.lpad(F.floor(F.rand(seed + 1) * 1_000_000).cast("string"), 6, "0")).alias("policy_no"),
        _choice(F.rand(seed + 2), [("LIFE01", 0.6), ("FAM01", 0.3), ("INV01", 0.1)]).alias("product_code"),
        _choice(F.rand(seed + 3), [("AGENCY", 0.7), ("INBRANCH", 0.3)]).alias("channel"),
        F.date_add(first, F.floor(F.rand(seed + 4) * days).cast("int")).alias("bank_value_date"),
        first.alias("txn_month"),
        F.lit("IDR").alias("currency"),
        (F.lit(100_000) + F.rand(seed + 5) * 4_900_000).cast(MONEY).alias("g"),
        *[
            (F.lit(low) + F.rand(seed + 6 + i) * (high - low)).cast("decimal(8,6)").alias(name)
            for i, (name, low, high) in enumerate(
                [("r_tabarru", 0.2, 0.4), ("r_tanahud", 0.05, 0.15), ("r_ujroh", 0.05, 0.1), ("r_admin", 0.01, 0.05)]
            )
        ],
    )
    claim = F.col("txn_type") == "CLAIM_PAID"

    def part(ratio: str, of_claim: str) -> Column:
        rate = F.when(claim, F.lit(of_claim).cast("decimal(8,6)")).otherwise(F.col(ratio))
        return F.round(F.col("g") * rate, 2).cast(AMOUNT)

    split = base.select(
        "source_rowid", "txn_type", "policy_no", "product_code", "channel", "bank_value_date", "txn_month", "currency",
        F.col("g").cast(AMOUNT).alias("gross_amount"),
        part("r_tabarru", "0.8").alias("tabarru_amount"),
        part("r_tanahud", "0").alias("tanahud_amount"),
        part("r_ujroh", "0").alias("ujroh_amount"),
        part("r_admin", "0.02").alias("admin_amount"),
    )
    g, t, a = F.col("gross_amount"), F.col("tabarru_amount"), F.col("admin_amount")
    rest = F.when(claim, g - t + a).otherwise(g - t - F.col("tanahud_amount") - F.col("ujroh_amount") - a)
    return split.withColumn("invest_amount", rest.cast(AMOUNT))


def synthetic_premiums(spark: SparkSession, rows: int, start: date, days: int = 31, seed: int = 42) -> DataFrame:
    """Premiums split 40/40/20; ujroh takes the residual."""
    amount = F.col("premium_amount")
    base = spark.range(1, rows + 1).select(
        F.col("id").alias("txn_id"),
        F.concat(F.lit("POL-"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("policy_id"),
        F.date_add(F.lit(start), F.floor(F.rand(seed) * days).cast("int")).alias("payment_date"),
        (F.lit(100) + F.rand(seed + 1) * 9_900).cast(MONEY).alias("premium_amount"),
    )
    share = F.round(amount * F.lit("0.40").cast("decimal(3,2)"), 2).cast(MONEY)
    return (
        base.withColumn("fund_tabarru", share)
        .withColumn("fund_tanahud", share)
        .withColumn("fund_ujroh", (amount - F.col("fund_tabarru") - F.col("fund_tanahud")).cast(MONEY))
        .withColumn("batch_processed", F.lit(False))
    )
