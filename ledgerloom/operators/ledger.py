"""Movements, trial balances and balance snapshots of the ledger."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AMOUNT = "decimal(20,6)"
SUM = "decimal(38,6)"


def month_window(day: Column) -> tuple[Column, Column]:
    """First day of the month and of the next one."""
    first = F.trunc(day, "MM").cast("date")
    return first, F.add_months(first, 1)


def side_sum(side: str, value: str = "amount", column: str = "side") -> Column:
    return F.sum(
        F.when(F.col(column) == side, F.col(value)).otherwise(F.lit(0).cast(AMOUNT))
    ).cast(SUM)


def with_ledger_id(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines of posted headers with their ledger id."""
    ids = headers.select("je_number", F.col("je_id").alias("ledger_id"), "je_type", "source_rowid")
    return lines.join(ids, "je_number")


def monthly_movement(lines: DataFrame, date_col: str = "je_date") -> DataFrame:
    """Debit and credit per month, account and fund (combined before the shuffle)."""
    return lines.groupBy(
        F.trunc(date_col, "MM").cast("date").alias("period_start"), "account_code", "fund"
    ).agg(side_sum("DR").alias("debit"), side_sum("CR").alias("credit"))


def trial_balance(lines: DataFrame, levels: Sequence[str] | None = None) -> DataFrame:
    """Movement with net; ``levels`` adds subtotals by rollup."""
    if levels is None:
        return monthly_movement(lines).withColumn("net", (F.col("debit") - F.col("credit")).cast(SUM))
    base = lines.withColumn("period_start", F.trunc("je_date", "MM").cast("date"))
    return (
        base.rollup(*levels)
        .agg(side_sum("DR").alias("debit"), side_sum("CR").alias("credit"), F.grouping_id().alias("level"))
        .withColumn("net", (F.col("debit") - F.col("credit")).cast(SUM))
    )


def roll_forward(movement: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Opening and closing balances per account and fund over the months.

    ``prior``: (account_code, fund, closing_balance) before the first month. Every account has a row for each
    month up to the last one of ``movement``: from the first month if it has a prior balance, else from its own
    first. A month without movement carries the balance over. The window runs over monthly totals, not over
    ledger lines.
    """
    keys = ["account_code", "fund"]
    zero = F.lit(0).cast(SUM)
    start = F.min("period_start").alias("_from")
    if prior is None:
        accounts = movement.groupBy(*keys).agg(start).withColumn("_start", zero)
    else:
        known = movement.select(*keys, "period_start", F.lit(None).cast(SUM).alias("_start")).unionByName(
            prior.select(*keys, F.lit(None).cast("date").alias("period_start"), F.col("closing_balance").cast(SUM).alias("_start"))
        )
        accounts = known.groupBy(*keys).agg(start, F.sum("_start").alias("_start"))
    # One row: the span of the months.
    span = movement.agg(F.min("period_start").alias("_first"), F.max("period_start").alias("_last")).withColumn("_k", F.lit(1))
    begin = F.col("_from") if prior is None else F.when(F.col("_start").isNull(), F.col("_from")).otherwise(F.col("_first"))
    spine = (
        accounts.withColumn("_k", F.lit(1))
        .join(F.broadcast(span), "_k")
        .select(*keys, "_start", F.explode(F.sequence(begin, F.col("_last"), F.expr("interval 1 month"))).alias("period_start"))
    )
    w = Window.partitionBy(*keys).orderBy("period_start").rowsBetween(Window.unboundedPreceding, -1)
    base = spine.join(movement, [*keys, "period_start"], "left").select(
        "period_start", *keys, "_start", F.coalesce("debit", zero).cast(SUM).alias("debit"), F.coalesce("credit", zero).cast(SUM).alias("credit")
    )
    net = F.col("debit") - F.col("credit")
    opening = (F.coalesce("_start", zero) + F.coalesce(F.sum(net).over(w), zero)).cast(SUM)
    return (
        base.withColumn("opening_balance", opening)
        .withColumn("closing_balance", (F.col("opening_balance") + net).cast(SUM))
        .drop("_start")
    )


def upsert_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """New debit, credit and closing replace the old ones; other rows stay."""
    keys = ["period_start", "account_code", "fund"]
    a, b = old.alias("o"), new.alias("n")
    joined = a.join(b, keys, "full_outer")

    def pick(first: str, second: str, name: str) -> Column:
        return F.coalesce(F.col(f"{first}.{name}"), F.col(f"{second}.{name}")).alias(name)

    return joined.select(
        *keys,
        pick("o", "n", "opening_balance"),
        pick("n", "o", "debit"),
        pick("n", "o", "credit"),
        pick("n", "o", "closing_balance"),
    )


def day_trial_balance(gl: DataFrame) -> DataFrame:
    """Debits against credits per day from one-sided ledger rows."""
    d = F.sum(F.when(F.col("acc_debit").isNotNull(), F.col("amount")))
    c = F.sum(F.when(F.col("acc_credit").isNotNull(), F.col("amount")))
    zero = F.lit(0).cast("decimal(30,2)")
    return (
        gl.groupBy("trx_date")
        .agg(F.coalesce(d, zero).alias("debits"), F.coalesce(c, zero).alias("credits"))
        .withColumn("difference", F.abs(F.col("debits") - F.col("credits")).cast("decimal(31,2)"))
        .withColumn("balanced", F.col("difference") < F.lit(Decimal("0.01")))
    )


def journal_balance(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Debit and credit totals of journal lines with a status text."""
    zero = F.lit(0).cast("decimal(20,2)")
    d = F.sum(F.when(F.col("dc") == "D", F.col("amount")).otherwise(zero))
    c = F.sum(F.when(F.col("dc") == "C", F.col("amount")).otherwise(zero))
    return (
        lines.groupBy(*keys)
        .agg(d.alias("total_debit"), c.alias("total_credit"))
        .withColumn("difference", (F.col("total_debit") - F.col("total_credit")).cast("decimal(31,2)"))
        .withColumn("status", F.when(F.col("difference") == 0, "BALANCED").otherwise("UNBALANCED"))
    )


def entry_balance(lines: DataFrame, tolerance: Decimal = Decimal("0.01")) -> DataFrame:
    """Journal entries pivoted by side with their difference."""
    zero = F.lit(0).cast(SUM)
    return (
        lines.groupBy("je_number")
        .pivot("side", ["DR", "CR"])
        .agg(F.sum("amount").cast(SUM))
        .select(
            "je_number",
            F.coalesce("DR", zero).alias("debit"),
            F.coalesce("CR", zero).alias("credit"),
            (F.coalesce("DR", zero) - F.coalesce("CR", zero)).cast(SUM).alias("difference"),
        )
        .withColumn("balanced", F.abs("difference") <= F.lit(tolerance))
    )


def fund_net_change(lines: DataFrame, fund: str = "fund_type") -> DataFrame:
    """Credit minus debit per fund of two-column lines."""
    return lines.groupBy(fund).agg(
        (F.sum("credit_amount") - F.sum("debit_amount")).cast("decimal(38,2)").alias("net_change")
    )


def signed_balance(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger rebuild: debit positive, credit negative."""
    sign = F.when(F.col("side") == "DR", F.col("amount")).otherwise(-F.col("amount"))
    return lines.groupBy(*keys).agg(F.sum(sign).cast(SUM).alias("balance"))


def product_slice(lines: DataFrame) -> DataFrame:
    """Month totals with subtotals by product and channel."""
    return (
        lines.withColumn("month", F.trunc("je_date", "MM").cast("date"))
        .rollup("month", "product_code", "channel")
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.sum("amount").cast(SUM).alias("total_amount"),
            F.grouping_id().alias("level"),
        )
    )


def trace(source: DataFrame, headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Lineage from the source row over the header to every posted line."""
    h = headers.select("source_rowid", "je_number", "je_date", "template_code", "template_version")
    return source.join(h, "source_rowid").join(
        lines.select("je_number", "line_no", "side", "account_code", "fund", "amount"), "je_number"
    )


def orphans(lines: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Lines without a row in the dimension."""
    return lines.join(dimension.select(*on).distinct(), list(on), "left_anti")


def journal_total(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Debit-side total and number of lines of each journal or voucher."""
    return lines.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("dc") == "D", F.col("amount"))), F.lit(0).cast("decimal(30,2)")).alias(
            "total_amount"
        ),
        F.count(F.lit(1)).alias("line_count"),
    )
