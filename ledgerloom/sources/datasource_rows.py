"""Journal source rows and settings derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schemas import DATASOURCE_ROW, JOURNAL_SETTING, conform
from ledgerloom.sources.tables import table


def _line(no, order, account, dc, idx, flag, amount=None, **t):
    codes = [t.get(f"t{i}") for i in range(1, 11)]
    return (no, order, account, dc, idx, flag, amount, *codes)


def sample_settings(spark: SparkSession) -> DataFrame:
    """Three journal types over the datasource ids 1, 35 and 45."""
    from datetime import date

    premium = [
        _line(1, 1, "BANK", "D", 0, 2),
        _line(2, 2, "KONTRIBUSI TABARRU", "C", 1, 1),
        _line(3, 3, "2199", "C", 2, 4, t3="ZZ", t6="X6"),
    ]
    claim = [
        _line(1, 2, "KLAIM", "D", 1, 1, t9="N9"),
        _line(2, 1, "BANK", "C", 0, 2),
        _line(2, 3, "3101", "C", 2, 3),
    ]
    payment = [
        _line(1, 1, "BIAYA", "D", 0, 1),
        _line(2, 2, "BANK", "C", 3, 3),
        _line(3, 3, "5100", "C", 1, 4),
    ]
    rows = [
        ("S0110", "Premium receipt", 1, 0, (1, None, None, premium)),
        ("S0210", "Claim", 1, 1, (35, date(1995, 1, 1), date(1997, 12, 31), claim)),
        ("S0310", "Claim payment", 1, 0, (45, date(1996, 1, 1), date(1999, 12, 31), payment)),
        ("S0410", "Retired", 0, 0, (1, None, None, payment)),
    ]
    return spark.createDataFrame(rows, JOURNAL_SETTING)


def datasource_rows(spark: SparkSession, root: str) -> DataFrame:
    """One contract row per order, with ``ds`` and ``journal_date``."""
    o = table(spark, root, "orders")
    key, total = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(20,2)")
    part = F.round(total * F.lit("0.30").cast("decimal(3,2)"), 2).cast("decimal(20,2)")
    status, prio = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    day = F.to_date("o_orderdate")
    empty = F.lit("")
    wide = o.select(
        F.concat(F.lit("O"), key.cast("string")).alias("id"),
        F.concat(F.lit("S0"), prio, F.lit("10")).alias("journal_type"),
        F.lit("SYS").alias("journal_source"),
        status.alias("journal_number"),
        F.lit("1").alias("journal_line_number"),
        F.concat(F.lit("REF."), key.cast("string"), F.lit(".X")).alias("transaction_reference"),
        F.date_format(day, "yyyyMM").alias("accounting_period"),
        day.cast("string").alias("transaction_date"),
        F.array(F.concat(F.lit("11"), status), F.concat(F.lit("21"), prio)).alias("account_code"),
        F.concat(F.lit("Order\n"), F.col("o_orderpriority")).alias("description"),
        F.lit("IDR").alias("currency_code"),
        F.array(total, part, (total - part).cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
        .cast("array<decimal(20,6)>")
        .alias("transaction_amount"),
        F.lit(1).cast("decimal(20,6)").alias("currency_rate"),
        *[empty.alias(c) for c in ("base_amount", "d_c_marker", "asset_indicator", "asset_code", "asset_sub_code")],
        F.array(status).alias("t1"),
        F.array(empty).alias("t2"),
        *[F.array(prio).alias(f"t{i}") for i in range(3, 8)],
        # The eighth code is missing for one status, which drops such lines.
        F.when(status == "P", F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("d")))
        .otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))
        .alias("t8"),
        *[F.array(*[F.lit(x) for x in "efgh"]).alias(f"t{i}") for i in (9, 10)],
        F.lit("SPA").alias("general_description_1"),
        F.concat(F.lit("POL."), F.col("o_custkey").cast("string")).alias("general_description_2"),
        F.concat(F.lit("PA.R."), F.col("o_custkey").cast("string")).alias("general_description_3"),
        *[empty.alias(f"general_description_{i}") for i in (4, 5, 6)],
        F.date_add(day, 30).cast("string").alias("due_date"),
        F.when(key % 3 == 0, 1).when(key % 3 == 1, 35).otherwise(45).alias("ds"),
        day.alias("journal_date"),
    )
    return conform(wide, DATASOURCE_ROW + ", ds int, journal_date date")
