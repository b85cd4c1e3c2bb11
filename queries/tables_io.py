"""Readers and writers run over whole tables: what was written is read back."""

from pyspark.sql import functions as F

from ledgerloom import schemas as K
from ledgerloom.operators import sinks
from ledgerloom.scratch import scratch_path
from ledgerloom.sources import readers
from ledgerloom.sources import tables as S
from queries.registry import query
from queries.views import GL, TXN


@query(
    "a01_loaded_month",
    f"WITH {TXN} SELECT source_rowid, txn_type, bank_value_date, gross_amount FROM txn WHERE txn_month = DATE '1997-03-01'",
)
def a01_loaded(spark, root):
    """All transactions written by month; one month is loaded from its partition."""
    path = scratch_path(spark, "txn")
    sinks.replace_partitions(S.txn_source(spark, root), path, ["txn_month"], ["bank_value_date", "source_rowid"])
    return readers.load_month(spark, path, 1997, 3).select("source_rowid", "txn_type", "bank_value_date", "gross_amount")


@query("a04_active_settings", "SELECT o_orderkey, o_orderpriority AS journal_type FROM orders WHERE o_orderkey % 3 = 1")
def a04(spark, root):
    settings = S.table(spark, root, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("journal_type"), (F.col("o_orderkey") % 3).cast("int").alias("status")
    )
    return readers.active_setting_rows(settings).drop("status")


@query(
    "a08_source_contract",
    f"""WITH {TXN} SELECT txn_type, COUNT(*) AS n, COUNT(policy_no) AS with_policy, CAST(SUM(gross_amount) AS DECIMAL(30,6)) AS gross FROM (
 SELECT txn_type, policy_no, gross_amount FROM txn UNION ALL SELECT 'REVERSAL', NULL, -gross_amount FROM txn WHERE txn_type = 'CLAIM_PAID') GROUP BY 1""",
)
def a08(spark, root):
    """Two sources of different columns under one contract; absent columns are NULL."""
    txn = S.txn_source(spark, root)
    back = txn.where("txn_type = 'CLAIM_PAID'").select(
        "source_rowid", F.lit("REVERSAL").alias("txn_type"), (-F.col("gross_amount")).alias("gross_amount")
    )
    both = K.union_sources([txn, back], K.TXN_SOURCE)
    return both.groupBy("txn_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("policy_no").alias("with_policy"), F.sum("gross_amount").cast("decimal(30,6)").alias("gross")
    )


@query("a13_compatibility_views", f"WITH {GL} SELECT acc_debit, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(30,2)) AS total FROM gl GROUP BY 1")
def a13(spark, root):
    """A query of the old table name runs over the view."""
    readers.create_views({"gl_entries": S.gl_entries(spark, root)})
    return spark.sql("SELECT acc_debit, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(30,2)) AS total FROM gl_entries GROUP BY acc_debit")


@query(
    "b01_staged_rows",
    f"WITH {TXN} SELECT txn_type, COUNT(*) AS n, CAST(SUM(gross_amount) AS DECIMAL(30,6)) AS gross FROM txn GROUP BY 1",
)
def b01(spark, root):
    """Two appends of disjoint halves hold every row once."""
    txn, path = S.txn_source(spark, root), scratch_path(spark, "staging")
    half = F.crc32("source_rowid") % 2 == 0
    sinks.append(txn.where(half), path, ["txn_type"])
    sinks.append(txn.where(~half), path, ["txn_type"])
    return spark.read.parquet(path).groupBy("txn_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gross_amount").cast("decimal(30,6)").alias("gross")
    )


@query(
    "b07_rebuilt_days",
    f"""WITH {GL}, d AS (SELECT trx_date, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(30,2)) AS total FROM gl GROUP BY 1)
 SELECT trx_date, n, CASE WHEN trx_date >= DATE '1996-01-01' THEN CAST(total * 2 AS DECIMAL(30,2)) ELSE total END AS total FROM d""",
)
def b07(spark, root):
    """Days rebuilt with doubled amounts replace their partitions; a second rebuild changes nothing."""
    days = S.gl_entries(spark, root).groupBy("trx_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(30,2)").alias("total")
    )
    path = scratch_path(spark, "days")
    yearly = days.withColumn("trx_year", F.year("trx_date"))
    sinks.replace_partitions(yearly, path, ["trx_year"], ["trx_date"])
    again = yearly.where("trx_date >= date'1996-01-01'").withColumn("total", (F.col("total") * 2).cast("decimal(30,2)"))
    for _ in range(2):
        sinks.replace_partitions(again, path, ["trx_year"], ["trx_date"])
    return spark.read.parquet(path).select("trx_date", "n", "total")
