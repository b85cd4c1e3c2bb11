"""Domain views derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast(MONEY)


def gl_entries(spark: SparkSession, root: str) -> DataFrame:
    """General-ledger rows: debit-only, credit-only and two-sided."""
    li, o = table(spark, root, "lineitem"), table(spark, root, "orders")
    flag, status, prio = F.col("l_returnflag"), F.col("l_linestatus"), F.col("o_orderpriority")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("trx_id"),
        F.when((status == "F") | (flag == "R"), F.concat(F.lit("1"), flag)).alias("acc_debit"),
        F.when(status == "O", F.concat(F.lit("4"), F.substring(prio, 1, 1))).alias("acc_credit"),
        money("l_extendedprice").alias("amount"),
        F.to_date("l_shipdate").alias("trx_date"),
        flag.alias("t_1"),
        status.alias("t_2"),
        prio.alias("t_3"),
        F.col("o_orderstatus").alias("t_4"),
        F.col("l_suppkey").cast("string").alias("t_5"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("reference_1"),
        F.concat(status, F.lit("/"), prio).alias("description"),
    )


def txn_source(spark: SparkSession, root: str) -> DataFrame:
    """Business transactions with their takaful components."""
    o = table(spark, root, "orders")
    gross, key = money("o_totalprice"), F.col("o_orderkey")
    claim = key % 5 == 0

    def share(premium: str, of_claim: str) -> Column:
        rate = F.when(claim, F.lit(of_claim).cast("decimal(3,2)")).otherwise(
            F.lit(premium).cast("decimal(3,2)")
        )
        return F.round(gross * rate, 2).cast("decimal(20,6)")

    base = o.select(
        F.concat(F.lit("TXN-"), F.lpad(key.cast("string"), 9, "0")).alias("source_rowid"),
        F.when(claim, "CLAIM_PAID").otherwise("PREMIUM_RECEIPT").alias("txn_type"),
        F.concat(F.lit("POL-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("policy_no"),
        F.when(F.col("o_orderstatus") == "F", "LIFE01")
        .when(F.col("o_orderstatus") == "O", "FAM01")
        .otherwise("INV01")
        .alias("product_code"),
        F.when(key % 10 < 7, "AGENCY").otherwise("INBRANCH").alias("channel"),
        F.to_date("o_orderdate").alias("bank_value_date"),
        F.trunc(F.to_date("o_orderdate"), "MM").alias("txn_month"),
        F.lit("IDR").alias("currency"),
        gross.cast("decimal(20,6)").alias("gross_amount"),
        share("0.30", "0.80").alias("tabarru_amount"),
        share("0.10", "0.00").alias("tanahud_amount"),
        share("0.08", "0.00").alias("ujroh_amount"),
        share("0.02", "0.02").alias("admin_amount"),
    )
    invest = F.when(
        F.col("txn_type") == "CLAIM_PAID",
        F.col("gross_amount") - F.col("tabarru_amount") + F.col("admin_amount"),
    ).otherwise(
        F.col("gross_amount")
        - F.col("tabarru_amount")
        - F.col("tanahud_amount")
        - F.col("ujroh_amount")
        - F.col("admin_amount")
    )
    return base.withColumn("invest_amount", invest.cast("decimal(20,6)"))


def premium_transaction(spark: SparkSession, root: str) -> DataFrame:
    """Month-end premiums; orders of status 'F' count as processed already."""
    o = table(spark, root, "orders").where(F.col("o_orderkey") % 5 != 0)
    amount = money("o_totalprice")
    share = F.round(amount * F.lit("0.40").cast("decimal(3,2)"), 2).cast(MONEY)
    return o.select(
        F.col("o_orderkey").alias("txn_id"),
        F.concat(F.lit("POL-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("policy_id"),
        F.to_date("o_orderdate").alias("payment_date"),
        amount.alias("premium_amount"),
        share.alias("fund_tabarru"),
        share.alias("fund_tanahud"),
        (amount - share - share).cast(MONEY).alias("fund_ujroh"),
        (F.col("o_orderstatus") == "F").alias("batch_processed"),
    )


def claims_transaction(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").where(F.col("o_orderkey") % 5 == 0)
    amount = money("o_totalprice")
    share = F.round(amount * F.lit("0.80").cast("decimal(3,2)"), 2).cast(MONEY)
    return o.select(
        F.col("o_orderkey").alias("claim_id"),
        F.concat(F.lit("POL-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("policy_id"),
        F.to_date("o_orderdate").alias("claim_date"),
        amount.alias("claim_amount"),
        share.alias("fund_tabarru"),
        (amount - share).cast(MONEY).alias("fund_tanahud"),
        (F.col("o_orderstatus") == "F").alias("batch_processed"),
    )


def journal_lines(spark: SparkSession, root: str) -> DataFrame:
    """Exploded journal lines, one per lineitem row.

    ``line_no`` repeats inside a journal; the ``sort_*`` columns make the
    order total.
    """
    li, o = table(spark, root, "lineitem"), table(spark, root, "orders")
    dc = F.when(F.col("l_linenumber") % 2 == 1, "D").otherwise("C")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("journal_id"),
        F.concat(F.lit("S0"), F.substring("o_orderpriority", 1, 1), F.lit("10")).alias("journal_type"),
        F.to_date("o_orderdate").alias("journal_date"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("sort_part"),
        F.col("l_suppkey").alias("sort_supp"),
        F.to_date("l_shipdate").alias("sort_date"),
        F.concat(F.when(dc == "D", "1").otherwise("4"), F.col("l_returnflag")).alias("account_code"),
        dc.alias("dc"),
        money("l_extendedprice").alias("amount"),
        (F.col("l_linenumber") % 5).cast("int").alias("account_flag"),
        F.col("l_returnflag").alias("t1"),
        F.col("l_linestatus").alias("t2"),
        F.col("o_orderstatus").alias("t3"),
        F.col("l_suppkey").cast("string").alias("t4"),
    )


LINE_ORDER = ["line_no", "sort_part", "sort_supp", "amount", "sort_date"]


def journals(spark: SparkSession, root: str) -> DataFrame:
    """Journal headers, one per order; finished orders have a voucher."""
    o = table(spark, root, "orders")
    done = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source_rowid"),
        F.concat(F.lit("S0"), F.substring("o_orderpriority", 1, 1), F.lit("10")).alias("journal_type"),
        F.to_date("o_orderdate").alias("journal_date"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("journal_ts"),
        F.col("o_orderstatus").alias("status"),
        F.when(done, F.concat(F.lit("V"), F.col("o_orderkey").cast("string"))).alias("voucher_id"),
        money("o_totalprice").alias("amount"),
        F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.col("o_orderdate"))
        .cast("timestamp_ntz")
        .alias("created_date"),
    )


def audit_events(spark: SparkSession, root: str) -> DataFrame:
    return audit_view(table(spark, root, "events"))


def audit_view(e: DataFrame) -> DataFrame:
    """Audit events from the events table or a stream of it."""
    kind = F.col("event_type")
    return e.select(
        "event_id",
        F.when(kind == "error", "JOURNAL_DELETED")
        .when(kind == "signup", "JOURNAL_CREATED")
        .when(kind == "purchase", "JOURNAL_APPROVED")
        .when(kind == "view", "JOURNAL_MODIFIED")
        .otherwise("VOUCHER_EXPORTED")
        .alias("event_type"),
        F.col("ts").cast("timestamp_ntz").alias("event_timestamp"),
        F.lit("JOURNAL").alias("entity_type"),
        F.get_json_object("props", "$.k").alias("entity_id"),
        "user_id",
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
        F.when(F.col("user_id") % 3 == 0, "SUPERVISOR").otherwise("CLERK").alias("user_role"),
        F.when(F.col("user_id") % 4 == 0, "mfa").otherwise("password").alias("authentication_method"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 8).cast("string")).alias("ip_address"),
        F.to_date("ts").alias("business_date"),
        (F.col("value").cast(MONEY) * 10000).cast(MONEY).alias("amount"),
        F.when(F.col("user_id") % 2 == 0, "month end correction").alias("justification"),
    )


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """Worker progress records."""
    return table(spark, root, "events").select(
        "event_id",
        (F.col("user_id") % 10).alias("worker_id"),
        F.col("value").cast(MONEY).alias("records_per_second"),
        F.col("ts").cast("timestamp_ntz").alias("checkpoint_at"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING").alias("status"),
    )
