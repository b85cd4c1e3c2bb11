from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import checksums, ledger, quality
from ledgerloom.plans import month_end as M
from ledgerloom.sources.generators import synthetic_premiums, synthetic_transactions
from ledgerloom.sources import tables as S

START = date(2024, 1, 1)


def claims(spark, n=0):
    return spark.range(n).select(
        F.col("id").alias("claim_id"), F.lit("POL-1").alias("policy_id"), F.lit(START).alias("claim_date"),
        F.lit("10.00").cast("decimal(20,2)").alias("claim_amount"), F.lit("8.00").cast("decimal(20,2)").alias("fund_tabarru"),
        F.lit("2.00").cast("decimal(20,2)").alias("fund_tanahud"), F.lit(False).alias("batch_processed"),
    )


def test_three_balanced_entries_per_premium(spark, tmp_path):
    p, c = synthetic_premiums(spark, 1000, START), claims(spark, 10)
    staged = M.stage_entries(p, c, "B1", first_sequence=500)
    heads = staged.headers.agg(F.count("*").alias("n"), F.min("je_sequence").alias("a"), F.max("je_sequence").alias("z"),
                               F.count_distinct("je_number").alias("u")).first()
    assert tuple(heads) == (3030, 500, 3529, 3030)
    sums = staged.lines.groupBy("je_number").agg((F.sum("debit_amount") - F.sum("credit_amount")).alias("d"))
    assert sums.where("d <> 0").isEmpty()
    assert staged.lines.where(~quality.debit_xor_credit()).isEmpty()
    results = M.precommit(staged, p, c)
    assert {r.validation_name for r in results.where("status = 'FAIL'").collect()} == set()
    assert M.publish(staged, results, str(tmp_path / "out"), "B1")
    back = spark.read.parquet(str(tmp_path / "out" / "headers"))
    assert back.count() == 3030 and back.where("status <> 'POSTED'").isEmpty()
    assert spark.read.parquet(str(tmp_path / "out" / "master")).first().status == "COMMITTED"


def test_failed_checks_keep_the_batch_out(spark, tmp_path):
    p, c = synthetic_premiums(spark, 20, START), claims(spark)
    staged = M.stage_entries(p, c, "B1")
    torn = M.Staged(staged.headers.where("je_sequence <> 7"), staged.lines)
    results = M.precommit(torn, p, c)
    failed = {r.validation_name for r in results.where("status = 'FAIL'").collect()}
    assert failed == {"record_count_check", "sequence_gap_check"}
    assert not M.publish(torn, results, str(tmp_path / "out"), "B1")
    assert not (tmp_path / "out").exists()


def test_rollback_restores_everything(spark):
    p, c = synthetic_premiums(spark, 30, START), claims(spark, 3)
    staged = M.stage_entries(p, c, "B1")
    before = spark.createDataFrame(
        [("TABARRU", Decimal(5)), ("TANAHUD", Decimal(7)), ("OPERATOR", Decimal(9))], "fund_type string, current_balance decimal(38,2)"
    )
    after = M.fund_balances(before, staged.lines)
    assert after.exceptAll(before).count() == 3
    end = date(2024, 1, 31)
    out = M.rollback(
        staged.headers, staged.lines, after, M.mark_processed(p, "payment_date", START, end, "B1"),
        M.mark_processed(c, "claim_date", START, end, "B1"), "B1",
    )
    assert out.headers.isEmpty() and out.lines.isEmpty()
    assert out.balances.exceptAll(before).isEmpty()
    assert out.premiums.where("batch_processed or batch_id is not null").isEmpty()


def test_fund_changes_match_the_sources(spark):
    p = synthetic_premiums(spark, 200, START)
    staged = M.stage_entries(p, claims(spark), "B")
    change = {r.fund_type: r.net_change for r in ledger.fund_net_change(staged.lines).collect()}
    assert change["TABARRU"] == p.agg(F.sum("fund_tabarru")).first()[0]
    assert sum(change.values()) == 0


def test_generated_transactions_obey_the_balance_rule(spark):
    t = synthetic_transactions(spark, 2000, 2024, 2)
    assert t.count() == 2000 and t.where(~quality.takaful_balanced()).isEmpty()
    share = t.agg(F.avg((F.col("txn_type") == "CLAIM_PAID").cast("int"))).first()[0]
    assert 0.15 < share < 0.25
    assert t.where("txn_month <> date'2024-02-01' or bank_value_date not between date'2024-02-01' and date'2024-02-29'").isEmpty()
    assert t.exceptAll(synthetic_transactions(spark, 2000, 2024, 2)).isEmpty()


def test_checksum_ignores_order_but_not_content(spark):
    p = synthetic_premiums(spark, 100, START)
    one = checksums.source_checksum(p, "txn_id", "premium_amount").first()
    assert one == checksums.source_checksum(p.orderBy(F.rand(1)).repartition(9), "txn_id", "premium_amount").first()
    changed = p.withColumn("premium_amount", F.when(F.col("txn_id") == 5, 1).otherwise(F.col("premium_amount")).cast("decimal(20,2)"))
    assert one != checksums.source_checksum(changed, "txn_id", "premium_amount").first()
    assert checksums.source_checksum(p.union(p.limit(1)), "txn_id", "premium_amount").first() != one


def test_no_sequence_gap_on_given_tables(spark, root):
    staged = M.stage_entries(S.premium_transaction(spark, root), S.claims_transaction(spark, root), "B")
    row = M.sequence_check(staged.headers, "je_sequence").first()
    assert row.gap_count == row.duplicate_count == 0 and row.last_seq == row.row_count


def test_month_end_in_one_call(spark, root, tmp_path):
    p, c = S.premium_transaction(spark, root), S.claims_transaction(spark, root)
    funds = spark.createDataFrame([("TABARRU",), ("OPERATOR",)], "fund_type string").withColumn("current_balance", F.lit(5).cast("decimal(38,2)"))
    done = spark.createDataFrame([(b, "COMPLETED") for b in M.PREREQUISITES], "batch_type string, status string")
    span = date(1990, 1, 1), date(2010, 12, 31)
    refused = M.month_end(p, c, done.where("batch_type <> 'AR_CLOSE'"), funds, *span, "B", str(tmp_path / "x"))
    assert refused.status == "REFUSED" and not (tmp_path / "x").exists()
    assert refused.balances.collect() == funds.collect()
    out = M.month_end(p, c, done, funds, *span, "B", str(tmp_path / "y"))
    assert out.status == "COMMITTED" and out.results.where("status = 'FAIL'").isEmpty()
    lines = spark.read.parquet(str(tmp_path / "y" / "lines"))
    for fund in ("TABARRU", "OPERATOR"):
        moved = lines.where(F.col("fund_type") == fund).agg(F.sum(F.col("credit_amount") - F.col("debit_amount"))).first()[0]
        assert out.balances.where(F.col("fund_type") == fund).first().current_balance == 5 + moved
    assert out.premiums.where("NOT batch_processed").isEmpty() and out.claims.where("NOT batch_processed").isEmpty()
