import hashlib
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, controls, fraud, quality
from ledgerloom.sources import tables as S


def fraud_lines(spark, rows):
    return spark.createDataFrame(
        [(j, a, dc, Decimal(x)) for j, a, dc, x in rows], "journal_id int, account_code string, dc string, amount decimal(20,2)"
    )


def test_first_digit_profile_needs_ten_lines(spark):
    rows = [(1, "a", "D", f"{d}5.10") for d in range(1, 10)] + [(2, "a", "D", "100")] * 10 + [(2, "a", "D", "0.50")]
    got = {r.journal_id: r for r in fraud.digit_profile(fraud_lines(spark, rows), ["journal_id"]).collect()}
    assert got[1].sample_size == 9 and got[1].deviation == 0
    assert got[2].sample_size == 10 and got[2].d1 == 10
    want = (abs(1 - Decimal("0.301")) + sum(map(Decimal, fraud.BENFORD[1:]))) / 9
    assert abs(got[2].deviation - want) < Decimal("0.000001")


def test_line_indicators(spark):
    rows = [(1, "CASH1", "C", "10001"), (1, "EXPENSE9", "D", "5"), (2, "CASH1", "C", "10000"), (2, "EXPENSE9", "D", "5"),
            (3, "x", "D", "80000"), (3, "x", "D", "99999.99"), (3, "x", "D", "90000"), (4, "x", "D", "100000"), (4, "x", "C", "79999")]
    got = {r.journal_id: r for r in fraud.line_indicators(fraud_lines(spark, rows), ["journal_id"]).collect()}
    assert [got[i].unusual_combination for i in (1, 2, 3)] == [True, False, False]
    assert [got[i].potential_structuring for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert got[4].round_count == 1 and got[4].excessive_round and got[3].round_share == Decimal("0.6666666667")


def test_signature_forms_agree_on_equality(spark):
    base = [("a", "D", "1"), ("b", "C", "2"), ("a", "D", "1")]
    rows = [(1, *x) for x in base] + [(2, *x) for x in reversed(base)] + [(3, *x) for x in base[:2]]
    df = fraud_lines(spark, rows)
    sig = {r.journal_id: r.signature for r in fraud.signatures(df, ["journal_id"]).collect()}
    assert sig[1] == sig[2] != sig[3]
    text = fraud.signature_text(df, ["journal_id"]).where("journal_id = 1").first().signature_text
    assert text == "a:1.00:D|a:1.00:D|b:2.00:C"


def test_duplicates_look_thirty_days_back(spark):
    rows = [(1, date(2024, 1, 1), "s"), (2, date(2024, 1, 31), "s"), (3, date(2024, 3, 2), "s"), (4, date(2024, 3, 2), "s"), (5, date(2024, 3, 2), "t")]
    df = spark.createDataFrame(rows, "journal_id int, journal_date date, signature string")
    got = {r.journal_id: (r.duplicate_count, r.latest_duplicate) for r in fraud.duplicate_counts(df).collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (1, 4), 4: (1, 3), 5: (0, None)}


def test_hot_signature_forms_no_pairs(spark):
    df = spark.range(3000).select(
        F.col("id").alias("journal_id"), F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 3).cast("int")).alias("journal_date"),
        F.lit("same").alias("signature"),
    )
    out = fraud.duplicate_counts(df)
    assert out.count() == 3000
    assert sorted(r.duplicate_count for r in out.select("duplicate_count").distinct().collect()) == [999, 1999, 2999]


@pytest.mark.parametrize("amount,level", [("100000", 0), ("100000.01", 1), ("1000000", 1), ("1000000.01", 2), ("10000000", 2), ("10000000.01", 3)])
def test_approval_bounds(spark, amount, level):
    assert spark.range(1).select(controls.approval_level(F.lit(amount).cast("decimal(20,2)")).alias("x")).first().x == level


def test_risk_score_keeps_the_published_order_of_bounds(spark):
    rows = [(1, "JOURNAL_DELETED", datetime(2024, 1, 1, 3), Decimal("20000000"), "password"),
            (2, "X", datetime(2024, 1, 1, 12), Decimal("20000000"), "mfa"), (3, "X", datetime(2024, 1, 1, 12), None, "mfa"),
            (4, "X", datetime(2024, 1, 1, 22), Decimal("1000000"), "password")]
    df = spark.createDataFrame(rows, "id int, event_type string, event_timestamp timestamp_ntz, amount decimal(20,2), authentication_method string")
    got = {r.id: (r.a, r.b) for r in df.select("id", audit.risk_score().alias("a"), audit.risk_score(True).alias("b")).collect()}
    d = Decimal
    assert got == {1: (d("0.9"), d("1.0")), 2: (d("0.2"), d("0.4")), 3: (d("0.0"), d("0.0")), 4: (d("0.0"), d("0.0"))}


def chain_of(spark, root, segment=None):
    events = S.audit_events(spark, root)
    return events, audit.build_hash_chain(events, segment)


def test_hash_chain_links_every_event(spark, root):
    events, chain = chain_of(spark, root, F.lit(0))
    digests = {r.event_id: r.d for r in events.select("event_id", audit.payload_digest(events.columns).alias("d")).collect()}
    last = {}
    rows = sorted(chain.collect(), key=lambda r: (r.entity_id, r.chain_no))
    assert len(rows) == events.count()
    for r in rows:
        assert r.hash_previous == last.get(r.entity_id, audit.GENESIS)
        last[r.entity_id] = hashlib.sha256((digests[r.event_id] + r.hash_previous).encode()).hexdigest()
        assert r.hash_current == last[r.entity_id]


@pytest.mark.parametrize("by_day", [False, True])
def test_untouched_chains_verify(spark, root, by_day):
    events, chain = chain_of(spark, root, F.unix_date(F.to_date("event_timestamp")) if by_day else None)
    stored = events.join(chain.drop(*audit.CHAIN), "event_id")
    assert audit.verify_hash_chain(stored).isEmpty()
    late = stored.where("event_timestamp >= timestamp'2024-01-15 07:00:00'")
    assert audit.verify_hash_chain(late, sliced=True).isEmpty()


def test_tampering_and_removal_are_found(spark, root):
    events, chain = chain_of(spark, root)
    stored = events.join(chain.drop(*audit.CHAIN), "event_id")
    longest = stored.orderBy(F.desc("chain_no")).first()
    mine = F.col("entity_id") == longest.entity_id
    gone = audit.verify_hash_chain(stored.where(~(mine & (F.col("chain_no") == 2)))).collect()
    assert [r.error for r in gone] == ["HASH_CHAIN_BROKEN"]
    changed = stored.withColumn("user_id", F.when(F.col("event_id") == longest.event_id, -1).otherwise(F.col("user_id")))
    found = audit.verify_hash_chain(changed).collect()
    assert [(r.event_id, r.error) for r in found] == [(longest.event_id, "HASH_MISMATCH")]


def test_changed_fields_see_nulls_and_missing_keys(spark):
    df = spark.createDataFrame([({"a": "1", "b": None, "c": "x"}, {"a": "2", "b": None, "d": "y"})], "o map<string,string>, n map<string,string>")
    assert df.select(audit.changed_fields(F.col("o"), F.col("n")).alias("c")).first().c == ["a", "c", "d"]


def test_compliance_names_the_first_violation(spark):
    rows = [("JOURNAL_APPROVED", "CLERK", Decimal("2000000"), None), ("JOURNAL_DELETED", "MANAGER", Decimal("1"), ""), ("JOURNAL_APPROVED", "MANAGER", None, None)]
    df = spark.createDataFrame(rows, "event_type string, user_role string, amount decimal(20,2), justification string").withColumn("business_date", F.lit(date(2024, 1, 1)))
    got = [(r.violation, r.compliance_flags, r.approval_required) for r in audit.with_compliance(df, F.lit(True)).collect()]
    assert got == [("SEGREGATION_VIOLATION", ["SEGREGATION_VIOLATION", "HIGH_VALUE_TRANSACTION"], True),
                   ("SOX_JUSTIFICATION_MISSING", ["SOX_JUSTIFICATION_MISSING"], False), (None, [], False)]
    closed = [r.violation for r in audit.with_compliance(df, F.lit(False)).collect()]
    assert closed == ["SEGREGATION_VIOLATION", "CLOSED_PERIOD_MODIFICATION", "CLOSED_PERIOD_MODIFICATION"]


def test_rule_report_counts_null_as_failed(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    row = quality.rule_report(df, {"positive": F.col("v") > 0}).first()
    assert (row.checked, row.failed) == (3, 2) and row.pass_rate == Decimal("33.3333")
    assert quality.rule_report(df.limit(0), {"positive": F.col("v") > 0}).first().checked == 0
