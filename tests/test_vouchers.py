import random
from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.plans import vouchers
from ledgerloom.plans.vouchers import GROUP_FIELDS, build_vouchers, link_journals

DAY = date(2024, 7, 18)


def lines(spark, rows):
    """rows: journal, line number, account, dc, amount, t1, t2, journal number."""
    base = spark.createDataFrame(
        [(j, n, a, dc, Decimal(x), t1, t2, num) for j, n, a, dc, x, t1, t2, num in rows],
        "journal_id string, journal_line_number int, account_code string, d_c_marker string,"
        " transaction_amount decimal(20,2), t1 string, t2 string, journal_number string",
    )
    fixed = {c: F.lit("") for c in GROUP_FIELDS if c not in ("t1", "journal_number")}
    fixed |= {f"t{i}": F.lit("") for i in (6, 8, 9, 10)}
    return base.withColumns(fixed).withColumns(
        {
            "base_amount": F.col("transaction_amount"), "setting_type": F.lit("S0110"), "journal_date": F.lit(DAY),
            "setting_description": F.lit("Demo"), "description": F.lit("text"), "currency_code": F.lit("IDR"),
        }
    )


def test_first_group_takes_the_journal(spark):
    df = lines(spark, [("j1", 1, "a", "D", "5", "A", "", ""), ("j1", 2, "b", "C", "5", "B", "", ""), ("j2", 1, "a", "D", "3", "B", "", "")])
    out = build_vouchers(df)
    assert sorted((r.seq, r.voucher_no) for r in out.vouchers.collect()) == [(1, "S01102407180001"), (2, "S01102407180002")]
    assert {r.description for r in out.vouchers.collect()} == {"Demo 2024-07-18/0001", "Demo 2024-07-18/0002"}
    assert sorted((r.seq, r.account_code, r.transaction_amount) for r in out.lines.collect()) == [
        (1, "a", Decimal("5.00")), (2, "a", Decimal("3.00"))]
    assert [(r.journal_id, r.account_code) for r in out.orphan_lines.collect()] == [("j1", "b")]
    assert sorted((r.journal_id, r.seq) for r in out.links.collect()) == [("j1", 1), ("j2", 2)]
    assert build_vouchers(df, split=True).lines.count() == 3


def test_lines_are_summed_per_key_and_total_is_kept(spark):
    df = lines(spark, [("j1", 1, "a", "D", "5", "A", "", ""), ("j2", 1, "a", "D", "7", "A", "", ""), ("j2", 2, "a", "D", "1", "A", "", "")])
    got = sorted((r.journal_line_number, r.transaction_amount) for r in build_vouchers(df).lines.collect())
    assert got == [(1, Decimal("12.00")), (2, Decimal("1.00"))]


def test_sequence_resumes_after_existing_vouchers(spark):
    df = lines(spark, [("j1", 1, "a", "D", "5", "A", "", "")])
    old = spark.createDataFrame([("S0110", DAY, "S01102407180003")], "journal_type string, journal_date date, voucher_no string")
    for grouping in ("fields", "digest", "first_line"):
        assert build_vouchers(df, old, grouping).vouchers.first().voucher_no == "S01102407180004"


def test_sequence_overflow_fails(spark):
    df = lines(spark, [("j1", 1, "a", "D", "5", "A", "", "")])
    old = spark.createDataFrame([("S0110", DAY, "S01102407189999")], "journal_type string, journal_date date, voucher_no string")
    with pytest.raises(PySparkException):
        build_vouchers(df, old).vouchers.collect()


def test_first_line_grouping_consolidates_and_renumbers(spark):
    df = lines(spark, [
        ("j1", 1, "b", "D", "5", "A", "x", "N1"), ("j1", 2, "a", "C", "5", "A", "x", "N1"),
        ("j2", 1, "a", "C", "2", "A", "x", "N1"), ("j2", 2, "a", "C", "9", "A", "y", "N1"), ("j3", 1, "z", "D", "1", "A", "x", "N2"),
    ])
    got = sorted((r.seq, r.journal_line_number, r.account_code, r.transaction_amount)
                 for r in build_vouchers(df, grouping="first_line").lines.collect())
    assert got == [(1, 1, "b", Decimal("5.00")), (1, 2, "a", Decimal("7.00")), (1, 3, "a", Decimal("9.00")), (2, 1, "z", Decimal("1.00"))]


def test_journals_are_linked_once(spark):
    df = lines(spark, [("j1", 1, "a", "D", "5", "A", "", ""), ("j2", 1, "a", "D", "3", "B", "", "")])
    links = build_vouchers(df).links
    journals = spark.createDataFrame([("j1", None), ("j2", "old"), ("j3", None)], "id string, voucher_id string")
    got = {r.id: r.voucher_id for r in link_journals(journals, links).collect()}
    assert got["j1"] and got["j2"] == "old" and got["j3"] is None


@pytest.mark.parametrize("same_hash", [False, True])
def test_lines_find_their_group_by_hash(spark, monkeypatch, same_hash):
    """groups are built once and lines are not sorted by the 17 fields; equal hashes change nothing."""
    draw = random.Random(4)
    rows = [
        (draw.choice(["j1", "j2", "j3", "j4", None]), draw.choice([1, 2]), draw.choice(["a", "b"]), "D", str(draw.randint(1, 900)),
         draw.choice(["A", "B", None]), draw.choice(["x", None]), draw.choice(["", "1", None]))
        for _ in range(60)
    ]
    df = lines(spark, rows).withColumn("setting_type", F.when(F.col("journal_id") == "j4", F.lit(None)).otherwise("S0110"))
    if same_hash:
        monkeypatch.setattr(vouchers, "_group_hash", lambda keys: F.lit(1).cast("bigint"))
    out, whole = build_vouchers(df), build_vouchers(df, split=True)
    # j4 has a day without a type of its own: its groups are numbered apart, and its lines have no voucher number.
    kind = lambda r: None if r[0] == "j4" else "S0110"
    order = lambda k: [(x is not None, x or "") for x in k]
    groups = {}
    for r in rows:
        groups.setdefault(kind(r), set()).add((r[7], r[5]))
    seq = {(t, k): i for t, ks in groups.items() for i, k in enumerate(sorted(ks, key=order), 1)}
    first = {j: min(seq[kind(r), (r[7], r[5])] for r in rows if r[0] == j) for j in {r[0] for r in rows}}
    for got, kept in ((out, lambda r, s: s == first[r[0]]), (whole, lambda r, s: True)):
        want = Counter()
        for r in rows:
            s = seq[kind(r), (r[7], r[5])]
            if kind(r) and kept(r, s):
                want[(s, r[7], r[5], r[1], r[2], r[6])] += Decimal(r[4])
        assert {(r.seq, r.journal_number, r.t1, r.journal_line_number, r.account_code, r.t2): r.transaction_amount for r in got.lines.collect()} == want
        assert got.vouchers.count() == len(seq)
    assert out.orphan_lines.columns == [*df.columns, "seq", "first_seq"]
    assert out.orphan_lines.count() == sum(seq[kind(r), (r[7], r[5])] != first[r[0]] for r in rows)
    assert {(r.journal_id, r.seq) for r in out.links.collect()} == set(first.items())
    text = out.lines._jdf.queryExecution().optimizedPlan().toString()
    assert ("xxhash64" in text) != same_hash
    assert text.count("LogicalRDD") + text.count("LocalRelation") <= 2
