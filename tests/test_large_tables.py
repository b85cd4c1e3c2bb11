"""What a task reads, sorts or writes stays small on large tables; the results are those of the plain form."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.operators import flags, graph, numbering, reports, sinks
from ledgerloom.operators.numbering import by_group_size
from ledgerloom.plans import month_end as M
from ledgerloom.plans import posting
from ledgerloom.plans.templates import Expanded
from ledgerloom.sources import tables as S
from ledgerloom.streaming import ledger_streams as J


def plan(df, mode="simple"):
    return df._jdf.queryExecution().toString() if mode == "all" else df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [2, 40])
def test_rows_of_a_stream_are_not_dealt_to_three_tasks(spark, tmp_path, n):
    """files hold up to a set number of rows, and a stream over them still has three batches."""
    rows = spark.range(n, numPartitions=2).withColumn("v", F.col("id") * 2)
    folder, per = J.write_for_batches(rows, str(tmp_path / "rows"), file_rows=4)
    seen = {}
    write = lambda batch, no: seen.update({no: [r.id for r in batch.collect()]})
    J.run_batches(J.read_stream(spark, folder, files_per_trigger=per), write, str(tmp_path / "mark"))
    assert sorted(x for ids in seen.values() for x in ids) == list(range(n))
    if n == 40:
        assert len(seen) == 3
        sizes = spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()
        assert max(r["count"] for r in sizes) <= 4


def test_all_groups_hot_needs_no_counting_pass(spark):
    """the split form reads its rows once."""
    calls = []
    df = spark.createDataFrame([(1,), (None,)], "k int")
    out = by_group_size(df, ["k"], lambda d: calls.append("small") or d, lambda d: calls.append("large") or d, limit=0)
    assert calls == ["large"] and out.count() == 2


def test_flag_machine_sorts_once_and_lays_out_what_it_uses(spark):
    """one sort for all windows; the layout has no column the machine does not read."""
    row = (None, 1, "D", "1A", Decimal("5.00"), 1, "unused")
    other = (7, 1, "D", "1A", Decimal("5.00"), 2, "unused")
    more = [(7, i, "DC"[i % 2], f"a{i}", Decimal(i + 1), (1, 3, 4, 2, 5, None)[i % 6], "unused") for i in range(2, 40)]
    lines = spark.createDataFrame([row, other, *more], "journal_id int, line_no int, dc string, account_code string, amount decimal(20,2), account_flag int, t1 string")
    small = flags.flagged_gl_rows(lines, ["journal_id"], ["line_no"])
    large = flags.flagged_gl_rows(lines, ["journal_id"], ["line_no"], limit=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert plan(flags.flagged_gl_rows(lines, ["journal_id"], ["line_no"])).count("Sort [") == 1
    assert "t1" not in plan(large, "all")


def test_edges_are_written_once_by_whole_numbers(spark):
    """edges are aggregated once, numbers as numbers; the rows are the same."""
    lines = spark.createDataFrame([(1, "a", 2), (1, "a", 3), (None, "b", 4), (2, None, 5)], "j bigint, a string, amount int")
    edge = graph.edges(lines, "j", "a")
    assert sorted((str(r.src), str(r.dst), r.n, r.amount) for r in edge.collect()) == sorted([
        ("j:1", "a:a", 2, 5), ("a:a", "j:1", 2, 5), ("None", "a:b", 1, 4), ("a:b", "None", 1, 4), ("j:2", "None", 1, 5), ("None", "j:2", 1, 5),
    ])
    assert "HashAggregate" not in plan(edge) and plan(edge).count("FileScan parquet [_l#") == 2


def test_export_makes_its_fields_after_the_join(spark, tmp_path):
    """rows are joined, shuffled and sorted by their own columns, not by 57."""
    heads = spark.createDataFrame([(1, date(2024, 7, 1), "S", False)], "voucher_id int, journal_date date, journal_type string, exported boolean")
    lines = spark.createDataFrame([(1, "V1", 2, "x", None), (1, "V1", 1, "y", "c")], "voucher_id int, voucher_no string, journal_line_number int, account_code string, t1 string")
    args = (heads, lines, date(2024, 1, 1), date(2024, 12, 31))
    rows = sinks.export_rows(*args).drop("_day", "voucher_no").collect()
    assert sorted((r.field_03, r.field_07, r.field_17, r.field_56) for r in rows) == [("1", "y", "c", ""), ("2", "x", "", "")]
    assert set(sinks.export_lines(*args).columns) == {"_day", "voucher_no", "journal_line_number", "account_code", "t1"}
    sinks.write_export(sinks.export_lines(*args), str(tmp_path / "out"))
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [t.count(",") for t in text] == [56, 56] and [t.split(",")[3] for t in text] == ["1", "2"]


def test_published_rows_are_not_sorted_by_their_batch(spark, tmp_path):
    """the batch is a literal when a partition is written, not a column that the rows of a task are sorted by."""
    p = spark.createDataFrame([(1, "P", date(2024, 7, 1), Decimal("9.00"), Decimal("4.00"), Decimal("4.00"))],
                              "txn_id int, policy_id string, payment_date date, premium_amount decimal(20,2), fund_tabarru decimal(20,2), fund_tanahud decimal(20,2)")
    c = p.limit(0).withColumnsRenamed({"txn_id": "claim_id", "payment_date": "claim_date", "premium_amount": "claim_amount"})
    staged = M.stage_entries(p, c, "B 1")
    for name, df in zip(M.Staged._fields, staged):
        df.write.parquet(str(tmp_path / name))
    kept = M.Staged(*[spark.read.parquet(str(tmp_path / name)).drop("batch_id") for name in M.Staged._fields])
    passed = spark.createDataFrame([("PASS",)], "status string")
    assert M.publish(kept, passed, str(tmp_path / "out"), "B 1")
    assert spark.read.parquet(str(tmp_path / "out/lines")).where("batch_id = 'B 1'").count() == 6


def test_faults_are_told_by_one_job(spark):
    """out of balance comes before unmatched, as with two checks."""
    some, none = spark.range(1), spark.range(0)
    frames = lambda u, m: Expanded(none, none, u, m)
    assert posting.refuse_faults(frames(none, none), "r") is None
    with pytest.raises(posting.UnbalancedError):
        posting.refuse_faults(frames(some, some), "r")
    with pytest.raises(ValueError, match="without a template"):
        posting.refuse_faults(frames(none, some), "r")


def test_only_rows_near_the_quantile_are_laid_out(spark, monkeypatch):
    """F8: a median sorts and writes the values around it, not all of them."""
    draw = random.Random(8)
    sizes = (0, 1, 100, 10**6, 10**15)
    rows = [(draw.choice(["a", None]), Decimal(draw.choice([-1, 1]) * draw.randint(0, draw.choice(sizes))) / 100) for _ in range(4000)]
    frame = spark.createDataFrame(rows, "k string, v decimal(20,2)")
    laid, spread = [], numbering.spread
    monkeypatch.setattr(numbering, "spread", lambda df, *a, **b: (laid.append(df.count()), spread(df, *a, **b))[1])
    for q in (0, 0.25, 0.5, 0.9, 1):
        got = {r.k: r.x for r in numbering.quantile_cont(frame, ["k"], "v", q, "x").collect()}
        for k in ("a", None):
            mine = sorted(v for j, v in rows if j == k)
            at = (len(mine) - 1) * Decimal(str(q))
            low = mine[int(at)]
            want = low + (mine[min(int(at) + 1, len(mine) - 1)] - low) * (at - int(at))
            assert abs(got[k] - want) < Decimal("0.001")
    assert max(laid) < len({*rows}) / 4


def test_summaries_list_codes_after_counting(spark):
    """F8: codes are gathered from counted combinations; values and types are those of the plain aggregation."""
    draw = random.Random(9)
    some = lambda *x: draw.choice([*x, None])
    money = lambda: some(Decimal(draw.randint(-10**6, 10**6)) / 100)
    day = lambda: some(date(2024, 1, 1), date(2024, 2, 2))
    gl = spark.createDataFrame(
        [(day(), some("A"), some("B"), money(), some("p", "q"), some("x"), some("y", "z")) for _ in range(700)],
        "trx_date date, acc_debit string, acc_credit string, amount decimal(20,2), t_1 string, t_2 string, t_3 string",
    )
    heads = spark.createDataFrame(
        [(day(), some("T"), some("s1", "s2"), some("v"), money(), datetime(2024, 1, draw.randint(1, 28)), some("F", "O")) for _ in range(500)],
        "journal_date date, journal_type string, source_rowid string, voucher_id string, amount decimal(20,2), created_date timestamp_ntz, status string",
    )
    vouchers = spark.createDataFrame(
        [(day(), some("T"), some("n1", "n2", "n3"), some(1, 2, 5)) for _ in range(300)],
        "journal_date date, journal_type string, voucher_no string, line_count bigint",
    )
    a, n = F.avg("amount"), F.count(F.lit(1))
    tcodes = gl.groupBy(F.trunc("trx_date", "MM").cast("date").alias("month"), "t_1", "t_2", "t_3").agg(
        n, F.sum("amount"), F.count_distinct("acc_debit"), F.count_distinct("acc_credit"), a, F.round(F.median("amount"), 4))
    pairs = [
        (reports.account_balance_summary(gl), gl.groupBy("trx_date", "acc_debit", "acc_credit").agg(
            n, F.sum("amount"), a, F.min("amount"), F.max("amount"), *[reports.code_list(c) for c in ("t_1", "t_2", "t_3")])),
        (reports.journal_daily_summary(heads), heads.groupBy("journal_date", "journal_type").agg(
            n, F.count_distinct("source_rowid"), F.count_if(F.col("voucher_id").isNull()), F.count("voucher_id"), F.sum("amount"), a,
            F.min("created_date"), F.max("created_date"), reports.code_list("status"))),
        (reports.voucher_summary(vouchers), vouchers.groupBy("journal_date", "journal_type").agg(
            n, F.count_distinct("voucher_no"), F.min("voucher_no"), F.max("voucher_no"), F.sum("line_count"), F.avg("line_count"))),
        (reports.tcode_analysis(gl).withColumn("median_amount", F.round(F.col("median_amount").cast("double"), 4)), tcodes),
    ]
    for got, want in pairs:
        assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)) for r in want.collect())
    text = pairs[0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 2 and text.rindex("Aggregate") > text.rindex("collect_set")


def test_mean_is_rounded_as_by_avg(spark):
    """20,000 amounts whose mean ends in 4999..., which two roundings would lift."""
    frame = spark.range(20001).select(F.when(F.col("id") == 0, "1.00").otherwise("0.00").cast("decimal(20,2)").alias("amount"), F.lit(-1).alias("s"))
    cases = [frame, frame.withColumn("amount", (F.col("amount") * F.col("s")).cast("decimal(20,2)")), frame.limit(7), frame.limit(0)]
    for df in cases:
        got = df.agg(A.mean_of(F.sum("amount"), F.count("amount")).cast("decimal(24,6)").alias("m"), F.avg("amount").alias("a")).first()
        assert got.m == got.a
    for cents, n in ((9999, 20000), (-9999, 20000), (10**18, 3), (49999, 100000000)):
        got = spark.range(1).select(A.mean_of(F.lit(Decimal(cents) / 100).cast("decimal(30,2)"), F.lit(n)).alias("m")).first().m
        units = (abs(cents) * 20000 + n) // (2 * n)
        assert got == Decimal(units if cents > 0 else -units).scaleb(-6)


def test_reports_read_the_ledger_once(spark, root):
    """F8: both ledger reports start from one written table."""
    jobs = posting.standard_reports(S.journals(spark, root), S.gl_entries(spark, root))
    for name in ("account_balance", "tcode_analysis"):
        assert "lineitem.parquet" not in jobs[name]._jdf.queryExecution().executedPlan().toString()


def test_ledger_reports_share_their_cells(spark):
    """F8: both ledger reports fold the same written counts, and give what they give alone."""
    rows = [(date(2024, 1 + i % 2, 1 + i % 3), "A" if i % 4 else None, None, Decimal(i % 7) if i % 5 else None, "p", "x", f"t{i % 2}") for i in range(60)]
    gl = spark.createDataFrame(rows, "trx_date date, acc_debit string, acc_credit string, amount decimal(20,2), t_1 string, t_2 string, t_3 string")
    heads = spark.createDataFrame([], "journal_date date, journal_type string, source_rowid string, voucher_id string, amount decimal(20,2), created_date timestamp_ntz, journal_ts timestamp_ntz, status string")
    jobs = posting.standard_reports(heads, gl)
    for name, alone in (("account_balance", reports.account_balance_summary(gl)), ("tcode_analysis", reports.tcode_analysis(gl))):
        assert jobs[name].schema == alone.schema
        assert sorted(map(repr, jobs[name].collect())) == sorted(map(repr, alone.collect()))
        assert "report-cells" in plan(jobs[name])


def test_lines_are_counted_before_they_meet_their_order(spark, tmp_path):
    """F8: a voucher's lines are counted by key; repeated orders and missing keys count as in the join of all rows."""
    from queries.reports import finished_vouchers

    day = datetime(2024, 1, 5)
    orders = [(1, 7, "F", 1.0, day, "1-URGENT"), (1, 7, "F", 1.0, day, "1-URGENT"), (2, 7, "F", 1.0, day, None), (3, 7, "O", 1.0, day, "1-URGENT"),
              (4, 7, "F", 1.0, None, "1-URGENT"), (None, 7, "F", 1.0, day, "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k,) for k in (1, 1, 1, 2, 3, 4, 4, None, 9)], "l_orderkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = finished_vouchers(spark, str(tmp_path))
    assert sorted((r.journal_id, r.journal_type, r.line_count, r.voucher_no) for r in out.collect()) == [
        (1, "S0110", 6, "S0110240105000000001"), (2, None, 1, None), (4, "S0110", 2, None)]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join") < text.rindex("Aggregate [l_orderkey")
