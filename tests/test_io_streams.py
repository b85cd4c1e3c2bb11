import os
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.layout import FIELD_COUNT, padded_fields
from ledgerloom.operators import listing, matching, retention, sinks
from ledgerloom.plans.exports import export_vouchers
from ledgerloom.sources import readers
from ledgerloom.sources.generators import synthetic_transactions
from ledgerloom.sources.routing import read_sources, source_name
from ledgerloom.streaming import ledger_streams as J


def test_month_read_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "txn")
    for month in (1, 2, 3):
        sinks.append(synthetic_transactions(spark, 50, 2024, month), path, ["txn_month"])
    df = readers.load_month(spark, path, 2024, 2)
    assert df.count() == 50
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan
    assert "txn_month#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all("txn_month=2024-02-01" in r[0] for r in df.select("_metadata.file_path").distinct().collect())


def test_gl_day_read_unpacks_json(spark, tmp_path):
    path = str(tmp_path / "gl")
    rows = [(1, date(2024, 7, 18), '{"reference_1":"r","description":"d"}'), (2, date(2024, 7, 19), "{}"), (3, date(2024, 7, 18), "broken")]
    spark.createDataFrame(rows, "id bigint, trx_date date, data string").write.parquet(path)
    got = {r.id: (r.reference_1, r.general_description_2) for r in readers.load_gl_day(spark, path, date(2024, 7, 18)).collect()}
    assert got == {1: ("r", None), 3: (None, None)}


def test_views_keep_decimal_amounts(spark):
    gl = spark.createDataFrame([(1, "12.345")], "id int, amount string")
    readers.register_gl_view(gl, "typed_gl")
    assert spark.sql("select amount from typed_gl").first()[0] == Decimal("12.35")
    readers.create_views({"old_name": gl})
    assert spark.table("old_name").count() == 1


def test_only_active_settings_are_read(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "journal_type string, status int")
    assert [r.journal_type for r in readers.active_setting_rows(df).collect()] == ["a"]


def test_csv_separates_lines_that_do_not_parse(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b\n1,2024-01-01\nx,2024-01-02\n3,2024-01-03\n")
    good, bad = readers.read_csv(spark, str(path), "a int, b date")
    assert sorted(r.a for r in good.collect()) == [1, 3]
    assert good.count() == 2
    assert [(r.a, r._corrupt) for r in bad.collect()] == [(None, "x,2024-01-02")]


@pytest.mark.parametrize("ds,name", [(1, "underwriting"), (110, "underwriting"), (91, "unit_deal_ul"), (93, "appropriate"), (85, None), (191, "unit_deal_ul"), (195, None), (45, "claim_payment"), (200, None)])
def test_routing(spark, ds, name):
    assert spark.range(1).select(source_name(F.lit(ds)).alias("s")).first().s == name


def test_rows_come_only_from_their_own_source(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 35), ("c", 2)], "id string, ds int")
    got = read_sources({"underwriting": frame, "claim_process": frame}, [1, 35])
    assert sorted(r.id for r in got.collect()) == ["a", "b"]


def test_new_rows_ignore_existing_and_repeated_keys(spark):
    old = spark.createDataFrame([("1", "A")], "source_rowid string, journal_type string")
    new = spark.createDataFrame([("1", "A", 9), ("1", "B", 2), ("1", "B", 1), ("2", "A", 5)], "source_rowid string, journal_type string, v int")
    got = sorted(map(tuple, sinks.new_rows(new, old, ["source_rowid", "journal_type"], ["v"]).collect()))
    assert got == [("1", "B", 1), ("2", "A", 5)]


def test_rerun_of_a_day_replaces_only_that_day(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda d, v: spark.createDataFrame([(d, v)], "journal_date string, v int")
    sinks.replace_partitions(day("2024-01-01", 1).union(day("2024-01-02", 2)), path, ["journal_date"], ["v"])
    sinks.replace_partitions(day("2024-01-02", 7), path, ["journal_date"], ["v"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 7]


def test_export_writes_57_fields_without_header(spark, tmp_path):
    heads = spark.createDataFrame(
        [("v1", date(2024, 7, 1), "S0110", "N1", False, None), ("v2", date(2024, 7, 2), "S0110", "N2", True, None), ("v3", date(2024, 8, 1), "S0110", "N3", False, None)],
        "voucher_id string, journal_date date, journal_type string, voucher_no string, exported boolean, export_date timestamp_ntz",
    )
    body = spark.createDataFrame([("v1", "N1", ["a", "b"]), ("v1", "N1", ["c"] * 58), ("v2", "N2", ["d"]), ("v3", "N3", ["e"])], "voucher_id string, voucher_no string, fields array<string>")
    path = str(tmp_path / "out")
    out = export_vouchers(heads, body, path, date(2024, 7, 1), date(2024, 7, 31))
    lines = [r.value.split(",") for r in spark.read.text(path).collect()]
    assert out.line_count == 2 and all(len(x) == FIELD_COUNT for x in lines)
    assert {r.voucher_id: r.exported for r in out.vouchers.collect()} == {"v1": True, "v2": True, "v3": False}
    with pytest.raises(ValueError):
        export_vouchers(heads, body, str(tmp_path / "none"), date(2025, 1, 1), date(2025, 1, 2))


def test_padding(spark):
    df = spark.createDataFrame([(["x"],), (["y"] * 60,)], "f array<string>").select(padded_fields(F.col("f")).alias("f"))
    assert [len(r.f) for r in df.collect()] == [57, 57]


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(2):
        sinks.log_run(spark, path, {"run_id": f"r{i}", "status": "COMPLETED", "record_count": i})
    assert spark.read.parquet(path).count() == 2


def test_retention(spark):
    df = spark.createDataFrame([(date(2020, 1, 15),), (date(2023, 5, 1),), (None,)], "d date")
    out = retention.split_by_age(df, "d", F.lit(date(2023, 6, 1)), 1095)
    assert (out.keep.count(), out.archive.count()) == (2, 1)
    months = df.select(F.trunc("d", "MM").cast("date").alias("month"))
    old = retention.expired_months(months, F.lit(date(2023, 6, 1)), 12)
    assert [r.month for r in old.collect()] == [date(2020, 1, 1)]
    assert retention.without_months(months.where("month is not null"), "month", old).count() == 1


def test_deletion_refuses_vouchered_journals(spark):
    j = spark.createDataFrame([(1, None), (2, "v"), (3, None)], "id int, voucher_id string")
    left, refused = listing.deletable(j, spark.createDataFrame([(1,), (2,), (9,)], "id int"))
    assert sorted(r.id for r in left.collect()) == [2, 3]
    assert {r.id: r.reason for r in refused.collect()} == {2: "HAS_VOUCHER", 9: "NOT_FOUND"}


def test_reconciliation_does_not_multiply_repeated_references(spark):
    side = lambda rows: spark.createDataFrame([(r, Decimal(a)) for r, a in rows], "reference string, amount decimal(20,2)")
    out = matching.reconcile(side([("a", "1")] * 50), side([("a", "50"), ("b", "2")]), side([("a", "50.01"), ("c", "3")]))
    got = {r.reference: (r.matched, r.exception) for r in out.collect()}
    assert got == {"a": (True, None), "b": (False, "MISSING_JOURNAL"), "c": (False, "MISSING_JOURNAL")}


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """Four files of events, some sent twice."""
    path = str(tmp_path_factory.mktemp("arrivals"))
    base = spark.range(200).select(
        F.col("id"), (F.col("id") % 5).alias("k"), F.lit("a").alias("account_code"), F.lit("D").alias("dc"),
        (F.col("id") * 1000).cast("decimal(20,2)").alias("amount"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("event_time"),
    )
    for i in range(4):
        base.where((F.col("id") % 4 == i) | (F.col("id") < 5)).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_summary_equals_batch(spark, arrivals, tmp_path):
    stream = J.hourly_summary(J.read_stream(spark, arrivals, 1), "event_time", ["k"], "amount", "10 days")
    J.run_updates(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    got = J.latest_versions(spark.read.parquet(str(tmp_path / "o")), ["hour", "k"])
    want = J.hourly_summary(spark.read.parquet(arrivals), "event_time", ["k"], "amount")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_ingest_is_idempotent(spark, arrivals, tmp_path):
    assert spark.read.parquet(arrivals).count() > 200
    J.run_append(J.idempotent_ingest(J.read_stream(spark, arrivals, 1), "event_time", ["id"]), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 200
    # A restart on the same checkpoint finds nothing new.
    J.run_append(J.idempotent_ingest(J.read_stream(spark, arrivals, 1), "event_time", ["id"]), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 200


def test_stream_fan_out_splits_by_approval(spark, arrivals, tmp_path):
    accounts = spark.createDataFrame([("a", "Cash")], "account_code string, account_name string")
    stream = J.journal_stream(J.read_stream(spark, arrivals), accounts)
    J.run_batches(stream, J.fan_out(str(tmp_path / "all"), str(tmp_path / "appr")), str(tmp_path / "c"))
    everything, waiting = spark.read.parquet(str(tmp_path / "all")), spark.read.parquet(str(tmp_path / "appr"))
    assert everything.count() == spark.read.parquet(arrivals).where("amount > 0").count()
    assert waiting.count() == everything.where("amount > 100000").count() > 0


def test_sessions_end_where_a_worker_falls_silent(spark):
    start = 1_700_000_000
    rows = [(1, start), (1, start + 200), (1, start + 1000)]
    df = spark.createDataFrame(rows, "worker_id int, s bigint").withColumn("t", F.timestamp_seconds("s"))
    got = J.worker_sessions(df, "t").orderBy("active_from").collect()
    assert [r.points for r in got] == [2, 1]
    assert got[0].stalled_from - got[0].active_from == timedelta(seconds=500)


def test_entry_contract(spark, root):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 130
    df = entry.entry(spark)
    assert "journal_id" in df.columns and not df.isEmpty()
    assert os.path.isdir(root)
