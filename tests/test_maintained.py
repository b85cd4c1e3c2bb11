"""Summaries and stalls kept up by streams, and checks on rows with gaps."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import audit, reports
from ledgerloom.plans.month_end import mark_processed
from ledgerloom.sources import tables as S
from ledgerloom.streaming import ledger_streams as J
from ledgerloom.streaming import maintained as M


def test_merged_batches_equal_the_summary(spark, tmp_path):
    draw = random.Random(2)
    rows = [
        (date(2024, 1, draw.randint(1, 3)), draw.choice(["A", None]), draw.choice(["X", "Y", None]), draw.choice([None, Decimal(draw.randint(-900, 900)) / 100]),
         draw.choice(["p", "q", None]), None, draw.choice(["z", "y"]))
        for _ in range(300)
    ]
    schema = "trx_date date, acc_debit string, acc_credit string, amount decimal(20,2), t_1 string, t_2 string, t_3 string"
    frame = spark.createDataFrame(rows, schema).withColumn("k", F.monotonically_increasing_id())
    write, target = M.maintain(M.ACCOUNT_DAYS, str(tmp_path / "state")), str(tmp_path / "state")
    for number in (0, 1, 2, 1):
        write(frame.where(F.col("k") % 3 == number), number)
    want = sorted(map(repr, reports.account_balance_summary(frame).collect()))
    columns = reports.account_balance_summary(frame).columns
    assert sorted(map(repr, M.maintained(spark, M.ACCOUNT_DAYS, target).select(*columns).collect())) == want
    M.compacted(spark, M.ACCOUNT_DAYS, target, str(tmp_path / "folded"))
    assert sorted(map(repr, M.maintained(spark, M.ACCOUNT_DAYS, str(tmp_path / "folded")).select(*columns).collect())) == want


def test_stalls_of_points_late_and_out_of_order(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    first = [(1, at(0)), (1, at(7)), (2, at(3)), (1, at(30))]
    second = [(1, at(23.5)), (1, at(26)), (2, at(1)), (1, at(60))]  # (2, 1) joins a session that is still open
    third = [(2, at(49)), (1, at(90)), (2, at(15)), (2, at(53)), (3, at(70)), (3, at(81))]  # (2, 15) is behind the watermark
    for k, part in enumerate((first, second, third)):
        spark.createDataFrame(part, "worker_id bigint, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    J.run_append(J.stall_stream(stream, "ts"), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = sorted(((r.worker_id, r.active_from, r.stalled_from, r.points) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    # The watermark ends at 80; the sessions of (1, 90) and (3, 81) are open.
    want = [(1, at(0), at(5), 1), (1, at(7), at(12), 1), (1, at(23.5), at(35), 3), (1, at(60), at(65), 1), (2, at(1), at(8), 2), (2, at(49), at(58), 2), (3, at(70), at(75), 1)]
    assert got == want


def test_rows_without_a_day_keep_their_flag(spark):
    rows = [(1, False, None), (2, True, None), (3, False, date(2024, 1, 5)), (4, False, date(2024, 2, 5)), (5, None, None)]
    frame = spark.createDataFrame(rows, "id int, batch_processed boolean, payment_date date")
    got = {r.id: (r.batch_processed, r.batch_id) for r in mark_processed(frame, "payment_date", date(2024, 1, 1), date(2024, 1, 31), "B").collect()}
    assert got == {1: (False, None), 2: (True, None), 3: (True, "B"), 4: (False, None), 5: (None, None)}


def test_a_changed_first_link_is_found_inside_a_slice(spark, root):
    events = S.audit_events(spark, root)
    by_day = audit.build_hash_chain(events, F.unix_date(F.to_date("event_timestamp")))
    stored = events.join(by_day.drop(*audit.CHAIN), "event_id").where("event_timestamp >= timestamp'2024-01-15'")
    assert audit.verify_hash_chain(stored, sliced=True).isEmpty()
    one = stored.where("chain_no = 1").orderBy("event_id").first().event_id
    forged = stored.withColumn("hash_previous", F.when(F.col("event_id") == one, F.lit("0" * 64)).otherwise(F.col("hash_previous")))
    errors = audit.verify_hash_chain(forged, sliced=True).where(F.col("event_id") == one).collect()
    assert "HASH_CHAIN_BROKEN" in {r.error for r in errors}
