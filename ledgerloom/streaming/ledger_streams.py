"""Streaming forms of ingest, monitoring and incremental summaries.

Every function maps a streaming (or batch) DataFrame to another one; the run
helpers at the end drive a stream over the files that are there and stop.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import audit, controls
from ledgerloom.operators.numbering import TASK_ROWS
from ledgerloom.scratch import scratch_path


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over Parquet with the schema of the files already there.

    ``path`` is a folder, or a glob where a single file is to be streamed.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_for_batches(rows: DataFrame, path: str, batches: int = 3, file_rows: int = TASK_ROWS) -> tuple[str, int]:
    """Write ``rows`` below ``path``; the folder, and the files per trigger at which a stream of it has ``batches`` batches.

    Every task writes its own rows, in files of up to ``file_rows``. Only where that gives too few files to be dealt
    evenly, so for few rows, they are written again as one file per batch.
    """
    rows.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/all")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/all")
    files = len(written.inputFiles())
    if files >= batches * (batches - 1):
        return f"{path}/all", -(-files // batches)
    written.repartition(batches).write.parquet(f"{path}/even")
    return f"{path}/even", 1


def journal_stream(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Enrich by the static account table, keep valid rows, map to journals.

    ``entries``: id, account_code, dc, amount, event_time.
    """
    return (
        entries.join(accounts, "account_code", "left")
        .where((F.col("amount") > 0) & F.col("dc").isin("D", "C") & F.col("account_name").isNotNull())
        .select(
            "id", "event_time", F.to_date("event_time").alias("journal_date"), "account_code", "account_name", "dc",
            "amount", controls.approval_level(F.col("amount")).alias("approval_level"),
        )
    )


def fan_out(all_path: str, approval_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: all journals, and those needing approval.

    Each batch replaces its own partition, so a retried batch writes no doubles.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("batch_no", F.lit(batch_id)).persist()
        for path, df in ((all_path, tagged), (approval_path, tagged.where("approval_level > 0"))):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(path)
        tagged.unpersist()

    return write


def hourly_summary(events: DataFrame, time: str, keys: list[str], value: str, watermark: str = "1 hour") -> DataFrame:
    """Count and sum per tumbling hour."""
    return (
        events.withWatermark(time, watermark)
        .groupBy(F.window(time, "1 hour"), *keys)
        .agg(F.count(F.lit(1)).alias("entry_count"), F.sum(value).alias("total_amount"))
        .select(F.col("window.start").alias("hour"), *keys, "entry_count", "total_amount")
    )


def sliding_throughput(points: DataFrame, time: str, watermark: str = "1 minute") -> DataFrame:
    """Mean rate over the last 60 seconds, every 10 seconds."""
    return (
        points.withWatermark(time, watermark)
        .groupBy(F.window(time, "60 seconds", "10 seconds"))
        .agg(F.avg("records_per_second").alias("mean_rate"), F.count(F.lit(1)).alias("points"))
        .select(F.col("window.start").alias("from_time"), F.col("window.end").alias("to_time"), "mean_rate", "points")
    )


def worker_sessions(points: DataFrame, time: str, gap: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Activity sessions per worker; a session's end marks the start of a stall."""
    return (
        points.withWatermark(time, watermark)
        .groupBy(F.session_window(time, gap), "worker_id")
        .agg(F.count(F.lit(1)).alias("points"))
        .select("worker_id", F.col("session_window.start").alias("active_from"), F.col("session_window.end").alias("stalled_from"), "points")
    )


def stall_stream(points: DataFrame, time: str, gap_seconds: int = 300, watermark: str = "10 minutes") -> DataFrame:
    """worker_id, active_from, stalled_from and points of each session whose worker has fallen silent.

    The state of a worker is its open sessions: first and last time and number of points. A point joins the sessions
    less than the gap away, so points out of order merge sessions; points behind the watermark are dropped by
    Spark. A timer stands at the end of the earliest open session, last point plus gap; when the watermark
    passes it, the stall row goes out. A worker's state holds the sessions inside the watermark's delay only.
    """
    gap = gap_seconds * 1_000_000
    out = "worker_id bigint, active_from timestamp, stalled_from timestamp, points bigint"
    held = "sessions array<struct<first: bigint, last: bigint, n: bigint>>"

    def track(key, batches, state):
        import pandas as pd

        sessions = [tuple(x) for x in state.get[0]] if state.exists else []
        new = [(t, t, 1) for pdf in batches for t in pdf["at"].tolist()]
        merged: list[list[int]] = []
        for first, last, n in sorted([*sessions, *new]):
            if merged and first - merged[-1][1] < gap:
                merged[-1][1] = max(merged[-1][1], last)
                merged[-1][2] += n
            else:
                merged.append([first, last, n])
        mark = state.getCurrentWatermarkMs()
        ends = [-(-(s[1] + gap) // 1000) for s in merged]  # timers count milliseconds
        closed = [s for s, end in zip(merged, ends) if end <= mark]
        still = [(tuple(s), end) for s, end in zip(merged, ends) if end > mark]
        if still:
            state.update(([s for s, _ in still],))
            state.setTimeoutTimestamp(min(end for _, end in still))
        elif state.exists:
            state.remove()
        if closed:
            first, last, n = zip(*closed)
            when = lambda xs: pd.to_datetime(xs, unit="us", utc=True)
            ends = [x + gap for x in last]
            yield pd.DataFrame({"worker_id": [key[0]] * len(n), "active_from": when(first), "stalled_from": when(ends), "points": n})

    rows = points.withWatermark(time, watermark).select(F.col("worker_id").cast("bigint").alias("worker_id"), time, F.unix_micros(time).alias("at"))
    return rows.groupBy("worker_id").applyInPandasWithState(track, out, held, "append", "EventTimeTimeout")


def idempotent_ingest(rows: DataFrame, time: str, keys: list[str], watermark: str = "10 days") -> DataFrame:
    """First arrival of each key; repeats inside the watermark are dropped."""
    return rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def audit_alert_stream(events: DataFrame) -> DataFrame:
    """Scored audit events with a risk above 0.7 or a high-value flag."""
    scored = audit.with_compliance(events).withColumn("risk_score", audit.risk_score())
    return scored.where(
        (F.col("risk_score") > F.lit(Decimal("0.7"))) | F.array_contains("compliance_flags", "HIGH_VALUE_TRANSACTION")
    )


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there into Parquet files, then stop."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Changed groups of each micro-batch below their batch number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_no", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_no").parquet(path)

    run_batches(stream, write, checkpoint, mode="update")


def latest_versions(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Current value of every group from the written updates."""
    rest = [c for c in updates.columns if c not in keys and c != "batch_no"]
    best = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_no").alias("b"))
    return best.select(*keys, *[F.col("b")[c].alias(c) for c in rest])


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Output and checkpoint folders in the shared scratch area."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
