"""Progress, throughput and alerts of batch workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Targets and alert thresholds.
TARGET_RPS = 5556
TARGET_WORKER_RPS = 720
TARGET_MINUTES = 20
WINDOW_MINUTES = 120
SLOW_WORKER_RPS = 500
STALL_SECONDS = 300
ALERT_RULES = [
    ("THROUGHPUT_CRITICAL", "throughput", "<", 2000, "CRITICAL", "Add more workers immediately"),
    ("THROUGHPUT_WARNING", "throughput", "<", 4000, "WARNING", "Monitor closely, consider adding workers"),
    ("ETA_CRITICAL", "eta_minutes", ">", 90, "CRITICAL", "Scale up workers or abort and reschedule"),
    ("ETA_WARNING", "eta_minutes", ">", 25, "WARNING", "Monitor closely"),
    ("WORKER_FAILURES_CRITICAL", "failed_workers", ">", 20, "CRITICAL", "Replace failed workers"),
    ("WORKER_FAILURES_WARNING", "failed_workers", ">", 5, "WARNING", "Check failed workers"),
]

RATE = "decimal(20,2)"


def _ratio(a: Column, b: Column, out: str = RATE) -> Column:
    """a / b as a rounded decimal, 0 where b is 0."""
    value = F.try_divide(a.cast("decimal(24,4)"), b.cast("decimal(20,4)"))
    return F.round(F.coalesce(value, F.lit(0)), 2).cast(out)


def latest_checkpoints(points: DataFrame) -> DataFrame:
    """Last checkpoint of each worker (highest event id on equal times)."""
    rest = [c for c in points.columns if c != "worker_id"]
    best = points.groupBy("worker_id").agg(
        F.max_by(F.struct(*rest), F.struct("checkpoint_at", "event_id")).alias("b")
    )
    return best.select("worker_id", *[F.col("b")[c].alias(c) for c in rest])


def stalled_workers(points: DataFrame, as_of: Column, after_seconds: int = STALL_SECONDS) -> DataFrame:
    """Workers without a checkpoint for a while, and failed ones."""
    last = latest_checkpoints(points)
    age = F.timestamp_diff("SECOND", F.col("checkpoint_at"), as_of)
    return (
        last.withColumn("silent_seconds", age)
        .withColumn(
            "reason",
            F.when(F.col("status") == "FAILED", "FAILED").when(
                (F.col("status") == "RUNNING") & (F.col("silent_seconds") > after_seconds), "STALLED"
            ),
        )
        .where(F.col("reason").isNotNull())
        .select("worker_id", "reason", "silent_seconds")
    )


def worker_summary(points: DataFrame) -> DataFrame:
    """Counts by status with mean rate, volume and slow workers."""
    slow = (F.col("status") == "RUNNING") & (F.col("records_per_second") < SLOW_WORKER_RPS)
    return points.groupBy("status").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_distinct("worker_id").alias("workers"),
        F.avg("records_per_second").alias("mean_rate"),
        F.sum("records_per_second").alias("total_rate"),
        F.count_if(slow).alias("slow_points"),
    )


def progress(workers: DataFrame) -> DataFrame:
    """``workers``: expected_records, processed_records, started_at, updated_at."""
    total, done = F.col("total_records"), F.col("processed_records")
    return (
        workers.agg(
            F.sum("expected_records").alias("total_records"),
            F.sum("processed_records").alias("processed_records"),
            F.timestamp_diff("SECOND", F.min("started_at"), F.max("updated_at")).alias("elapsed_seconds"),
        )
        .withColumn("percentage", F.round(_ratio(done * 100, total, "decimal(20,4)"), 1).cast("decimal(10,1)"))
        .withColumn("rate", _ratio(done, F.col("elapsed_seconds")))
        .withColumn("eta_seconds", _ratio((total - done) * F.col("elapsed_seconds"), done))
    )


def throughput(points: DataFrame, as_of: Column, seconds: int = 60) -> DataFrame:
    """Current rate of the last seconds, mean and peak rate against the target."""
    recent = (F.col("checkpoint_at") >= as_of - F.make_dt_interval(secs=F.lit(seconds))) & (
        F.col("checkpoint_at") <= as_of
    )
    current = F.coalesce(F.avg(F.when(recent, F.col("records_per_second"))), F.lit(0))
    return (
        points.agg(
            F.round(current, 2).cast(RATE).alias("current_rps"),
            F.round(F.avg("records_per_second"), 2).cast(RATE).alias("average_rps"),
            F.max("records_per_second").alias("peak_rps"),
        )
        .withColumn("performance_ratio", _ratio(F.col("current_rps"), F.lit(TARGET_RPS)))
        .withColumn("status", F.when(F.col("current_rps") > TARGET_RPS, "good").otherwise("warning"))
    )


def batch_kpis(batches: DataFrame) -> DataFrame:
    """``batches``: batch_id, transactions, total_seconds, worker_count,
    validation_failures, failed_workers, eta_minutes."""
    rate = _ratio(F.col("transactions"), F.col("total_seconds"))
    return (
        batches.withColumn("total_minutes", _ratio(F.col("total_seconds"), F.lit(60)))
        .withColumn("buffer_minutes", (F.lit(WINDOW_MINUTES) - F.col("total_minutes")).cast(RATE))
        .withColumn("on_time", F.col("total_minutes") <= TARGET_MINUTES)
        .withColumn("throughput", rate)
        .withColumn("performance_ratio", _ratio(F.col("throughput"), F.lit(TARGET_RPS)))
        .withColumn("entries_per_second", (F.col("throughput") * 3).cast(RATE))
        .withColumn("worker_rps", _ratio(F.col("throughput"), F.col("worker_count")))
        .withColumn("worker_utilization", _ratio(F.col("worker_rps"), F.lit(TARGET_WORKER_RPS)))
        .withColumn("success", F.col("validation_failures") == 0)
    )


def alerts(kpis: DataFrame) -> DataFrame:
    """Alert rows per batch; a metric raises its most severe alert only."""
    seen: dict[str, Column] = {}
    rows = []
    for name, metric, sign, limit, level, action in ALERT_RULES:
        hit = F.col(metric) < limit if sign == "<" else F.col(metric) > limit
        fresh = hit & ~seen.get(metric, F.lit(False))
        seen[metric] = seen.get(metric, F.lit(False)) | hit
        rows.append(
            F.when(
                fresh,
                F.struct(
                    F.lit(name).alias("alert"),
                    F.lit(level).alias("level"),
                    F.col(metric).cast(RATE).alias("value"),
                    F.lit(action).alias("action"),
                ),
            )
        )
    return (
        kpis.withColumn("a", F.explode_outer(F.array_compact(F.array(*rows))))
        .where(F.col("a").isNotNull())
        .select("batch_id", "a.*")
    )


# The advice texts.
def recommendation() -> Column:
    """Dry-run advice over batch KPIs."""
    return (
        F.when(F.col("validation_failures") > 0, "DO NOT PROCEED - Validation failures detected")
        .when(F.col("total_minutes") > 90, "WARNING - Batch may exceed 2-hour window. Consider optimization.")
        .when(
            F.col("throughput") < TARGET_RPS,
            "WARNING - Throughput below target. Monitor closely during production run.",
        )
        .otherwise("PROCEED - Dry run successful. System ready for production batch.")
    )
