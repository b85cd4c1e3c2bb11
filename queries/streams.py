from pyspark.sql import functions as F

from ledgerloom.sources import tables as S
from ledgerloom.streaming import ledger_streams as J
from ledgerloom.streaming import maintained as M
from queries.registry import ORACLES, query
from queries import reports  # noqa: F401  the summaries that are maintained
from queries.views import AUDIT


def events(spark, root):
    e = J.read_stream(spark, f"{root}/event[s].parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def checkpoint_points(spark, root):
    return events(spark, root).select(
        (F.col("user_id") % 10).alias("worker_id"), F.col("value").cast(S.MONEY).alias("records_per_second"),
        F.col("ts").alias("checkpoint_at"),
    )


def updated(stream, spark, name, keys):
    out, mark = J.stream_paths(spark, name)
    J.run_updates(stream, out, mark)
    return J.latest_versions(spark.read.parquet(out), keys)


@query(
    "j01_journal_stream",
    """SELECT event_id AS id, ts AS event_time, CAST(ts AS DATE) AS journal_date, CAST(user_id % 30 AS VARCHAR) AS account_code, n_name AS account_name,
 CASE WHEN event_id % 2 = 0 THEN 'D' ELSE 'C' END AS dc, CAST(CAST(value AS DECIMAL(20,2)) * 10000 AS DECIMAL(20,2)) AS amount,
 CASE WHEN CAST(value AS DECIMAL(20,2)) * 10000 <= 100000 THEN 0 WHEN CAST(value AS DECIMAL(20,2)) * 10000 <= 1000000 THEN 1
  WHEN CAST(value AS DECIMAL(20,2)) * 10000 <= 10000000 THEN 2 ELSE 3 END AS approval_level
 FROM events JOIN nation ON n_nationkey = user_id % 30 WHERE CAST(value AS DECIMAL(20,2)) > 0""",
)
def j01(spark, root):
    entries = events(spark, root).select(
        F.col("event_id").alias("id"), F.col("ts").alias("event_time"),
        (F.col("user_id") % 30).cast("string").alias("account_code"),
        F.when(F.col("event_id") % 2 == 0, "D").otherwise("C").alias("dc"),
        (F.col("value").cast(S.MONEY) * 10000).cast(S.MONEY).alias("amount"),
    )
    accounts = S.table(spark, root, "nation").select(
        F.col("n_nationkey").cast("string").alias("account_code"), F.col("n_name").alias("account_name")
    )
    out, mark = J.stream_paths(spark, "j01")
    J.run_append(J.journal_stream(entries, accounts), out, mark)
    return spark.read.parquet(out).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query(
    "j02_fan_out",
    """WITH a AS (SELECT event_id AS id, CAST(value AS DECIMAL(20,2)) * 10000 AS amount FROM events JOIN nation ON n_nationkey = user_id % 30
   WHERE CAST(value AS DECIMAL(20,2)) > 0)
 SELECT 'all' AS target, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(30,2)) AS total FROM a
 UNION ALL SELECT 'approval', COUNT(*), CAST(SUM(amount) AS DECIMAL(30,2)) FROM a WHERE amount > 100000""",
)
def j02(spark, root):
    entries = events(spark, root).select(
        F.col("event_id").alias("id"), F.col("ts").alias("event_time"),
        (F.col("user_id") % 30).cast("string").alias("account_code"), F.lit("D").alias("dc"),
        (F.col("value").cast(S.MONEY) * 10000).cast(S.MONEY).alias("amount"),
    )
    accounts = S.table(spark, root, "nation").select(
        F.col("n_nationkey").cast("string").alias("account_code"), F.col("n_name").alias("account_name")
    )
    out, mark = J.stream_paths(spark, "j02")
    J.run_batches(J.journal_stream(entries, accounts), J.fan_out(f"{out}/all", f"{out}/approval"), mark)

    def total(name):
        return spark.read.parquet(f"{out}/{name}").agg(
            F.lit(name).alias("target"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")
        )

    return total("all").unionByName(total("approval"))


@query(
    "j03_hourly_summary",
    """SELECT date_trunc('hour', ts) AS hour, event_type, COUNT(*) AS entry_count, CAST(SUM(CAST(value AS DECIMAL(20,2))) AS DECIMAL(30,2)) AS total_amount
 FROM events GROUP BY 1, 2""",
)
def j03(spark, root):
    e = events(spark, root).withColumn("amount", F.col("value").cast(S.MONEY))
    out = updated(J.hourly_summary(e, "ts", ["event_type"], "amount"), spark, "j03", ["hour", "event_type"])
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(
    "j04_sliding_throughput",
    """WITH w AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * k) AS from_time, CAST(value AS DECIMAL(20,2)) AS v
   FROM events, range(6) r(k))
 SELECT from_time, from_time + INTERVAL 60 SECOND AS to_time, CAST(round(SUM(v) / COUNT(*), 4) AS DECIMAL(24,4)) AS mean_rate, COUNT(*) AS points FROM w GROUP BY 1, 2""",
)
def j04(spark, root):
    out = updated(J.sliding_throughput(checkpoint_points(spark, root), "checkpoint_at"), spark, "j04", ["from_time"])
    return out.select(
        F.col("from_time").cast("timestamp_ntz").alias("from_time"), F.col("to_time").cast("timestamp_ntz").alias("to_time"),
        F.round("mean_rate", 4).cast("decimal(24,4)").alias("mean_rate"), "points",
    )


@query(
    "j04_worker_sessions",
    """WITH s AS (SELECT user_id % 10 AS worker_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events),
 g AS (SELECT *, SUM(new) OVER (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
 SELECT worker_id, MIN(ts) AS active_from, MAX(ts) + INTERVAL 5 MINUTE AS stalled_from, COUNT(*) AS points FROM g GROUP BY worker_id, g""",
)
def j04_sessions(spark, root):
    """Session windows close on the watermark, so this form runs as a batch."""
    points = checkpoint_points_batch(spark, root)
    out = J.worker_sessions(points, "checkpoint_at")
    return out.select(
        "worker_id", F.col("active_from").cast("timestamp_ntz").alias("active_from"),
        F.col("stalled_from").cast("timestamp_ntz").alias("stalled_from"), "points",
    )


def checkpoint_points_batch(spark, root):
    c = S.checkpoints(spark, root)
    return c.withColumn("checkpoint_at", F.col("checkpoint_at").cast("timestamp"))


@query("j05_idempotent_ingest", "SELECT COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT user_id) AS distinct_keys FROM events")
def j05(spark, root):
    out, mark = J.stream_paths(spark, "j05")
    J.run_append(J.idempotent_ingest(events(spark, root), "ts", ["user_id"], "60 days"), out, mark)
    return spark.read.parquet(out).agg(
        F.count(F.lit(1)).alias("users"), F.count_distinct("user_id").alias("distinct_keys")
    )


@query(
    "j06_audit_alerts",
    f"""WITH {AUDIT} SELECT event_id FROM audit WHERE amount > 1000000 OR
 (CASE WHEN hour(event_timestamp) < 6 OR hour(event_timestamp) > 22 THEN 0.2 ELSE 0 END + CASE WHEN amount > 1000000 THEN 0.3 ELSE 0 END
  + CASE WHEN event_type = 'JOURNAL_DELETED' THEN 0.4 ELSE 0 END - CASE WHEN authentication_method <> 'password' THEN 0.1 ELSE 0 END) > 0.7""",
)
def j06(spark, root):
    """The batch mapping of the audit view applied to the stream of events."""
    raw = J.read_stream(spark, f"{root}/event[s].parquet")
    out, mark = J.stream_paths(spark, "j06")
    J.run_append(J.audit_alert_stream(S.audit_view(raw)), out, mark)
    return spark.read.parquet(out).select("event_id")


def maintained(spark, rows, summary, name):
    """The summary after a stream over all rows in three batches, the last of which ran again, folded and read."""
    base, mark = J.stream_paths(spark, name)
    folder, files = J.write_for_batches(rows, f"{base}/rows")
    write, batches = M.maintain(summary, f"{base}/state"), []

    def twice(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 2:
            write(batch, batch_id)
        batches.append(batch_id)

    J.run_batches(J.read_stream(spark, folder, files_per_trigger=files), twice, mark)
    M.compacted(spark, summary, f"{base}/state", f"{base}/folded")
    return M.maintained(spark, summary, f"{base}/folded")


@query("j03_maintained_journal_days", ORACLES["e03_journal_daily_summary"])
def j03_journal_days(spark, root):
    return maintained(spark, S.journals(spark, root), M.JOURNAL_DAYS, "j03-journals")


@query("j03_maintained_account_days", ORACLES["e04_account_balance_summary"])
def j03_account_days(spark, root):
    return maintained(spark, S.gl_entries(spark, root), M.ACCOUNT_DAYS, "j03-accounts")


@query(
    "j04_stalled_workers",
    """WITH s AS (SELECT user_id % 10 AS worker_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events),
 g AS (SELECT *, SUM(new) OVER (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
 SELECT worker_id, MIN(ts) AS active_from, MAX(ts) + INTERVAL 5 MINUTE AS stalled_from, COUNT(*) AS points FROM g GROUP BY worker_id, g
 HAVING MAX(ts) + INTERVAL 5 MINUTE <= (SELECT date_trunc('millisecond', MAX(ts)) - INTERVAL 10 MINUTE FROM events)""",
)
def j04_stalls(spark, root):
    """Stalls seen by the stream: sessions that the watermark has passed."""
    out, mark = J.stream_paths(spark, "j04-stalls")
    J.run_append(J.stall_stream(checkpoint_points(spark, root), "checkpoint_at"), out, mark)
    stalls = spark.read.parquet(out)
    return stalls.select(
        "worker_id", F.col("active_from").cast("timestamp_ntz").alias("active_from"), F.col("stalled_from").cast("timestamp_ntz").alias("stalled_from"), "points"
    )
