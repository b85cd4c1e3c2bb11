from pyspark.sql import functions as F

from ledgerloom.operators import reports as R
from ledgerloom.operators import sketches as K
from ledgerloom.scratch import cut
from ledgerloom.sources import tables as S
from queries.registry import avg6, query
from queries.views import CHECKPOINTS, GL, JOURNALS

PAIRS = f"""WITH {GL},
 pairs AS (SELECT trx_date, COALESCE(acc_debit, '') AS account_debit, COALESCE(acc_credit, '') AS account_credit,
    CAST(SUM(amount) AS DECIMAL(30,2)) AS total_amount, COUNT(*) AS tx_count,
    COUNT(DISTINCT reference_1) AS n_refs, COUNT(DISTINCT description) AS n_descs,
    string_agg(DISTINCT reference_1, ',' ORDER BY reference_1) AS ref_list,
    string_agg(DISTINCT description, ' | ' ORDER BY description) AS desc_list
  FROM gl WHERE amount > 0 GROUP BY 1, 2, 3 HAVING SUM(amount) > 0),
 ranked AS (SELECT *, CASE WHEN account_debit <> '' THEN 'D' ELSE 'C' END AS dc_marker,
    ROW_NUMBER() OVER (PARTITION BY trx_date ORDER BY total_amount DESC, account_debit, account_credit) AS journal_id
  FROM pairs)"""


@query(
    "e01_account_pair_day",
    PAIRS + " SELECT journal_id, trx_date, account_debit, account_credit, total_amount, tx_count, dc_marker,"
    " n_refs, n_descs FROM ranked",
)
def e01(spark, root):
    return R.account_pair_totals(S.gl_entries(spark, root))


@query(
    "l06_day_journals",
    PAIRS
    + """ SELECT journal_id, trx_date, account_debit, account_credit, 'DAY' AS journal_type,
  account_debit || '_' || account_credit AS account_key,
  CASE WHEN account_debit <> '' THEN account_debit ELSE account_credit END AS account, dc_marker,
  total_amount, CAST(round(total_amount * CAST(0.000001 AS DECIMAL(6,6)), 2) AS DECIMAL(24,2)) AS amount_millions,
  tx_count FROM ranked""",
)
def l06(spark, root):
    return R.account_pair_journals(S.gl_entries(spark, root))


@query(
    "l06_day_journal_details",
    f"""WITH {GL} SELECT trx_date, COALESCE(acc_debit, '') AS account_debit, COALESCE(acc_credit, '') AS account_credit, k.kind, k.value,
 CAST(SUM(amount) AS DECIMAL(30,2)) AS amount, COUNT(*) AS tx_count
 FROM gl, LATERAL (VALUES ('ref', reference_1), ('desc', description)) k(kind, value) WHERE amount > 0 AND k.value IS NOT NULL GROUP BY ALL""",
)
def l06_details(spark, root):
    return R.account_pair_details(S.gl_entries(spark, root))


@query(
    "l06_day_journal_pages",
    f"""WITH {GL}, d AS (SELECT trx_date, COALESCE(acc_debit, '') AS account_debit, COALESCE(acc_credit, '') AS account_credit, k.kind, k.value,
   CAST(SUM(amount) AS DECIMAL(30,2)) AS amount, COUNT(*) AS tx_count
   FROM gl, LATERAL (VALUES ('ref', reference_1), ('desc', description)) k(kind, value) WHERE amount > 0 AND k.value IS NOT NULL GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY trx_date, account_debit, account_credit, kind ORDER BY value) AS place FROM d)
 SELECT trx_date, account_debit, account_credit, kind, CAST((place - 1) // 2 + 1 AS INTEGER) AS page, COUNT(*) AS n_lines,
   CAST(SUM(amount) AS DECIMAL(30,2)) AS page_amount, string_agg(value || '=' || amount || '=' || tx_count, '|' ORDER BY value) AS lines
 FROM n GROUP BY 1, 2, 3, 4, 5""",
)
def l06_pages(spark, root):
    pages = R.account_pair_pages(R.account_pair_details(S.gl_entries(spark, root)), page_rows=2)
    text = F.transform("lines", lambda x: F.concat_ws("=", x["value"], x["amount"].cast("string"), x["tx_count"].cast("string")))
    return pages.withColumn("lines", F.array_join(text, "|"))


@query(
    "e02_account_pair_modes",
    f"""WITH {GL},
 keyed AS (SELECT *, COALESCE(acc_debit, '') AS account_debit, COALESCE(acc_credit, '') AS account_credit FROM gl),
 counts AS (SELECT trx_date, account_debit, account_credit, k.kind, k.v, COUNT(*) AS n
   FROM keyed, LATERAL (VALUES ('t1', t_1), ('t2', t_2), ('t3', t_3)) k(kind, v) WHERE k.v IS NOT NULL GROUP BY ALL),
 best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY trx_date, account_debit, account_credit, kind ORDER BY n DESC, v) AS rn
   FROM counts),
 modes AS (SELECT trx_date, account_debit, account_credit, MAX(v) FILTER (WHERE kind = 't1') AS primary_t1,
   MAX(v) FILTER (WHERE kind = 't2') AS primary_t2, MAX(v) FILTER (WHERE kind = 't3') AS primary_t3
   FROM best WHERE rn = 1 GROUP BY 1, 2, 3),
 totals AS (SELECT trx_date, account_debit, account_credit, CAST(SUM(amount) AS DECIMAL(30,2)) AS total_amount,
   COUNT(*) AS tx_count, COUNT(DISTINCT reference_1) AS n_refs, COUNT(DISTINCT description) AS n_descs
   FROM keyed GROUP BY 1, 2, 3 HAVING SUM(amount) > 0)
 SELECT *, CASE WHEN account_debit <> '' THEN 'D' ELSE 'C' END AS dc_marker
 FROM totals JOIN modes USING (trx_date, account_debit, account_credit)""",
)
def e02(spark, root):
    return R.account_pair_modes(S.gl_entries(spark, root))


@query(
    "e03_journal_daily_summary",
    f"""WITH {JOURNALS} SELECT journal_date, journal_type, COUNT(*) AS entry_count,
 COUNT(DISTINCT source_rowid) AS unique_sources, COUNT(*) FILTER (WHERE voucher_id IS NULL) AS unvouchered_count,
 COUNT(voucher_id) AS vouchered_count, CAST(SUM(amount) AS DECIMAL(30,2)) AS total_amount,
 {avg6('amount')} AS avg_amount, MIN(created_date) AS first_created, MAX(created_date) AS last_created,
 string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM journals GROUP BY 1, 2""",
)
def e03(spark, root):
    return R.journal_daily_summary(S.journals(spark, root))


@query(
    "e04_account_balance_summary",
    f"""WITH {GL} SELECT trx_date, acc_debit, acc_credit, COUNT(*) AS transaction_count,
 CAST(SUM(amount) AS DECIMAL(30,2)) AS total_amount, {avg6('amount')} AS avg_amount,
 MIN(amount) AS min_amount, MAX(amount) AS max_amount, string_agg(DISTINCT t_1, ',' ORDER BY t_1) AS t1_codes,
 string_agg(DISTINCT t_2, ',' ORDER BY t_2) AS t2_codes, string_agg(DISTINCT t_3, ',' ORDER BY t_3) AS t3_codes
 FROM gl GROUP BY 1, 2, 3""",
)
def e04(spark, root):
    return R.account_balance_summary(S.gl_entries(spark, root))


def finished_vouchers(spark, root):
    """One voucher per finished order with its line count; lines are counted before they meet their order."""
    counts = S.table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    done = S.journals(spark, root).where("status = 'F'")
    return done.join(counts, F.col("id") == F.col("l_orderkey")).groupBy(
        "journal_date", "journal_type", F.col("l_orderkey").alias("journal_id")
    ).agg(F.sum("n").alias("line_count")).withColumn(
        "voucher_no",
        F.concat(F.col("journal_type"), F.date_format("journal_date", "yyMMdd"), F.lpad(F.col("journal_id").cast("string"), 9, "0")),
    )


VOUCHERS = """vouchers AS (SELECT CAST(o_orderdate AS DATE) AS journal_date,
 'S0' || substr(o_orderpriority, 1, 1) || '10' AS journal_type, o_orderkey,
 'S0' || substr(o_orderpriority, 1, 1) || '10' || strftime(o_orderdate, '%y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS voucher_no,
 COUNT(*) AS line_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL)"""


@query(
    "e05_voucher_summary",
    f"""WITH {VOUCHERS} SELECT journal_date, journal_type, COUNT(*) AS voucher_count,
 COUNT(DISTINCT voucher_no) AS unique_vouchers, MIN(voucher_no) AS first_voucher, MAX(voucher_no) AS last_voucher,
 CAST(SUM(line_count) AS BIGINT) AS total_lines, AVG(line_count) AS avg_lines_per_voucher FROM vouchers GROUP BY 1, 2""",
)
def e05(spark, root):
    return R.voucher_summary(finished_vouchers(spark, root))


@query(
    "e06_tcode_analysis",
    f"""WITH {GL},
 ranked AS (SELECT *, CAST(date_trunc('month', trx_date) AS DATE) AS month FROM gl),
 pos AS (SELECT month, t_1, t_2, t_3, amount,
   ROW_NUMBER() OVER (PARTITION BY month, t_1, t_2, t_3 ORDER BY amount) AS rn,
   COUNT(*) OVER (PARTITION BY month, t_1, t_2, t_3) AS n FROM ranked),
 med AS (SELECT month, t_1, t_2, t_3, MIN(amount) AS lo, MAX(amount) AS hi FROM pos
   WHERE rn IN ((n + 1) // 2, (n + 2) // 2) GROUP BY 1, 2, 3, 4)
 SELECT r.month, r.t_1, r.t_2, r.t_3, COUNT(*) AS transaction_count, CAST(SUM(amount) AS DECIMAL(30,2)) AS total_amount,
 COUNT(DISTINCT acc_debit) AS unique_debit_accounts, COUNT(DISTINCT acc_credit) AS unique_credit_accounts,
 {avg6('amount')} AS avg_transaction_amount,
 CAST(MIN(m.lo) + (MIN(m.hi) - MIN(m.lo)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(38,6)) AS median_amount
 FROM ranked r JOIN med m USING (month, t_1, t_2, t_3) GROUP BY 1, 2, 3, 4""",
)
def e06(spark, root):
    return R.tcode_analysis(S.gl_entries(spark, root)).withColumn(
        "median_amount", F.col("median_amount").cast("decimal(38,6)")
    )


@query(
    "e07_processing_metrics",
    f"""WITH {JOURNALS} SELECT date_trunc('hour', created_date) AS hour, journal_type, COUNT(*) AS records_processed,
 AVG(date_diff('second', journal_ts, created_date)) AS avg_processing_delay_seconds,
 MIN(created_date) AS first_processed, MAX(created_date) AS last_processed,
 date_diff('second', MIN(created_date), MAX(created_date)) AS processing_seconds FROM journals GROUP BY 1, 2""",
)
def e07(spark, root):
    return R.processing_metrics(S.journals(spark, root))


@query(
    "e08_data_quality",
    f"""WITH {JOURNALS} SELECT journal_date, journal_type, COUNT(*) AS total_records,
 COUNT(*) FILTER (WHERE status = 'P') AS null_data_count, COUNT(*) FILTER (WHERE amount < 1000) AS null_search_id_count,
 COUNT(*) FILTER (WHERE voucher_id IS NULL AND journal_date < DATE '1999-12-25') AS old_unvouchered,
 COUNT(*) FILTER (WHERE status = 'O' AND id % 7 = 0) AS invalid_json_count,
 COUNT(*) FILTER (WHERE status = 'F' AND id % 11 = 0) AS type_mismatch_count FROM journals GROUP BY 1, 2""",
)
def e08(spark, root):
    return R.data_quality_summary(payloads(spark, root), F.lit("2000-01-01").cast("date"))


def payloads(spark, root):
    """Journals with a JSON text, missing or not an object in some."""
    j = S.journals(spark, root)
    told = F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("journal_type"))
    body = F.to_json(F.struct(F.when(F.col("status") == "F", told).alias("journal_type")))
    data = (
        F.when(F.col("status") == "P", F.lit(None))
        .when((F.col("status") == "O") & (F.col("id") % 7 == 0), "[1]")
        .otherwise(body)
    )
    return j.withColumn("data", data).withColumn(
        "search_id", F.when(F.col("amount") >= 1000, F.array("source_rowid"))
    )


@query(
    "e09_day_totals",
    f"""WITH {GL} SELECT trx_date, acc_debit, acc_credit, CAST(SUM(amount) AS DECIMAL(30,2)) AS total_amount,
 COUNT(*) AS tx_count, COUNT(DISTINCT trx_id) AS n_trx_ids FROM gl GROUP BY 1, 2, 3""",
)
def e09(spark, root):
    return R.day_totals(S.gl_entries(spark, root))


@query(
    "e09_day_id_lists",
    f"""WITH {GL} SELECT trx_date, acc_debit, acc_credit, k.kind, k.value, COUNT(*) AS tx_count
 FROM gl, LATERAL (VALUES ('t1', t_1), ('trx_id', trx_id)) k(kind, value) WHERE k.value IS NOT NULL GROUP BY ALL""",
)
def e09_ids(spark, root):
    return R.day_ids(S.gl_entries(spark, root))


@query(
    "e10_journal_voucher_counts",
    f"""WITH {JOURNALS} SELECT journal_date, journal_type, COUNT(*) AS journal_count,
 COUNT(DISTINCT voucher_id) AS voucher_count, CAST(SUM(amount) AS DECIMAL(30,2)) AS total_amount FROM journals GROUP BY 1, 2""",
)
def e10(spark, root):
    return R.journal_voucher_counts(S.journals(spark, root))


@query(
    "e22_processing_report",
    f"""WITH {JOURNALS}, {GL}, {VOUCHERS},
 j AS (SELECT journal_date AS day, AVG(date_diff('second', journal_ts, created_date)) AS delay, COUNT(*) AS n FROM journals GROUP BY 1)
 SELECT day, 'avg_processing_time' AS metric_name, delay AS metric_value, 'seconds' AS metric_unit FROM j
 UNION ALL SELECT day, 'total_journals', CAST(n AS DOUBLE), 'count' FROM j
 UNION ALL SELECT journal_date, 'total_vouchers', CAST(COUNT(*) AS DOUBLE), 'count' FROM vouchers GROUP BY 1
 UNION ALL SELECT trx_date, 'total_gl_entries', CAST(COUNT(*) AS DOUBLE), 'count' FROM gl GROUP BY 1
 UNION ALL SELECT journal_date, 'total_data_size', CAST(SUM(9) AS DOUBLE) / 1048576.0, 'MB' FROM
   (SELECT journal_date, status FROM journals) GROUP BY 1""",
)
def e22(spark, root):
    # The stored document stands for the data column whose size is reported.
    j = S.journals(spark, root)
    sized = j.select("journal_date", "journal_ts", "created_date", F.concat(F.lit("12345678"), "status").alias("data"))
    return R.processing_report(sized, finished_vouchers(spark, root), S.gl_entries(spark, root))


@query(
    "e23_day_status",
    f"""WITH {JOURNALS}, c AS (SELECT journal_date, COUNT(*) AS journal_count,
 COUNT(*) FILTER (WHERE voucher_id IS NULL) AS unvouchered, CAST(SUM(amount) AS DECIMAL(30,2)) AS total_amount,
 arg_max(status, (created_date, id)) AS last_status, MAX(created_date) AS last_run_at FROM journals GROUP BY 1)
 SELECT * FROM c""",
)
def e23(spark, root):
    j = S.journals(spark, root)
    log = j.select(
        "journal_date", F.col("status").alias("run_status"), F.col("created_date").alias("created_at"), F.col("id").alias("run_id")
    )
    return R.day_status(j, log)


@query(
    "e24_batch_result",
    f"""WITH {JOURNALS}, d AS (SELECT journal_date, COUNT(*) AS journals, COUNT(voucher_id) AS vouchers,
 COUNT(voucher_id) > 0 AS success FROM journals GROUP BY 1)
 SELECT COUNT(*) AS total_days, COUNT(*) FILTER (WHERE success) AS successful_days,
 COUNT(*) FILTER (WHERE NOT success) AS failed_days, CAST(SUM(journals) AS BIGINT) AS total_journals,
 CAST(SUM(vouchers) AS BIGINT) AS total_vouchers,
 CAST(round(100.0 * COUNT(*) FILTER (WHERE success) / COUNT(*), 2) AS DECIMAL(7,2)) AS success_rate FROM d""",
)
def e24(spark, root):
    days = S.journals(spark, root).groupBy("journal_date").agg(
        F.count(F.lit(1)).alias("journals"), F.count("voucher_id").alias("vouchers")
    )
    return R.batch_result(days.withColumn("success", F.col("vouchers") > 0))


@query(
    "e33_runtime_statistics",
    f"""WITH {CHECKPOINTS}, pos AS (SELECT worker_id, records_per_second AS v,
   ROW_NUMBER() OVER (PARTITION BY worker_id ORDER BY records_per_second) AS rn,
   COUNT(*) OVER (PARTITION BY worker_id) AS n FROM checkpoints),
 med AS (SELECT worker_id, CAST(SUM(v) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(38,6)) AS median_value FROM (
   SELECT worker_id, v FROM pos WHERE rn = (n + 1) // 2 UNION ALL SELECT worker_id, v FROM pos WHERE rn = (n + 2) // 2)
   GROUP BY 1)
 SELECT worker_id, COUNT(*) AS runs, {avg6('records_per_second')} AS mean_value, MIN(records_per_second) AS min_value,
 MAX(records_per_second) AS max_value, MIN(median_value) AS median_value FROM checkpoints JOIN med USING (worker_id) GROUP BY 1""",
)
def e33(spark, root):
    stats = R.runtime_statistics(S.checkpoints(spark, root), ["worker_id"], "records_per_second")
    return stats.withColumn("median_value", F.col("median_value").cast("decimal(38,6)"))


@query(
    "e35_overall_totals",
    PAIRS + """ SELECT COUNT(*) AS journal_count, CAST(SUM(total_amount) AS DECIMAL(38,2)) AS total_amount,
 CAST(SUM(tx_count) AS BIGINT) AS transaction_count, MAX(total_amount) AS largest FROM ranked""",
)
def e35(spark, root):
    return R.overall_totals(R.account_pair_totals(S.gl_entries(spark, root)))


@query(
    "e37_latency_percentiles",
    f"""WITH {CHECKPOINTS} SELECT worker_id, quantile_disc(records_per_second, 0.5) AS p50,
 quantile_disc(records_per_second, 0.95) AS p95, quantile_disc(records_per_second, 0.99) AS p99,
 MAX(records_per_second) AS max_value, COUNT(*) AS n FROM checkpoints GROUP BY 1""",
)
def e37(spark, root):
    return R.latency_percentiles(S.checkpoints(spark, root), ["worker_id"], "records_per_second")


@query(
    "e06_sketched_medians",
    f"""WITH {GL} SELECT date_trunc('month', trx_date)::DATE AS month, t_1, COUNT(*) AS n, TRUE AS within FROM gl GROUP BY 1, 2""",
)
def e06_sketched(spark, root):
    """Medians of a month from its days' sketches: their ranks, counted over all rows, are within the stated error."""
    gl = S.gl_entries(spark, root)
    daily = cut(K.daily_sketches(gl, "trx_date", ["t_1"], amounts=["amount"]), "daily-quantiles")
    month = F.trunc("day", "MM").cast("date")
    medians = K.merged_sketches(daily, month, ["t_1"]).select(F.col("period").alias("month"), "t_1", K.quantile("amount").alias("median"))
    rows = gl.withColumn("month", F.trunc("trx_date", "MM").cast("date"))
    bounds = K.rank_bounds(rows, medians, ["month", "t_1"], "amount", "median")
    # A rank is a place among the rows: one place of leeway for small groups.
    slack = K.rank_error() + 1 / F.col("rows")
    within = (F.col("below") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)
    return bounds.select("month", "t_1", F.col("rows").alias("n"), within.alias("within"))


@query(
    "e10_sketched_distinct_accounts",
    f"""WITH {GL} SELECT date_trunc('month', trx_date)::DATE AS month, COUNT(DISTINCT t_5) AS suppliers, COUNT(DISTINCT trx_id) AS transactions,
 TRUE AS suppliers_within, TRUE AS transactions_within FROM gl GROUP BY 1""",
)
def e10_sketched(spark, root):
    """Distinct counts of a month from its days' sketches, against the exact counts."""
    gl = S.gl_entries(spark, root)
    daily = cut(K.daily_sketches(gl, "trx_date", [], distinct=["t_5", "trx_id"]), "daily-distinct")
    month = F.trunc("day", "MM").cast("date")
    near = K.merged_sketches(daily, month, []).select("period", K.distinct_count("t_5").alias("a"), K.distinct_count("trx_id").alias("b"))
    exact = gl.groupBy(F.trunc("trx_date", "MM").cast("date").alias("month")).agg(
        F.count_distinct("t_5").alias("suppliers"), F.count_distinct("trx_id").alias("transactions")
    )
    met = exact.join(near, F.col("month") == F.col("period"))
    inside = lambda est, true: F.abs(F.col(est) - F.col(true)) <= F.greatest(F.lit(1), F.col(true) * K.count_error())
    return met.select("month", "suppliers", "transactions", inside("a", "suppliers").alias("suppliers_within"), inside("b", "transactions").alias("transactions_within"))
