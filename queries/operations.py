from datetime import date

from pyspark.sql import functions as F

from ledgerloom.functions.layout import fifty_seven_fields
from ledgerloom.operators import graph as GR
from ledgerloom.operators import listing as L
from ledgerloom.operators import matching as MT
from ledgerloom.operators import monitoring as MO
from ledgerloom.operators import quality as Q
from ledgerloom.operators import reports as R
from ledgerloom.operators import retention as RT
from ledgerloom.operators import sinks as K
from ledgerloom.operators.numbering import number_in_groups, number_small, top_per_group
from ledgerloom.operators.sequences import duplicates
from ledgerloom.plans.exports import export_vouchers
from ledgerloom.plans.posting import refresh_reports, standard_reports
from ledgerloom.schemas import TXN_SOURCE, conform
from ledgerloom.scratch import cut, scratch_path
from ledgerloom.sources import readers
from ledgerloom.sources import tables as S
from queries.registry import avg6, query
from queries.reports import VOUCHERS, finished_vouchers, payloads
from queries.views import CHECKPOINTS, GL, JOURNALS, LINES, TXN


@query(
    "a02_unpacked_gl",
    f"WITH {GL} SELECT trx_id, trx_date, amount, reference_1, description FROM gl",
)
def a02(spark, root):
    gl = S.gl_entries(spark, root)
    packed = gl.select("trx_id", "trx_date", "amount", F.to_json(F.struct("reference_1", "description")).alias("data"))
    return readers.unpack_gl(packed).select("trx_id", "trx_date", "amount", "reference_1", "description")


@query("a03_gl_view", f"WITH {GL} SELECT trx_date, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(30,2)) AS total FROM gl GROUP BY 1")
def a03(spark, root):
    readers.register_gl_view(S.gl_entries(spark, root), "gl_entries_filtered")
    return spark.sql("SELECT trx_date, count(*) AS n, sum(amount) AS total FROM gl_entries_filtered GROUP BY trx_date")


@query(
    "a05_csv_ingest",
    f"WITH {TXN} SELECT source_rowid, txn_type, bank_value_date, gross_amount, invest_amount FROM txn",
)
def a05(spark, root):
    path = scratch_path(spark, "csv")
    conform(S.txn_source(spark, root), TXN_SOURCE).write.option("header", True).csv(path)
    good, _ = readers.read_csv(spark, path)
    return good.select("source_rowid", "txn_type", "bank_value_date", "gross_amount", "invest_amount")


@query(
    "b03_new_rows_only",
    f"""WITH {LINES}, one AS (SELECT journal_id, line_no, arg_min(account_code, (sort_part, sort_supp, amount, sort_date)) AS account_code,
   arg_min(amount, (sort_part, sort_supp, amount, sort_date)) AS amount FROM lines GROUP BY 1, 2)
 SELECT * FROM one WHERE (journal_id, line_no) NOT IN (SELECT DISTINCT journal_id, line_no FROM lines WHERE t3 = 'F')""",
)
def b03(spark, root):
    lines = S.journal_lines(spark, root)
    fresh = K.new_rows(lines, lines.where("t3 = 'F'"), ["journal_id", "line_no"], ["sort_part", "sort_supp", "amount", "sort_date"])
    return fresh.select("journal_id", "line_no", "account_code", "amount")


def export_frames(spark, root):
    """Finished orders as vouchers, and their lines by the names of the 57 fields; both are stored tables, written once."""
    lines = S.journal_lines(spark, root).where("t3 = 'F'")
    number = F.concat(F.col("journal_type"), F.date_format("journal_date", "yyMMdd"), F.col("journal_id").cast("string"))
    named = lines.select(
        F.col("journal_id").alias("voucher_id"), number.alias("voucher_no"), "journal_date",
        "journal_type", F.lit("SYS").alias("journal_source"), F.col("line_no").alias("journal_line_number"),
        number.alias("transaction_reference"), "account_code", F.lit("IDR").alias("currency_code"),
        F.col("amount").alias("transaction_amount"), F.col("dc").alias("d_c_marker"), "t1", "t2",
    )
    named = cut(named, "export-lines")
    heads = cut(named.select("voucher_id", "journal_date", "journal_type", "voucher_no").distinct(), "export-heads").withColumn(
        "exported", F.col("voucher_id") % 4 == 0
    ).withColumn("export_date", F.lit(None).cast("timestamp_ntz"))
    return heads, named.drop("journal_date")


@query(
    "b05_export_rows",
    f"""WITH {LINES} SELECT concat_ws(',', journal_type, 'SYS', '', line_no, journal_type || strftime(journal_date, '%y%m%d') || journal_id, '', '', account_code, '', 'IDR',
 amount, '', '', dc, '', '', '', t1, t2) || repeat(',', 38) AS line FROM lines WHERE t3 = 'F' AND journal_id % 4 <> 0 AND journal_type IN ('S0110', 'S0210', 'S0310')
 AND journal_date BETWEEN DATE '1990-01-01' AND DATE '2010-12-31'""",
)
def b05(spark, root):
    heads, body = export_frames(spark, root)
    rows = K.export_rows(heads, body, date(1990, 1, 1), date(2010, 12, 31), ["S0110", "S0210", "S0310"])
    return rows.select(F.concat_ws(",", *[f"field_{i:02d}" for i in range(57)]).alias("line"))


@query(
    "l09_export_marks",
    f"""WITH {LINES} SELECT DISTINCT journal_id AS voucher_id, journal_id % 4 = 0 OR journal_type IN ('S0110', 'S0210', 'S0310') AS exported,
 journal_id % 4 <> 0 AND journal_type IN ('S0110', 'S0210', 'S0310') AS has_date FROM lines WHERE t3 = 'F'""",
)
def l09(spark, root):
    heads, body = export_frames(spark, root)
    out = export_vouchers(
        heads, body, scratch_path(spark, "export"), date(1990, 1, 1), date(2010, 12, 31), ["S0110", "S0210", "S0310"]
    )
    return out.vouchers.select("voucher_id", "exported", F.col("export_date").isNotNull().alias("has_date"))


@query(
    "b08_archive_split",
    f"""WITH {JOURNALS} SELECT CASE WHEN journal_date < DATE '2000-01-01' - 1095 THEN 'archive' ELSE 'keep' END AS part, COUNT(*) AS n, MIN(journal_date) AS first_day,
 MAX(journal_date) AS last_day FROM journals GROUP BY 1""",
)
def b08(spark, root):
    out = RT.split_by_age(S.journals(spark, root), "journal_date", F.lit("2000-01-01").cast("date"))

    def stats(name, df):
        return df.agg(
            F.count(F.lit(1)).alias("n"), F.min("journal_date").alias("first_day"), F.max("journal_date").alias("last_day")
        ).withColumn("part", F.lit(name))

    return stats("keep", out.keep).unionByName(stats("archive", out.archive))


@query(
    "b08_failed_run_rows",
    """SELECT l_orderkey, COUNT(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY 1""",
)
def b08_failed(spark, root):
    li = S.table(spark, root, "lineitem").withColumn("run_id", F.col("l_orderkey"))
    runs = S.table(spark, root, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("DONE").alias("status")
    )
    return RT.rows_of_runs(li, runs).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b09_expired_months",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders) SELECT month FROM m WHERE month < DATE '1998-03-01'""",
)
def b09(spark, root):
    months = S.table(spark, root, "orders").select(F.trunc(F.to_date("o_orderdate"), "MM").cast("date").alias("month"))
    return RT.expired_months(months, F.lit("1999-03-17").cast("date"), 12)


@query(
    "b10_copy_report",
    f"""WITH {JOURNALS}, {GL} SELECT 'journals' AS table_name, COUNT(*) AS rows_copied FROM journals WHERE journal_date >= DATE '1995-01-01'
 UNION ALL SELECT 'gl_entries', COUNT(*) FROM gl WHERE trx_date >= DATE '1995-01-01'""",
)
def b10(spark, root):
    """Rows from 1995 on, copied into month partitions and counted there."""
    frames = {"journals": (S.journals(spark, root), "journal_date"), "gl_entries": (S.gl_entries(spark, root), "trx_date")}
    return RT.copy_partitioned(frames, F.lit("1995-01-01").cast("date"), scratch_path(spark, "copy"))


@query(
    "b11_month_calendar",
    """WITH b AS (SELECT CAST(date_trunc('month', MIN(o_orderdate)) AS DATE) AS a, CAST(date_trunc('month', MAX(o_orderdate)) AS DATE) AS z FROM orders),
 m AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS month FROM b)
 SELECT month, strftime(month, '%Y%m') AS partition_name, CAST(month + INTERVAL 1 MONTH AS DATE) AS next_month FROM m
 WHERE month NOT IN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT' AND month(o_orderdate) < 7)""",
)
def b11(spark, root):
    o = S.table(spark, root, "orders").withColumn("day", F.to_date("o_orderdate"))
    have = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.month("day") < 7)).select(
        F.trunc("day", "MM").cast("date").alias("month")
    )
    return RT.missing_months(RT.month_span(o, "day"), have)


@query(
    "b12_run_log",
    f"WITH {JOURNALS} SELECT journal_type, 'r1' AS run_id, 'COMPLETED' AS status, COUNT(*) AS record_count FROM journals GROUP BY 1",
)
def b12(spark, root):
    path = scratch_path(spark, "run-log")
    K.append(K.run_counts(S.journals(spark, root), "r1"), path)
    return spark.read.parquet(path)


@query(
    "l14_staging_archive",
    """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'archive' ELSE 'keep' END AS part, COUNT(*) AS n FROM orders GROUP BY 1""",
)
def l14(spark, root):
    out = RT.staging_archive(S.table(spark, root, "orders").withColumn("batch_id", F.col("o_orderpriority")), "5-LOW")
    return out.keep.agg(F.lit("keep").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(
        out.archive.agg(F.lit("archive").alias("part"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "c06_c08_journal_list",
    f"""WITH {JOURNALS} SELECT id, journal_type, journal_date, voucher_id FROM journals WHERE journal_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
 AND journal_type IN ('S0110', 'S0310') AND voucher_id IS NOT NULL""",
)
def c06(spark, root):
    out = L.list_journals(S.journals(spark, root), date(1996, 1, 1), date(1999, 12, 31), ["S0110", "S0310"], True)
    return out.select("id", "journal_type", "journal_date", "voucher_id")


@query("g02_journal_page", f"WITH {JOURNALS} SELECT id, journal_date, amount FROM journals ORDER BY journal_date DESC, id LIMIT 50 OFFSET 100")
def g02(spark, root):
    return L.page(S.journals(spark, root).select("id", "journal_date", "amount"), [F.desc("journal_date"), "id"], 100, 50)


@query("g03_top_amounts", f"WITH {GL} SELECT trx_id, amount, t_5 FROM gl ORDER BY amount DESC, trx_id, t_5 LIMIT 20")
def g03(spark, root):
    return L.top(S.gl_entries(spark, root).select("trx_id", "amount", "t_5"), [F.desc("amount"), "trx_id", "t_5"], 20)


@query(
    "g07_g08_day_results",
    f"""WITH {JOURNALS}, d AS (SELECT CAST(unnest(generate_series(MIN(journal_date), MAX(journal_date), INTERVAL 1 DAY)) AS DATE) AS day FROM journals),
 o AS (SELECT journal_date, COUNT(*) AS journals, COUNT(voucher_id) AS vouchers, CASE WHEN COUNT(voucher_id) = 0 THEN 'no vouchers' END AS error FROM journals GROUP BY 1)
 SELECT day, COALESCE(journals, 0) AS journals, COALESCE(vouchers, 0) AS vouchers, journal_date IS NOT NULL AND error IS NULL AS success,
 CASE WHEN journal_date IS NULL THEN 'no data' ELSE error END AS error_message FROM d LEFT JOIN o ON day = journal_date""",
)
def g07(spark, root):
    j = S.journals(spark, root)
    days = j.agg(F.min("journal_date").alias("a"), F.max("journal_date").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")
    )
    outcome = j.groupBy("journal_date").agg(F.count(F.lit(1)).alias("journals"), F.count("voucher_id").alias("vouchers"))
    outcome = outcome.withColumn("error", F.when(F.col("vouchers") == 0, "no vouchers"))
    return L.day_results(days, outcome)


@query(
    "l13_delete_journals",
    f"""WITH {JOURNALS}, w AS (SELECT id FROM journals WHERE id % 3 = 0 UNION ALL SELECT id + 100000000 FROM journals WHERE id % 1000 = 0)
 SELECT w.id, CASE WHEN voucher_id IS NOT NULL THEN 'HAS_VOUCHER' ELSE 'NOT_FOUND' END AS reason FROM w LEFT JOIN journals USING (id)
 WHERE journals.id IS NULL OR voucher_id IS NOT NULL
 UNION ALL SELECT id, 'KEPT' FROM journals WHERE NOT (id % 3 = 0 AND voucher_id IS NULL)""",
)
def l13(spark, root):
    j = S.journals(spark, root)
    ids = j.where("id % 3 = 0").select("id").unionByName(j.where("id % 1000 = 0").select((F.col("id") + 100000000).alias("id")))
    left, refused = L.deletable(j, ids)
    return refused.unionByName(left.select("id", F.lit("KEPT").alias("reason")))


@query(
    "d02_d03_d06_lines_of_headers",
    f"""WITH {LINES} SELECT o_orderkey AS id, line_no, account_code, amount FROM orders LEFT JOIN lines ON journal_id = o_orderkey""",
)
def d06(spark, root):
    heads = S.journals(spark, root).select("id")
    lines = S.journal_lines(spark, root).select(F.col("journal_id").alias("id"), "line_no", "account_code", "amount")
    return heads.join(lines, "id", "left")


@query("d11_lines_of_batch", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def d11(spark, root):
    batch = S.table(spark, root, "orders").where("o_orderpriority = '2-HIGH'").select("o_orderkey")
    li = S.table(spark, root, "lineitem")
    return li.join(batch, li["l_orderkey"] == batch["o_orderkey"], "left_semi").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "d14_location_codes",
    """SELECT l_orderkey, l_partkey, l_extendedprice, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) THEN CAST(l_suppkey AS VARCHAR) ELSE '3174' END AS t_5 FROM lineitem""",
)
def d14(spark, root):
    codes = S.table(spark, root, "supplier").where("s_nationkey < 12").select(
        F.lit("T5").alias("analysis_dimension"), F.col("s_suppkey").cast("string").alias("analysis_code")
    )
    li = S.table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", F.col("l_suppkey").cast("string").alias("t_5"))
    return MT.known_code_or_default(li, "t_5", codes, "T5")


@query(
    "d17_three_way_reconciliation",
    f"""WITH {LINES}, j AS (SELECT journal_id AS reference, SUM(amount) AS journal_amount, COUNT(*) AS journal_count FROM lines WHERE journal_id % 11 <> 0 GROUP BY 1),
 b AS (SELECT journal_id AS reference, SUM(amount) + CASE WHEN journal_id % 7 = 0 THEN 1 ELSE 0 END AS bank_amount, COUNT(*) AS bank_count FROM lines WHERE journal_id % 13 <> 0 GROUP BY journal_id),
 s AS (SELECT journal_id AS reference, SUM(amount) + CASE WHEN journal_id % 5 = 0 THEN 0.005 ELSE 0 END AS source_amount, COUNT(*) AS source_count FROM lines WHERE journal_id % 17 <> 0 GROUP BY journal_id),
 x AS (SELECT * FROM j FULL JOIN b USING (reference) FULL JOIN s USING (reference))
 SELECT reference, journal_count, bank_count, source_count, CASE WHEN journal_amount IS NULL THEN 'MISSING_JOURNAL' WHEN bank_amount IS NULL THEN 'MISSING_BANK' WHEN source_amount IS NULL THEN 'MISSING_SOURCE'
  WHEN abs(journal_amount - bank_amount) > 0.01 THEN 'AMOUNT_DIFFERS_BANK' WHEN abs(journal_amount - source_amount) > 0.01 THEN 'AMOUNT_DIFFERS_SOURCE' END AS exception FROM x""",
)
def d17(spark, root):
    lines = S.journal_lines(spark, root).select(F.col("journal_id").alias("reference"), "amount", "line_no")
    base = number_in_groups(lines, ["reference"], ["line_no"], column="place")

    def side(skip, every, extra):
        """The lines of most journals, the first line of some of them off by ``extra``."""
        off = F.when((F.col("place") == 1) & (F.col("reference") % every == 0), F.lit(extra)).otherwise(F.lit("0"))
        amount = F.col("amount").cast("decimal(20,3)") + off.cast("decimal(10,3)")
        return base.where(F.col("reference") % skip != 0).select("reference", amount.alias("amount"))

    journals = base.where(F.col("reference") % 11 != 0).select("reference", F.col("amount").cast("decimal(20,3)").alias("amount"))
    out = MT.reconcile(journals, side(13, 7, "1"), side(17, 5, "0.005"))
    return out.select("reference", "journal_count", "bank_count", "source_count", "exception")


@query(
    "f01_ranked_accounts",
    f"""WITH {GL}, a AS (SELECT COALESCE(acc_debit, '') AS d, COALESCE(acc_credit, '') AS c, CAST(SUM(amount) AS DECIMAL(30,2)) AS total FROM gl GROUP BY 1, 2)
 SELECT d, c, total, ROW_NUMBER() OVER (ORDER BY total DESC, d, c) AS journal_id FROM a""",
)
def f01(spark, root):
    blank = F.lit("")
    totals = S.gl_entries(spark, root).groupBy(F.coalesce("acc_debit", blank).alias("d"), F.coalesce("acc_credit", blank).alias("c")).agg(F.sum("amount").alias("total"))
    return number_small(totals, [F.desc("total"), "d", "c"], column="journal_id")


@query(
    "f06_bucketed_lines",
    f"""WITH {GL}, p AS (SELECT trx_date, COALESCE(acc_debit, '') AS d, COALESCE(acc_credit, '') AS c, CAST(SUM(amount) AS DECIMAL(30,2)) AS total FROM gl GROUP BY 1, 2, 3),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY trx_date ORDER BY total DESC, d, c) AS rn FROM p)
 SELECT trx_date, rn % 4 AS bucket, COUNT(*) AS n, string_agg(CASE WHEN d <> '' THEN d ELSE c END || '=' || total || '=' || CASE WHEN d <> '' THEN 'D' ELSE 'C' END, ';' ORDER BY rn) AS entries FROM r GROUP BY 1, 2""",
)
def f06(spark, root):
    out = R.bucketed_lines(R.account_pair_totals(S.gl_entries(spark, root)), buckets=4)
    text = F.transform("lines", lambda x: F.concat_ws("=", x["account"], x["amount"].cast("string"), x["dc"]))
    return out.select("trx_date", "bucket", "n", F.array_join(text, ";").alias("entries"))


@query(
    "f11_latest_checkpoints",
    f"""WITH {CHECKPOINTS} SELECT worker_id, arg_max(records_per_second, (checkpoint_at, event_id)) AS records_per_second, MAX(checkpoint_at) AS checkpoint_at,
 arg_max(status, (checkpoint_at, event_id)) AS status FROM checkpoints GROUP BY 1""",
)
def f11(spark, root):
    return MO.latest_checkpoints(S.checkpoints(spark, root)).select("worker_id", "records_per_second", "checkpoint_at", "status")


@query(
    "f11_stalled_workers",
    f"""WITH {CHECKPOINTS}, l AS (SELECT worker_id, MAX(checkpoint_at) AS last_at, arg_max(status, (checkpoint_at, event_id)) AS status FROM checkpoints GROUP BY 1),
 x AS (SELECT *, date_diff('second', last_at, TIMESTAMP '2024-02-01 00:00:00') AS silent_seconds FROM l)
 SELECT worker_id, CASE WHEN status = 'FAILED' THEN 'FAILED' ELSE 'STALLED' END AS reason FROM x WHERE status = 'FAILED' OR silent_seconds > 300""",
)
def f11_stalled(spark, root):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return MO.stalled_workers(S.checkpoints(spark, root), at).select("worker_id", "reason")


@query(
    "f12_point_in_time",
    """WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase')
 SELECT e.event_id, e.user_id, v.event_id AS version_id, CAST(v.value AS DECIMAL(20,2)) AS version_value FROM (SELECT * FROM events WHERE event_type = 'click') e
 ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""",
)
def f12(spark, root):
    e = S.table(spark, root, "events")
    versions = e.where("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("valid_from"), F.col("event_id").alias("version_id"), S.money("value").alias("version_value")
    )
    facts = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    out = MT.as_of(facts, versions, ["user_id"], "ts", "valid_from", ["version_id", "version_value"], ["event_id"])
    return out.select("event_id", "user_id", "version_id", "version_value")


@query(
    "f12_effective_dated",
    """WITH v(o_orderstatus, v_from, v_to, rate) AS (VALUES ('F', DATE '1990-01-01', DATE '1997-01-01', 1), ('F', DATE '1997-01-01', DATE '2005-01-01', 2), ('O', DATE '1996-01-01', DATE '1998-01-01', 3))
 SELECT o_orderkey, rate FROM orders LEFT JOIN v ON v.o_orderstatus = orders.o_orderstatus AND v_from <= CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) < v_to""",
)
def f12_dated(spark, root):
    versions = spark.createDataFrame(
        [("F", date(1990, 1, 1), date(1997, 1, 1), 1), ("F", date(1997, 1, 1), date(2005, 1, 1), 2), ("O", date(1996, 1, 1), date(1998, 1, 1), 3)],
        "o_orderstatus string, v_from date, v_to date, rate int",
    )
    o = S.table(spark, root, "orders").withColumn("day", F.to_date("o_orderdate"))
    return MT.effective_dated(o, F.broadcast(versions), ["o_orderstatus"], "day", "v_from", "v_to").select("o_orderkey", "rate")


@query(
    "g03_first_per_group",
    """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""",
)
def g03_first(spark, root):
    o = S.table(spark, root, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return top_per_group(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(
    "f03_line_numbers",
    f"""WITH {LINES} SELECT journal_id, account_code, amount, sort_part, ROW_NUMBER() OVER (PARTITION BY journal_id ORDER BY line_no, sort_part, sort_supp, amount, sort_date) AS line_number FROM lines""",
)
def f03(spark, root):
    out = number_in_groups(S.journal_lines(spark, root), ["journal_id"], S.LINE_ORDER, "line_number")
    return out.select("journal_id", "account_code", "amount", "sort_part", "line_number")


@query(
    "h01_takaful_balance",
    f"""WITH {TXN} SELECT txn_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE CASE txn_type WHEN 'CLAIM_PAID' THEN gross_amount = tabarru_amount + invest_amount - admin_amount
 ELSE gross_amount = tabarru_amount + tanahud_amount + invest_amount + ujroh_amount + admin_amount END) AS balanced FROM txn GROUP BY 1""",
)
def h01(spark, root):
    return S.txn_source(spark, root).groupBy("txn_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(Q.takaful_balanced()).alias("balanced")
    )


RATE = "CAST(CAST((c - f) * 100 AS DOUBLE) / c AS DECIMAL(9,4))"


@query(
    "h03_h11_rule_report",
    f"""WITH {GL}, x AS (SELECT trx_date, COUNT(*) AS c, COUNT(*) FILTER (WHERE acc_debit IS NULL AND acc_credit IS NULL) AS f1, 0 AS f2,
   COUNT(*) FILTER (WHERE acc_debit IS NOT NULL AND acc_credit IS NOT NULL) AS f3 FROM gl GROUP BY 1),
 r AS (SELECT trx_date, 'account_present' AS rule, c, f1 AS f FROM x UNION ALL SELECT trx_date, 'amount_not_negative', c, f2 FROM x UNION ALL SELECT trx_date, 'one_sided', c, f3 FROM x)
 SELECT trx_date, rule, c AS checked, f AS failed, {RATE} AS pass_rate FROM r""",
)
def h03(spark, root):
    return Q.rule_report(S.gl_entries(spark, root), Q.gl_rules(), ["trx_date"])


@query("h03_rule_violations", f"WITH {GL} SELECT trx_id, amount, t_5, 'account_present' AS broken FROM gl WHERE acc_debit IS NULL AND acc_credit IS NULL UNION ALL SELECT trx_id, amount, t_5, 'one_sided' FROM gl WHERE acc_debit IS NOT NULL AND acc_credit IS NOT NULL")
def h03_violations(spark, root):
    return Q.violations(S.gl_entries(spark, root), Q.gl_rules()).select(
        "trx_id", "amount", "t_5", F.array_join("broken_rules", ",").alias("broken")
    )


@query("h04_duplicate_keys", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def h04(spark, root):
    return duplicates(S.table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "h05_journal_validity",
    f"""WITH {LINES}, {JOURNALS}, b AS (SELECT id AS journal_id, CAST(COALESCE(SUM(CASE WHEN dc = 'D' THEN lines.amount ELSE 0 END), 0) AS DECIMAL(30,2)) AS debits,
 CAST(COALESCE(SUM(CASE WHEN dc = 'D' THEN 0 ELSE lines.amount END), 0) AS DECIMAL(30,2)) AS credits, COUNT(dc) AS line_count
 FROM journals LEFT JOIN lines ON id = lines.journal_id GROUP BY 1)
 SELECT *, CASE WHEN line_count = 0 THEN 'NO_LINES' WHEN debits = 0 THEN 'ZERO_TOTAL' WHEN debits <> credits THEN 'UNBALANCED' END AS error FROM b""",
)
def h05(spark, root):
    heads = S.journals(spark, root).select(F.col("id").alias("journal_id"))
    return Q.journal_validity(S.journal_lines(spark, root), ["journal_id"], heads)


@query(
    "h10_quality_scores",
    f"""WITH {GL}, q AS (SELECT trx_date, COUNT(*) AS n, COUNT(*) FILTER (WHERE acc_debit IS NOT NULL OR acc_credit IS NOT NULL) AS v,
   COUNT(*) FILTER (WHERE t_4 = 'F') AS a, COUNT(*) FILTER (WHERE acc_debit IS NULL OR acc_credit IS NULL) AS c, COUNT(*) FILTER (WHERE amount > 10000) AS t FROM gl GROUP BY 1)
 SELECT trx_date, n AS total_records, v AS valid_records, n - v AS invalid_records, CAST(CAST(v * 100 AS DOUBLE) / n AS DECIMAL(9,4)) AS quality_score,
 CAST(round(CAST(round(v / n, 8) AS DECIMAL(12,8)) * 0.3 + CAST(round(a / n, 8) AS DECIMAL(12,8)) * 0.4 + CAST(round(c / n, 8) AS DECIMAL(12,8)) * 0.2 + CAST(round(t / n, 8) AS DECIMAL(12,8)) * 0.1, 8) AS DECIMAL(12,8)) AS score FROM q""",
)
def h10(spark, root):
    gl = S.gl_entries(spark, root)
    present = Q.gl_rules()["account_present"]
    weighted = Q.weighted_score(
        gl,
        {"completeness": present, "accuracy": F.col("t_4") == "F", "consistency": Q.gl_rules()["one_sided"], "timeliness": F.col("amount") > 10000},
        ["trx_date"],
    ).select("trx_date", "score")
    return Q.quality_score(gl, present, ["trx_date"]).join(weighted, "trx_date")


@query(
    "e25_worker_summary",
    f"""WITH {CHECKPOINTS} SELECT status, COUNT(*) AS points, COUNT(DISTINCT worker_id) AS workers, {avg6('records_per_second')} AS mean_rate,
 CAST(SUM(records_per_second) AS DECIMAL(30,2)) AS total_rate, COUNT(*) FILTER (WHERE status = 'RUNNING' AND records_per_second < 500) AS slow_points FROM checkpoints GROUP BY 1""",
)
def e25(spark, root):
    return MO.worker_summary(S.checkpoints(spark, root))


WORKERS = f"""{CHECKPOINTS}, w AS (SELECT worker_id, COUNT(*) * 2 AS expected_records, COUNT(*) FILTER (WHERE status = 'RUNNING') AS processed_records,
   MIN(checkpoint_at) AS started_at, MAX(checkpoint_at) AS updated_at FROM checkpoints GROUP BY 1)"""


@query(
    "e26_progress",
    f"""WITH {WORKERS}, t AS (SELECT CAST(SUM(expected_records) AS BIGINT) AS total_records, CAST(SUM(processed_records) AS BIGINT) AS processed_records,
   date_diff('second', MIN(started_at), MAX(updated_at)) AS elapsed_seconds FROM w)
 SELECT *, CAST(round(CAST(round(processed_records * 100.0 / total_records, 2) AS DECIMAL(20,2)), 1) AS DECIMAL(10,1)) AS percentage, CAST(round(processed_records / elapsed_seconds, 2) AS DECIMAL(20,2)) AS rate,
 CAST(round((total_records - processed_records) * elapsed_seconds / processed_records, 2) AS DECIMAL(20,2)) AS eta_seconds FROM t""",
)
def e26(spark, root):
    workers = S.checkpoints(spark, root).groupBy("worker_id").agg(
        (F.count(F.lit(1)) * 2).alias("expected_records"), F.count_if(F.col("status") == "RUNNING").alias("processed_records"),
        F.min("checkpoint_at").alias("started_at"), F.max("checkpoint_at").alias("updated_at"),
    )
    return MO.progress(workers.select("expected_records", "processed_records", "started_at", "updated_at"))


@query(
    "e27_throughput",
    f"""WITH {CHECKPOINTS}, t AS (SELECT CAST(round(COALESCE(AVG(records_per_second) FILTER (WHERE checkpoint_at BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 12:00:00'), 0), 2) AS DECIMAL(20,2)) AS current_rps,
 CAST(round(AVG(records_per_second), 2) AS DECIMAL(20,2)) AS average_rps, MAX(records_per_second) AS peak_rps FROM checkpoints)
 SELECT *, CAST(round(current_rps / 5556, 2) AS DECIMAL(20,2)) AS performance_ratio, 'warning' AS status FROM t""",
)
def e27(spark, root):
    return MO.throughput(S.checkpoints(spark, root), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), seconds=3600)


def batches(spark, root):
    """One batch per day of checkpoints."""
    c = S.checkpoints(spark, root)
    return c.groupBy(F.to_date("checkpoint_at").cast("string").alias("batch_id")).agg(
        (F.count(F.lit(1)) * 20000).alias("transactions"), F.max(F.hour("checkpoint_at") * 90 + 60).cast("bigint").alias("total_seconds"),
        F.count_distinct("worker_id").alias("worker_count"), F.count_if(F.col("records_per_second") > 150).alias("validation_failures"),
        F.count_if(F.col("status") == "FAILED").alias("failed_workers"), F.max(F.minute("checkpoint_at") + F.hour("checkpoint_at")).cast("bigint").alias("eta_minutes"),
    )


BATCHES = f"""{CHECKPOINTS}, bt AS (SELECT CAST(CAST(checkpoint_at AS DATE) AS VARCHAR) AS batch_id, COUNT(*) * 20000 AS transactions, MAX(hour(checkpoint_at) * 90 + 60) AS total_seconds,
   COUNT(DISTINCT worker_id) AS worker_count, COUNT(*) FILTER (WHERE records_per_second > 150) AS validation_failures, COUNT(*) FILTER (WHERE status = 'FAILED') AS failed_workers,
   MAX(minute(checkpoint_at) + hour(checkpoint_at)) AS eta_minutes FROM checkpoints GROUP BY 1),
 k1 AS (SELECT *, CAST(round(total_seconds / 60.0, 2) AS DECIMAL(20,2)) AS total_minutes, CAST(round(transactions / total_seconds, 2) AS DECIMAL(20,2)) AS throughput FROM bt),
 k2 AS (SELECT *, CAST(120 - total_minutes AS DECIMAL(20,2)) AS buffer_minutes, total_minutes <= 20 AS on_time, CAST(round(CAST(throughput AS DOUBLE) / 5556, 2) AS DECIMAL(20,2)) AS performance_ratio,
   CAST(throughput * 3 AS DECIMAL(20,2)) AS entries_per_second, CAST(round(CAST(throughput AS DOUBLE) / worker_count, 2) AS DECIMAL(20,2)) AS worker_rps, validation_failures = 0 AS success FROM k1),
 kp AS (SELECT *, CAST(round(CAST(worker_rps AS DOUBLE) / 720, 2) AS DECIMAL(20,2)) AS worker_utilization FROM k2)"""


@query("e28_batch_kpis", f"WITH {BATCHES} SELECT * FROM kp")
def e28(spark, root):
    return MO.batch_kpis(batches(spark, root))


@query(
    "h22_alerts",
    f"""WITH {BATCHES}
 SELECT batch_id, CASE WHEN throughput < 2000 THEN 'THROUGHPUT_CRITICAL' ELSE 'THROUGHPUT_WARNING' END AS alert, CASE WHEN throughput < 2000 THEN 'CRITICAL' ELSE 'WARNING' END AS level, throughput AS value FROM kp WHERE throughput < 4000
 UNION ALL SELECT batch_id, CASE WHEN eta_minutes > 90 THEN 'ETA_CRITICAL' ELSE 'ETA_WARNING' END, CASE WHEN eta_minutes > 90 THEN 'CRITICAL' ELSE 'WARNING' END, CAST(eta_minutes AS DECIMAL(20,2)) FROM kp WHERE eta_minutes > 25
 UNION ALL SELECT batch_id, CASE WHEN failed_workers > 20 THEN 'WORKER_FAILURES_CRITICAL' ELSE 'WORKER_FAILURES_WARNING' END, CASE WHEN failed_workers > 20 THEN 'CRITICAL' ELSE 'WARNING' END, CAST(failed_workers AS DECIMAL(20,2)) FROM kp WHERE failed_workers > 5""",
)
def h22(spark, root):
    return MO.alerts(MO.batch_kpis(batches(spark, root))).drop("action")


@query(
    "h23_recommendations",
    f"""WITH {BATCHES} SELECT batch_id, CASE WHEN validation_failures > 0 THEN 'DO NOT PROCEED - Validation failures detected' WHEN total_minutes > 90 THEN 'WARNING - Batch may exceed 2-hour window. Consider optimization.'
 WHEN throughput < 5556 THEN 'WARNING - Throughput below target. Monitor closely during production run.' ELSE 'PROCEED - Dry run successful. System ready for production batch.' END AS recommendation FROM kp""",
)
def h23(spark, root):
    return MO.batch_kpis(batches(spark, root)).select("batch_id", MO.recommendation().alias("recommendation"))


EDGES = f"""{LINES}, e1 AS (SELECT 'journal_id:' || journal_id AS src, 't4:' || t4 AS dst, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(30,2)) AS amount FROM lines GROUP BY 1, 2),
 edges AS (SELECT * FROM e1 UNION ALL SELECT dst, src, n, amount FROM e1)"""


def edge_table(spark, root):
    return GR.edges(S.journal_lines(spark, root), "journal_id", "t4")


@query(
    "h24_node_features",
    f"""WITH {EDGES} SELECT src AS node, COUNT(*) AS degree, CAST(SUM(n) AS BIGINT) AS edge_count, {avg6('amount')} AS mean_amount FROM edges GROUP BY 1""",
)
def h24(spark, root):
    out = GR.node_features(edge_table(spark, root))
    return out.select("node", "degree", "edge_count", F.col("mean_amount").cast("decimal(24,6)").alias("mean_amount"))


FEATURES = ["degree", "edge_count", "mean_amount", "std_cents"]
STEPS = 10


def lloyd_sql(k: int = 4, steps: int = STEPS, scale: int = 1_000_000) -> str:
    """Features in whole numbers, centres by MD5, and each Lloyd step as a table of its own."""
    cents = "CAST(amount * 100 AS HUGEINT)"
    spread = f"COUNT(amount) * SUM({cents} * {cents}) - SUM({cents}) * SUM({cents})"
    std = f"CASE WHEN COUNT(amount) > 1 THEN CAST(round(sqrt(CAST({spread} AS DOUBLE) / CAST(COUNT(amount) * (COUNT(amount) - 1) AS DOUBLE))) AS HUGEINT) ELSE 0 END"
    scaled = ", ".join(f"COALESCE(({c} - MIN({c}) OVER ()) * {scale} // nullif(MAX({c}) OVER () - MIN({c}) OVER (), 0), 0) AS {c}" for c in "abcd")
    gap = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in "abcd")
    near = f"SELECT node, p.a, p.b, p.c, p.d, min(row(CAST({gap} AS HUGEINT), cluster)) AS n FROM points p CROSS JOIN c{{i}} c GROUP BY ALL"
    kept = ", ".join(f"COALESCE(m.{c}, o.{c}) AS {c}" for c in "abcd")
    mean = ", ".join(f"SUM({c}) // COUNT(*) AS {c}" for c in "abcd")
    parts = [
        f"""f AS MATERIALIZED (SELECT src AS node, CAST(COUNT(*) AS HUGEINT) AS a, CAST(SUM(n) AS HUGEINT) AS b, CAST({avg6('amount')} * 1000000 AS HUGEINT) AS c, {std} AS d FROM edges GROUP BY 1)""",
        f"points AS MATERIALIZED (SELECT node, {scaled} FROM f)",
        f"""c0 AS MATERIALIZED (SELECT CAST(ROW_NUMBER() OVER (ORDER BY md5(a || ',' || b || ',' || c || ',' || d), a, b, c, d) - 1 AS INTEGER) AS cluster, a, b, c, d
  FROM (SELECT DISTINCT a, b, c, d FROM points) QUALIFY cluster < {k})""",
    ]
    for i in range(steps):
        parts.append(f"n{i} AS MATERIALIZED ({near.format(i=i)})")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.cluster, {kept} FROM c{i} o LEFT JOIN (SELECT n[2] AS cluster, {mean} FROM n{i} GROUP BY 1) m USING (cluster))")
    parts.append(f"n{steps} AS MATERIALIZED ({near.format(i=steps)})")
    return ",\n ".join(parts)


@query(
    "h24_cluster_risk",
    f"""WITH {EDGES}, {lloyd_sql()}, s AS (SELECT node, n[2] AS cluster, sqrt(CAST(n[1] AS DOUBLE)) / sqrt(CAST(MAX(n[1]) OVER () AS DOUBLE)) AS risk_score FROM n{STEPS})
 SELECT *, CASE WHEN risk_score > 0.7 THEN 'HIGH' WHEN risk_score > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_bucket FROM s""",
)
def h24_cluster(spark, root):
    features = GR.node_features(edge_table(spark, root))
    return GR.cluster_risk(features, FEATURES, steps=STEPS).select("node", "cluster", "risk_score", "risk_bucket")


@query(
    "h25_related_records",
    f"""WITH RECURSIVE {EDGES}, h0 AS (SELECT 't4:7' AS node), h1 AS (SELECT DISTINCT dst AS node FROM edges JOIN h0 ON src = node),
 h2 AS (SELECT DISTINCT dst AS node FROM edges JOIN h1 ON src = node WHERE dst NOT IN (SELECT node FROM h0)),
 h3 AS (SELECT DISTINCT dst AS node FROM edges JOIN h2 ON src = node WHERE dst NOT IN (SELECT node FROM h1))
 SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3""",
)
def h25(spark, root):
    seeds = spark.createDataFrame([("t4:7",)], "node string")
    return GR.reach(edge_table(spark, root), seeds, hops=3)


@query(
    "h25_related_from_each",
    f"""WITH {LINES}, e AS (SELECT DISTINCT 'journal_id:' || journal_id AS j, 'account_code:' || account_code AS a FROM lines),
 h1 AS (SELECT a AS seed, j AS node, 1 AS hop FROM e),
 h2 AS (SELECT DISTINCT x.a AS seed, y.a AS node, 2 AS hop FROM e x JOIN e y USING (j) WHERE x.a <> y.a)
 SELECT DISTINCT a AS seed, a AS node, 0 AS hop FROM e UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2""",
)
def h25_each(spark, root):
    """All accounts as seeds: their journals, and the accounts they share a journal with."""
    edge = GR.edges(S.journal_lines(spark, root), "journal_id", "account_code")
    seeds = edge.where(F.col("src").startswith("account_code:")).select(F.col("src").alias("node"))
    return GR.reach_from_each(edge, seeds, hops=2)


L11 = {
    "journal_daily_summary": ("entry_count", "SELECT COUNT(*) AS n FROM journals GROUP BY journal_date, journal_type"),
    "account_balance": ("transaction_count", "SELECT COUNT(*) AS n FROM gl GROUP BY trx_date, acc_debit, acc_credit"),
    "tcode_analysis": ("transaction_count", "SELECT COUNT(*) AS n FROM gl GROUP BY date_trunc('month', trx_date), t_1, t_2, t_3"),
    "processing_metrics": ("records_processed", "SELECT COUNT(*) AS n FROM journals GROUP BY date_trunc('hour', created_date), journal_type"),
    "voucher_summary": ("total_lines", "SELECT SUM(line_count) AS n FROM vouchers GROUP BY journal_date, journal_type"),
    "data_quality_summary": ("null_data_count", "SELECT COUNT(*) FILTER (WHERE status = 'P') AS n FROM journals GROUP BY journal_date, journal_type"),
}


@query(
    "l11_refreshed_reports",
    f"WITH {JOURNALS}, {GL}, {VOUCHERS} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS view_name, COUNT(*) AS row_count, CAST(SUM(n) AS BIGINT) AS total, CAST(SUM(n * n) AS BIGINT) AS squares FROM ({sql})"
        for name, (_, sql) in L11.items()
    ),
)
def l11(spark, root):
    """All six tables written, read back and measured."""
    jobs = standard_reports(
        S.journals(spark, root), S.gl_entries(spark, root), finished_vouchers(spark, root), payloads(spark, root),
        F.lit("2000-01-01").cast("date"),
    )
    target = scratch_path(spark, "reports")
    log = refresh_reports(jobs, target).select("view_name", "row_count")
    measures = None
    for name, (column, _) in L11.items():
        one = spark.read.parquet(f"{target}/{name}").agg(
            F.lit(name).alias("view_name"),
            F.sum(F.col(column).cast("bigint")).alias("total"),
            F.sum(F.col(column).cast("bigint") * F.col(column).cast("bigint")).alias("squares"),
        )
        measures = one if measures is None else measures.unionByName(one)
    return log.join(measures, "view_name")
