from pyspark.sql import functions as F

from ledgerloom.operators import audit as A
from ledgerloom.operators import controls as C
from ledgerloom.operators import fraud as X
from ledgerloom.operators import merkle as M
from ledgerloom.plans.closing import close_periods
from ledgerloom.sources import tables as S
from queries.registry import query
from queries.views import AUDIT, GL, JOURNALS, LINES

BENFORD_SQL = """dig AS (SELECT account_code, t3, CASE WHEN substr(CAST(amount AS VARCHAR), 1, 1) BETWEEN '1' AND '9'
   THEN CAST(substr(CAST(amount AS VARCHAR), 1, 1) AS INTEGER) END AS d FROM lines),
 cnt AS (SELECT account_code, t3, COUNT(d) AS sample_size, {counts} FROM dig GROUP BY 1, 2)""".format(
    counts=", ".join(f"COUNT(*) FILTER (WHERE d = {i}) AS d{i}" for i in range(1, 10))
)
DEV_SQL = " + ".join(f"abs(CAST(d{i} AS DOUBLE) / sample_size - {e})" for i, e in enumerate(X.BENFORD, start=1))


@query(
    "e30_first_digit_profile",
    f"WITH {LINES}, {BENFORD_SQL} SELECT *, CASE WHEN sample_size >= 10 THEN CAST(round(({DEV_SQL}) / 9, 6) AS DECIMAL(20,6)) ELSE 0 END AS deviation FROM cnt",
)
def e30(spark, root):
    return X.digit_profile(S.journal_lines(spark, root), ["account_code", "t3"])


FACTS = """facts AS (SELECT journal_id, COUNT(*) AS line_count, COUNT(*) FILTER (WHERE amount % 100 = 0) AS round_count,
   COUNT(*) FILTER (WHERE amount >= 80000 AND amount < 100000) AS near_threshold_count,
   COALESCE(bool_or(account_code LIKE '%CASH%' AND dc = 'C' AND amount > 10000), false) AND COALESCE(bool_or(account_code LIKE '%EXPENSE%' AND dc = 'D'), false) AS unusual_combination
   FROM flines GROUP BY 1)"""
FLINES = """flines AS (SELECT * REPLACE (CASE WHEN t1 = 'N' AND dc = 'C' THEN 'CASH-' || account_code WHEN t1 = 'R' AND dc = 'D' THEN 'EXPENSE-' || account_code
   ELSE account_code END AS account_code, CAST(CASE WHEN sort_supp % 3 = 0 THEN round(amount, -2) ELSE amount END AS DECIMAL(20,2)) AS amount) FROM lines)"""


def fraud_lines(spark, root):
    """Lines with cash and expense accounts and some amounts in full hundreds."""
    account = (
        F.when((F.col("t1") == "N") & (F.col("dc") == "C"), F.concat(F.lit("CASH-"), "account_code"))
        .when((F.col("t1") == "R") & (F.col("dc") == "D"), F.concat(F.lit("EXPENSE-"), "account_code"))
        .otherwise(F.col("account_code"))
    )
    amount = F.when(F.col("sort_supp") % 3 == 0, F.round("amount", -2)).otherwise(F.col("amount"))
    return (
        S.journal_lines(spark, root)
        .withColumn("account_code", account)
        .withColumn("amount", amount.cast("decimal(20,2)"))
    )


@query(
    "e31_e32_d16_line_indicators",
    f"""WITH {LINES}, {FLINES}, {FACTS} SELECT *, CAST(CAST(round_count AS DOUBLE) / line_count AS DECIMAL(20,10)) AS round_share,
 round_count > 0.3 * line_count AS excessive_round, near_threshold_count >= 3 AS potential_structuring FROM facts""",
)
def e31(spark, root):
    return X.line_indicators(fraud_lines(spark, root), ["journal_id"])


SIG_WORDS = " || ':' || ".join(f"CAST(SUM(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR)" for i in range(4))
SIG = f"""sigl AS (SELECT journal_id, sha256(account_code || ':' || CAST(round(amount, -5) AS DECIMAL(20,2)) || ':' || dc) AS h FROM lines),
 sig AS (SELECT journal_id, COUNT(*) || ':' || {SIG_WORDS} AS signature FROM sigl GROUP BY 1)"""


def coarse_lines(spark, root):
    """Amounts in steps of 100,000, so that small journals repeat."""
    return S.journal_lines(spark, root).withColumn("amount", F.round("amount", -5).cast("decimal(20,2)"))


@query("h20_duplicate_signature", f"WITH {LINES}, {SIG} SELECT * FROM sig")
def h20(spark, root):
    return X.signatures(coarse_lines(spark, root), ["journal_id"])


@query(
    "d15_duplicate_journals",
    f"""WITH {LINES}, {SIG}, {JOURNALS}, j AS (SELECT journal_id, journal_date, signature FROM sig JOIN journals ON id = journal_id),
 pairs AS (SELECT a.journal_id, COUNT(b.journal_id) AS duplicate_count,
   arg_max(b.journal_id, (b.journal_date, b.journal_id)) AS latest_duplicate FROM j a LEFT JOIN j b ON a.signature = b.signature
   AND b.journal_date BETWEEN a.journal_date - 30 AND a.journal_date AND a.journal_id <> b.journal_id GROUP BY 1)
 SELECT journal_id, journal_date, duplicate_count, duplicate_count > 0 AS has_duplicates, latest_duplicate FROM j JOIN pairs USING (journal_id)""",
)
def d15(spark, root):
    signed = X.match_signatures(coarse_lines(spark, root), ["journal_id"])
    j = S.journals(spark, root).select(F.col("id").alias("journal_id"), "journal_date").join(signed, "journal_id")
    return X.duplicate_counts(j).drop("signature")


@query(
    "h19_time_patterns",
    f"""WITH {JOURNALS} SELECT id, hour(created_date) < 6 OR hour(created_date) > 20 AS after_hours,
 isodow(created_date) >= 6 AS weekend, day(journal_date) >= 28 AS period_end FROM journals""",
)
def h19(spark, root):
    j = S.journals(spark, root)
    return j.select("id", *[c.alias(n) for n, c in X.time_pattern(F.col("created_date"), F.col("journal_date")).items()])


@query(
    "h18_fraud_score",
    f"""WITH {LINES}, {FLINES}, {FACTS}, {JOURNALS},
 dg AS (SELECT journal_id, CASE WHEN substr(CAST(amount AS VARCHAR), 1, 1) BETWEEN '1' AND '9' THEN CAST(substr(CAST(amount AS VARCHAR), 1, 1) AS INTEGER) END AS d FROM flines),
 cn AS (SELECT journal_id, COUNT(d) AS sample_size, {", ".join(f"COUNT(*) FILTER (WHERE d = {i}) AS d{i}" for i in range(1, 10))} FROM dg GROUP BY 1),
 dev AS (SELECT journal_id, CASE WHEN sample_size >= 10 THEN ({DEV_SQL}) / 9 ELSE 0 END AS deviation FROM cn),
 sg AS (SELECT journal_id, string_agg(account_code || ':' || amount || ':' || dc, '|' ORDER BY account_code || ':' || amount || ':' || dc) AS s FROM flines GROUP BY 1),
 js AS (SELECT id AS journal_id, journal_date, created_date, s FROM journals LEFT JOIN sg ON id = journal_id),
 dup AS (SELECT DISTINCT a.journal_id FROM js a JOIN js b ON a.s = b.s AND b.journal_date BETWEEN a.journal_date - 30 AND a.journal_date AND a.journal_id <> b.journal_id),
 t AS (SELECT js.journal_id, COALESCE(deviation > 0.15, false) AS b, dup.journal_id IS NOT NULL AS d, COALESCE(round_count > 0.3 * line_count, false) AS r,
   hour(created_date) < 6 OR hour(created_date) > 20 OR isodow(created_date) >= 6 OR day(journal_date) >= 28 AS u,
   COALESCE(unusual_combination, false) AS c, COALESCE(near_threshold_count >= 3, false) AS st FROM js LEFT JOIN facts USING (journal_id) LEFT JOIN dev USING (journal_id) LEFT JOIN dup USING (journal_id)),
 sc AS (SELECT journal_id, CAST(least(0.3 * b::INT + 0.4 * d::INT + 0.2 * r::INT + 0.2 * u::INT + 0.3 * c::INT + 0.5 * st::INT, 1.0) AS DECIMAL(4,1)) AS risk_score,
   concat_ws(',', CASE WHEN b THEN 'BENFORD_DEVIATION' END, CASE WHEN d THEN 'DUPLICATE_DETECTED' END, CASE WHEN r THEN 'EXCESSIVE_ROUND_NUMBERS' END,
   CASE WHEN u THEN 'UNUSUAL_TIME_PATTERN' END, CASE WHEN c THEN 'UNUSUAL_ACCOUNT_COMBINATION' END, CASE WHEN st THEN 'POTENTIAL_STRUCTURING' END) AS indicators FROM t)
 SELECT *, risk_score > 0.5 AS requires_review FROM sc""",
)
def h18(spark, root):
    heads = S.journals(spark, root).select(F.col("id").alias("journal_id"), "journal_date", "created_date")
    return X.fraud_scores(heads, fraud_lines(spark, root))


@query(
    "e34_account_activity_alerts",
    f"""WITH {LINES} SELECT account_code, COUNT(*) AS movement_count, CAST(SUM(amount) AS DECIMAL(30,2)) AS movement_amount FROM lines
 WHERE journal_date > DATE '1998-06-30' - 30 AND journal_date <= DATE '1998-06-30' GROUP BY 1 HAVING COUNT(*) > 100 OR SUM(amount) > 1000000""",
)
def e34(spark, root):
    return X.account_activity_alerts(S.journal_lines(spark, root), F.lit("1998-06-30").cast("date"))


LEVELS = """lv AS (SELECT *, amount * 30 AS big, CASE WHEN amount * 30 <= 100000 THEN 0 WHEN amount * 30 <= 1000000 THEN 1
   WHEN amount * 30 <= 10000000 THEN 2 ELSE 3 END AS approval_level FROM journals)"""


def submissions(spark, root):
    j = S.journals(spark, root)
    return C.submit_for_approval(
        j.select(
            F.col("id").alias("journal_id"), "journal_date", (F.col("amount") * 30).cast("decimal(20,2)").alias("amount"),
            (F.col("id") % 7).alias("submitted_by"),
            F.when(F.col("id") % 4 == 0, "URGENT").otherwise("NORMAL").alias("urgency"),
        )
    )


@query(
    "h12_approval_levels",
    f"""WITH {JOURNALS}, {LEVELS} SELECT id AS journal_id, approval_level,
 CASE approval_level WHEN 0 THEN '' WHEN 1 THEN '2,3' WHEN 2 THEN '4,5' ELSE '6' END AS approvers,
 CASE approval_level WHEN 0 THEN 'AUTO_APPROVED' ELSE 'PENDING' END AS status,
 CASE WHEN approval_level = 0 THEN NULL WHEN id % 4 = 0 THEN 24 ELSE 72 END AS sla_hours FROM lv""",
)
def h12(spark, root):
    return submissions(spark, root).select(
        "journal_id", "approval_level", F.array_join("approvers", ",").alias("approvers"), "status", "sla_hours"
    )


@query(
    "h13_approval_guards",
    f"""WITH {JOURNALS}, {LEVELS}, r AS (SELECT id AS journal_id, (id // 7) % 7 AS user_id, id % 7 AS sub, id % 13 = 0 AS missing, approval_level AS l FROM lv),
 x AS (SELECT *, CASE WHEN missing THEN 'NO_WORKFLOW' WHEN l = 0 THEN 'NOT_PENDING'
   WHEN NOT ((l = 1 AND user_id IN (2, 3)) OR (l = 2 AND user_id IN (4, 5)) OR (l = 3 AND user_id = 6)) THEN 'NOT_AN_APPROVER'
   WHEN user_id = sub THEN 'OWN_SUBMISSION' END AS reason FROM r)
 SELECT journal_id, user_id, CASE WHEN reason IS NULL THEN 'APPROVED' ELSE 'REFUSED' END AS result, reason FROM x""",
)
def h13(spark, root):
    flows = submissions(spark, root)
    requests = flows.select("journal_id", F.floor(F.col("journal_id") / 7).alias("k")).select(
        "journal_id", (F.col("k") % 7).alias("user_id")
    )
    return C.approve(requests, flows.where(F.col("journal_id") % 13 != 0))


def periods(spark, root):
    """Months of the orders with a status by month number."""
    month = F.trunc(F.to_date("o_orderdate"), "MM").cast("date")
    n = F.month("period_date")
    return (
        S.table(spark, root, "orders").select(month.alias("period_date")).distinct().withColumn(
            "status", F.when(n % 4 == 0, "CLOSED").when(n % 4 == 1, "OPEN").when(n % 4 == 2, "LOCKED").otherwise("OPEN")
        )
    )


PERIODS = """periods AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS period_date,
   CASE month(o_orderdate) % 4 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'OPEN' WHEN 2 THEN 'LOCKED' ELSE 'OPEN' END AS status FROM orders)"""


@query(
    "h14_period_requests",
    f"""WITH {AUDIT}, {PERIODS}, r AS (SELECT event_id AS request_id, CAST(make_date(1995 + CAST(event_id % 8 AS INTEGER), CAST(1 + user_id % 12 AS INTEGER), 1) AS DATE) AS period_date,
   CASE WHEN event_id % 2 = 0 THEN 'OPEN' ELSE 'CLOSE' END AS action, CASE user_id % 4 WHEN 0 THEN 'MANAGER' WHEN 1 THEN 'CFO' WHEN 2 THEN 'ADMIN' ELSE 'CLERK' END AS role,
   event_id % 3 AS blockers, event_id % 5 = 0 AS force FROM audit),
 x AS (SELECT r.*, p.status, CASE WHEN action = 'OPEN' AND role NOT IN ('MANAGER', 'ADMIN') THEN 'UNAUTHORIZED'
   WHEN action = 'CLOSE' AND role = 'CLERK' THEN 'UNAUTHORIZED' WHEN action = 'OPEN' AND p.status IS NOT NULL AND p.status <> 'CLOSED' THEN 'ALREADY_' || p.status
   WHEN action = 'CLOSE' AND COALESCE(p.status <> 'OPEN', true) THEN 'NOT_OPEN' WHEN action = 'CLOSE' AND blockers > 0 AND NOT force THEN 'BLOCKED' END AS reason
   FROM r LEFT JOIN periods p USING (period_date))
 SELECT request_id, period_date, action, reason, CASE WHEN reason IS NULL THEN CASE action WHEN 'OPEN' THEN 'OPEN' ELSE 'CLOSED' END ELSE status END AS new_status FROM x""",
)
def h14(spark, root):
    e = S.audit_events(spark, root)
    u = F.col("user_id") % 4
    requests = e.select(
        F.col("event_id").alias("request_id"),
        F.make_date((F.col("event_id") % 8 + 1995).cast("int"), (F.col("user_id") % 12 + 1).cast("int"), F.lit(1)).alias("period_date"),
        F.when(F.col("event_id") % 2 == 0, "OPEN").otherwise("CLOSE").alias("action"),
        F.when(u == 0, "MANAGER").when(u == 1, "CFO").when(u == 2, "ADMIN").otherwise("CLERK").alias("user_role"),
        (F.col("event_id") % 3).alias("blockers"),
        (F.col("event_id") % 5 == 0).alias("force"),
    )
    return C.period_requests(requests, periods(spark, root))


@query(
    "h15_posting_period",
    f"""WITH {GL}, {PERIODS} SELECT CAST(date_trunc('month', trx_date) AS DATE) AS month, COALESCE(status = 'OPEN', false) AS in_open_period,
 COUNT(*) AS n, COUNT(*) FILTER (WHERE year(trx_date) = 1998 AND 6 - month(trx_date) <= 1) AS by_distance
 FROM gl LEFT JOIN periods ON period_date = CAST(date_trunc('month', trx_date) AS DATE) GROUP BY 1, 2""",
)
def h15(spark, root):
    out = C.posting_allowed(S.gl_entries(spark, root).select("trx_date"), periods(spark, root), "trx_date")
    near = C.open_by_month_distance(F.col("trx_date"), F.lit("1998-06-15").cast("date"))
    return out.groupBy(F.trunc("trx_date", "MM").cast("date").alias("month"), "in_open_period").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(near).alias("by_distance")
    )


@query(
    "h21_duty_violations",
    f"""WITH {AUDIT}, a AS (SELECT event_id, user_role, CASE event_type WHEN 'JOURNAL_CREATED' THEN 'CREATE' WHEN 'JOURNAL_APPROVED' THEN 'APPROVE'
   WHEN 'JOURNAL_DELETED' THEN 'REVERSE' WHEN 'VOUCHER_EXPORTED' THEN 'EXPORT' ELSE 'POST' END AS action FROM audit)
 SELECT * FROM a WHERE NOT ((user_role = 'CLERK' AND action = 'CREATE') OR (user_role = 'SUPERVISOR' AND action IN ('CREATE', 'APPROVE', 'REVERSE')))""",
)
def h21(spark, root):
    t = F.col("event_type")
    act = (
        F.when(t == "JOURNAL_CREATED", "CREATE").when(t == "JOURNAL_APPROVED", "APPROVE")
        .when(t == "JOURNAL_DELETED", "REVERSE").when(t == "VOUCHER_EXPORTED", "EXPORT").otherwise("POST")
    )
    return C.duty_violations(S.audit_events(spark, root).select("event_id", "user_role", act.alias("action")))


@query(
    "e36_l12_closing_blockers",
    f"""WITH {JOURNALS}, {GL}, {LEVELS}, w AS (SELECT journal_date, COUNT(*) FILTER (WHERE approval_level > 0) AS unapproved FROM lv GROUP BY 1),
 o AS (SELECT journal_date, COUNT(*) FILTER (WHERE voucher_id IS NULL) AS unvouchered FROM journals GROUP BY 1),
 b AS (SELECT trx_date, abs(COALESCE(SUM(amount) FILTER (WHERE acc_debit IS NOT NULL), 0) - COALESCE(SUM(amount) FILTER (WHERE acc_credit IS NOT NULL), 0)) AS imb FROM gl GROUP BY 1)
 SELECT journal_date, unvouchered, unapproved, CAST(COALESCE(imb, 0) AS DECIMAL(31,2)) AS imbalance,
 unvouchered = 0 AND unapproved = 0 AND COALESCE(imb, 0) < 0.01 AS can_close FROM o JOIN w USING (journal_date) LEFT JOIN b ON trx_date = journal_date""",
)
def e36(spark, root):
    return C.closing_blockers(S.journals(spark, root), S.gl_entries(spark, root), submissions(spark, root))


@query(
    "l12_close_periods",
    f"""WITH {JOURNALS}, {GL}, {LEVELS}, w AS (SELECT journal_date, COUNT(*) FILTER (WHERE approval_level > 0) AS unapproved FROM lv GROUP BY 1),
 o AS (SELECT journal_date, COUNT(*) FILTER (WHERE voucher_id IS NULL) AS unvouchered FROM journals GROUP BY 1),
 b AS (SELECT trx_date, CAST(abs(COALESCE(SUM(amount) FILTER (WHERE acc_debit IS NOT NULL), 0) - COALESCE(SUM(amount) FILTER (WHERE acc_credit IS NOT NULL), 0)) AS DECIMAL(31,2)) AS imb FROM gl GROUP BY 1),
 x AS (SELECT o.journal_date AS period_date, concat_ws('; ', CASE WHEN unvouchered > 0 THEN unvouchered || ' unposted journals' END,
   CASE WHEN unapproved > 0 THEN unapproved || ' unapproved high-value transactions' END, CASE WHEN COALESCE(imb, 0) >= 0.01 THEN 'Trial balance not balanced: ' || imb END) AS issues
   FROM o JOIN w USING (journal_date) LEFT JOIN b ON trx_date = journal_date),
 r AS (SELECT *, CASE day(period_date) % 3 WHEN 0 THEN 'CLERK' WHEN 1 THEN 'CFO' ELSE 'MANAGER' END AS role, month(period_date) % 4 AS m, day(period_date) % 5 = 0 AS force FROM x),
 z AS (SELECT *, CASE WHEN role = 'CLERK' THEN 'UNAUTHORIZED' WHEN m IN (0, 2) THEN 'NOT_OPEN' WHEN issues <> '' AND NOT force THEN 'BLOCKED' END AS reason,
   CASE m WHEN 0 THEN 'CLOSED' WHEN 2 THEN 'LOCKED' ELSE 'OPEN' END AS st FROM r)
 SELECT CAST(period_date AS VARCHAR) AS request_id, period_date, issues, reason, CASE WHEN reason IS NULL THEN 'CLOSED' ELSE st END AS new_status FROM z""",
)
def l12(spark, root):
    """Every journal day is requested to be closed."""
    j = S.journals(spark, root)
    days = j.select(F.col("journal_date").alias("period_date")).distinct()
    d, n = F.dayofmonth("period_date") % 3, F.month("period_date") % 4
    requests = days.select(
        F.col("period_date").cast("string").alias("request_id"), "period_date",
        F.when(d == 0, "CLERK").when(d == 1, "CFO").otherwise("MANAGER").alias("user_role"),
        (F.dayofmonth("period_date") % 5 == 0).alias("force"),
    )
    status = days.withColumn("status", F.when(n == 0, "CLOSED").when(n == 2, "LOCKED").otherwise("OPEN"))
    return close_periods(requests, status, j, S.gl_entries(spark, root), submissions(spark, root))


RISK = """CAST(least(greatest(CASE WHEN hour(event_timestamp) < 6 OR hour(event_timestamp) > 22 THEN 0.2 ELSE 0 END
 + {value} + CASE WHEN event_type = 'JOURNAL_DELETED' THEN 0.4 ELSE 0 END - CASE WHEN authentication_method <> 'password' THEN 0.1 ELSE 0 END, 0), 1) AS DECIMAL(4,1))"""


@query(
    "h16_audit_risk",
    f"""WITH {AUDIT} SELECT event_id, {RISK.format(value="CASE WHEN amount > 1000000 THEN 0.3 ELSE 0 END")} AS risk_score,
 {RISK.format(value="CASE WHEN amount > 10000000 THEN 0.5 WHEN amount > 1000000 THEN 0.3 ELSE 0 END")} AS fixed_score FROM audit""",
)
def h16(spark, root):
    return S.audit_events(spark, root).select(
        "event_id", A.risk_score().alias("risk_score"), A.risk_score(fixed=True).alias("fixed_score")
    )


FLAGS = """SELECT event_id, concat_ws(',', CASE WHEN seg THEN 'SEGREGATION_VIOLATION' END, CASE WHEN amount > 1000000 THEN 'HIGH_VALUE_TRANSACTION' END,
 CASE WHEN sox THEN 'SOX_JUSTIFICATION_MISSING' END) AS compliance_flags, amount > 100000 AS approval_required,
 CASE WHEN seg THEN 'SEGREGATION_VIOLATION' WHEN sox THEN 'SOX_JUSTIFICATION_MISSING' END AS violation FROM
 (SELECT *, event_type = 'JOURNAL_APPROVED' AND user_role <> 'SUPERVISOR' AS seg,
  event_type IN ('JOURNAL_DELETED', 'JOURNAL_MODIFIED') AND justification IS NULL AS sox FROM audit)"""


@query("h17_compliance_flags", f"WITH {AUDIT} {FLAGS}")
def h17(spark, root):
    return A.with_compliance(S.audit_events(spark, root)).select(
        "event_id", F.array_join("compliance_flags", ",").alias("compliance_flags"), "approval_required", "violation"
    )


DIGEST = """sha256('{"context_user_id":' || user_id || ',"entity_id":"' || entity_id || '","entity_type":"JOURNAL","event_id":' || event_id ||
 ',"event_timestamp":"' || strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '","event_type":"' || event_type || '"}')"""


def chain_sql(segment: str) -> str:
    return f"""{AUDIT}, e AS (SELECT entity_id, event_id, {segment} AS segment, {DIGEST} AS digest,
   ROW_NUMBER() OVER (PARTITION BY entity_id, {segment} ORDER BY event_timestamp, event_id) AS n FROM audit),
 s AS (SELECT *, sha256('JOURNAL#' || entity_id || '#' || segment) AS seed FROM e),
 chain AS (SELECT entity_id, segment, event_id, n, seed AS hash_previous, sha256(digest || seed) AS hash_current FROM s WHERE n = 1
   UNION ALL SELECT s.entity_id, s.segment, s.event_id, s.n, c.hash_current, sha256(s.digest || c.hash_current)
   FROM chain c JOIN s ON s.entity_id = c.entity_id AND s.segment = c.segment AND s.n = c.n + 1)"""


@query(
    "f08_hash_chain",
    f"""WITH RECURSIVE {chain_sql("CAST(year(event_timestamp) * 12 + month(event_timestamp) - 1 AS BIGINT)")}
 SELECT 'JOURNAL' AS entity_type, entity_id, segment, n AS chain_no, event_id, hash_previous, hash_current FROM chain""",
)
def f08(spark, root):
    return A.build_hash_chain(S.audit_events(spark, root))


@query(
    "f07_hash_chain_errors",
    f"""WITH {AUDIT} SELECT event_id, 'HASH_MISMATCH' AS error FROM audit WHERE user_id % 50 = 7""",
)
def f07(spark, root):
    """Events of some users were altered after the chain had been built."""
    events = S.audit_events(spark, root)
    stored = events.join(A.build_hash_chain(events).drop(*A.CHAIN), "event_id")
    altered = stored.withColumn(
        "event_type", F.when(F.col("user_id") % 50 == 7, F.lit("ALTERED")).otherwise(F.col("event_type"))
    )
    return A.verify_hash_chain(altered).select("event_id", "error")


@query(
    "f07_slice_errors",
    f"""WITH {AUDIT} SELECT event_id, 'HASH_MISMATCH' AS error FROM audit WHERE user_id % 50 = 7 AND event_timestamp >= TIMESTAMP '2024-01-15'""",
)
def f07_slice(spark, root):
    """The same check from the fifteenth on: intact events raise no alarm."""
    events = S.audit_events(spark, root)
    stored = events.join(A.build_hash_chain(events).drop(*A.CHAIN), "event_id").where("event_timestamp >= timestamp'2024-01-15'")
    altered = stored.withColumn(
        "event_type", F.when(F.col("user_id") % 50 == 7, F.lit("ALTERED")).otherwise(F.col("event_type"))
    )
    return A.verify_hash_chain(altered, sliced=True).select("event_id", "error")


@query(
    "f08_segment_heads",
    f"""WITH RECURSIVE {chain_sql("CAST(datediff('day', DATE '1970-01-01', CAST(event_timestamp AS DATE)) AS BIGINT)")},
 h AS (SELECT entity_id, segment, arg_max(hash_current, n) AS head FROM chain GROUP BY 1, 2)
 SELECT 'JOURNAL' AS entity_type, entity_id, segment, head, sha256(string_agg(head, '' ORDER BY segment) OVER (PARTITION BY entity_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS root FROM h""",
)
def f08_heads(spark, root):
    """Chains cut by day."""
    day = F.unix_date(F.to_date("event_timestamp"))
    return A.segment_heads(A.build_hash_chain(S.audit_events(spark, root), day))


DAY_SEGMENT = "CAST(datediff('day', DATE '1970-01-01', CAST(event_timestamp AS DATE)) AS BIGINT)"


def tree_sql(fanout: int, levels: int) -> str:
    """Levels of the tree over day heads, one table each; a tree of one node is done."""
    parts = [
        f"""h AS (SELECT entity_id, segment, arg_max(hash_current, n) AS head FROM chain GROUP BY 1, 2)""",
        """l0 AS MATERIALIZED (SELECT entity_id, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY segment) - 1 AS place,
  COUNT(*) OVER (PARTITION BY entity_id) AS size, sha256('L#' || segment || '#' || head) AS hash FROM h)""",
    ]
    for i in range(levels):
        parts.append(
            f"""l{i + 1} AS MATERIALIZED (SELECT entity_id, place // {fanout} AS place, (any_value(size) + {fanout - 1}) // {fanout} AS size,
  sha256('N' || string_agg(hash, '' ORDER BY l{i}.place)) AS hash FROM l{i} WHERE size > 1 GROUP BY entity_id, l{i}.place // {fanout})"""
        )
    return ",\n ".join(parts)


@query(
    "f08_chain_trees",
    f"""WITH RECURSIVE {chain_sql(DAY_SEGMENT)}, {tree_sql(4, 8)}
 SELECT 'JOURNAL' AS entity_type, entity_id, height, hash AS root FROM ({' UNION ALL '.join(f"SELECT entity_id, {i} AS height, hash, size FROM l{i}" for i in range(9))}) WHERE size = 1""",
)
def f08_trees(spark, root):
    """Roots over the heads of day segments, four children a node."""
    day = F.unix_date(F.to_date("event_timestamp"))
    chain = A.build_hash_chain(S.audit_events(spark, root), day)
    return M.roots(A.chain_tree(chain, fanout=4), A.CHAIN)


@query(
    "f07_unproven_segments",
    f"""WITH {AUDIT} SELECT entity_type, entity_id, {DAY_SEGMENT} AS segment,
 CASE WHEN bool_and(user_id % 3 = 1) THEN 'SEGMENT_MISSING' ELSE 'ROOT_MISMATCH' END AS error FROM audit WHERE event_timestamp >= TIMESTAMP '2024-01-15'
 GROUP BY ALL HAVING bool_or(user_id % 50 = 7) OR bool_or(user_id % 3 = 1)""",
)
def f07_unproven(spark, root):
    """From the fifteenth on events were altered or taken out and the chains linked again, so no link is broken."""
    day = F.unix_date(F.to_date("event_timestamp"))
    events = S.audit_events(spark, root)
    tree = A.chain_tree(A.build_hash_chain(events, day), fanout=4)
    part = events.where("event_timestamp >= timestamp'2024-01-15'")
    wanted = part.select(*A.CHAIN, day.cast("bigint").alias("name"))
    proofs = M.inclusion_proofs(tree, wanted, A.CHAIN, fanout=4)
    kind = F.when(F.col("user_id") % 50 == 7, F.lit("ALTERED")).otherwise(F.col("event_type"))
    altered = part.withColumn("event_type", kind).where("user_id % 3 <> 1")
    return A.verify_segments(altered, proofs, M.roots(tree, A.CHAIN), day)


@query(
    "i21_changed_fields",
    f"""WITH {JOURNALS} SELECT id, concat_ws(',', CASE WHEN status <> 'F' THEN 'amount' END, CASE WHEN id % 2 = 0 THEN 'note' END, CASE WHEN id % 3 = 0 THEN 'status' END) AS changed FROM journals""",
)
def i21(spark, root):
    j = S.journals(spark, root)
    old = F.create_map(F.lit("amount"), F.col("amount").cast("string"), F.lit("status"), F.col("status"))
    amount = F.when(F.col("status") != "F", F.lit("0")).otherwise(F.col("amount").cast("string"))
    status = F.when(F.col("id") % 3 == 0, F.lit("changed")).otherwise(F.col("status"))
    new = F.create_map(F.lit("amount"), amount, F.lit("status"), status)
    new = F.when(F.col("id") % 2 == 0, F.map_concat(new, F.create_map(F.lit("note"), F.lit("x")))).otherwise(new)
    return j.select("id", F.array_join(A.changed_fields(old, new), ",").alias("changed"))


@query(
    "l10_audit_log",
    f"""WITH {AUDIT}, n AS (SELECT event_id, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY event_timestamp, event_id) AS chain_no FROM audit),
 f AS ({FLAGS}) SELECT event_id, chain_no, compliance_flags, violation, {RISK.format(value="CASE WHEN amount > 1000000 THEN 0.3 ELSE 0 END")} AS risk_score
 FROM audit JOIN n USING (event_id) JOIN f USING (event_id)""",
)
def l10(spark, root):
    return A.audit_log(S.audit_events(spark, root)).select(
        "event_id", "chain_no", F.array_join("compliance_flags", ",").alias("compliance_flags"), "violation", "risk_score"
    )


@query(
    "c07_forensic_search",
    f"""WITH {AUDIT} SELECT event_id, event_timestamp, event_type, entity_type || ':' || entity_id AS entity,
 user_name || ' (' || user_id || ')' AS "user", ip_address FROM audit
 WHERE event_type = 'JOURNAL_MODIFIED' AND event_timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND ip_address = '10.0.0.3'""",
)
def c07(spark, root):
    from datetime import datetime

    return A.forensic_search(
        S.audit_events(spark, root), event_type="JOURNAL_MODIFIED", start=datetime(2024, 1, 5), ip_address="10.0.0.3"
    )
