from datetime import date

from pyspark.sql import functions as F

from ledgerloom.operators import checksums, sequences
from ledgerloom.operators.ledger import fund_net_change
from ledgerloom.operators.numbering import number_rows
from ledgerloom.plans import month_end as M
from ledgerloom.scratch import scratch_path
from ledgerloom.sources import tables as S
from queries.registry import query
from queries.views import CLAIMS, PREMIUM

START, END = date(1990, 1, 1), date(2010, 12, 31)
BATCH = "1990-2010-MONTHEND"

BASE = f"""WITH {PREMIUM}, {CLAIMS},
 p AS (SELECT * FROM premium WHERE NOT batch_processed), c AS (SELECT * FROM claims WHERE NOT batch_processed),
 srcs AS (SELECT 0 AS kind, txn_id AS source_id, policy_id, payment_date AS je_date, premium_amount AS amount, fund_tabarru, fund_tanahud FROM p
   UNION ALL SELECT 1, claim_id, policy_id, claim_date, claim_amount, fund_tabarru, fund_tanahud FROM c),
 rn AS (SELECT *, ROW_NUMBER() OVER (ORDER BY kind, source_id) AS rn FROM srcs),
 ent AS (SELECT rn.*, e.* FROM rn, LATERAL (VALUES
   (0, 0, 'Premium receipt - Policy ', '1010-001', 'OPERATOR', '2010-001', 'OPERATOR', amount),
   (0, 1, 'Tabarru allocation - Policy ', '2010-001', 'OPERATOR', '3010-001', 'TABARRU', fund_tabarru),
   (0, 2, 'Tanahud allocation - Policy ', '2010-001', 'OPERATOR', '3020-001', 'TANAHUD', fund_tanahud),
   (1, 0, 'Tabarru claim - Policy ', '3010-001', 'TABARRU', '2020-001', 'OPERATOR', fund_tabarru),
   (1, 1, 'Tanahud claim - Policy ', '3020-001', 'TANAHUD', '2020-001', 'OPERATOR', fund_tanahud),
   (1, 2, 'Claim payment - Policy ', '2020-001', 'OPERATOR', '1010-001', 'OPERATOR', amount)
  ) e(k, entry_no, descr, da, df, ca, cf, amt) WHERE e.k = rn.kind),
 hdr AS (SELECT *, (rn - 1) * 3 + entry_no + 1 AS je_sequence, CASE kind WHEN 0 THEN 'PREMIUM' ELSE 'CLAIM' END AS source_type,
   'JE-' || CASE kind WHEN 0 THEN 'PREM' ELSE 'CLAI' END || '-' || strftime(je_date, '%Y%m%d') || '-' ||
   lpad(CAST((rn - 1) * 3 + entry_no + 1 AS VARCHAR), 10, '0') AS je_number FROM ent),
 jl AS (SELECT je_number, 1 AS line_number, da AS account_code, df AS fund_type, amt AS debit_amount, CAST(0 AS DECIMAL(20,2)) AS credit_amount FROM hdr
   UNION ALL SELECT je_number, 2, ca, cf, CAST(0 AS DECIMAL(20,2)), amt FROM hdr)"""


def sources(spark, root):
    return (
        M.unprocessed(S.premium_transaction(spark, root), "payment_date", START, END),
        M.unprocessed(S.claims_transaction(spark, root), "claim_date", START, END),
    )


def staged(spark, root):
    return M.stage_entries(*sources(spark, root), BATCH)


@query("a09_unprocessed_premiums", BASE + " SELECT * FROM p")
def a09(spark, root):
    return sources(spark, root)[0]


@query(
    "l07_month_end_headers",
    BASE + """ SELECT je_sequence, je_number, je_date, source_type, source_id, descr || policy_id AS description,
 amt AS total_debit, amt AS total_credit FROM hdr""",
)
def l07_headers(spark, root):
    return staged(spark, root).headers.select(
        "je_sequence", "je_number", "je_date", "source_type", "source_id", "description", "total_debit", "total_credit"
    )


@query("l07_month_end_lines", BASE + " SELECT * FROM jl")
def l07_lines(spark, root):
    return staged(spark, root).lines.drop("batch_id", "je_date", "description")


@query("e16_fund_net_change", BASE + """ SELECT fund_type, CAST(SUM(credit_amount) - SUM(debit_amount) AS DECIMAL(38,2)) AS net_change FROM jl GROUP BY 1""")
def e16(spark, root):
    return fund_net_change(staged(spark, root).lines)


@query(
    "d18_fund_expectations",
    BASE + """ SELECT 'TABARRU' AS fund_type, CAST((SELECT SUM(fund_tabarru) FROM p) - (SELECT SUM(fund_tabarru) FROM c) AS DECIMAL(38,2)) AS expected_change
 UNION ALL SELECT 'TANAHUD', CAST((SELECT SUM(fund_tanahud) FROM p) - (SELECT SUM(fund_tanahud) FROM c) AS DECIMAL(38,2))
 UNION ALL SELECT 'UJROH', CAST(0 AS DECIMAL(38,2))""",
)
def d18(spark, root):
    return M.fund_expectations(*sources(spark, root))


@query(
    "h07_precommit_checks",
    BASE + """, n AS (SELECT COUNT(*) * 3 AS n FROM srcs), t AS (SELECT CAST(SUM(amt) AS DECIMAL(38,2)) AS t FROM hdr),
 f AS (SELECT 'TABARRU' AS ft, CAST((SELECT SUM(fund_tabarru) FROM p) - (SELECT SUM(fund_tabarru) FROM c) AS DECIMAL(38,2)) AS x
   UNION ALL SELECT 'TANAHUD', CAST((SELECT SUM(fund_tanahud) FROM p) - (SELECT SUM(fund_tanahud) FROM c) AS DECIMAL(38,2))
   UNION ALL SELECT 'UJROH', CAST(0 AS DECIMAL(38,2)))
 SELECT 'record_count_check' AS validation_name, 'PASS' AS status, CAST(n AS VARCHAR) AS expected_value, CAST(n AS VARCHAR) AS actual_value, '0' AS difference FROM n
 UNION ALL SELECT 'sequence_duplicate_check', 'PASS', '0', '0', NULL UNION ALL SELECT 'sequence_gap_check', 'PASS', '0', '0', NULL
 UNION ALL SELECT 'debit_credit_balance', 'PASS', CAST(t AS VARCHAR), CAST(t AS VARCHAR), '0.00' FROM t
 UNION ALL SELECT 'fund_total_' || ft, 'PASS', CAST(x AS VARCHAR), CAST(x AS VARCHAR), '0.00' FROM f""",
)
def h07(spark, root):
    return M.precommit(staged(spark, root), *sources(spark, root))


@query(
    "h06_preflight_checks",
    BASE + """, b AS (SELECT COUNT(*) FILTER (WHERE NOT (fund_tabarru > 0 AND fund_tanahud > 0 AND fund_ujroh > 0)) AS a,
   COUNT(*) FILTER (WHERE fund_tabarru + fund_tanahud + fund_ujroh <> premium_amount) AS s FROM p)
 SELECT 'prerequisite_AP_CLOSE' AS validation_name, 'PASS' AS status, 'COMPLETED' AS expected_value, 'COMPLETED' AS actual_value, CAST(NULL AS VARCHAR) AS difference
 UNION ALL SELECT 'prerequisite_AR_CLOSE', 'FAIL', 'COMPLETED', 'RUNNING', NULL
 UNION ALL SELECT 'prerequisite_PAYROLL_CLOSE', 'FAIL', 'COMPLETED', 'MISSING', NULL
 UNION ALL SELECT 'premium_fund_allocation', CASE WHEN a > 0 THEN 'FAIL' ELSE 'PASS' END, '0', CAST(a AS VARCHAR), NULL FROM b
 UNION ALL SELECT 'premium_allocation_sum', CASE WHEN s > 0 THEN 'FAIL' ELSE 'PASS' END, '0', CAST(s AS VARCHAR), NULL FROM b""",
)
def h06(spark, root):
    batches = spark.createDataFrame(
        [("AP_CLOSE", "COMPLETED"), ("AR_CLOSE", "RUNNING")], "batch_type string, status string"
    )
    return M.preflight(sources(spark, root)[0], batches)


@query(
    "h08_staging_integrity",
    BASE + """ SELECT (SELECT COUNT(*) * 3 FROM p) AS expected_count, (SELECT CAST(SUM(premium_amount) AS DECIMAL(38,2)) FROM p) AS source_total,
 COUNT(*) AS actual_count, CAST(SUM(amt) FILTER (WHERE entry_no = 0) AS DECIMAL(38,2)) AS staged_total, true AS intact FROM hdr WHERE kind = 0""",
)
def h08(spark, root):
    return M.staging_integrity(staged(spark, root), sources(spark, root)[0])


@query(
    "h02_fund_allocation_rules",
    BASE + """ SELECT 'premium' AS source, COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT (fund_tabarru > 0 AND fund_tanahud > 0 AND fund_ujroh > 0)) AS missing_allocation,
 COUNT(*) FILTER (WHERE fund_tabarru + fund_tanahud + fund_ujroh <> premium_amount) AS wrong_sum FROM premium
 UNION ALL SELECT 'claim', COUNT(*), COUNT(*) FILTER (WHERE NOT (fund_tabarru > 0)), COUNT(*) FILTER (WHERE fund_tabarru + claim_amount * 0.2 <> claim_amount) FROM claims""",
)
def h02(spark, root):
    p, c = S.premium_transaction(spark, root), S.claims_transaction(spark, root)
    ok = (F.col("fund_tabarru") > 0) & (F.col("fund_tanahud") > 0) & (F.col("fund_ujroh") > 0)
    premium = p.agg(
        F.lit("premium").alias("source"), F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("missing_allocation"),
        F.count_if(F.col("fund_tabarru") + F.col("fund_tanahud") + F.col("fund_ujroh") != F.col("premium_amount")).alias("wrong_sum"),
    )
    fifth = F.col("claim_amount") * F.lit("0.2").cast("decimal(2,1)")
    claim = c.agg(
        F.lit("claim").alias("source"), F.count(F.lit(1)).alias("total"),
        F.count_if(~(F.col("fund_tabarru") > 0)).alias("missing_allocation"),
        F.count_if(F.col("fund_tabarru") + fifth != F.col("claim_amount")).alias("wrong_sum"),
    )
    return premium.unionByName(claim)


@query(
    "g04_gap_free_sequence",
    """SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_custkey, o_orderkey) + 999 AS seq,
 ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS seq_in_status FROM orders""",
)
def g04(spark, root):
    o = S.table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    n = number_rows(o, ["o_custkey", "o_orderkey"], start=1000)
    n = number_rows(n, ["o_custkey", "o_orderkey"], keys=["o_orderstatus"], column="seq_in_status")
    return n.select("o_orderkey", "seq", "seq_in_status")


@query(
    "f04_sequence_gaps",
    """, d AS (SELECT DISTINCT l_orderkey AS s FROM lineitem), g AS (SELECT s - LAG(s) OVER (ORDER BY s) AS step FROM all_rows)
 SELECT (SELECT COUNT(*) FROM all_rows) AS row_count, (SELECT MIN(s) FROM d) AS first_seq, (SELECT MAX(s) FROM d) AS last_seq,
 COUNT(*) FILTER (WHERE step > 1) AS gap_count, CAST(COALESCE(SUM(step - 1) FILTER (WHERE step > 1), 0) AS BIGINT) AS missing_count,
 COUNT(*) FILTER (WHERE step = 0) AS duplicate_count FROM g""".replace(", d AS", "WITH all_rows AS (SELECT l_orderkey AS s FROM lineitem), d AS", 1),
)
def f04(spark, root):
    return sequences.sequence_check(S.table(spark, root, "lineitem").select("l_orderkey"), "l_orderkey")


@query(
    "g06_missing_sequences",
    """WITH g AS (SELECT s, LAG(s) OVER (ORDER BY s) AS p FROM (SELECT DISTINCT l_orderkey AS s FROM lineitem))
 SELECT p + 1 AS first_missing, s - 1 AS last_missing, s - p - 1 AS missing FROM g WHERE s - p > 1""",
)
def g06(spark, root):
    return sequences.missing_ranges(S.table(spark, root, "lineitem").select("l_orderkey").distinct(), "l_orderkey")


WORDS = ", ".join(
    f"SUM(CAST(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS DECIMAL(38,0))) AS w{i}" for i in range(4)
)


@query(
    "e29_source_checksum",
    f"""WITH {PREMIUM}, h AS (SELECT payment_date, sha256(txn_id || ':' || premium_amount) AS d FROM premium),
 s AS (SELECT payment_date, COUNT(*) AS row_count, {WORDS} FROM h GROUP BY 1)
 SELECT payment_date, row_count, sha256(concat_ws(':', row_count, w0, w1, w2, w3)) AS checksum FROM s""",
)
def e29(spark, root):
    return checksums.source_checksum(S.premium_transaction(spark, root), "txn_id", "premium_amount", ["payment_date"])


@query(
    "e29_bucket_checksums",
    f"""WITH {PREMIUM} SELECT CAST(floor(txn_id / 1000) AS BIGINT) AS bucket, COUNT(*) AS row_count,
 sha256(string_agg(txn_id || ':' || premium_amount, '' ORDER BY txn_id)) AS checksum FROM premium GROUP BY 1""",
)
def e29_buckets(spark, root):
    return checksums.bucket_checksums(S.premium_transaction(spark, root), "txn_id", "premium_amount")


@query(
    "l07_month_end",
    BASE + f""", net AS (SELECT fund_type, SUM(credit_amount - debit_amount) AS change FROM jl GROUP BY 1)
 SELECT fund_type, 'COMMITTED' AS status, CAST(1000000 + change AS DECIMAL(38,2)) AS current_balance, (SELECT COUNT(*) FROM hdr) AS headers,
 (SELECT COUNT(*) FROM jl) AS lines, (SELECT COUNT(*) FROM p WHERE payment_date BETWEEN '{START}' AND '{END}') AS premiums_marked,
 (SELECT COUNT(*) FROM c WHERE claim_date BETWEEN '{START}' AND '{END}') AS claims_marked FROM net""",
)
def l07(spark, root):
    """The whole batch as one call; what it published, balanced and marked."""
    p, c = S.premium_transaction(spark, root), S.claims_transaction(spark, root)
    funds = spark.createDataFrame([(f,) for f in ("OPERATOR", "TABARRU", "TANAHUD")], "fund_type string")
    before = funds.withColumn("current_balance", F.lit(1000000).cast("decimal(38,2)"))
    batches = spark.createDataFrame([(b, "COMPLETED") for b in M.PREREQUISITES], "batch_type string, status string")
    target = scratch_path(spark, "month-end")
    out = M.month_end(p, c, batches, before, START, END, BATCH, target)
    mine = F.col("batch_id") == BATCH
    counts = [
        df.agg(F.count(F.lit(1)).alias(name))
        for name, df in (
            ("headers", spark.read.parquet(f"{target}/headers").where(mine)),
            ("lines", spark.read.parquet(f"{target}/lines").where(mine)),
            ("premiums_marked", out.premiums.where(mine)),
            ("claims_marked", out.claims.where(mine)),
        )
    ]
    rows = out.balances.withColumn("status", F.lit(out.status)).withColumn("_k", F.lit(1))
    for one in counts:  # one row each
        rows = rows.join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k")
    return rows.drop("_k")


@query(
    "l08_rollback_balances",
    BASE + """ SELECT fund_type, CAST(1000000 AS DECIMAL(38,2)) AS current_balance FROM (VALUES ('OPERATOR'), ('TABARRU'), ('TANAHUD')) f(fund_type)""",
)
def l08(spark, root):
    """Balances after a batch and its rollback are the balances before it."""
    s = staged(spark, root)
    funds = spark.createDataFrame([(f,) for f in ("OPERATOR", "TABARRU", "TANAHUD")], "fund_type string")
    before = funds.withColumn("current_balance", F.lit(1000000).cast("decimal(38,2)"))
    after = M.fund_balances(before, s.lines)
    p, c = S.premium_transaction(spark, root), S.claims_transaction(spark, root)
    p = M.mark_processed(p, "payment_date", START, END, BATCH)
    c = M.mark_processed(c, "claim_date", START, END, BATCH)
    return M.rollback(s.headers, s.lines, after, p, c, BATCH).balances


@query(
    "b06_mark_processed",
    f"""WITH {PREMIUM} SELECT txn_id, true AS batch_processed, CASE WHEN NOT batch_processed THEN '{BATCH}' END AS batch_id FROM premium""",
)
def b06(spark, root):
    out = M.mark_processed(S.premium_transaction(spark, root), "payment_date", START, END, BATCH)
    return out.select("txn_id", "batch_processed", "batch_id")


@query("l08_rollback_sources", f"""WITH {PREMIUM} SELECT txn_id, batch_processed, CAST(NULL AS VARCHAR) AS batch_id FROM premium""")
def l08_sources(spark, root):
    p = M.mark_processed(S.premium_transaction(spark, root), "payment_date", START, END, BATCH)
    s = staged(spark, root)
    funds = spark.createDataFrame([("TABARRU",)], "fund_type string").withColumn("current_balance", F.lit(0).cast("decimal(38,2)"))
    out = M.rollback(s.headers, s.lines, funds, p, p, BATCH).premiums
    return out.select("txn_id", "batch_processed", "batch_id")
