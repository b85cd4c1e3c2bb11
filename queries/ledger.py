from pyspark.sql import functions as F

from ledgerloom.operators import ledger as G
from ledgerloom.plans import templates as T
from ledgerloom.plans.posting import post_month
from ledgerloom.plans.publication import publish_month
from ledgerloom.scratch import scratch_path
from ledgerloom.sources import tables as S
from ledgerloom.sources.sample_templates import balanced_catalogue, sample_catalogue, wide_catalogue
from queries.registry import ORACLES, query
from queries.views import GL, JOURNALS, LINES, TXN

ROUTED = f"""WITH {TXN}, routed AS (SELECT *, CASE
   WHEN txn_type = 'PREMIUM_RECEIPT' AND gross_amount >= 450000 AND gross_amount > tabarru_amount * 3 THEN 4
   WHEN txn_type = 'PREMIUM_RECEIPT' AND product_code = 'LIFE01' AND channel = 'AGENCY' THEN 3
   WHEN txn_type = 'PREMIUM_RECEIPT' AND bank_value_date < DATE '1997-01-01' THEN 1
   WHEN txn_type = 'PREMIUM_RECEIPT' THEN 2
   WHEN txn_type = 'CLAIM_PAID' AND gross_amount <= 400000 THEN 5 END AS match_id FROM txn),
 coded AS (SELECT *, CASE match_id WHEN 1 THEN 'PREM' WHEN 2 THEN 'PREM' WHEN 3 THEN 'PREMLIFE' WHEN 4 THEN 'PREMBIG'
   WHEN 5 THEN 'CLAIM' END AS template_code, CASE match_id WHEN 2 THEN '2' WHEN 1 THEN '1' WHEN 3 THEN '1' WHEN 4 THEN '1'
   WHEN 5 THEN '1' END AS template_version,
   'JE-' || strftime(bank_value_date, '%Y%m') || '-' || source_rowid AS je_number FROM routed)"""

LINE_SQL = ROUTED + """, spec AS (
 SELECT je_number, l.* FROM coded, LATERAL (VALUES
  (1, 'DR', '1010', 'OP', gross_amount), (2, 'CR', '3010', 'TBR', tabarru_amount), (3, 'CR', '3020', 'TNH', tanahud_amount),
  (4, 'CR', '3030', 'INV', invest_amount)) l(line_no, side, account_code, fund, amount) WHERE match_id IN (1, 2)
 UNION ALL SELECT je_number, 5, 'CR', '4010', 'OP', CASE WHEN match_id = 1 THEN ujroh_amount + admin_amount ELSE ujroh_amount END
   FROM coded WHERE match_id IN (1, 2)
 UNION ALL SELECT je_number, CASE WHEN admin_amount > 5000 THEN 6 ELSE 7 END, 'CR', CASE WHEN admin_amount > 5000 THEN '4020' ELSE '4030' END,
   'OP', admin_amount FROM coded WHERE match_id = 2
 UNION ALL SELECT je_number, l.* FROM coded, LATERAL (VALUES (1, 'DR', '1010', 'OP', gross_amount),
  (2, 'CR', '3010', 'TBR', CAST(round(tabarru_amount, 0) AS DECIMAL(20,6))), (3, 'CR', '3030', 'INV', gross_amount - tabarru_amount)) l WHERE match_id = 3
 UNION ALL SELECT je_number, l.* FROM coded, LATERAL (VALUES (1, 'DR', '1010', 'OP', gross_amount),
  (2, 'CR', '3010', 'TBR', CAST(least(gross_amount, 450000) AS DECIMAL(20,6))),
  (3, 'CR', '3030', 'INV', CAST(gross_amount - least(gross_amount, 450000) AS DECIMAL(20,6)))) l WHERE match_id = 4
 UNION ALL SELECT je_number, l.* FROM coded, LATERAL (VALUES (1, 'DR', '5010', 'TBR', tabarru_amount),
  (2, 'DR', '5020', 'INV', invest_amount), (3, 'CR', '1010', 'OP', gross_amount),
  (4, 'CR', '4099', 'OP', tabarru_amount + invest_amount - gross_amount)) l WHERE match_id = 5),
 jline AS (SELECT s.* EXCLUDE (amount), CAST(round(s.amount, 2) AS DECIMAL(20,6)) AS amount, bank_value_date AS je_date,
   product_code, channel, template_code, template_version, source_rowid FROM spec s JOIN coded USING (je_number) WHERE s.amount <> 0)"""


def expanded(spark, root):
    return T.expand_transactions(S.txn_source(spark, root), sample_catalogue(spark))


@query("d07_template_resolution", ROUTED + " SELECT source_rowid, match_id, template_code, template_version FROM coded")
def d07(spark, root):
    return T.resolve_templates(S.txn_source(spark, root), sample_catalogue(spark)).select(
        "source_rowid", F.col("match_id"), "template_code", "template_version"
    )


@query(
    "c03_entry_headers",
    ROUTED + """ SELECT sha256(je_number) AS je_id, je_number, bank_value_date AS je_date, 'JE' AS je_type, source_rowid, template_code,
 template_version, 'run' AS run_id, 'engine' AS created_by FROM coded WHERE match_id IS NOT NULL""",
)
def c03(spark, root):
    return expanded(spark, root).headers


@query(
    "l04_expanded_lines",
    LINE_SQL + """ SELECT je_number, line_no, side, account_code, fund, amount, product_code, channel, je_date, template_code, template_version FROM jline""",
)
def l04(spark, root):
    return expanded(spark, root).lines.drop("je_id", "run_id")


@query("d07_indexed_templates", ROUTED + " SELECT source_rowid, match_id, template_code, template_version FROM coded")
def d07_indexed(spark, root):
    """The same templates from an index of 100,000 more matches."""
    return T.resolve_templates(S.txn_source(spark, root), wide_catalogue(spark)).select("source_rowid", "match_id", "template_code", "template_version")


@query("l04_indexed_lines", ORACLES["l04_expanded_lines"])
def l04_indexed(spark, root):
    return T.expand_transactions(S.txn_source(spark, root), wide_catalogue(spark)).lines.drop("je_id", "run_id")


@query(
    "h09_unbalanced_entries",
    LINE_SQL + """ SELECT je_number, template_code, template_version,
 CAST(SUM(CASE WHEN side = 'DR' THEN amount ELSE -amount END) AS DECIMAL(20,6)) AS difference FROM jline
 WHERE template_code <> 'CLAIM' GROUP BY 1, 2, 3 HAVING abs(SUM(CASE WHEN side = 'DR' THEN amount ELSE -amount END)) > 0.01""",
)
def h09(spark, root):
    return expanded(spark, root).unbalanced


@query("c04_unmatched_transactions", ROUTED + " SELECT source_rowid, gross_amount FROM coded WHERE match_id IS NULL")
def c04(spark, root):
    return expanded(spark, root).unmatched.select("source_rowid", "gross_amount")


MOVE = LINE_SQL + """, mvt AS (SELECT CAST(date_trunc('month', je_date) AS DATE) AS period_start, account_code, fund,
 CAST(SUM(CASE WHEN side = 'DR' THEN amount ELSE 0 END) AS DECIMAL(38,6)) AS debit,
 CAST(SUM(CASE WHEN side = 'CR' THEN amount ELSE 0 END) AS DECIMAL(38,6)) AS credit FROM jline GROUP BY 1, 2, 3)"""


@query("e11_monthly_movement", MOVE + " SELECT * FROM mvt")
def e11(spark, root):
    return G.monthly_movement(expanded(spark, root).lines)


@query("e12_trial_balance", MOVE + " SELECT *, CAST(debit - credit AS DECIMAL(38,6)) AS net FROM mvt")
def e12(spark, root):
    return G.trial_balance(expanded(spark, root).lines)


@query(
    "e12_trial_balance_rollup",
    LINE_SQL + """ SELECT CAST(date_trunc('month', je_date) AS DATE) AS period_start, fund,
 CAST(SUM(CASE WHEN side = 'DR' THEN amount ELSE 0 END) AS DECIMAL(38,6)) AS debit,
 CAST(SUM(CASE WHEN side = 'CR' THEN amount ELSE 0 END) AS DECIMAL(38,6)) AS credit,
 CAST(GROUPING(CAST(date_trunc('month', je_date) AS DATE), fund) AS BIGINT) AS level,
 CAST(SUM(CASE WHEN side = 'DR' THEN amount ELSE -amount END) AS DECIMAL(38,6)) AS net
 FROM jline GROUP BY ROLLUP (CAST(date_trunc('month', je_date) AS DATE), fund)""",
)
def e12_rollup(spark, root):
    return G.trial_balance(expanded(spark, root).lines, ["period_start", "fund"])


#: Each account's months from its first movement to the last month of all, then running balances.
SPINE = """sp AS (SELECT account_code, fund, CAST(unnest(generate_series(f, (SELECT MAX(period_start) FROM mvt), INTERVAL 1 MONTH)) AS DATE) AS period_start
   FROM (SELECT account_code, fund, MIN(period_start) AS f FROM mvt GROUP BY 1, 2)),
 mvs AS (SELECT period_start, account_code, fund, CAST(COALESCE(debit, 0) AS DECIMAL(38,6)) AS debit, CAST(COALESCE(credit, 0) AS DECIMAL(38,6)) AS credit
   FROM sp LEFT JOIN mvt USING (period_start, account_code, fund)),
 rolled AS (SELECT *, CAST(COALESCE(SUM(debit - credit) OVER (PARTITION BY account_code, fund ORDER BY period_start
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(38,6)) AS opening_balance FROM mvs),
 snap AS (SELECT *, CAST(opening_balance + debit - credit AS DECIMAL(38,6)) AS closing_balance FROM rolled)"""
ROLL = MOVE + ", " + SPINE


@query("f09_roll_forward", ROLL + " SELECT * FROM snap")
def f09(spark, root):
    return G.roll_forward(G.monthly_movement(expanded(spark, root).lines))


@query(
    "b04_snapshot_upsert",
    ROLL + """ SELECT period_start, account_code, fund, opening_balance,
 CASE WHEN period_start >= DATE '1998-01-01' THEN CAST(debit * 2 AS DECIMAL(38,6)) ELSE debit END AS debit, credit,
 CASE WHEN period_start >= DATE '1998-01-01' THEN CAST(opening_balance + debit * 2 - credit AS DECIMAL(38,6)) ELSE closing_balance END AS closing_balance
 FROM snap""",
)
def b04(spark, root):
    """Months from 1998 on are delivered again with twice the debit."""
    snap = G.roll_forward(G.monthly_movement(expanded(spark, root).lines))
    again = snap.where("period_start >= date'1998-01-01'").withColumn("debit", (F.col("debit") * 2).cast("decimal(38,6)"))
    again = again.withColumn(
        "closing_balance", (F.col("opening_balance") + F.col("debit") - F.col("credit")).cast("decimal(38,6)")
    )
    return G.upsert_snapshot(snap, again)


@query(
    "e15_entry_balance",
    LINE_SQL + """, b AS (SELECT je_number, CAST(SUM(CASE WHEN side = 'DR' THEN amount ELSE 0 END) AS DECIMAL(38,6)) AS debit,
 CAST(SUM(CASE WHEN side = 'CR' THEN amount ELSE 0 END) AS DECIMAL(38,6)) AS credit FROM jline GROUP BY 1)
 SELECT *, CAST(debit - credit AS DECIMAL(38,6)) AS difference, abs(debit - credit) <= 0.01 AS balanced FROM b""",
)
def e15(spark, root):
    return G.entry_balance(expanded(spark, root).lines)


@query(
    "e17_signed_balance",
    LINE_SQL + """ SELECT account_code, fund, CAST(SUM(CASE WHEN side = 'DR' THEN amount ELSE -amount END) AS DECIMAL(38,6)) AS balance
 FROM jline GROUP BY 1, 2""",
)
def e17(spark, root):
    return G.signed_balance(expanded(spark, root).lines, ["account_code", "fund"])


@query(
    "e18_product_slice",
    LINE_SQL + """, m AS (SELECT *, CAST(date_trunc('month', je_date) AS DATE) AS month FROM jline)
 SELECT month, product_code, channel, COUNT(*) AS line_count, CAST(SUM(amount) AS DECIMAL(38,6)) AS total_amount,
 CAST(GROUPING(month, product_code, channel) AS BIGINT) AS level FROM m GROUP BY ROLLUP (month, product_code, channel)""",
)
def e18(spark, root):
    return G.product_slice(expanded(spark, root).lines)


@query(
    "d05_lines_with_ledger_id",
    LINE_SQL + """ SELECT je_number, line_no, amount, sha256(je_number) AS ledger_id, source_rowid FROM jline""",
)
def d05(spark, root):
    e = expanded(spark, root)
    return G.with_ledger_id(e.lines.drop("je_id"), e.headers).select(
        "je_number", "line_no", "amount", "ledger_id", "source_rowid"
    )


@query(
    "d12_lineage_trace",
    LINE_SQL + """ SELECT t.source_rowid, t.policy_no, j.je_number, j.line_no, j.side, j.account_code, j.amount
 FROM jline j JOIN txn t USING (source_rowid)""",
)
def d12(spark, root):
    e = expanded(spark, root)
    return G.trace(S.txn_source(spark, root), e.headers, e.lines).select(
        "source_rowid", "policy_no", "je_number", "line_no", "side", "account_code", "amount"
    )


@query(
    "d13_orphan_accounts",
    LINE_SQL + """ SELECT je_number, line_no, account_code FROM jline WHERE account_code NOT IN
 (SELECT '10' || CAST(n_nationkey AS VARCHAR) FROM nation)""",
)
def d13(spark, root):
    accounts = S.table(spark, root, "nation").select(
        F.concat(F.lit("10"), F.col("n_nationkey").cast("string")).alias("account_code")
    )
    return G.orphans(expanded(spark, root).lines, accounts, ["account_code"]).select(
        "je_number", "line_no", "account_code"
    )


@query(
    "e13_day_trial_balance",
    f"""WITH {GL}, b AS (SELECT trx_date, CAST(COALESCE(SUM(amount) FILTER (WHERE acc_debit IS NOT NULL), 0) AS DECIMAL(30,2)) AS debits,
 CAST(COALESCE(SUM(amount) FILTER (WHERE acc_credit IS NOT NULL), 0) AS DECIMAL(30,2)) AS credits FROM gl GROUP BY 1)
 SELECT *, CAST(abs(debits - credits) AS DECIMAL(31,2)) AS difference, abs(debits - credits) < 0.01 AS balanced FROM b""",
)
def e13(spark, root):
    return G.day_trial_balance(S.gl_entries(spark, root))


@query(
    "e14_journal_balance",
    f"""WITH {LINES}, b AS (SELECT journal_id, CAST(SUM(CASE WHEN dc = 'D' THEN amount ELSE 0 END) AS DECIMAL(30,2)) AS total_debit,
 CAST(SUM(CASE WHEN dc = 'C' THEN amount ELSE 0 END) AS DECIMAL(30,2)) AS total_credit FROM lines GROUP BY 1)
 SELECT *, CAST(total_debit - total_credit AS DECIMAL(31,2)) AS difference,
 CASE WHEN total_debit = total_credit THEN 'BALANCED' ELSE 'UNBALANCED' END AS status FROM b""",
)
def e14(spark, root):
    return G.journal_balance(S.journal_lines(spark, root), ["journal_id"])


@query(
    "e21_journal_totals",
    f"""WITH {LINES} SELECT journal_id, CAST(COALESCE(SUM(amount) FILTER (WHERE dc = 'D'), 0) AS DECIMAL(30,2)) AS total_amount,
 COUNT(*) AS line_count FROM lines GROUP BY 1""",
)
def e21(spark, root):
    return G.journal_total(S.journal_lines(spark, root), ["journal_id"])


@query(
    "a01_month_transactions",
    f"""WITH {TXN} SELECT txn_month, txn_type = 'PREMIUM_RECEIPT' AS is_premium, txn_type = 'CLAIM_PAID' AS is_claim, COUNT(*) AS n,
 CAST(SUM(gross_amount) AS DECIMAL(30,6)) AS gross, CAST(date_trunc('month', MIN(bank_value_date)) AS DATE) AS month_start,
 CAST(date_trunc('month', MIN(bank_value_date)) + INTERVAL 1 MONTH AS DATE) AS next_month FROM txn GROUP BY 1, 2, 3""",
)
def a01(spark, root):
    txn = S.txn_source(spark, root)
    first, following = G.month_window(F.min("bank_value_date"))
    return txn.groupBy(
        "txn_month", (F.col("txn_type") == "PREMIUM_RECEIPT").alias("is_premium"),
        (F.col("txn_type") == "CLAIM_PAID").alias("is_claim"),
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("gross_amount").alias("gross"),
        first.alias("month_start"), following.alias("next_month"),
    )


@query(
    "d09_journal_descriptions",
    f"""WITH {JOURNALS}, st(journal_type, description) AS (VALUES ('S0110', 'Urgent'), ('S0210', 'High'), ('S0510', 'Low'))
 SELECT id, journals.journal_type, description FROM journals LEFT JOIN st ON journals.journal_type = st.journal_type""",
)
def d09(spark, root):
    st = spark.createDataFrame(
        [("S0110", "Urgent"), ("S0210", "High"), ("S0510", "Low")], "journal_type string, description string"
    )
    return S.journals(spark, root).join(F.broadcast(st), "journal_type", "left").select("id", "journal_type", "description")


@query(
    "l05_posted_balances",
    f"""WITH {TXN}, m AS (SELECT txn_type, txn_month AS period_start, CAST(SUM(gross_amount) AS DECIMAL(38,6)) AS g, CAST(SUM(tabarru_amount) AS DECIMAL(38,6)) AS t,
   CAST(SUM(invest_amount) AS DECIMAL(38,6)) AS i, CAST(SUM(admin_amount) AS DECIMAL(38,6)) AS a, CAST(SUM(tanahud_amount) AS DECIMAL(38,6)) AS h,
   CAST(SUM(ujroh_amount) AS DECIMAL(38,6)) AS u FROM txn GROUP BY 1, 2),
 each AS (SELECT period_start, '5010' AS account_code, 'TBR' AS fund, t AS debit, CAST(0 AS DECIMAL(38,6)) AS credit FROM m WHERE txn_type = 'CLAIM_PAID'
   UNION ALL SELECT period_start, '5020', 'INV', i, 0 FROM m WHERE txn_type = 'CLAIM_PAID' UNION ALL SELECT period_start, '1010', 'OP', 0, g FROM m WHERE txn_type = 'CLAIM_PAID'
   UNION ALL SELECT period_start, '4099', 'OP', 0, a FROM m WHERE txn_type = 'CLAIM_PAID' UNION ALL SELECT period_start, '1010', 'OP', g, 0 FROM m WHERE txn_type <> 'CLAIM_PAID'
   UNION ALL SELECT period_start, '3010', 'TBR', 0, t FROM m WHERE txn_type <> 'CLAIM_PAID' UNION ALL SELECT period_start, '3020', 'TNH', 0, h FROM m WHERE txn_type <> 'CLAIM_PAID'
   UNION ALL SELECT period_start, '3030', 'INV', 0, i FROM m WHERE txn_type <> 'CLAIM_PAID' UNION ALL SELECT period_start, '4010', 'OP', 0, u + a FROM m WHERE txn_type <> 'CLAIM_PAID'),
 mvt AS (SELECT period_start, account_code, fund, CAST(SUM(debit) AS DECIMAL(38,6)) AS debit, CAST(SUM(credit) AS DECIMAL(38,6)) AS credit FROM each GROUP BY 1, 2, 3),
 {SPINE} SELECT * FROM snap""",
)
def l05(spark, root):
    """All transactions in two runs over the same months, the second one run again."""
    txn, target = S.txn_source(spark, root), scratch_path(spark, "ledger")
    late = F.crc32("source_rowid") % 2 == 1
    post_month(txn.where(~late), balanced_catalogue(spark), target, run_id="run-1")
    post_month(txn.where(late), balanced_catalogue(spark), target, run_id="run-2")
    return post_month(txn.where(late), balanced_catalogue(spark), target, run_id="run-2").balances


@query("l05_published_balances", ORACLES["l05_posted_balances"])
def l05_published(spark, root):
    """Two runs in versions; the second one first with all transactions of a month more, then as it should be."""
    txn, target = S.txn_source(spark, root), scratch_path(spark, "versions")
    late = F.crc32("source_rowid") % 2 == 1
    publish_month(txn.where(~late), balanced_catalogue(spark), target, "run-1")
    more = txn.where(late).withColumn("bank_value_date", F.add_months("bank_value_date", -1)).withColumn("source_rowid", F.concat(F.lit("X"), "source_rowid"))
    publish_month(more, balanced_catalogue(spark), target, "run-2")
    return publish_month(txn.where(late), balanced_catalogue(spark), target, "run-2").balances
