from datetime import date

from pyspark.sql import functions as F

from ledgerloom.functions.layout import FIELD_POSITIONS, fifty_seven_fields
from ledgerloom.operators import flags
from ledgerloom.operators.sinks import export_rows
from ledgerloom.plans import journals as J
from ledgerloom.plans import vouchers as V
from ledgerloom.scratch import cut, small_side
from ledgerloom.sources import tables as S
from ledgerloom.sources.datasource_rows import datasource_rows, sample_settings
from ledgerloom.sources.routing import source_name
from queries.registry import query
from queries.views import LINES

FIRST_DAY = date(1990, 1, 1)

SRC = """src AS (SELECT 'O' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS s,
    substr(o_orderpriority, 1, 1) AS p, 'Order ' || o_orderpriority AS description, o_custkey,
    CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 35 ELSE 45 END AS ds,
    'REF.' || o_orderkey || '.X' AS reference, CAST(o_totalprice AS DECIMAL(20,2)) AS g,
    CAST(round(CAST(o_totalprice AS DECIMAL(20,2)) * 0.30, 2) AS DECIMAL(20,2)) AS part FROM orders),
 cfg(stype, sdesc, ds, d_from, d_to, status2, jln, pln, acct, dc, idx, flag, t3c, t6c, t9c) AS (VALUES
  ('S0110', 'Premium receipt', 1, NULL, NULL, 0, 1, 1, 'BANK', 'D', 0, 2, NULL, NULL, NULL),
  ('S0110', 'Premium receipt', 1, NULL, NULL, 0, 2, 2, 'KONTRIBUSI TABARRU', 'C', 1, 1, NULL, NULL, NULL),
  ('S0110', 'Premium receipt', 1, NULL, NULL, 0, 3, 3, '2199', 'C', 2, 4, 'ZZ', 'X6', NULL),
  ('S0210', 'Claim', 35, DATE '1995-01-01', DATE '1997-12-31', 1, 1, 2, 'KLAIM', 'D', 1, 1, NULL, NULL, 'N9'),
  ('S0210', 'Claim', 35, DATE '1995-01-01', DATE '1997-12-31', 1, 2, 1, 'BANK', 'C', 0, 2, NULL, NULL, NULL),
  ('S0210', 'Claim', 35, DATE '1995-01-01', DATE '1997-12-31', 1, 2, 3, '3101', 'C', 2, 3, NULL, NULL, NULL),
  ('S0310', 'Claim payment', 45, DATE '1996-01-01', DATE '1999-12-31', 0, 1, 1, 'BIAYA', 'D', 0, 1, NULL, NULL, NULL),
  ('S0310', 'Claim payment', 45, DATE '1996-01-01', DATE '1999-12-31', 0, 2, 2, 'BANK', 'C', 3, 3, NULL, NULL, NULL),
  ('S0310', 'Claim payment', 45, DATE '1996-01-01', DATE '1999-12-31', 0, 3, 3, '5100', 'C', 1, 4, NULL, NULL, NULL)),
 active AS (SELECT src.*, cfg.* EXCLUDE (ds) FROM src JOIN cfg ON src.ds = cfg.ds
   AND (d_from IS NULL OR d_to IS NULL OR day BETWEEN d_from AND d_to OR (status2 = 1 AND day > d_to))),
 x AS (SELECT *, sha256(stype || chr(1) || id || chr(1) || CAST(day AS VARCHAR)) AS journal_id,
   CASE WHEN acct IN ('BANK', 'KONTRIBUSI TABARRU', 'KLAIM', 'BIAYA')
     THEN CASE idx WHEN 0 THEN '11' || s WHEN 1 THEN '21' || p END ELSE acct END AS account_code,
   CASE idx WHEN 0 THEN g WHEN 1 THEN part WHEN 2 THEN g - part ELSE 0 END AS amount,
   COALESCE(t3c, p) AS t3, COALESCE(t6c, p) AS t6,
   CASE idx WHEN 0 THEN 'a' WHEN 1 THEN CASE WHEN s = 'P' THEN NULL ELSE 'b' END WHEN 2 THEN 'c' ELSE 'd' END AS t8,
   COALESCE(t9c, substr('efgh', idx + 1, 1)) AS t9, substr('efgh', idx + 1, 1) AS t10 FROM active),
 pos AS (SELECT * FROM x WHERE amount > 0),
 slots AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY journal_id, jln ORDER BY pln DESC) AS rn FROM pos),
 jl AS (SELECT * FROM slots WHERE rn = 1 AND t8 IS NOT NULL AND account_code IS NOT NULL)"""

LINE_SQL = """SELECT journal_id, stype AS setting_type, day AS journal_date, jln AS journal_line_number, flag AS account_flag,
  substr(replace(reference, '.', ''), 1, 15) AS transaction_reference, account_code, description, dc AS d_c_marker,
  CAST(amount AS DECIMAL(20,2)) AS transaction_amount, CAST(amount AS DECIMAL(20,2)) AS base_amount, s AS t1, 'N/A' AS t2, t3, p AS t4,
  t6, t8, t9, t10, replace('PA.R.' || o_custkey, '.', '') AS general_description_3,
  CAST(day + 30 AS VARCHAR) AS due_date"""
LINE_COLS = (
    "journal_id setting_type journal_date journal_line_number account_flag transaction_reference account_code"
    " description d_c_marker transaction_amount base_amount t1 t2 t3 t4 t6 t8 t9 t10 general_description_3 due_date"
).split()


def built(spark, root):
    return J.build_journals(sample_settings(spark), datasource_rows(spark, root), start=FIRST_DAY)


@query("l01_journals", f"""WITH {SRC} SELECT h.journal_id AS id, h.id AS source_rowid, h.stype AS journal_type, h.day AS journal_date,
 COUNT(jl.jln) AS line_count FROM (SELECT DISTINCT journal_id, id, stype, day FROM x) h LEFT JOIN jl USING (journal_id) GROUP BY ALL""")
def l01_journals(spark, root):
    out = built(spark, root)
    counts = out.lines.groupBy(F.col("journal_id").alias("id")).agg(F.count(F.lit(1)).alias("line_count"))
    return out.journals.join(counts, "id", "left").select(
        "id", "source_rowid", "journal_type", "journal_date",
        F.coalesce("line_count", F.lit(0).cast("bigint")).alias("line_count"),
    )


@query("l01_journal_lines", f"WITH {SRC} {LINE_SQL} FROM jl")
def l01_lines(spark, root):
    return built(spark, root).lines.select(*LINE_COLS)


@query("l01_dropped_lines", f"WITH {SRC} {LINE_SQL} FROM slots WHERE rn = 1 AND (t8 IS NULL OR account_code IS NULL)")
def l01_dropped(spark, root):
    return built(spark, root).dropped_lines.select(*LINE_COLS)


@query(
    "l01_gl_rows",
    f"""WITH {SRC}, seg AS (SELECT *, SUM(CASE WHEN flag IN (1, 2) THEN 1 ELSE 0 END) OVER w AS sg,
   last_value(CASE WHEN dc = 'D' THEN account_code END IGNORE NULLS) OVER w AS d,
   last_value(CASE WHEN dc = 'C' THEN account_code END IGNORE NULLS) OVER w AS c
   FROM pos WINDOW w AS (PARTITION BY journal_id ORDER BY pln, jln ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, SUM(CASE WHEN flag = 4 THEN 1 ELSE 0 END) OVER w AS k FROM seg
   WINDOW w AS (PARTITION BY journal_id, sg ORDER BY pln, jln ROWS UNBOUNDED PRECEDING)),
 v AS (SELECT *, CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END * SUM(CASE WHEN flag IN (1, 2) THEN amount
   WHEN flag = 4 THEN CASE WHEN k % 2 = 1 THEN -amount ELSE amount END ELSE 0 END) OVER
   (PARTITION BY journal_id, sg ORDER BY pln, jln ROWS UNBOUNDED PRECEDING) AS xv FROM k)
 SELECT journal_id, stype AS journal_type, reference AS trx_id, day AS trx_date, COALESCE(d, '') AS acc_debit,
  COALESCE(c, '') AS acc_credit, CAST(CASE WHEN flag = 4 THEN amount - xv ELSE xv END AS DECIMAL(20,2)) AS amount,
  jln AS journal_line_number, t8 AS t_8 FROM v WHERE flag IN (1, 3, 4)""",
)
def l01_gl(spark, root):
    return built(spark, root).gl.select(
        "journal_id", "journal_type", "trx_id", "trx_date", "acc_debit", "acc_credit", "amount",
        "journal_line_number", "t_8",
    )


@query(
    "d04_reversal_lines",
    f"""WITH {SRC} SELECT sha256('S1110' || chr(1) || journal_id || chr(1) || CAST(day AS VARCHAR)) AS journal_id,
 jln AS journal_line_number, account_code, CASE WHEN dc = 'D' THEN 'C' ELSE 'D' END AS d_c_marker,
 CAST(amount AS DECIMAL(20,2)) AS transaction_amount, t3, t6, t8 FROM jl WHERE stype = 'S0110'""",
)
def d04(spark, root):
    """Reversal journals whose source row is the journal to reverse."""
    base = built(spark, root)
    only = base.lines.where("setting_type = 'S0110'")
    # A journal's own lines are few (one per configured line), so they fit an array.
    body = only.groupBy(F.col("journal_id").alias("id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "journal_line_number", "account_code", "d_c_marker", "transaction_amount",
                    *[f"t{i}" for i in range(1, 11)],
                )
            )
        ).alias("lines")
    )
    premium = sample_settings(spark).where("journal_type = 'S0110'").select(
        F.lit("S1110").alias("journal_type"), "description", "status", "status2",
        F.col("journal_set").withField("ds", F.col("journal_set.ds") + 1).alias("journal_set"),
    )
    src = datasource_rows(spark, root).where("ds = 1").join(
        base.journals.where("journal_type = 'S0110'").select(
            F.col("id").alias("jid"), F.col("source_rowid").alias("sid")
        ),
        F.col("id") == F.col("sid"),
    )
    src = src.withColumn("id", F.col("jid")).withColumn("ds", F.col("ds") + 1).drop("jid", "sid")
    return J.build_journals(premium, src, originals=body, start=FIRST_DAY).lines.select(
        "journal_id", "journal_line_number", "account_code", "d_c_marker", "transaction_amount", "t3", "t6", "t8"
    )


@query(
    "c01_active_settings",
    f"""WITH {SRC}, st AS (SELECT DISTINCT stype, ds, d_from, d_to, status2 FROM cfg)
 SELECT DISTINCT day, stype AS journal_type, d_from IS NULL OR d_to IS NULL OR day BETWEEN d_from AND d_to OR (status2 = 1 AND day > d_to) AS either_active,
 (d_from IS NULL AND d_to IS NULL) OR COALESCE(day BETWEEN d_from AND d_to, false) OR COALESCE(status2 = 1 AND day > d_to, false) AS strict_active,
 (d_from IS NULL AND d_to IS NULL) OR COALESCE(day BETWEEN d_from AND d_to, false) AS domain_active,
 CASE WHEN day >= DATE '1996-06-01' THEN 0 ELSE 1 END AS gate FROM st JOIN src USING (ds)""",
)
def c01(spark, root):
    days = datasource_rows(spark, root).select("ds", F.col("journal_date").alias("day")).distinct()
    conf = small_side(sample_settings(spark).where("status = 1"))
    return days.join(conf, F.col("ds") == F.col("journal_set.ds")).select(
        "day", "journal_type",
        *[J.setting_active(F.col("day"), m).alias(f"{m}_active") for m in ("either", "strict", "domain")],
        J.gate_status(F.col("day"), date(1996, 6, 1)).alias("gate"),
    )


@query(
    "a07_source_routing",
    """SELECT l_suppkey % 200 AS ds, CASE WHEN d BETWEEN 1 AND 10 OR d BETWEEN 101 AND 110 THEN 'underwriting'
 WHEN d BETWEEN 11 AND 30 OR d BETWEEN 111 AND 130 THEN 'bank_reconciliation'
 WHEN d BETWEEN 51 AND 70 OR d BETWEEN 151 AND 170 THEN 'bank_reconciliation_ul'
 WHEN d BETWEEN 91 AND 92 OR d BETWEEN 191 AND 192 THEN 'unit_deal_ul'
 WHEN d BETWEEN 31 AND 40 OR d BETWEEN 131 AND 140 THEN 'claim_process'
 WHEN d BETWEEN 71 AND 80 OR d BETWEEN 171 AND 180 THEN 'claim_process_ul'
 WHEN d BETWEEN 41 AND 50 OR d BETWEEN 141 AND 150 THEN 'claim_payment'
 WHEN d BETWEEN 81 AND 90 OR d BETWEEN 181 AND 190 THEN NULL
 WHEN d BETWEEN 91 AND 99 THEN 'appropriate' END AS source, COUNT(*) AS n
 FROM (SELECT l_suppkey, l_suppkey % 200 AS d FROM lineitem) GROUP BY 1, 2""",
)
def a07(spark, root):
    ds = (F.col("l_suppkey") % 200).alias("ds")
    return S.table(spark, root, "lineitem").groupBy(ds).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "source", source_name(F.col("ds"))
    )


F05 = f"""WITH {LINES}, pos AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY journal_id ORDER BY line_no, sort_part, sort_supp, amount, sort_date) AS rn
   FROM lines WHERE amount > 0),
 seg AS (SELECT *, SUM(CASE WHEN account_flag IN (1, 2) THEN 1 ELSE 0 END) OVER w AS sg,
   last_value(CASE WHEN dc = 'D' THEN account_code END IGNORE NULLS) OVER w AS d,
   last_value(CASE WHEN dc = 'C' THEN account_code END IGNORE NULLS) OVER w AS c
   FROM pos WINDOW w AS (PARTITION BY journal_id ORDER BY rn ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, SUM(CASE WHEN account_flag = 4 THEN 1 ELSE 0 END) OVER
   (PARTITION BY journal_id, sg ORDER BY rn ROWS UNBOUNDED PRECEDING) AS k FROM seg),
 v AS (SELECT *, CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END * SUM(CASE WHEN account_flag IN (1, 2) THEN amount
   WHEN account_flag = 4 THEN CASE WHEN k % 2 = 1 THEN -amount ELSE amount END ELSE 0 END) OVER
   (PARTITION BY journal_id, sg ORDER BY rn ROWS UNBOUNDED PRECEDING) AS xv FROM k)
 SELECT journal_id, line_no, COALESCE(d, '') AS acc_debit, COALESCE(c, '') AS acc_credit,
  CAST(CASE WHEN account_flag = 4 THEN amount - xv ELSE xv END AS DECIMAL(20,2)) AS amount FROM v WHERE account_flag IN (1, 3, 4)"""


@query("f05_flag_machine", F05)
def f05(spark, root):
    return flags.flagged_gl_rows(S.journal_lines(spark, root), ["journal_id"], S.LINE_ORDER)


@query("f05_flag_machine_split", F05)
def f05_split(spark, root):
    """The many-task form on every journal, as a hot journal would take it."""
    return flags.flagged_gl_rows(S.journal_lines(spark, root), ["journal_id"], S.LINE_ORDER, limit=0)


@query(
    "l03_one_sided_gl",
    f"""WITH {LINES} SELECT journal_id, line_no, CASE WHEN dc = 'D' THEN account_code END AS acc_debit,
 CASE WHEN dc = 'C' THEN account_code END AS acc_credit, amount FROM lines WHERE account_flag IN (1, 3, 4)""",
)
def l03(spark, root):
    return flags.one_sided_gl_rows(S.journal_lines(spark, root), ["journal_id"])


@query(
    "i11_last_line_per_number",
    f"""WITH {LINES}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY journal_id, line_no
   ORDER BY sort_part DESC, sort_supp DESC, amount DESC, sort_date DESC) AS rn FROM lines)
 SELECT journal_id, line_no, account_code, amount, t1, t4 FROM r WHERE rn = 1""",
)
def i11_last(spark, root):
    kept = flags.last_line_per_number(S.journal_lines(spark, root), ["journal_id"], S.LINE_ORDER[1:])
    return kept.select("journal_id", "line_no", "account_code", "amount", "t1", "t4")


# A group's fields that vary inside a day: type of the row, number, t3 and priority.
GROUPED = f"""WITH {SRC}, gk AS (SELECT *, 'S0' || p || '10' AS jt FROM jl),
 grp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stype, day ORDER BY jt, s, t3, p) AS seq
   FROM (SELECT DISTINCT stype, sdesc, day, jt, s, t3, p FROM gk)),
 placed AS (SELECT gk.*, grp.seq FROM gk JOIN grp USING (stype, day, jt, s, t3, p)),
 own AS (SELECT *, MIN(seq) OVER (PARTITION BY journal_id) AS first_seq FROM placed),
 hdr AS (SELECT *, stype || strftime(day, '%y%m%d') || lpad(CAST(seq AS VARCHAR), 4, '0') AS voucher_no FROM grp)"""


def lines(spark, root):
    """Journal lines written once, as vouchers are built from stored journals."""
    return cut(built(spark, root).lines, "lines")


@query(
    "l02_vouchers",
    GROUPED + """ SELECT sha256('voucher' || chr(1) || voucher_no) AS voucher_id, stype AS journal_type, day AS journal_date,
 CAST(seq AS INTEGER) AS seq, voucher_no, substr(sdesc || ' ' || day || '/' || lpad(CAST(seq AS VARCHAR), 4, '0'), 1, 50) AS description FROM hdr""",
)
def l02(spark, root):
    return V.build_vouchers(lines(spark, root)).vouchers


VLINES = """ SELECT voucher_no, seq, jln AS journal_line_number, account_code, dc AS d_c_marker, 'N/A' AS t2, t6, t8, t9, t10,
 CAST(SUM(amount) AS DECIMAL(30,2)) AS transaction_amount FROM own JOIN hdr USING (stype, day, jt, s, t3, p, seq)
 {where} GROUP BY voucher_no, seq, jln, account_code, dc, t6, t8, t9, t10"""
VCOLS = "voucher_no seq journal_line_number account_code d_c_marker t2 t6 t8 t9 t10 transaction_amount".split()


@query("e19_voucher_lines", GROUPED + VLINES.format(where="WHERE seq = first_seq"))
def e19(spark, root):
    return V.build_vouchers(lines(spark, root)).lines.select(*VCOLS)


@query("e19_voucher_lines_split", GROUPED + VLINES.format(where=""))
def e19_split(spark, root):
    return V.build_vouchers(lines(spark, root), split=True).lines.select(*VCOLS)


@query(
    "f10_orphan_lines",
    GROUPED + """ SELECT journal_id, jln AS journal_line_number, account_code, seq, first_seq FROM own WHERE seq <> first_seq""",
)
def f10(spark, root):
    return V.build_vouchers(lines(spark, root)).orphan_lines.select(
        "journal_id", "journal_line_number", "account_code", "seq", "first_seq"
    )


@query(
    "d10_voucher_links",
    GROUPED + """ SELECT DISTINCT journal_id, sha256('voucher' || chr(1) || voucher_no) AS voucher_id
 FROM own JOIN hdr USING (stype, day, jt, s, t3, p, seq) WHERE seq = first_seq""",
)
def d10(spark, root):
    return V.build_vouchers(lines(spark, root)).links.select("journal_id", "voucher_id")


DIGEST = f"""WITH {SRC}, gk AS (SELECT *, md5(stype || '|"SYS"|"' || s || '"|"' || strftime(day, '%Y%m') || '"') AS grouping_key FROM jl),
 grp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stype, day ORDER BY grouping_key) AS seq
   FROM (SELECT DISTINCT stype, sdesc, day, grouping_key FROM gk))"""


@query(
    "f02_digest_vouchers",
    DIGEST + """ SELECT stype || strftime(day, '%y%m%d') || lpad(CAST(seq AS VARCHAR), 4, '0') AS voucher_no,
 grouping_key, COUNT(*) AS line_count, CAST(SUM(amount) AS DECIMAL(30,2)) AS total FROM grp JOIN gk USING (stype, day, grouping_key) GROUP BY 1, 2""",
)
def f02(spark, root):
    out = V.build_vouchers(lines(spark, root), grouping="digest").lines
    return out.groupBy("voucher_no", "grouping_key").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("transaction_amount").alias("total")
    )


FIRST = f"""WITH {SRC}, firsts AS (SELECT stype, day, journal_id, sdesc, 'SYS|' || s || '|' || strftime(day, '%Y%m') AS k FROM jl GROUP BY ALL),
 grp AS (SELECT stype, day, k, MIN(sdesc) AS sdesc, ROW_NUMBER() OVER (PARTITION BY stype, day ORDER BY MIN(journal_id)) AS seq
   FROM firsts GROUP BY stype, day, k),
 placed AS (SELECT jl.*, seq FROM jl JOIN firsts USING (stype, day, journal_id, sdesc) JOIN grp USING (stype, day, k)),
 merged AS (SELECT stype, day, seq, account_code, dc, s AS t1, SUM(amount) AS amount, MIN((journal_id, jln)) AS first_at,
   arg_min(t6, (journal_id, jln)) AS t6 FROM placed GROUP BY 1, 2, 3, 4, 5, 6)"""


@query(
    "e20_consolidated_voucher_lines",
    FIRST + """ SELECT stype || strftime(day, '%y%m%d') || lpad(CAST(seq AS VARCHAR), 4, '0') AS voucher_no,
 ROW_NUMBER() OVER (PARTITION BY stype, day, seq ORDER BY first_at) AS journal_line_number, account_code, dc AS d_c_marker, t1, t6,
 CAST(amount AS DECIMAL(30,2)) AS transaction_amount FROM merged""",
)
def e20(spark, root):
    return V.build_vouchers(lines(spark, root), grouping="first_line").lines.select(
        "voucher_no", "journal_line_number", "account_code", "d_c_marker", "t1", "t6", "transaction_amount"
    )


@query(
    "f13_resumed_sequence",
    GROUPED + """ SELECT stype || strftime(day, '%y%m%d') || lpad(CAST(seq + prior AS VARCHAR), 4, '0') AS voucher_no
 FROM grp JOIN (SELECT stype, day, MAX(seq) AS prior FROM grp GROUP BY 1, 2) USING (stype, day)""",
)
def f13(spark, root):
    """A second batch of the same days goes on after the first one's numbers."""
    first = V.build_vouchers(lines(spark, root)).vouchers
    return V.build_vouchers(lines(spark, root), existing=first).vouchers.select("voucher_no")


@query(
    "i11_export_fields",
    f"""WITH {SRC} SELECT journal_id, jln AS line_no, stype || '' AS setting_type, concat_ws(',', 'S0' || p || '10', 'SYS', s, jln,
 substr(replace(reference, '.', ''), 1, 15), strftime(day, '%Y%m'), day, account_code, description, 'IDR',
 CAST(amount AS DECIMAL(20,2)), '1.000000', CAST(amount AS DECIMAL(20,2)), dc, '', '', '', s, 'N/A', t3, p, p, t6, p, t8, t9, t10, '',
 'POL.' || o_custkey, replace('PA.R.' || o_custkey, '.', ''), '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '', '',
 '', '', '', '', CAST(day + 30 AS VARCHAR), '', '', '', '') AS fields FROM jl""",
)
def i11(spark, root):
    df = built(spark, root).lines
    present = [c for c in FIELD_POSITIONS if c in df.columns]
    return df.select(
        "journal_id", F.col("journal_line_number").alias("line_no"), "setting_type",
        F.array_join(fifty_seven_fields(F.struct(*present), present), ",").alias("fields"),
    )


@query(
    "l09_voucher_export_rows",
    GROUPED + """, v AS (SELECT stype, day, jt, s, t3, p, seq, voucher_no, sdesc, jln, account_code, dc, t6, t8, t9, t10, SUM(amount) AS amount
   FROM own JOIN hdr USING (stype, sdesc, day, jt, s, t3, p, seq) WHERE seq = first_seq GROUP BY ALL)
 SELECT voucher_no, concat_ws(',', jt, 'SYS', s, jln, voucher_no, strftime(day, '%Y%m'), day, account_code,
  substr(sdesc || ' ' || day || '/' || lpad(CAST(seq AS VARCHAR), 4, '0'), 1, 50), 'IDR', CAST(amount AS DECIMAL(30,2)), '1.000000', CAST(amount AS DECIMAL(30,2)),
  dc, '', '', '', s, 'N/A', t3, p, p, t6, p, t8, t9, t10) || repeat(',', 30) AS line FROM v""",
)
def l09_rows(spark, root):
    """Settings to journals to vouchers to the 57 fields of the export."""
    out = V.build_vouchers(lines(spark, root))
    heads = out.vouchers.withColumn("exported", F.lit(False))
    rows = export_rows(heads, out.lines, date(1990, 1, 1), date(2010, 12, 31))
    return rows.select("voucher_no", F.concat_ws(",", *[f"field_{i:02d}" for i in range(57)]).alias("line"))
