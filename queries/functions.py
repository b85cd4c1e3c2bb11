"""Column functions applied to whole tables."""

from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import codes as C
from ledgerloom.functions import text as X
from ledgerloom.functions.expressions import compile_expression
from ledgerloom.sources import tables as S
from queries.registry import query
from queries.views import GL, TXN


def orders(spark, root):
    return S.table(spark, root, "orders")


@query(
    "i01_account_codes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, s AS setting, CASE WHEN upper(trim(s)) LIKE '%BANK%' OR upper(trim(s)) LIKE '%KOMISI%'
 THEN CASE l_linenumber % 4 WHEN 0 THEN 'A' || l_suppkey WHEN 1 THEN 'B' || l_partkey END ELSE s END AS account_code
 FROM (SELECT *, CASE l_suppkey % 3 WHEN 0 THEN ' bank jkt' WHEN 1 THEN 'Komisi' ELSE '21-' || l_returnflag END AS s FROM lineitem)""",
)
def i01(spark, root):
    li = S.table(spark, root, "lineitem")
    k = F.col("l_suppkey") % 3
    setting = F.when(k == 0, " bank jkt").when(k == 1, "Komisi").otherwise(F.concat(F.lit("21-"), "l_returnflag"))
    lookup = F.array(F.concat(F.lit("A"), F.col("l_suppkey").cast("string")), F.concat(F.lit("B"), F.col("l_partkey").cast("string")))
    return li.withColumn("setting", setting).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "setting",
        C.account_code(F.col("setting"), lookup, (F.col("l_linenumber") % 4).cast("int")).alias("account_code"),
    )


@query(
    "i02_tcodes",
    """SELECT o_orderkey, CASE WHEN trim(COALESCE(st, el)) = '' THEN 'N/A' ELSE COALESCE(st, el) END AS first_code,
 CASE WHEN trim(COALESCE(st, e2)) = '' THEN 'N/A' ELSE COALESCE(st, e2) END AS idx_code FROM (SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN '  ' END AS st, CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN substr(o_orderpriority, 1, 1) END AS el,
  CASE o_custkey % 3 WHEN 1 THEN o_orderpriority END AS e2 FROM orders)""",
)
def i02(spark, root):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    setting = F.when(k == 0, F.col("o_orderstatus")).when(k == 1, "  ")
    first = F.when(c == 0, "").when(c == 1, F.substring("o_orderpriority", 1, 1))
    values = F.array(first, F.when(c == 1, F.col("o_orderpriority")))
    return orders(spark, root).select(
        "o_orderkey", C.tcode(setting, values).alias("first_code"), C.tcode(setting, values, F.lit(1)).alias("idx_code")
    )


@query(
    "i03_i07_amounts",
    """SELECT o_orderkey, a AS line_amount, CAST(round(a * 1.0725, 2) AS DECIMAL(20,2)) AS base_amount FROM (SELECT o_orderkey,
 CAST(CASE WHEN o_orderkey % 3 = 0 THEN 125.50 ELSE round(CAST(o_totalprice AS DECIMAL(20,6)) / 1 * CAST(0.375 AS DECIMAL(4,3)), 2) END AS DECIMAL(20,2)) AS a
 FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS o_totalprice FROM orders))""".replace("CAST(o_totalprice AS DECIMAL(20,6)) / 1 *", "o_totalprice *"),
)
def i03(spark, root):
    k = F.col("o_orderkey") % 3
    setting = F.when(k == 0, F.lit("125.50")).when(k == 1, F.lit("0")).cast("decimal(20,2)")
    amounts = F.array(F.lit(0).cast("decimal(24,5)"), (S.money("o_totalprice") * F.lit("0.375").cast("decimal(4,3)")).cast("decimal(24,5)"))
    line = A.line_amount(setting, amounts, F.lit(1))
    return orders(spark, root).select("o_orderkey", line.alias("line_amount")).withColumn(
        "base_amount", A.base_amount(F.col("line_amount"), F.lit("1.0725").cast("decimal(20,6)"))
    )


@query(
    "i04_i06_clean_text",
    """SELECT doc_id, substr(replace(text, '.', ''), 1, 15) AS reference, regexp_replace(substr(text, 1, 50), '[\\x00\\n\\r]+', ' ', 'g') AS description,
 substr(replace(text, '.', ''), 1, 30) AS participant FROM documents""",
)
def i04(spark, root):
    t = F.col("text")
    return S.table(spark, root, "documents").select(
        "doc_id", X.clean_reference(t).alias("reference"), X.clean_description(t).alias("description"),
        X.clean_participant(t).alias("participant"),
    )


@query(
    "i08_i10_numbers",
    """SELECT o_orderkey, TRY_CAST(substr(t, 2, 1) AS INTEGER) % 2 = 1 AS reversal, t || strftime(o_orderdate, '%y%m%d') || lpad(CAST(o_orderkey % 9999 + 1 AS VARCHAR), 4, '0') AS voucher_no,
 substr(o_orderpriority || ' ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '/' || lpad(CAST(o_orderkey % 9999 + 1 AS VARCHAR), 4, '0'), 1, 50) AS description,
 'JE-' || strftime(o_orderdate, '%Y%m') || '-' || o_orderkey AS je_number, 'JE-PREM-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS batch_number
 FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'S0110' WHEN 1 THEN 'S1110' ELSE 'SX110' END AS t FROM orders)""",
)
def i08(spark, root):
    k, day, seq = F.col("o_orderkey") % 3, F.to_date("o_orderdate"), F.col("o_orderkey") % 9999 + 1
    kind = F.when(k == 0, "S0110").when(k == 1, "S1110").otherwise("SX110")
    return orders(spark, root).select(
        "o_orderkey", C.is_reversal(kind).alias("reversal"), C.voucher_number(kind, day, seq).alias("voucher_no"),
        C.voucher_description(F.col("o_orderpriority"), day, seq).alias("description"),
        C.je_number(day, F.col("o_orderkey").cast("string")).alias("je_number"),
        C.batch_je_number(F.lit("PREMIUM_RECEIPT"), day, F.col("o_orderkey")).alias("batch_number"),
    )


@query(
    "i12_expressions",
    f"""WITH {TXN} SELECT source_rowid, CAST(abs(tabarru_amount - gross_amount) AS DECIMAL(24,6)) AS a,
 CAST(greatest(tabarru_amount, invest_amount) + least(admin_amount, 1000) AS DECIMAL(24,6)) AS b,
 CAST(round((gross_amount + admin_amount) * 2, 0) AS DECIMAL(24,6)) AS c, gross_amount > 200000 AND NOT (tabarru_amount <= 1000) OR channel = 'AGENCY' AS d FROM txn""",
)
def i12(spark, root):
    txn = S.txn_source(spark, root)

    def amount(text):
        return compile_expression(text, txn.columns).cast("decimal(24,6)")

    return txn.select(
        "source_rowid", amount("abs(:tabarru_amount - :gross_amount)").alias("a"),
        amount("max(:tabarru_amount, :invest_amount) + min(:admin_amount, 1000)").alias("b"),
        amount("round((:gross_amount + :admin_amount) * 2, 0)").alias("c"),
        compile_expression(":gross_amount > 200000 and not (:tabarru_amount <= 1000) or :channel = 'AGENCY'", txn.columns).alias("d"),
    )


@query(
    "i13_i14_json_arrays",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id || '|' || event_type AS joined, 2 AS n_items,
 '{"k":' || CAST(json_extract_string(props, '$.k') AS INTEGER) || ',"status":"NEW"}' AS updated FROM events""",
)
def i13(spark, root):
    e = S.table(spark, root, "events").withColumn("d", F.from_json("props", "k int"))
    items = F.array(F.col("user_id").cast("string"), F.col("event_type"))
    return e.select(
        "event_id", F.col("d.k").alias("k"), F.array_join(items, "|").alias("joined"),
        F.json_array_length(F.to_json(items)).alias("n_items"),
        F.to_json(F.col("d").withField("status", F.lit("NEW"))).alias("updated"),
    )


@query(
    "i15_i18_scalars",
    """SELECT o_orderkey, upper(trim(' ' || o_orderpriority || ' ')) AS u, o_orderpriority LIKE '%-HIGH' AS is_high, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS padded,
 CAST(date_trunc('month', o_orderdate) AS DATE) AS month, year(o_orderdate) AS y, strftime(o_orderdate, '%Y/%m') AS ym, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month,
 o_orderkey % 7 AS m, abs(o_custkey - 500) AS a, greatest(o_orderkey, o_custkey) AS g, COALESCE(CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END, 'none') AS filled,
 CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END || '-x' AS nulled FROM orders""",
)
def i15(spark, root):
    day, only = F.to_date("o_orderdate"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus"))
    return orders(spark, root).select(
        "o_orderkey", F.upper(F.trim(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))).alias("u"),
        F.col("o_orderpriority").like("%-HIGH").alias("is_high"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("padded"),
        F.trunc(day, "MM").cast("date").alias("month"), F.year(day).cast("bigint").alias("y"), F.date_format(day, "yyyy/MM").alias("ym"),
        F.add_months(day, 1).alias("next_month"), (F.col("o_orderkey") % 7).alias("m"), F.abs(F.col("o_custkey") - 500).alias("a"),
        F.greatest("o_orderkey", "o_custkey").alias("g"), F.coalesce(only, F.lit("none")).alias("filled"),
        F.concat(only, F.lit("-x")).alias("nulled"),
    )


@query(
    "i19_i24_digests",
    """SELECT o_orderkey, md5('T|"' || o_orderstatus || '"|"' || o_orderpriority || '"') AS group_key,
 sha256(o_orderkey || chr(1) || o_orderstatus) AS stable_id FROM orders""",
)
def i19(spark, root):
    return orders(spark, root).select(
        "o_orderkey", C.group_digest(F.lit("T"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("group_key"),
        C.stable_key(F.col("o_orderkey"), F.col("o_orderstatus")).alias("stable_id"),
    )


@query(
    "i20_account_pairs",
    f"""WITH {GL} SELECT COALESCE(acc_debit, '') || '_' || COALESCE(acc_credit, '') AS account_pair, COUNT(*) AS n,
 CAST(round(SUM(amount) * CAST(0.000001 AS DECIMAL(6,6)), 2) AS DECIMAL(24,2)) AS amount_millions FROM gl GROUP BY 1""",
)
def i20(spark, root):
    blank = F.lit("")
    pair = F.concat_ws("_", F.coalesce("acc_debit", blank), F.coalesce("acc_credit", blank))
    return S.gl_entries(spark, root).groupBy(pair.alias("account_pair")).agg(
        F.count(F.lit(1)).alias("n"), A.in_millions(F.sum("amount")).alias("amount_millions")
    )


@query(
    "i22_money",
    """SELECT o_orderkey, CASE WHEN ca = cb THEN CAST(a + b AS DECIMAL(20,2)) END AS total, CASE WHEN ca = cb AND a >= b THEN CAST(a - b AS DECIMAL(20,2)) END AS rest FROM
 (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS a, CAST(200000 AS DECIMAL(20,2)) AS b, 'IDR' AS ca, CASE WHEN o_orderstatus = 'P' THEN 'USD' ELSE 'IDR' END AS cb FROM orders)""",
)
def i22(spark, root):
    a, b = S.money("o_totalprice"), F.lit(200000).cast(S.MONEY)
    ca, cb = F.lit("IDR"), F.when(F.col("o_orderstatus") == "P", "USD").otherwise("IDR")
    return orders(spark, root).select(
        "o_orderkey", A.same_currency_sum(a, ca, b, cb).alias("total"), A.same_currency_difference(a, ca, b, cb).alias("rest")
    )


@query(
    "i23_account_format",
    """SELECT c_custkey, CASE WHEN trim(n) <> '' THEN upper(trim(n)) END AS account, regexp_matches(d, '^[0-9]{10}$') AS ten_digits FROM
 (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE ' ' || lower(c_name) END AS n, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') ELSE CAST(c_custkey AS VARCHAR) END AS d FROM customer)""",
)
def i23(spark, root):
    raw = F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("c_name")))
    text = F.col("c_custkey").cast("string")
    code = F.when(F.col("c_custkey") % 2 == 0, F.lpad(text, 10, "0")).otherwise(text)
    return S.table(spark, root, "customer").select(
        "c_custkey", C.normalised_account(raw).alias("account"), C.is_ten_digit_account(code).alias("ten_digits")
    )


@query(
    "i25_gains",
    """SELECT s_suppkey, CASE WHEN b > 0 THEN CAST(round(CAST((b - a) * 100 AS DOUBLE) / b, 2) AS DECIMAL(20,2)) ELSE 0 END AS improvement,
 CASE WHEN a > 0 THEN CAST(round(CAST(b AS DOUBLE) / a, 2) AS DECIMAL(20,2)) ELSE 0 END AS speedup FROM
 (SELECT s_suppkey, CAST(s_suppkey % 16 * 100 AS DECIMAL(20,2)) AS b, CAST(s_suppkey % 8 * 50 AS DECIMAL(20,2)) AS a FROM supplier)""",
)
def i25(spark, root):
    b = (F.col("s_suppkey") % 16 * 100).cast(S.MONEY)
    a = (F.col("s_suppkey") % 8 * 50).cast(S.MONEY)
    return S.table(spark, root, "supplier").select(
        "s_suppkey", A.improvement_percent(b, a).alias("improvement"), A.speed_up(b, a).alias("speedup")
    )


@query(
    "c10_masked_fields",
    """SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '****' ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS account_number,
 'acct=' || CASE WHEN length(c_name) <= 4 THEN '****' ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END || ';segment=' || c_mktsegment AS log_text FROM customer""",
)
def c10(spark, root):
    values = F.create_map(
        F.lit("account_number"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("email"), F.lit("x@y")
    )
    safe = X.without_keys(X.masked_values(values, X.SENSITIVE_FIELDS), X.PII_FIELDS)
    return S.table(spark, root, "customer").select("c_custkey", X.masked(F.col("c_name")).alias("account_number"), safe.alias("safe")).select(
        "c_custkey", "account_number",
        F.concat(F.lit("acct="), F.col("safe")["account_number"], F.lit(";segment="), F.col("safe")["segment"]).alias("log_text"),
    )


@query("c11_side_flip", "SELECT l_orderkey, l_partkey, l_extendedprice, CASE WHEN l_linenumber % 2 = 1 THEN 'C' ELSE 'D' END AS flipped FROM lineitem")
def c11(spark, root):
    dc = F.when(F.col("l_linenumber") % 2 == 1, "D").otherwise("C")
    return S.table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", C.opposite_side(dc).alias("flipped"))
