"""The SQL functions of the session over whole tables."""

from pyspark.sql import functions as F

from ledgerloom.functions.catalogue import register
from ledgerloom.sources import tables as S
from queries import functions  # noqa: F401  (the column builders' SQL, which these are held to)
from queries.registry import ORACLES, query
from queries.views import GL, JOURNALS


def views(spark, root):
    """Each order is a setting whose lines are its line items, and a posted journal with the same lines."""
    li = S.table(spark, root, "lineitem")
    # A line number stands once in a setting: the first of the given lines with it.
    first = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(first).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    row = F.struct(
        F.col("l_linenumber").cast("int").alias("journal_line_number"), F.col("l_suppkey").cast("int").alias("process_line_number"),
        F.concat(F.lit("21-"), "l_partkey").alias("account_code"), F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("D").alias("d_c_marker"),
        (F.col("l_linenumber") - 1).cast("int").alias("data_idx"), F.lit(1).alias("account_flag"), F.col("l_returnflag").alias("t1_code"), F.col("l_linestatus").alias("t10_code"),
    )
    kind = F.concat(F.lit("S"), (F.col("l_orderkey") % 2).cast("string"), F.lit("-"), F.col("l_orderkey").cast("string"))
    lines.groupBy(kind.alias("journal_type")).agg(F.to_json(F.struct(F.collect_list(row).alias("row"))).alias("journal_set")).createOrReplaceTempView("rule_settings")
    given = {3: F.col("l_linenumber").cast("string"), 7: F.concat(F.lit("A"), "l_partkey"), 10: F.col("l_extendedprice").cast("decimal(20,2)").cast("string"),
             13: F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("D"), 17: F.col("l_returnflag"), 26: F.col("l_linestatus")}
    fields = F.array(*[given.get(i, F.lit("")) for i in range(57)])
    lines.select(F.col("l_orderkey").cast("string").alias("journal_id"), kind.alias("journal_type"), fields.alias("fields")).createOrReplaceTempView("rule_posted")
    j = S.journals(spark, root)
    j.createOrReplaceTempView("rule_journals")
    j.where("voucher_id IS NOT NULL" if "voucher_id" in j.columns else "true").createOrReplaceTempView("rule_vouchers")
    S.gl_entries(spark, root).createOrReplaceTempView("rule_ledger")
    register(spark, "rule_settings", "rule_posted", "rule_journals", "rule_vouchers", "rule_ledger")


@query("i01_sql_account_codes", ORACLES["i01_account_codes"])
def i01_sql(spark, root):
    register(spark)
    S.table(spark, root, "lineitem").createOrReplaceTempView("rule_lines")
    return spark.sql(
        """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, s AS setting,
 account_code(s, array('A' || l_suppkey, 'B' || l_partkey), cast(l_linenumber % 4 AS INT)) AS account_code
 FROM (SELECT *, CASE l_suppkey % 3 WHEN 0 THEN ' bank jkt' WHEN 1 THEN 'Komisi' ELSE '21-' || l_returnflag END AS s FROM rule_lines)"""
    )


@query("i02_sql_tcodes", ORACLES["i02_tcodes"])
def i02_sql(spark, root):
    register(spark)
    S.table(spark, root, "orders").createOrReplaceTempView("rule_orders")
    return spark.sql(
        """SELECT o_orderkey, tcode(s, v) AS first_code, tcode(s, v, 1) AS idx_code FROM (SELECT o_orderkey,
 CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN '  ' END AS s,
 array(CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN substring(o_orderpriority, 1, 1) END, CASE o_custkey % 3 WHEN 1 THEN o_orderpriority END) AS v FROM rule_orders)"""
    )


FIRST = "x AS (SELECT l_orderkey, l_linenumber, unnest(min(row(l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus))) FROM lineitem GROUP BY 1, 2), f(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS (SELECT * FROM x)"
DC = "CASE WHEN l_linenumber % 2 = 0 THEN {} ELSE {} END"


@query(
    "d02_sql_setting_lines",
    f"""WITH {FIRST} SELECT 'S' || l_orderkey % 2 || '-' || l_orderkey AS journal_type, CAST(l_linenumber AS INTEGER) AS line_no, CAST(l_suppkey AS INTEGER) AS process_no,
 '21-' || l_partkey AS account_code, {DC.format("'C'", "'D'")} AS dc, l_returnflag AS t1, CAST(NULL AS VARCHAR) AS t2, l_linestatus AS t10 FROM f""",
)
def d02_sql(spark, root):
    """The lines of every setting by a lateral call."""
    views(spark, root)
    return spark.sql(
        """SELECT t.journal_type, s.journal_line_number AS line_no, s.process_line_number AS process_no, s.account_code, s.d_c_marker AS dc,
 s.t1_code AS t1, s.t2_code AS t2, s.t10_code AS t10 FROM rule_settings t, LATERAL setting_lines(t.journal_type) s"""
    )


@query(
    "d04_sql_reversal_lines",
    f"""WITH {FIRST}, m AS (SELECT max(l_orderkey) FILTER (WHERE l_orderkey % 2 = 1) AS k FROM lineitem)
 SELECT CAST(l_linenumber AS INTEGER) AS line_no, CAST(l_suppkey AS INTEGER) AS process_no, 'A' || l_partkey AS account_code, {DC.format("'D'", "'C'")} AS dc,
 CAST(l_linenumber - 1 AS INTEGER) AS data_idx, CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, l_linestatus AS t10 FROM f JOIN m ON l_orderkey = k""",
)
def d04_sql(spark, root):
    """The reversal of the latest journal of a reversal type."""
    views(spark, root)
    last = spark.table("rule_posted").where("substring(journal_type, 2, 1) = '1'").agg(F.max_by(F.struct("journal_type", "journal_id"), F.col("journal_id").cast("long"))).first()[0]
    return spark.sql(
        """SELECT journal_line_number AS line_no, process_line_number AS process_no, account_code, d_c_marker AS dc, data_idx,
 transaction_amount AS amount, t10_code AS t10 FROM reversal_lines(:of_type, :of_journal)""",
        {"of_type": last["journal_type"], "of_journal": last["journal_id"]},
    )


@query(
    "e22_sql_processing_metrics",
    f"""WITH {JOURNALS}, {GL}, j AS (SELECT journal_date, count(*) AS n FROM journals GROUP BY 1)
 SELECT journal_date, 'total_journals' AS metric_name, CAST(n AS DECIMAL(24,6)) AS metric_value FROM j
 UNION ALL SELECT journal_date, 'total_gl_entries', CAST((SELECT count(*) FROM gl WHERE trx_date = journal_date) AS DECIMAL(24,6)) FROM j""",
)
def e22_sql(spark, root):
    """Two metrics of every journal day by a lateral call."""
    views(spark, root)
    return spark.sql(
        """SELECT d.journal_date, m.metric_name, m.metric_value FROM (SELECT DISTINCT journal_date FROM rule_journals) d,
 LATERAL processing_metrics(d.journal_date) m WHERE m.metric_name IN ('total_journals', 'total_gl_entries')"""
    )
