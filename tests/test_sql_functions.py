import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import codes as C
from ledgerloom.functions import text as X
from ledgerloom.functions.catalogue import register
from ledgerloom.sources.routing import source_name


def test_scalars_equal_the_column_builders(spark):
    register(spark)
    rows = [
        (None, ["a", ""], 0, "S1110", 11, "2.005"), (" ", None, 1, "S0110", 81, None), ("x", [], 5, "SX", 500, "0"),
        ("Premi 1", ["p", "q"], 1, "", None, "1234.565"), (None, None, None, None, 91, "-1"), (" fee", ["z"], 3, "S", 191, "0.005"),
    ]
    df = spark.createDataFrame(rows, "s string, v array<string>, i int, k string, ds int, m string")
    df = df.withColumns({"day": F.lit("2024-02-29").cast("date"), "n": F.col("i").cast("bigint"), "m": F.col("m").cast("decimal(20,2)")})
    df = df.withColumn("w", F.array(F.col("m").cast("decimal(24,5)"), F.lit("7.125").cast("decimal(24,5)")))
    s, v, i = F.col("s"), F.col("v"), F.col("i")
    pairs = {
        "tcode(s, v)": C.tcode(s, v), "tcode(s, v, i)": C.tcode(s, v, i), "account_code(s, v, i)": C.account_code(s, v, i),
        "normalised_account(s)": C.normalised_account(s), "opposite_side(s)": C.opposite_side(s), "is_reversal(k)": C.is_reversal(F.col("k")),
        "source_name(ds)": source_name(F.col("ds")), "voucher_number(k, day, n)": C.voucher_number(F.col("k"), F.col("day"), F.col("n")),
        "voucher_description(s, day, n)": C.voucher_description(s, F.col("day"), F.col("n")), "je_number(day, k)": C.je_number(F.col("day"), F.col("k")),
        "location_or_default(k, s)": C.lookup_or_default(F.col("k"), s), "line_amount(m, w, i)": A.line_amount(F.col("m"), F.col("w"), i),
        "base_amount(m, cast(1.0725 as decimal(20,6)))": A.base_amount(F.col("m"), F.lit("1.0725").cast("decimal(20,6)")),
        "clean_reference(s)": X.clean_reference(s),
    }
    got = df.select(*[F.struct(F.expr(sql).alias("a"), col.alias("b")).alias(f"c{n}") for n, (sql, col) in enumerate(pairs.items())]).collect()
    for row in got:
        for sql, pair in zip(pairs, row):
            assert pair["a"] == pair["b"], sql


def test_setting_and_reversal_lines(spark):
    spark.sql(
        """SELECT * FROM VALUES ('S1', '{"row":[{"journal_line_number":1,"account_code":"BANK","d_c_marker":"D","account_flag":4},{"journal_line_number":2}]}'),
 ('S0', '{}'), ('S2', NULL) AS t(journal_type, journal_set)"""
    ).createOrReplaceTempView("sqlf_settings")
    fields = "transform(sequence(0, 56), i -> CASE i WHEN 3 THEN {n} WHEN 10 THEN '5.50' WHEN 13 THEN {dc} ELSE 'f' || i END)"
    spark.sql(f"SELECT 'j' AS journal_id, {fields.format(n=repr('1'), dc=repr('D'))} AS fields UNION ALL SELECT 'j', {fields.format(n=repr('9'), dc=repr('C'))}").createOrReplaceTempView("sqlf_posted")
    assert "processing_metrics" not in register(spark, "sqlf_settings", "sqlf_posted")
    assert [r.account_code for r in spark.sql("SELECT * FROM setting_lines('S1') ORDER BY journal_line_number").collect()] == ["BANK", None]
    assert spark.sql("SELECT * FROM setting_lines('S0')").count() == spark.sql("SELECT * FROM setting_lines('S2')").count() == spark.sql("SELECT * FROM setting_lines(NULL)").count() == 0
    back = spark.sql("SELECT * FROM reversal_lines('S1', 'j') ORDER BY 1").collect()
    assert [(r.journal_line_number, r.d_c_marker, r.data_idx, r.account_flag, str(r.transaction_amount), r.t10_code) for r in back] == [
        (1, "C", 0, 4, "5.50", "f26"), (9, "D", 8, None, "5.50", "f26")
    ]
    assert spark.sql("SELECT * FROM reversal_lines('S0', 'j')").count() == 0  # no reversal type
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM no_such_lines('S1')")
