"""Hand-made frames for the journal rules."""

from datetime import date
from decimal import Decimal
from itertools import product

from pyspark.sql import functions as F

from ledgerloom.operators import flags
from ledgerloom.plans import journals as J
from ledgerloom.schemas import DATASOURCE_ROW, JOURNAL_SETTING, conform
from ledgerloom.sources.datasource_rows import _line

DAY = date(2024, 7, 18)


def source(spark, **over):
    row = dict(
        id="T1", journal_type="S0110", journal_source="SYS", journal_number="N1", journal_line_number="1",
        transaction_reference="AB.C.1234567890123456", accounting_period="202407", transaction_date="2024-07-18",
        account_code=["1100", "2200", "3300"], description="first\n\r\nsecond", currency_code="IDR",
        transaction_amount=[Decimal("100.005"), Decimal("40"), Decimal("0"), Decimal("7")], currency_rate=Decimal("2"),
        base_amount="", d_c_marker="", asset_indicator="", asset_code="", asset_sub_code="",
        general_description_1="", general_description_2="P", general_description_3="A.B", general_description_4="",
        general_description_5="", general_description_6="", due_date="2024-08-01", ds=1, journal_date=DAY,
        **{f"t{i}": [f"x{i}", f"y{i}", f"z{i}", f"w{i}"] for i in range(1, 11)},
    )
    row.update(over)
    schema = DATASOURCE_ROW + ", ds int, journal_date date"
    names = [f.split()[0] for f in schema.replace("array<", "").split(", ")]
    from pyspark.sql import types as T

    fields = T.DataType.fromDDL(schema).fields
    assert len(names) == len(fields)
    return spark.createDataFrame([tuple(row[f.name] for f in fields)], T.StructType(fields))


def settings(spark, lines, kind="S0110", status=1, status2=0, start=None, end=None):
    return spark.createDataFrame([(kind, "Demo", status, status2, (1, start, end, lines))], JOURNAL_SETTING)


def built_lines(spark, lines, **over):
    out = J.build_journals(settings(spark, lines), source(spark, **over))
    return out, [r.asDict() for r in out.lines.orderBy("journal_line_number").collect()]


def test_setting_activity_modes(spark):
    bounds = [(None, None), (date(2024, 1, 1), None), (None, date(2024, 1, 1)),
              (date(2024, 1, 1), date(2024, 12, 31)), (date(2023, 1, 1), date(2023, 12, 31))]
    rows = [(f"S0{i}{s2}", "d", 1, s2, (1, a, b, [])) for i, (a, b) in enumerate(bounds) for s2 in (0, 1)]
    df = spark.createDataFrame(rows, JOURNAL_SETTING)

    def active(mode):
        return {r.journal_type for r in J.active_settings(df, DAY, mode).collect()}

    assert active("either") == {"S000", "S001", "S010", "S011", "S020", "S021", "S030", "S031", "S041"}
    assert active("strict") == {"S000", "S001", "S021", "S030", "S031", "S041"}
    assert active("domain") == {"S000", "S001", "S021", "S030", "S031"}


def test_line_values(spark):
    _, (line,) = built_lines(spark, [_line(1, 1, " bank ", "D", 1, 1, t1="", t2=None)])
    assert line["account_code"] == "2200"
    assert line["transaction_amount"] == Decimal("40.00") and line["base_amount"] == Decimal("80.00")
    assert (line["t1"], line["t2"], line["t7"]) == ("N/A", "x2", "x7")
    # The last three codes follow the line's own index.
    assert (line["t8"], line["t10"]) == ("y8", "y10")
    assert line["transaction_reference"] == "ABC123456789012"
    assert line["description"] == "first second" and line["general_description_3"] == "AB"


def test_amount_is_rounded_and_configured_amount_wins(spark):
    _, lines = built_lines(
        spark, [_line(1, 1, "1", "D", 0, 1), _line(2, 2, "2", "C", 0, 1, Decimal("12.50")), _line(3, 3, "3", "C", 2, 1)]
    )
    assert [x["transaction_amount"] for x in lines] == [Decimal("100.01"), Decimal("12.50")]


def test_null_field_drops_line_but_keeps_gl(spark):
    out, lines = built_lines(spark, [_line(1, 1, "KLAIM", "D", 3, 1), _line(2, 2, "9", "C", 1, 1)])
    assert [x["journal_line_number"] for x in lines] == [2]
    assert [r.journal_line_number for r in out.dropped_lines.collect()] == [1]
    assert out.gl.count() == 2


def test_later_line_overwrites_same_number(spark):
    _, lines = built_lines(spark, [_line(1, 2, "late", "D", 0, 1), _line(1, 1, "early", "D", 1, 1), _line(2, 3, "gone", "C", 2, 1)])
    assert [(x["journal_line_number"], x["account_code"]) for x in lines] == [(1, "late")]


def test_later_zero_line_does_not_overwrite(spark):
    _, lines = built_lines(spark, [_line(1, 1, "early", "D", 1, 1), _line(1, 2, "late", "D", 2, 1)])
    assert [(x["journal_line_number"], x["account_code"]) for x in lines] == [(1, "early")]


def test_days_before_the_first_journal_day_build_nothing(spark):
    out, lines = built_lines(spark, [_line(1, 1, "1", "D", 0, 1)], journal_date=date(2019, 4, 30))
    assert not lines and out.journals.count() == 0


def test_reversal_flips_the_original(spark):
    conf = settings(spark, [_line(1, 1, "x", "D", 0, 3), _line(2, 2, "y", "C", 0, 2)], kind="S1110")
    lines = spark.createDataFrame(
        [("T1", [(1, "1100", "D", Decimal("5.00"), *["a"] * 10), (2, "2200", "C", Decimal("5.00"), *["b"] * 10)])],
        "id string, lines array<struct<journal_line_number:int,account_code:string,d_c_marker:string,"
        "transaction_amount:decimal(20,2)," + ",".join(f"t{i}:string" for i in range(1, 11)) + ">>",
    )
    out = J.build_journals(conf, source(spark), originals=lines)
    got = [(r.journal_line_number, r.account_code, r.d_c_marker, r.transaction_amount, r.account_flag)
           for r in out.lines.orderBy("journal_line_number").collect()]
    assert got == [(1, "1100", "C", Decimal("5.00"), 3), (2, "2200", "D", Decimal("5.00"), 2)]


def fold(lines):
    """The machine one line at a time."""
    d, c, x, out = "", "", Decimal(0), []
    for no, side, account, amount, flag in lines:
        if amount <= 0:
            continue
        d, c = (account, c) if side == "D" else (d, account)
        if flag == 1:
            x = amount
            out.append((no, d, c, x))
        elif flag == 2:
            x = amount
        elif flag == 3:
            out.append((no, d, c, x))
        elif flag == 4:
            out.append((no, d, c, x))
            x = amount - x
    return out


def flag_sequences():
    rows, want = [], []
    jid = 0
    for size in (1, 2, 3, 4):
        for seq in product(range(5), repeat=size):
            lines = []
            for i, flag in enumerate(seq):
                amount = Decimal(str((i * 7 + flag * 3 + jid) % 11))
                lines.append((i + 1, "D" if (i + jid) % 2 else "C", f"a{i}{flag}", amount.quantize(Decimal("0.01")), flag))
            rows += [(jid, no, dc, acc, amt, fl) for no, dc, acc, amt, fl in lines]
            want += [(jid, *r) for r in fold(lines)]
            jid += 1
    return rows, sorted(want)


def test_flag_machine_matches_a_sequential_fold(spark):
    rows, want = flag_sequences()
    df = spark.createDataFrame(
        rows, "journal_id int, line_no int, dc string, account_code string, amount decimal(20,2), account_flag int"
    )
    for limit in (1_000_000, 2, 0):
        got = flags.flagged_gl_rows(df, ["journal_id"], ["line_no"], limit=limit)
        assert sorted(tuple(r) for r in got.collect()) == want, limit


def test_journal_gl_matches_a_sequential_fold(spark):
    conf = [_line(i + 1, i + 1, f"a{i}", "D" if i % 2 else "C", 0, f, Decimal(a)) for i, (f, a) in
            enumerate([(3, "5"), (2, "100"), (4, "70"), (4, "10"), (0, "1"), (3, "2"), (1, "9"), (4, "4")])]
    out = J.build_journals(settings(spark, conf), source(spark))
    got = [(r.journal_line_number, r.acc_debit, r.acc_credit, r.amount) for r in out.gl.orderBy("journal_line_number").collect()]
    want = fold([(c[0], c[3], c[2], c[6], c[5]) for c in conf])
    assert got == [(n, d, c, a.quantize(Decimal("0.01"))) for n, d, c, a in want]


def test_one_sided_rows(spark):
    df = spark.createDataFrame(
        [(1, 1, "D", "a", Decimal("5"), 1), (1, 2, "C", "b", Decimal("5"), 2), (1, 3, "C", "c", Decimal("5"), 3)],
        "journal_id int, line_no int, dc string, account_code string, amount decimal(20,2), account_flag int",
    )
    got = [tuple(r) for r in flags.one_sided_gl_rows(df, ["journal_id"]).orderBy("line_no").collect()]
    assert got == [(1, 1, "a", None, Decimal("5.00")), (1, 3, None, "c", Decimal("5.00"))]


def test_rerun_gives_the_same_keys(spark):
    conf = [_line(1, 1, "1", "D", 0, 1)]
    ids = [J.build_journals(settings(spark, conf), source(spark)).journals.first().id for _ in range(2)]
    assert ids[0] == ids[1]


def test_contract_fills_missing_columns(spark):
    df = conform(spark.createDataFrame([("1",)], "id string"), DATASOURCE_ROW)
    row = df.select("id", "due_date", F.size("t1").alias("n")).first()
    assert row.id == "1" and row.due_date is None
