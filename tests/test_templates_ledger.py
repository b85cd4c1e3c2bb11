import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas as K
from ledgerloom.functions.expressions import compile_expression
from ledgerloom.operators import ledger
from ledgerloom.plans.posting import UnbalancedError, post_month, refresh_reports, trial_balance_of
from ledgerloom.plans.templates import expand_transactions, load_catalogue, resolve_templates

FAR = date(9999, 12, 31)


def txn(spark, rows):
    """rows: id, type, product, channel, day, gross, tabarru, admin."""
    df = spark.createDataFrame(
        [(i, t, p, c, d, Decimal(g), Decimal(tb), Decimal(a)) for i, t, p, c, d, g, tb, a in rows],
        "source_rowid string, txn_type string, product_code string, channel string, bank_value_date date,"
        " gross_amount decimal(20,6), tabarru_amount decimal(20,6), admin_amount decimal(20,6)",
    )
    return K.conform(df, K.TXN_SOURCE)


@pytest.fixture(params=[2_000, 0], ids=["case", "tables"])
def case_rows(request):
    """Both ways of a catalogue: compiled, and kept as tables."""
    return request.param


def catalogue(spark, lines=(), conds=(), controls=(), matches=None, templates=None, case_rows=2_000):
    templates = templates or [("T", "1", "t", "P", "d", "JE", date(2020, 1, 1), FAR, "ACTIVE")]
    matches = matches or [(1, "T", "1", None, None, None, None, None, 100)]
    return load_catalogue(
        spark.createDataFrame(templates, K.TEMPLATE), spark.createDataFrame(matches, K.TEMPLATE_MATCH),
        spark.createDataFrame(list(lines), K.TEMPLATE_LINE), spark.createDataFrame(list(conds), K.TEMPLATE_COND),
        spark.createDataFrame(list(controls), K.TEMPLATE_CONTROL),
        case_rows=case_rows,
    )


def test_routing_prefers_priority_then_specific_then_id(spark, case_rows):
    day = date(2024, 1, 15)
    t = [(c, "1", "t", "P", "d", "JE", a, b, s) for c, a, b, s in [
        ("WILD", date(2020, 1, 1), FAR, "ACTIVE"), ("SPEC", date(2020, 1, 1), FAR, "ACTIVE"), ("CHAN", date(2020, 1, 1), FAR, "ACTIVE"),
        ("OLD", date(2020, 1, 1), day, "ACTIVE"), ("DRAFT", date(2020, 1, 1), FAR, "DRAFT"), ("BIG", date(2020, 1, 1), FAR, "ACTIVE")]]
    m = [(1, "WILD", "1", None, None, None, None, None, 100), (2, "SPEC", "1", "A", None, None, None, None, 100),
         (3, "CHAN", "1", "A", "X", None, None, None, 100), (4, "OLD", "1", None, None, None, None, None, 1),
         (5, "DRAFT", "1", None, None, None, None, None, 0), (6, "BIG", "1", None, None, Decimal(1000), Decimal(5000), ":tabarru_amount > 1", 50)]
    cat = catalogue(spark, templates=t, matches=m, case_rows=case_rows)
    rows = [("1", "P", "B", "Y", day, "10", "0", "0"), ("2", "P", "A", "Y", day, "10", "0", "0"), ("3", "P", "A", "X", day, "10", "0", "0"),
            ("4", "P", "A", "X", day, "1000", "2", "0"), ("5", "P", "B", "X", day, "1000", "1", "0"), ("6", "Q", "B", "X", day, "1", "1", "0"),
            ("7", "P", "B", "Y", date(2024, 1, 14), "10", "0", "0")]
    got = {r.source_rowid: r.template_code for r in resolve_templates(txn(spark, rows), cat).collect()}
    assert got == {"1": "WILD", "2": "SPEC", "3": "CHAN", "4": "BIG", "5": "WILD", "6": None, "7": "OLD"}


def test_indexed_routing_equals_the_compiled_one(spark):
    """Random intervals of days and amounts, open ones, wildcards, ties and rows with NULLs."""
    draw = random.Random(3)
    t = [(f"T{k}", "1", "t", draw.choice("PQ"), "d", "JE", date(2023, draw.randint(1, 12), 1), draw.choice([FAR, date(2024, draw.randint(1, 12), 15)]), "ACTIVE") for k in range(12)]
    m = []
    for k in range(150):
        low, high = draw.choice([None, 0, 10, 99, 1000]), draw.choice([None, 10, 100, 1500, 10**6])
        money = [None if x is None else Decimal(x) for x in (low, high)]
        m.append((k, f"T{draw.randrange(12)}", "1", draw.choice([None, "A", "B"]), draw.choice([None, "X"]), *money, draw.choice([None, "", ":admin_amount > 5"]), draw.randint(1, 9)))
    rows = [(f"r{k}", draw.choice(["P", "Q", "Z", None]), draw.choice(["A", "B", None]), draw.choice(["X", "Y", None]),
             date(2023, 1, 1) + timedelta(days=draw.randrange(800)), str(draw.choice([-5, 0, 10, 99, 100, 1000, 1500, 10**7])), "0", str(draw.randint(0, 9))) for k in range(400)]
    frame = txn(spark, rows + rows[:20])
    got = [sorted((r.source_rowid, r.match_id, r.template_code) if r.match_id is not None else (r.source_rowid, -1, "") for r in
                  resolve_templates(frame, catalogue(spark, templates=t, matches=m, case_rows=n)).collect()) for n in (2_000, 0)]
    assert got[0] == got[1] and len({r[2] for r in got[0]}) > 5


LINES = [
    ("T", "1", 1, "DR", "1010", "OP", ":gross_amount", 2, True), ("T", "1", 2, "CR", "3010", "TBR", ":tabarru_amount", 2, True),
    ("T", "1", 3, "CR", "4010", "OP", ":admin_amount", 2, True), ("T", "1", 4, "CR", "9", "OP", ":gross_amount", 2, False),
]
ROWS = [("a", "P", "A", "X", date(2024, 1, 3), "100", "60", "40"), ("b", "P", "A", "X", date(2024, 2, 3), "100", "60", "30"),
        ("c", "P", "A", "X", date(2024, 2, 4), "50", "50", "0")]


def test_expansion_drops_zero_and_inactive_lines(spark, case_rows):
    out = expand_transactions(txn(spark, ROWS), catalogue(spark, LINES, case_rows=case_rows))
    got = sorted((r.je_number, r.line_no, r.side, r.amount) for r in out.lines.collect())
    assert [g[:2] for g in got] == [("JE-202401-a", 1), ("JE-202401-a", 2), ("JE-202401-a", 3), ("JE-202402-b", 1),
                                    ("JE-202402-b", 2), ("JE-202402-b", 3), ("JE-202402-c", 1), ("JE-202402-c", 2)]
    assert [(r.je_number, r.difference) for r in out.unbalanced.collect()] == [("JE-202402-b", Decimal("10"))]


def test_auto_adjust_balances_with_one_line(spark, case_rows):
    ctrl = [("T", "1", True, Decimal("0.01"), "AUTO_ADJUST", "8888", "OP")]
    out = expand_transactions(txn(spark, ROWS), catalogue(spark, LINES, controls=ctrl, case_rows=case_rows))
    extra = [(r.je_number, r.line_no, r.side, r.amount) for r in out.lines.where("account_code = '8888'").collect()]
    assert extra == [("JE-202402-b", 4 + 1, "CR", Decimal("10"))]
    assert out.unbalanced.isEmpty()
    assert ledger.entry_balance(out.lines).where("not balanced").isEmpty()


def test_conditional_lines_need_all_conditions(spark, case_rows):
    conds = [("T", "1", 3, "a", ":admin_amount > 5"), ("T", "1", 3, "b", ":gross_amount >= 100 and :tabarru_amount < 70")]
    out = expand_transactions(txn(spark, ROWS), catalogue(spark, LINES, conds, case_rows=case_rows))
    assert sorted(r.je_number for r in out.lines.where("line_no = 3").collect()) == ["JE-202401-a", "JE-202402-b"]


@pytest.mark.parametrize("text", ["", "x; y", "__import__('os')", "exec(:a)", ":a | :b", "concat(:a, :b)", "`a`"])
def test_expressions_outside_the_whitelist_are_refused(text):
    with pytest.raises(ValueError):
        compile_expression(text, ["a", "b"])


def test_unknown_column_is_refused():
    with pytest.raises(KeyError):
        compile_expression(":nope + 1", ["a"])


def test_roll_forward_over_two_months(spark):
    move = spark.createDataFrame(
        [(date(2024, 1, 1), "A", "F", Decimal(10), Decimal(4)), (date(2024, 2, 1), "A", "F", Decimal(1), Decimal(9))],
        "period_start date, account_code string, fund string, debit decimal(38,6), credit decimal(38,6)",
    )
    prior = spark.createDataFrame([("A", "F", Decimal(100))], "account_code string, fund string, closing_balance decimal(38,6)")
    got = [(r.opening_balance, r.closing_balance) for r in ledger.roll_forward(move, prior).orderBy("period_start").collect()]
    assert got == [(Decimal(100), Decimal(106)), (Decimal(106), Decimal(98))]


def test_post_month_is_idempotent_and_balanced(spark, tmp_path):
    cat = catalogue(spark, LINES)
    good = txn(spark, [ROWS[0], ROWS[2]])
    target = str(tmp_path / "ledger")
    for _ in range(2):
        out = post_month(good, cat, target, run_id="r")
    assert spark.read.parquet(f"{target}/ledger_lines").count() == 5
    total = trial_balance_of(spark, target).agg(F.sum("net")).first()[0]
    assert total == 0
    # Accounts without movement in the second month carry over.
    accounts = out.balances.select("account_code", "fund").distinct().count()
    assert out.balances.where("period_start = date'2024-02-01'").count() == accounts
    months = sorted(p.name for p in (tmp_path / "ledger" / "ledger_lines").glob("run_id=r/je_month=*"))
    assert months == ["je_month=2024-01-01", "je_month=2024-02-01"]


def test_a_rerun_with_fewer_months_takes_its_balances_back(spark, tmp_path):
    cat = catalogue(spark, LINES)
    target = str(tmp_path / "ledger")
    march = ("d", "P", "A", "X", date(2024, 3, 4), "50", "50", "0")
    post_month(txn(spark, [ROWS[2]]), cat, target, run_id="other")
    post_month(txn(spark, [ROWS[0], march]), cat, target, run_id="r")
    for rows in ([march], []):
        got = post_month(txn(spark, rows), cat, target, run_id="r").balances
        want = post_month(txn(spark, [ROWS[2], *rows]), cat, str(tmp_path / f"only-{len(rows)}"), run_id="x").balances
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    alone = str(tmp_path / "alone")
    post_month(txn(spark, [ROWS[0]]), cat, alone, run_id="r")
    assert post_month(txn(spark, []), cat, alone, run_id="r").balances.isEmpty()


def test_runs_of_one_month_add_up(spark, tmp_path):
    cat = catalogue(spark, LINES)
    target = str(tmp_path / "ledger")
    post_month(txn(spark, [ROWS[0]]), cat, target, run_id="1")
    post_month(txn(spark, [ROWS[2]]), cat, target, run_id="2")
    once = post_month(txn(spark, [ROWS[0], ROWS[2]]), cat, str(tmp_path / "once"), run_id="x").balances
    again = post_month(txn(spark, [ROWS[0], ROWS[2]]), cat, target, run_id="2").balances  # the first is posted by run 1
    lines = spark.read.parquet(f"{target}/ledger_lines")
    assert lines.count() == spark.read.parquet(f"{tmp_path}/once/ledger_lines").count()
    assert sorted(again.collect()) == sorted(once.collect())


def test_roll_forward_keeps_idle_accounts(spark):
    move = spark.createDataFrame(
        [(date(2024, 1, 1), "A", "F", Decimal(5), Decimal(0)), (date(2024, 3, 1), "A", "F", Decimal(1), Decimal(0))],
        "period_start date, account_code string, fund string, debit decimal(38,6), credit decimal(38,6)",
    )
    prior = spark.createDataFrame(
        [("A", "F", Decimal(10)), ("B", "F", Decimal(99))], "account_code string, fund string, closing_balance decimal(38,6)"
    )
    got = {(r.account_code, r.period_start.month): int(r.closing_balance) for r in ledger.roll_forward(move, prior).collect()}
    assert got == {("A", 1): 15, ("A", 2): 15, ("A", 3): 16, ("B", 1): 99, ("B", 2): 99, ("B", 3): 99}


def test_post_month_refuses_unbalanced_entries(spark, tmp_path):
    with pytest.raises(UnbalancedError):
        post_month(txn(spark, ROWS), catalogue(spark, LINES), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_refresh_goes_on_after_a_failure(spark, tmp_path):
    bad = spark.range(1).select(F.raise_error(F.lit("boom")).alias("x"))
    log = {r.view_name: r for r in refresh_reports({"bad": bad, "good": spark.range(3)}, str(tmp_path)).collect()}
    assert "boom" in log["bad"].error and log["good"].row_count == 3 and log["good"].error is None
