"""Versions: what readers see while runs write, fail, meet and shrink."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import versions
from ledgerloom.plans.posting import post_month
from ledgerloom.plans.publication import publish_month
from test_templates_ledger import LINES, ROWS, catalogue, txn

MARCH = ("d", "P", "A", "X", date(2024, 3, 4), "50", "50", "0")


def rows(df):
    return sorted(df.select("period_start", "account_code", "fund", "opening_balance", "debit", "credit", "closing_balance").collect())


def test_published_balances_equal_posted_ones_over_reruns(spark, tmp_path):
    cat, target = catalogue(spark, LINES), str(tmp_path / "v")
    publish_month(txn(spark, [ROWS[2]]), cat, target, "other")
    for n, part in enumerate(([ROWS[0], MARCH], [MARCH], [], [ROWS[0], ROWS[2]])):
        got = publish_month(txn(spark, part), cat, target, "r").balances
        new = [r for r in part if r != ROWS[2]]  # entries of the other run stay with it
        want = post_month(txn(spark, [ROWS[2], *new]), cat, str(tmp_path / f"p{n}"), run_id="x").balances
        assert rows(got) == rows(want)


def test_readers_see_the_old_version_until_the_commit(spark, tmp_path, monkeypatch):
    cat, target = catalogue(spark, LINES), str(tmp_path / "v")
    before = publish_month(txn(spark, [ROWS[0]]), cat, target, "r")
    seen = rows(before.balances)

    def dies(*args):
        raise KeyboardInterrupt("killed before the commit")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            publish_month(txn(spark, [MARCH]), cat, target, "s")
    number, parts = versions.current(spark, target)
    assert number == 1 and list(parts["lines"]) == ["r"]
    schema = before.balances.schema
    assert rows(versions.read(spark, target, "balances", schema)) == seen
    assert publish_month(txn(spark, [MARCH]), cat, target, "s").balances.where(F.col("period_start") == date(2024, 3, 1)).count() > 0
    assert rows(versions.read(spark, target, "balances", schema, 1)) == seen


def test_of_two_writers_from_one_version_one_wins(spark, tmp_path):
    target = str(tmp_path / "v")
    frame = spark.range(3)
    assert versions.commit(spark, target, 0, {"t": {"a": versions.stage(frame, target, "t")}}) == 1
    with pytest.raises(versions.ConflictError):
        versions.commit(spark, target, 0, {"t": {"a": None}})
    (tmp_path / "v" / "versions" / f".claim-{2:012d}").write_text("")  # a writer between its claim and its manifest
    with pytest.raises(versions.ConflictError):
        versions.commit(spark, target, 1, {"t": {"a": None}})
    assert versions.commit(spark, target, 1, {"t": {"b": versions.stage(frame, target, "t")}}, patience=-1) == 2  # it had died
    assert versions.read(spark, target, "t", frame.schema).count() == 6
    assert versions.commit(spark, target, 2, {"t": {"b": None}}) == 3
    assert versions.read(spark, target, "t", frame.schema).count() == 3 and versions.read(spark, target, "u", frame.schema).isEmpty()
