"""Physical plans that must not change shape."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import listing, reports
from ledgerloom.plans.journals import build_journals
from ledgerloom.plans.templates import expand_transactions
from ledgerloom.sources import tables as S
from ledgerloom.sources.datasource_rows import datasource_rows, sample_settings
from ledgerloom.sources.sample_templates import sample_catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def built(spark, root):
    return build_journals(sample_settings(spark), datasource_rows(spark, root), start=date(1990, 1, 1))


@pytest.mark.parametrize("part", ["journals", "lines", "gl", "dropped_lines"])
def test_journals_are_built_without_a_shuffle(built, part):
    text = plan(getattr(built, part))
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_templates_expand_without_join_or_shuffle(spark, root):
    text = plan(expand_transactions(S.txn_source(spark, root), sample_catalogue(spark)).lines)
    assert "Exchange" not in text and "Join" not in text


def test_line_scan_reads_only_used_columns(spark, root):
    text = plan(reports.account_balance_summary(S.gl_entries(spark, root)))
    schema = text.split("lineitem.parquet")[1].split("ReadSchema: ")[1].split(">")[0]
    assert "l_tax" not in schema and "l_discount" not in schema and "l_quantity" not in schema


def test_filters_reach_the_scan(spark, root):
    df = S.table(spark, root, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(df)


def test_top_rows_are_taken_per_task(spark, root):
    text = plan(listing.top(S.journals(spark, root), [F.desc("amount"), "id"], 5))
    assert "TakeOrderedAndProject" in text


def test_day_journals_scan_the_ledger_once(spark, root):
    df = reports.account_pair_journals(S.gl_entries(spark, root))
    df.collect()
    final = plan(df)
    assert final.split("== Initial Plan ==")[0].count("lineitem.parquet") == 1
