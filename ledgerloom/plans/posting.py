"""Month run: transactions to staged entries, ledger and balances."""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, reports, sinks
from ledgerloom.operators.ledger import monthly_movement, roll_forward
from ledgerloom.plans.templates import Catalogue, Expanded, expand_transactions
from ledgerloom.scratch import cut


class Posted(NamedTuple):
    run_id: str
    balances: DataFrame
    unmatched: DataFrame


class UnbalancedError(ValueError):
    """A template with mode ERROR produced entries out of balance."""


def refuse_faults(out: Expanded, run_id: str) -> None:
    """Fails for entries out of balance, then for transactions without a template; one job for both.

    All rows have to be seen where there is no fault, so they are counted by all tasks at once.
    """
    faults = out.unbalanced.select(F.lit("unbalanced").alias("f")).unionAll(out.unmatched.select(F.lit("unmatched").alias("f")))
    found = {r.f for r in faults.groupBy("f").count().collect()}
    if "unbalanced" in found:
        raise UnbalancedError(f"run {run_id} has entries out of balance")
    if found:
        raise ValueError(f"run {run_id} has transactions without a template")


def post_month(
    txn: DataFrame,
    catalogue: Catalogue,
    target: str,
    run_id: str | None = None,
    prior: DataFrame | None = None,
) -> Posted:
    """Stage, check and post ``txn``, then roll the balances from its first month on.

    The ledger is append-only: each run has its own folder, so runs of the same months add up and a rerun
    replaces itself alone. Entries another run has posted already (same je_number) are not posted again.
    Balances come from the whole ledger of the months since the first one touched, on top of the balances
    before it (``prior``: those before the ledger begins), so later months follow a change. A month the run's former
    entries touched counts as touched, and balances of months that no longer have any go.
    """
    spark = txn.sparkSession
    run_id = run_id or uuid.uuid4().hex
    out = expand_transactions(txn, catalogue, run_id)
    refuse_faults(out, run_id)
    stage = f"{target}/staging"
    for name, df in (("headers", out.headers), ("lines", out.lines)):
        sinks.replace_run(df, f"{stage}/{name}", run_id)
    headers = sinks.read_runs(spark, f"{stage}/headers", out.headers.schema).where(F.col("run_id") == run_id)
    lines = sinks.read_runs(spark, f"{stage}/lines", out.lines.schema).where(F.col("run_id") == run_id)
    if sinks.exists(spark, f"{target}/ledger_headers"):
        posted = sinks.read_runs(spark, f"{target}/ledger_headers", sinks.with_month(out.headers).schema)
        others = posted.where(F.col("run_id") != run_id).select("je_number").distinct()
        headers, lines = (df.join(others, "je_number", "left_anti") for df in (headers, lines))
    former = _first_month(spark, f"{target}/ledger_headers", sinks.with_month(out.headers).schema, run_id)
    sinks.replace_run(sinks.with_month(headers), f"{target}/ledger_headers", run_id, ["je_month"], ["je_date", "je_number"])
    sinks.post_lines(lines, f"{target}/ledger_lines", run_id)
    months = [m for m in (former, _first_month(spark, f"{target}/ledger_headers", sinks.with_month(out.headers).schema, run_id)) if m]
    schema = sinks.with_month(out.lines).schema
    if months:
        _roll(spark, target, min(months), schema, prior)
    shape = roll_forward(monthly_movement(sinks.read_runs(spark, f"{target}/ledger_lines", schema)), prior).schema
    return Posted(run_id, spark.read.schema(shape).parquet(f"{target}/balances"), out.unmatched)


def _first_month(spark: SparkSession, path: str, schema, run_id: str):
    """First month the run has posted so far, or None."""
    if not sinks.exists(spark, path):
        return None
    return sinks.read_runs(spark, path, schema).where(F.col("run_id") == run_id).agg(F.min("je_month")).first()[0]


def _roll(spark: SparkSession, target: str, first, schema, prior: DataFrame | None) -> None:
    ledger_lines = sinks.read_runs(spark, f"{target}/ledger_lines", schema).where(F.col("je_month") >= F.lit(first))
    if sinks.exists(spark, f"{target}/balances"):
        # Months below the first one touched stay as they are: the balances before it open the new ones.
        keys = ["account_code", "fund"]
        before = spark.read.parquet(f"{target}/balances").where(F.col("period_start") < F.lit(first))
        last = before.groupBy(*keys).agg(F.max_by("closing_balance", "period_start").alias("closing_balance"))
        prior = last if prior is None else last.unionByName(prior.select(*last.columns).join(last, keys, "left_anti"))
    movement = monthly_movement(ledger_lines)
    rolled = roll_forward(movement, prior)
    sinks.replace_partitions(rolled, f"{target}/balances", ["period_start"], ["account_code", "fund"])
    low, high = movement.agg(F.min("period_start"), F.max("period_start")).first()
    stale = lambda month: month >= first.isoformat() and (low is None or not low.isoformat() <= month <= high.isoformat())
    sinks.drop_partitions(spark, f"{target}/balances", "period_start", stale)


def trial_balance_of(spark: SparkSession, target: str) -> DataFrame:
    return ledger.trial_balance(spark.read.parquet(f"{target}/ledger_lines"))


def refresh_reports(jobs: dict[str, DataFrame], target: str) -> DataFrame:
    """Write every summary table; returns the log (name, seconds, rows, error).

    One failing report does not stop the others.
    """
    log = []
    spark = next(iter(jobs.values())).sparkSession
    for name, df in jobs.items():
        start, error = time.time(), None
        try:
            df.write.mode("overwrite").parquet(f"{target}/{name}")
        except Exception as err:
            error = str(err)[:500]
        rows = None if error else spark.read.parquet(f"{target}/{name}").count()
        log.append((name, round(time.time() - start, 3), rows, error))
    return spark.createDataFrame(log, "view_name string, seconds double, row_count bigint, error string")


def standard_reports(
    journals: DataFrame,
    gl: DataFrame,
    vouchers: DataFrame | None = None,
    payloads: DataFrame | None = None,
    as_of: Column | None = None,
) -> dict[str, DataFrame]:
    """The summary tables by name; ``vouchers`` and ``payloads`` (see the two reports) add theirs.

    The ledger rows are written once, with the columns the reports use, and so are their counts and sums.
    """
    gl = cut(gl.select("trx_date", "acc_debit", "acc_credit", "t_1", "t_2", "t_3", "amount"), "report-ledger")
    cells = cut(reports.ledger_cells(gl), "report-cells")
    jobs = {
        "journal_daily_summary": reports.journal_daily_summary(journals),
        "account_balance": reports.account_balance_summary(gl, cells),
        "tcode_analysis": reports.tcode_analysis(gl, stored=True, cells=cells),
        "processing_metrics": reports.processing_metrics(journals),
    }
    if vouchers is not None:
        jobs["voucher_summary"] = reports.voucher_summary(vouchers)
    if payloads is not None:
        jobs["data_quality_summary"] = reports.data_quality_summary(payloads, F.current_date() if as_of is None else as_of)
    return jobs
