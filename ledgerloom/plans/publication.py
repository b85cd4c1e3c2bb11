"""Month runs whose ledger and balances are published in one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import sinks, versions
from ledgerloom.operators.ledger import monthly_movement, roll_forward
from ledgerloom.plans.posting import Posted, refuse_faults
from ledgerloom.plans.templates import Catalogue, TableCatalogue, expand_transactions
from ledgerloom.scratch import cut

KEYS = ["account_code", "fund"]


def publish_month(txn: DataFrame, catalogue: Catalogue | TableCatalogue, target: str, run_id: str, prior: DataFrame | None = None) -> Posted:
    """Post ``txn`` as ``run_id`` and publish headers, lines and balances together.

    A part of the ledger is a run, a part of the balances a month. What the run posted before is replaced, entries of
    other runs are not posted twice, and balances are rolled on from the first month the run touches or
    touched; months without entries and behind all others drop out. Readers see the version before, or all of this
    one. A second writer that started from the same version gets ``ConflictError`` and may run again.
    """
    spark = txn.sparkSession
    number, parts = versions.current(spark, target)
    out = expand_transactions(txn, catalogue, run_id)
    refuse_faults(out, run_id)
    headers, lines = sinks.with_month(out.headers), sinks.with_month(out.lines)
    held = versions.read(spark, target, "headers", headers.schema, number, leave=(run_id,)).select("je_number").distinct()
    headers, lines = (cut(df.join(held, "je_number", "left_anti").select(*df.columns), "posting") for df in (headers, lines))

    mine = tuple(p for p in parts.get("headers", {}) if p != run_id)
    former = versions.read(spark, target, "headers", headers.schema, number, leave=mine)
    first = former.select("je_month").union(headers.select("je_month")).agg(F.min("je_month")).first()[0]
    changes: versions.Parts = {}
    if first is not None:
        for name, df in (("headers", headers), ("lines", lines)):
            ordered = df.repartitionByRange("je_month", "je_date", "je_number").sortWithinPartitions("je_month", "je_date", "je_number")
            changes[name] = {run_id: None if df.isEmpty() else versions.stage(ordered, target, name)}
        others = versions.read(spark, target, "lines", lines.schema, number, leave=(run_id,))
        movement = monthly_movement(others.unionByName(lines).where(F.col("je_month") >= F.lit(first)))
        months = parts.get("balances", {})
        kept = tuple(m for m in months if m >= first.isoformat())
        shape = roll_forward(movement, prior).schema
        before = versions.read(spark, target, "balances", shape, number, leave=kept)
        last = before.groupBy(*KEYS).agg(F.max_by("closing_balance", "period_start").alias("closing_balance"))
        opening = last if prior is None else last.unionByName(prior.select(*last.columns).join(last, KEYS, "left_anti"))
        rolled = cut(roll_forward(movement, opening if prior is not None or not before.isEmpty() else None), "rolled")
        new = [r[0].isoformat() for r in rolled.select("period_start").distinct().collect()]  # one per month
        folder = versions.stage(rolled.withColumn("_part", F.col("period_start").cast("string")), target, "balances", "_part") if new else ""
        changes["balances"] = {m: None for m in kept} | {m: f"{folder}/_part={m}" for m in new}
        number = versions.commit(spark, target, number, changes)
    shape = roll_forward(monthly_movement(lines)).schema
    return Posted(run_id, versions.read(spark, target, "balances", shape, number), out.unmatched)
