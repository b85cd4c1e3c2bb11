"""Month-end batch: three journal entries per premium or claim, checked and
published as a whole."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import codes as C
from ledgerloom.operators.numbering import number_rows
from ledgerloom.operators.sequences import sequence_check

MONEY = "decimal(20,2)"
TOLERANCE = Decimal("0.01")
PREREQUISITES = ["AP_CLOSE", "AR_CLOSE", "PAYROLL_CLOSE"]


@dataclass(frozen=True)
class Entry:
    """One two-line journal entry; ``amount`` names a source column."""

    description: str
    debit: tuple[str, str]
    credit: tuple[str, str]
    amount: str


# Accounts and funds of the premium entries.
PREMIUM_ENTRIES = [
    Entry("Premium receipt - Policy ", ("1010-001", "OPERATOR"), ("2010-001", "OPERATOR"), "amount"),
    Entry("Tabarru allocation - Policy ", ("2010-001", "OPERATOR"), ("3010-001", "TABARRU"), "fund_tabarru"),
    Entry("Tanahud allocation - Policy ", ("2010-001", "OPERATOR"), ("3020-001", "TANAHUD"), "fund_tanahud"),
]

# Default mapping for claims; pass another list where the chart differs.
CLAIM_ENTRIES = [
    Entry("Tabarru claim - Policy ", ("3010-001", "TABARRU"), ("2020-001", "OPERATOR"), "fund_tabarru"),
    Entry("Tanahud claim - Policy ", ("3020-001", "TANAHUD"), ("2020-001", "OPERATOR"), "fund_tanahud"),
    Entry("Claim payment - Policy ", ("2020-001", "OPERATOR"), ("1010-001", "OPERATOR"), "amount"),
]


def unprocessed(df: DataFrame, day_col: str, start: date, end: date) -> DataFrame:
    return df.where(~F.col("batch_processed") & F.col(day_col).between(F.lit(start), F.lit(end)))


def _sources(premiums: DataFrame, claims: DataFrame) -> DataFrame:
    p = premiums.select(
        F.lit(0).alias("kind"), F.col("txn_id").alias("source_id"), "policy_id",
        F.col("payment_date").alias("je_date"), F.col("premium_amount").alias("amount"),
        "fund_tabarru", "fund_tanahud",
    )
    c = claims.select(
        F.lit(1).alias("kind"), F.col("claim_id").alias("source_id"), "policy_id",
        F.col("claim_date").alias("je_date"), F.col("claim_amount").alias("amount"),
        "fund_tabarru", "fund_tanahud",
    )
    return p.unionByName(c)


def _entries(specs: list[Entry]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("entry_no"),
                F.concat(F.lit(e.description), F.col("policy_id")).alias("description"),
                F.lit(e.debit[0]).alias("debit_account"),
                F.lit(e.debit[1]).alias("debit_fund"),
                F.lit(e.credit[0]).alias("credit_account"),
                F.lit(e.credit[1]).alias("credit_fund"),
                F.col(e.amount).cast(MONEY).alias("amount"),
            )
            for i, e in enumerate(specs)
        ]
    )


class Staged(NamedTuple):
    headers: DataFrame
    lines: DataFrame


def stage_entries(
    premiums: DataFrame,
    claims: DataFrame,
    batch_id: str,
    first_sequence: int = 1,
    premium_entries: list[Entry] = PREMIUM_ENTRIES,
    claim_entries: list[Entry] = CLAIM_ENTRIES,
) -> Staged:
    """Numbered entries of all sources; sequences are gap-free, premiums first.

    Only the source rows are numbered (over range partitions); the sequences of
    their entries follow by arithmetic.
    """
    if len(premium_entries) != len(claim_entries):
        raise ValueError("premiums and claims must have equally many entries")
    per = len(premium_entries)
    numbered = number_rows(_sources(premiums, claims), ["kind", "source_id"], column="rn")
    premium = F.col("kind") == 0
    rows = (
        numbered.withColumn(
            "e", F.explode(F.when(premium, _entries(premium_entries)).otherwise(_entries(claim_entries)))
        )
        .withColumn(
            "je_sequence", (F.col("rn") - 1) * F.lit(per) + F.col("e.entry_no") + F.lit(first_sequence)
        )
        .withColumn("template_code", F.when(premium, "PREMIUM_RECEIPT").otherwise("CLAIM_PAYMENT"))
        .withColumn("source_type", F.when(premium, "PREMIUM").otherwise("CLAIM"))
        .withColumn(
            "je_number", C.batch_je_number(F.col("template_code"), F.col("je_date"), F.col("je_sequence"))
        )
    )
    headers = rows.select(
        F.lit(batch_id).alias("batch_id"), "je_sequence", "je_number", "je_date",
        F.col("source_type").alias("je_type"), "source_type", "source_id", "template_code",
        F.col("e.entry_no").alias("entry_no"), F.col("e.description").alias("description"),
        F.col("e.amount").alias("total_debit"), F.col("e.amount").alias("total_credit"),
        F.lit("PENDING").alias("status"),
    )
    zero = F.lit(0).cast(MONEY)
    sides = F.array(
        F.struct(
            F.lit(1).alias("line_number"), F.col("e.debit_account").alias("account_code"),
            F.col("e.debit_fund").alias("fund_type"), F.col("e.amount").alias("debit_amount"),
            zero.alias("credit_amount"),
        ),
        F.struct(
            F.lit(2).alias("line_number"), F.col("e.credit_account").alias("account_code"),
            F.col("e.credit_fund").alias("fund_type"), zero.alias("debit_amount"),
            F.col("e.amount").alias("credit_amount"),
        ),
    )
    lines = rows.select(
        F.lit(batch_id).alias("batch_id"), "je_number", "je_date", F.col("e.description").alias("description"),
        F.explode(sides).alias("l"),
    ).select("batch_id", "je_number", "je_date", "description", "l.*")
    return Staged(headers, lines)


def _result(name: str, expected: Column, actual: Column, failed: Column, difference: Column | None = None) -> Column:
    text = "string"
    return F.struct(
        F.lit(name).alias("validation_name"),
        F.when(failed, "FAIL").otherwise("PASS").alias("status"),
        expected.cast(text).alias("expected_value"),
        actual.cast(text).alias("actual_value"),
        (F.lit(None) if difference is None else difference).cast(text).alias("difference"),
    )


def _one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row aggregates in one row."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def _as_rows(one_row: DataFrame, results: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def preflight(premiums: DataFrame, batches: DataFrame) -> DataFrame:
    """Prerequisite batches and fund allocations; ``batches``: batch_type, status."""
    funds = (F.col("fund_tabarru") > 0) & (F.col("fund_tanahud") > 0) & (F.col("fund_ujroh") > 0)
    whole = F.col("fund_tabarru") + F.col("fund_tanahud") + F.col("fund_ujroh") == F.col("premium_amount")
    source = premiums.agg(
        F.count_if(~F.coalesce(funds, F.lit(False))).alias("no_funds"),
        F.count_if(~F.coalesce(whole, F.lit(False))).alias("bad_sum"),
    )
    zero = F.lit(0)
    source_rows = _as_rows(
        source,
        [
            _result("premium_fund_allocation", zero, F.col("no_funds"), F.col("no_funds") > 0),
            _result("premium_allocation_sum", zero, F.col("bad_sum"), F.col("bad_sum") > 0),
        ],
    )
    done = batches.agg(
        *[
            F.coalesce(F.max(F.when(F.col("batch_type") == b, F.col("status"))), F.lit("MISSING")).alias(b)
            for b in PREREQUISITES
        ]
    )
    batch_rows = _as_rows(
        done,
        [
            _result(f"prerequisite_{b}", F.lit("COMPLETED"), F.col(b), F.col(b) != "COMPLETED")
            for b in PREREQUISITES
        ],
    )
    return batch_rows.unionByName(source_rows)


def fund_expectations(premiums: DataFrame, claims: DataFrame) -> DataFrame:
    """Expected net change per fund; UJROH must not move."""
    zero = F.lit(0).cast("decimal(38,2)")
    p = premiums.agg(F.sum("fund_tabarru").alias("pt"), F.sum("fund_tanahud").alias("pn"))
    c = claims.agg(F.sum("fund_tabarru").alias("ct"), F.sum("fund_tanahud").alias("cn"))
    both = _one_row(p, c)

    def net(a: str, b: str) -> Column:
        return (F.coalesce(a, zero) - F.coalesce(b, zero)).cast("decimal(38,2)")

    return both.select(
        F.explode(
            F.array(
                F.struct(F.lit("TABARRU").alias("fund_type"), net("pt", "ct").alias("expected_change")),
                F.struct(F.lit("TANAHUD").alias("fund_type"), net("pn", "cn").alias("expected_change")),
                F.struct(F.lit("UJROH").alias("fund_type"), zero.alias("expected_change")),
            )
        ).alias("f")
    ).select("f.*")


def precommit(staged: Staged, premiums: DataFrame, claims: DataFrame, per: int = 3) -> DataFrame:
    """Counts, sequences, debit = credit and fund totals as result rows."""
    sources = premiums.select(F.lit(1).alias("x")).unionByName(claims.select(F.lit(1).alias("x")))
    expected = sources.agg((F.count(F.lit(1)) * per).alias("expected"))
    totals = staged.headers.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("total_debit"), F.lit(0)).cast("decimal(38,2)").alias("td"),
        F.coalesce(F.sum("total_credit"), F.lit(0)).cast("decimal(38,2)").alias("tc"),
    )
    one = _one_row(totals, expected, sequence_check(staged.headers, "je_sequence"))
    general = _as_rows(
        one,
        [
            _result("record_count_check", F.col("expected"), F.col("n"), F.col("expected") != F.col("n"), F.col("n") - F.col("expected")),
            _result("sequence_duplicate_check", F.lit(0), F.col("duplicate_count"), F.col("duplicate_count") > 0),
            _result("sequence_gap_check", F.lit(0), F.col("gap_count"), F.col("gap_count") > 0),
            _result("debit_credit_balance", F.col("td"), F.col("tc"), F.col("td") != F.col("tc"), F.col("td") - F.col("tc")),
        ],
    )
    actual = staged.lines.groupBy("fund_type").agg(
        (F.sum("credit_amount") - F.sum("debit_amount")).cast("decimal(38,2)").alias("actual_change")
    )
    funds = (
        fund_expectations(premiums, claims)
        .join(actual, "fund_type", "left")
        .withColumn("actual_change", F.coalesce("actual_change", F.lit(0).cast("decimal(38,2)")))
        .withColumn("gap", (F.col("actual_change") - F.col("expected_change")).cast("decimal(38,2)"))
        .select(
            F.concat(F.lit("fund_total_"), "fund_type").alias("validation_name"),
            F.when(F.abs("gap") > F.lit(TOLERANCE), "FAIL").otherwise("PASS").alias("status"),
            F.col("expected_change").cast("string").alias("expected_value"),
            F.col("actual_change").cast("string").alias("actual_value"),
            F.col("gap").cast("string").alias("difference"),
        )
    )
    return general.unionByName(funds)


def staging_integrity(staged: Staged, premiums: DataFrame, per: int = 3) -> DataFrame:
    """Premium count and total against the staged receipt entries."""
    source = premiums.agg(
        (F.count(F.lit(1)) * per).alias("expected_count"),
        F.coalesce(F.sum("premium_amount"), F.lit(0)).cast("decimal(38,2)").alias("source_total"),
    )
    mine = staged.headers.where("source_type = 'PREMIUM'").agg(
        F.count(F.lit(1)).alias("actual_count"),
        F.coalesce(F.sum(F.when(F.col("entry_no") == 0, F.col("total_debit"))), F.lit(0))
        .cast("decimal(38,2)")
        .alias("staged_total"),
    )
    return _one_row(source, mine).withColumn(
        "intact",
        (F.col("expected_count") == F.col("actual_count"))
        & (F.abs(F.col("source_total") - F.col("staged_total")) <= F.lit(TOLERANCE)),
    )


def gate_passed(results: DataFrame) -> bool:
    return results.where("status = 'FAIL'").isEmpty()


def publish(staged: Staged, results: DataFrame, target: str, batch_id: str) -> bool:
    """Write the batch when every check passed; the master row comes last.

    Readers join on a COMMITTED master row, so a half-written batch is never
    seen and a rerun replaces the partition of its batch.
    """
    if not gate_passed(results):
        return False
    posted = staged.headers.withColumn("status", F.lit("POSTED"))
    for name, df in (("headers", posted), ("lines", staged.lines)):
        # All rows are of this batch: as a literal the partition column asks for no sort of the rows.
        one = df.withColumn("batch_id", F.lit(batch_id))
        one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(
            f"{target}/{name}"
        )
    spark = staged.headers.sparkSession
    spark.createDataFrame([("COMMITTED", batch_id)], "status string, batch_id string").coalesce(1).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}/master")
    return True


def fund_balances(current: DataFrame, lines: DataFrame, sign: int = 1) -> DataFrame:
    """Fund balances after a batch (sign 1) or after its rollback (sign -1)."""
    change = lines.groupBy("fund_type").agg(
        (F.sum("credit_amount") - F.sum("debit_amount")).cast("decimal(38,2)").alias("net_change")
    )
    zero = F.lit(0).cast("decimal(38,2)")
    return current.join(change, "fund_type", "left").select(
        "fund_type",
        (F.col("current_balance") + F.lit(sign) * F.coalesce("net_change", zero))
        .cast("decimal(38,2)")
        .alias("current_balance"),
    )


def mark_processed(df: DataFrame, day_col: str, start: date, end: date, batch_id: str) -> DataFrame:
    """Rows of the days that aren't processed yet get the mark; a row without a day keeps its flag."""
    inside = F.col(day_col).between(F.lit(start), F.lit(end))
    hit = F.coalesce(~F.col("batch_processed") & inside, F.lit(False))
    old = F.col("batch_id") if "batch_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("batch_id", F.when(hit, F.lit(batch_id)).otherwise(old)).withColumn(
        "batch_processed", F.col("batch_processed") | hit
    )


class MonthEnd(NamedTuple):
    status: str
    results: DataFrame
    balances: DataFrame
    premiums: DataFrame
    claims: DataFrame


def month_end(
    premiums: DataFrame,
    claims: DataFrame,
    batches: DataFrame,
    balances: DataFrame,
    start: date,
    end: date,
    batch_id: str,
    target: str,
) -> MonthEnd:
    """One batch: pre-flight, staging, pre-commit checks, publication, fund balances and source marks.

    REFUSED by the pre-flight or REJECTED by the pre-commit checks, nothing is published and balances and sources come
    back as they were. Entries are staged once below ``target`` and read back for every later step.
    """
    due = unprocessed(premiums, "payment_date", start, end), unprocessed(claims, "claim_date", start, end)
    results = preflight(due[0], batches)
    if not gate_passed(results):
        return MonthEnd("REFUSED", results, balances, premiums, claims)
    made = stage_entries(*due, batch_id)
    kept = []
    for name, df in zip(Staged._fields, made):
        path = f"{target}/staging/{batch_id}/{name}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        kept.append(df.sparkSession.read.schema(df.schema).parquet(path))
    staged = Staged(*kept)
    checks = precommit(staged, *due)
    results = results.unionByName(checks, allowMissingColumns=True)
    if not publish(staged, checks, target, batch_id):
        return MonthEnd("REJECTED", results, balances, premiums, claims)
    return MonthEnd(
        "COMMITTED",
        results,
        fund_balances(balances, staged.lines),
        mark_processed(premiums, "payment_date", start, end, batch_id),
        mark_processed(claims, "claim_date", start, end, batch_id),
    )


class RolledBack(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    balances: DataFrame
    premiums: DataFrame
    claims: DataFrame


def rollback(
    headers: DataFrame, lines: DataFrame, balances: DataFrame, premiums: DataFrame, claims: DataFrame, batch_id: str
) -> RolledBack:
    """Undo a committed batch: entries out, balances back, sources free again."""
    gone = F.coalesce(F.col("batch_id") == batch_id, F.lit(False))

    def reset(df: DataFrame) -> DataFrame:
        return df.withColumn("batch_processed", F.col("batch_processed") & ~gone).withColumn(
            "batch_id", F.when(~gone, F.col("batch_id"))
        )

    return RolledBack(
        headers.where(~gone),
        lines.where(~gone),
        fund_balances(balances, lines.where(gone), sign=-1),
        reset(premiums),
        reset(claims),
    )
