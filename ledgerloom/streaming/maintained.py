"""Summaries kept up to date by a stream: mergeable partial aggregates, one set per batch.

A batch is reduced to sums, least and greatest values per key, and to the distinct (key, name, value) of its code
columns and of the columns whose distinct values are counted. It replaces what was written under its number, so a batch that runs
again changes nothing. The summary merges the batches; it never reads the rows they came from. ``compacted`` folds the
batches so far into one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(30,2)"


@dataclass(frozen=True)
class Summary:
    """``sums``, ``least`` and ``most`` map a column of the summary to an expression over the rows.

    ``means`` maps one to its (sum, count); ``codes`` (joined text of a small code table) and ``distinct`` (a count)
    to the column whose values are kept. ``money`` are the sums with two decimals, ``hidden`` columns serve others.
    """

    keys: tuple[str, ...]
    sums: dict[str, str]
    least: dict[str, str] = field(default_factory=dict)
    most: dict[str, str] = field(default_factory=dict)
    means: dict[str, tuple[str, str]] = field(default_factory=dict)
    codes: dict[str, str] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)
    money: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()


JOURNAL_DAYS = Summary(
    keys=("journal_date", "journal_type"),
    sums={
        "entry_count": "1",
        "unvouchered_count": "CAST(voucher_id IS NULL AS INT)",
        "vouchered_count": "CAST(voucher_id IS NOT NULL AS INT)",
        "total_amount": "amount",
        "amounts": "CAST(amount IS NOT NULL AS INT)",
    },
    least={"first_created": "created_date"},
    most={"last_created": "created_date"},
    means={"avg_amount": ("total_amount", "amounts")},
    codes={"statuses": "status"},
    distinct={"unique_sources": "source_rowid"},
    money=("total_amount",),
    hidden=("amounts",),
)
ACCOUNT_DAYS = Summary(
    keys=("trx_date", "acc_debit", "acc_credit"),
    sums={"transaction_count": "1", "total_amount": "amount", "amounts": "CAST(amount IS NOT NULL AS INT)"},
    least={"min_amount": "amount"},
    most={"max_amount": "amount"},
    means={"avg_amount": ("total_amount", "amounts")},
    codes={"t1_codes": "t_1", "t2_codes": "t_2", "t3_codes": "t_3"},
    money=("total_amount",),
    hidden=("amounts",),
)


def mean6(total: Column, count: Column) -> Column:
    """A mean with six decimals, rounded half away from zero as by ``avg``; exact."""
    scaled = (F.abs(total) * F.lit(2_000_000)).cast("decimal(38,0)") + count
    units = F.call_function("div", scaled, (count * 2).cast("decimal(20,0)"))
    return F.when(count > 0, (F.signum(total).cast("int") * units * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(24,6)"))


def partials(rows: DataFrame, summary: Summary) -> tuple[DataFrame, DataFrame]:
    """The two tables of a batch: totals by key, and (key, name, value) of kept values."""
    aggs = [
        *[F.sum(F.expr(e)).alias(c) for c, e in summary.sums.items()],
        *[F.min(F.expr(e)).alias(c) for c, e in summary.least.items()],
        *[F.max(F.expr(e)).alias(c) for c, e in summary.most.items()],
    ]
    kept = {**summary.codes, **summary.distinct}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in kept.items()]))
    values = rows.select(*summary.keys, pairs.alias("_v")).select(*summary.keys, "_v.name", "_v.value").where("value IS NOT NULL")
    return rows.groupBy(*summary.keys).agg(*aggs), values.distinct()


def maintain(summary: Summary, target: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of the partial aggregates below ``target``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for name, part in zip(("totals", "values"), partials(batch, summary)):
            part.write.mode("overwrite").parquet(f"{target}/{name}/batch_no={batch_id}")
        batch.unpersist()

    return write


def merged(spark: SparkSession, summary: Summary, target: str) -> tuple[DataFrame, DataFrame]:
    """Totals and kept values over all batches, in the form of one batch."""
    totals, values = (spark.read.parquet(f"{target}/{name}").drop("batch_no") for name in ("totals", "values"))
    aggs = [
        *[F.sum(c).cast(MONEY if c in summary.money else "bigint").alias(c) for c in summary.sums],
        *[F.min(c).alias(c) for c in summary.least],
        *[F.max(c).alias(c) for c in summary.most],
    ]
    return totals.groupBy(*summary.keys).agg(*aggs), values.distinct()


def compacted(spark: SparkSession, summary: Summary, target: str, into: str) -> None:
    """Fold all batches below ``target`` into one below ``into``, under the greatest number so far.

    A stream that goes on writes below ``into``; its next batch has a greater number.
    """
    last = spark.read.parquet(f"{target}/totals").agg(F.max("batch_no")).first()[0]
    for name, part in zip(("totals", "values"), merged(spark, summary, target)):
        part.write.mode("overwrite").parquet(f"{into}/{name}/batch_no={last}")


def maintained(spark: SparkSession, summary: Summary, target: str) -> DataFrame:
    """The summary over all batches so far.

    Totals and kept values meet in one aggregation by key, so that keys with NULLs need no join.
    """
    totals, values = merged(spark, summary, target)
    measures = [c for c in totals.columns if c not in summary.keys]
    rows = totals.unionByName(values, allowMissingColumns=True)
    named = lambda n: F.when(F.col("name") == n, F.col("value"))
    one = rows.groupBy(*summary.keys).agg(
        *[F.max(c).alias(c) for c in measures],
        *[F.array_join(F.array_sort(F.collect_list(named(n))), ",").alias(n) for n in summary.codes],
        *[F.count(named(n)).alias(n) for n in summary.distinct],
    )
    means = {n: mean6(F.col(total), F.col(count)) for n, (total, count) in summary.means.items()}
    return one.withColumns(means).drop(*summary.hidden)
