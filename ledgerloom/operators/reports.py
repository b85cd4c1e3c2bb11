"""Summary reports over journals, ledger rows and vouchers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerloom.functions import amounts as A
from ledgerloom.operators.numbering import TASK_ROWS, join_keys, number_in_groups, quantile_cont
from ledgerloom.scratch import cut

PAIR = ["trx_date", "account_debit", "account_credit"]


def code_list(name: str) -> Column:
    """Distinct codes as text; only for columns whose domain is a code table."""
    return F.array_join(F.array_sort(F.collect_set(name)), ",")


def pair_values(gl: DataFrame, kinds: dict[str, str], carry_null: str) -> DataFrame:
    """One row per day, account pair, kind and distinct value with sum and count.

    All lists, modes and totals of the day aggregate come from this one
    partially aggregated pass. ``carry_null`` names the kind whose rows add up
    to the totals.
    """
    entries = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()]
    )
    return (
        gl.select(
            "trx_date",
            F.coalesce("acc_debit", F.lit("")).alias("account_debit"),
            F.coalesce("acc_credit", F.lit("")).alias("account_credit"),
            "amount",
            F.explode(entries).alias("e"),
        )
        .groupBy(*PAIR, F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        .agg(F.sum("amount").alias("part_amount"), F.count(F.lit(1)).alias("part_count"))
        .withColumn("is_total", F.col("kind") == carry_null)
    )


def _totals(values: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    return values.groupBy(*PAIR).agg(
        F.sum(F.when(F.col("is_total"), F.col("part_amount"))).cast("decimal(30,2)").alias("total_amount"),
        F.sum(F.when(F.col("is_total"), F.col("part_count"))).alias("tx_count"),
        *extra,
    )


def _distinct(kind: str) -> Column:
    return F.count_if((F.col("kind") == kind) & F.col("value").isNotNull())


def _dc(debit: Column) -> Column:
    return F.when(debit != "", "D").otherwise("C")


def account_pair_totals(gl: DataFrame) -> DataFrame:
    """Per day and account pair: totals, rank by total, D/C marker."""
    values = pair_values(gl.where("amount > 0"), {"ref": "reference_1", "desc": "description"}, "ref")
    totals = _totals(values, [_distinct("ref").alias("n_refs"), _distinct("desc").alias("n_descs")])
    rank = Window.partitionBy("trx_date").orderBy(
        F.desc("total_amount"), "account_debit", "account_credit"
    )
    return totals.where("total_amount > 0").select(
        F.row_number().over(rank).alias("journal_id"),
        *PAIR,
        "total_amount",
        "tx_count",
        _dc(F.col("account_debit")).alias("dc_marker"),
        "n_refs",
        "n_descs",
    )


def account_pair_journals(gl: DataFrame) -> DataFrame:
    """Day journals: one row per day and account pair, ranked by total.

    The references and descriptions of a journal are rows of ``account_pair_details``, so no cell grows with the
    data and the shape is the same at any size.
    """
    totals = (
        gl.where("amount > 0")
        .groupBy("trx_date", F.coalesce("acc_debit", F.lit("")).alias("account_debit"), F.coalesce("acc_credit", F.lit("")).alias("account_credit"))
        .agg(F.sum("amount").cast("decimal(30,2)").alias("total_amount"), F.count(F.lit(1)).alias("tx_count"))
        .where("total_amount > 0")
    )
    rank = Window.partitionBy("trx_date").orderBy(F.desc("total_amount"), "account_debit", "account_credit")
    return totals.select(
        F.row_number().over(rank).alias("journal_id"),
        *PAIR,
        F.lit("DAY").alias("journal_type"),
        F.concat_ws("_", "account_debit", "account_credit").alias("account_key"),
        F.when(F.col("account_debit") != "", F.col("account_debit"))
        .otherwise(F.col("account_credit"))
        .alias("account"),
        _dc(F.col("account_debit")).alias("dc_marker"),
        "total_amount",
        F.round(F.col("total_amount") / F.lit(1000000), 2).cast("decimal(24,2)").alias("amount_millions"),
        "tx_count",
    )


def account_pair_details(gl: DataFrame) -> DataFrame:
    """References (kind ref) and descriptions (desc) of the day journals, each with its amount and count."""
    values = pair_values(gl.where("amount > 0"), {"ref": "reference_1", "desc": "description"}, "ref")
    return values.where(F.col("value").isNotNull()).select(
        *PAIR, "kind", "value", F.col("part_amount").cast("decimal(30,2)").alias("amount"), F.col("part_count").alias("tx_count")
    )


def account_pair_pages(details: DataFrame, page_rows: int = 1000, limit: int = TASK_ROWS) -> DataFrame:
    """The lists of the day journals in pages: ``lines`` holds up to ``page_rows`` (value, amount, tx_count) in the order of the value.

    Every list is whole over its pages, numbered from 1, and no cell holds more than a page, whatever the journal.
    Journals above ``limit`` values are numbered over range partitions; the rows are the same.
    """
    keys = [*PAIR, "kind"]
    placed = number_in_groups(details, keys, ["value"], "_place", limit)
    page = F.floor((F.col("_place") - 1) / F.lit(page_rows)).cast("int") + 1
    line = F.struct("value", "amount", "tx_count")
    return placed.groupBy(*keys, page.alias("page")).agg(
        F.array_sort(F.collect_list(line)).alias("lines"),
        F.sum("amount").cast("decimal(30,2)").alias("page_amount"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def account_pair_modes(gl: DataFrame) -> DataFrame:
    """Day aggregate with the most frequent t-codes (smallest code on ties)."""
    values = pair_values(gl, {"ref": "reference_1", "desc": "description"}, "ref")
    totals = _totals(values, [_distinct("ref").alias("n_refs"), _distinct("desc").alias("n_descs")])
    codes = ["t_1", "t_2", "t_3"]
    # Code combinations are few, so only their counts are unfolded per code.
    combos = (
        gl.withColumn("account_debit", F.coalesce("acc_debit", F.lit("")))
        .withColumn("account_credit", F.coalesce("acc_credit", F.lit("")))
        .groupBy(*PAIR, *codes)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    unfolded = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in codes])
    counts = (
        combos.select(*PAIR, "n", F.explode(unfolded).alias("e"))
        .where("e.value is not null")
        .groupBy(*PAIR, F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        .agg(F.sum("n").alias("n"))
    )

    def mode(kind: str) -> Column:
        order = F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))
        return F.min_by(
            F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, order)
        ).alias(f"primary_{kind.replace('_', '')}")

    modes = counts.groupBy(*PAIR).agg(*[mode(c) for c in codes])
    return (
        totals.where("total_amount > 0")
        .join(modes, PAIR, "left")
        .withColumn("dc_marker", _dc(F.col("account_debit")))
    )


def bucketed_lines(totals: DataFrame, buckets: int = 100) -> DataFrame:
    """Lines of the day journals gathered by journal number modulo ``buckets``.

    ``totals`` are account-pair aggregates, so a day's lines are bounded by the
    pairs of the chart of accounts.
    """
    item = F.struct(
        "journal_id",
        F.when(F.col("account_debit") != "", F.col("account_debit")).otherwise(F.col("account_credit")).alias("account"),
        F.col("total_amount").alias("amount"),
        F.col("dc_marker").alias("dc"),
    )
    return totals.groupBy("trx_date", (F.col("journal_id") % buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("lines")
    )


def _amount_sums(n: str) -> list[Column]:
    """Row count ``n`` and what total and mean of the amounts are made of, before codes are folded."""
    return [F.count(F.lit(1)).alias(n), F.sum("amount").alias("_sum"), F.count("amount").alias("_known")]


def _total(df: DataFrame) -> Column:
    """Sum of the partial sums in the type of a sum over the rows of ``df``."""
    return F.sum("_sum").cast(df.agg(F.sum("amount").alias("s")).schema["s"].dataType)


def _mean(df: DataFrame, value: str = "amount") -> Column:
    """Mean over the rows of ``df`` from partial sums and counts, with type and rounding of ``avg``."""
    kind, mean = df.schema[value].dataType, df.agg(F.avg(value).alias("m")).schema["m"].dataType
    if isinstance(kind, DecimalType):
        return A.mean_of(F.sum("_sum"), F.sum("_known"), kind.scale).cast(mean)
    return F.sum("_sum") / F.nullif(F.sum("_known"), F.lit(0))


def journal_daily_summary(journals: DataFrame) -> DataFrame:
    """Counted per status first, so that codes are listed from a few rows; sources are told apart on their own."""
    keys = ["journal_date", "journal_type"]
    cells = journals.groupBy(*keys, "status").agg(
        *_amount_sums("entry_count"),
        F.count("voucher_id").alias("vouchered_count"),
        F.min("created_date").alias("first_created"),
        F.max("created_date").alias("last_created"),
    )
    days = cells.groupBy(*keys).agg(
        F.sum("entry_count").alias("entry_count"),
        F.sum("vouchered_count").alias("vouchered_count"),
        _total(journals).alias("total_amount"),
        _mean(journals).alias("avg_amount"),
        F.min("first_created").alias("first_created"),
        F.max("last_created").alias("last_created"),
        code_list("status").alias("statuses"),
    )
    sources = journals.where(F.col("source_rowid").isNotNull()).select(*keys, "source_rowid").distinct()
    sources = sources.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_sources"))
    return join_keys(days, sources, keys, "left").select(
        *keys,
        "entry_count",
        F.coalesce("unique_sources", F.lit(0).cast("bigint")).alias("unique_sources"),
        (F.col("entry_count") - F.col("vouchered_count")).alias("unvouchered_count"),
        "vouchered_count",
        "total_amount",
        "avg_amount",
        "first_created",
        "last_created",
        "statuses",
    )


def ledger_cells(gl: DataFrame) -> DataFrame:
    """Counts and sums per day, account pair and codes, from which both ledger reports are folded."""
    return gl.groupBy("trx_date", "acc_debit", "acc_credit", "t_1", "t_2", "t_3").agg(
        *_amount_sums("transaction_count"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount")
    )


def account_balance_summary(gl: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Folded from ``ledger_cells`` (``cells``, if they are at hand), so that codes are listed from a few rows."""
    cells = ledger_cells(gl) if cells is None else cells
    return cells.groupBy("trx_date", "acc_debit", "acc_credit").agg(
        F.sum("transaction_count").alias("transaction_count"),
        _total(gl).alias("total_amount"),
        _mean(gl).alias("avg_amount"),
        F.min("min_amount").alias("min_amount"),
        F.max("max_amount").alias("max_amount"),
        code_list("t_1").alias("t1_codes"),
        code_list("t_2").alias("t2_codes"),
        code_list("t_3").alias("t3_codes"),
    )


def voucher_summary(vouchers: DataFrame) -> DataFrame:
    """``vouchers``: journal_date, journal_type, voucher_no, line_count."""
    numbers = vouchers.groupBy("journal_date", "journal_type", "voucher_no").agg(
        F.count(F.lit(1)).alias("voucher_count"), F.sum("line_count").alias("_sum"), F.count("line_count").alias("_known")
    )
    return numbers.groupBy("journal_date", "journal_type").agg(
        F.sum("voucher_count").alias("voucher_count"),
        F.count("voucher_no").alias("unique_vouchers"),
        F.min("voucher_no").alias("first_voucher"),
        F.max("voucher_no").alias("last_voucher"),
        F.sum("_sum").alias("total_lines"),
        _mean(vouchers, "line_count").alias("avg_lines_per_voucher"),
    )


def tcode_analysis(gl: DataFrame, exact: bool = True, stored: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """Month and t-code statistics with the median amount.

    ``exact=False`` takes the sketch median in the same pass. The exact one reads the rows again: they are written
    once, unless ``stored`` says that ``gl`` is a written table. ``cells``: the ``ledger_cells`` of ``gl``, if they are at hand.
    """
    keys = ["month", "t_1", "t_2", "t_3"]
    month = F.trunc("trx_date", "MM").cast("date").alias("month")
    keyed = gl.select(month, "t_1", "t_2", "t_3", "acc_debit", "acc_credit", "amount")
    if not exact:
        return keyed.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.sum("amount").alias("total_amount"),
            F.count_distinct("acc_debit").alias("unique_debit_accounts"),
            F.count_distinct("acc_credit").alias("unique_credit_accounts"),
            F.avg("amount").alias("avg_transaction_amount"),
            F.percentile_approx("amount", 0.5, 10000).alias("median_amount"),
        )
    if not stored:
        keyed = cut(keyed, "tcodes")
    # Account pairs are counted first, so that accounts are told apart among a few rows.
    if cells is None:
        pairs = keyed.groupBy(*keys, "acc_debit", "acc_credit").agg(*_amount_sums("transaction_count"))
    else:
        pairs = cells.withColumn("month", month)
    stats = pairs.groupBy(*keys).agg(
        F.sum("transaction_count").alias("transaction_count"),
        _total(keyed).alias("total_amount"),
        F.count_distinct("acc_debit").alias("unique_debit_accounts"),
        F.count_distinct("acc_credit").alias("unique_credit_accounts"),
        _mean(keyed).alias("avg_transaction_amount"),
    )
    median = quantile_cont(keyed.select(*keys, "amount"), keys, "amount", column="median_amount", stored=True)
    return join_keys(stats, median, keys, "left")


def processing_metrics(journals: DataFrame) -> DataFrame:
    delay = F.timestamp_diff("SECOND", F.col("journal_ts"), F.col("created_date"))
    return (
        journals.groupBy(
            F.date_trunc("hour", "created_date").cast("timestamp_ntz").alias("hour"), "journal_type"
        )
        .agg(
            F.count(F.lit(1)).alias("records_processed"),
            F.avg(delay).alias("avg_processing_delay_seconds"),
            F.min("created_date").alias("first_processed"),
            F.max("created_date").alias("last_processed"),
        )
        .withColumn(
            "processing_seconds", F.timestamp_diff("SECOND", F.col("first_processed"), F.col("last_processed"))
        )
    )


def data_quality_summary(journals: DataFrame, as_of: Column, age_days: int = 7) -> DataFrame:
    """``journals`` with a JSON text column ``data`` and ``search_id``."""
    kind = F.substring(F.ltrim("data"), 1, 1)
    return journals.groupBy("journal_date", "journal_type").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("data").isNull()).alias("null_data_count"),
        F.count_if(F.col("search_id").isNull()).alias("null_search_id_count"),
        F.count_if(
            F.col("voucher_id").isNull() & (F.col("journal_date") < F.date_sub(as_of, age_days))
        ).alias("old_unvouchered"),
        F.count_if(kind != "{").alias("invalid_json_count"),
        F.count_if(F.get_json_object("data", "$.journal_type") != F.col("journal_type")).alias(
            "type_mismatch_count"
        ),
    )


def day_totals(gl: DataFrame) -> DataFrame:
    """Totals per day and account pair, with the number of different transaction ids."""
    return gl.groupBy("trx_date", "acc_debit", "acc_credit").agg(
        F.sum("amount").alias("total_amount"),
        F.count(F.lit(1)).alias("tx_count"),
        F.count_distinct("trx_id").alias("n_trx_ids"),
    )


def day_ids(gl: DataFrame) -> DataFrame:
    """The t-codes (kind t1) and transaction ids (trx_id) of each day and account pair, a row each."""
    entries = F.array(
        F.struct(F.lit("t1").alias("kind"), F.col("t_1").alias("value")),
        F.struct(F.lit("trx_id").alias("kind"), F.col("trx_id").alias("value")),
    )
    rows = gl.select("trx_date", "acc_debit", "acc_credit", F.explode(entries).alias("e"))
    return (
        rows.groupBy("trx_date", "acc_debit", "acc_credit", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("tx_count"))
        .where("value IS NOT NULL")
    )


def journal_voucher_counts(journals: DataFrame) -> DataFrame:
    return journals.groupBy("journal_date", "journal_type").agg(
        F.count(F.lit(1)).alias("journal_count"),
        F.count_distinct("voucher_id").alias("voucher_count"),
        F.sum("amount").alias("total_amount"),
    )


def processing_report(journals: DataFrame, vouchers: DataFrame, gl: DataFrame) -> DataFrame:
    """Five metrics per day in long form (one pass per input table)."""
    size = F.octet_length("data")
    j = (
        journals.groupBy(F.col("journal_date").alias("day"))
        .agg(
            F.avg(F.timestamp_diff("SECOND", F.col("journal_ts"), F.col("created_date"))).alias("delay"),
            F.count(F.lit(1)).alias("n"),
            (F.sum(size) / F.lit(1048576.0)).alias("mb"),
        )
        .select(
            "day",
            F.expr(
                "stack(3, 'avg_processing_time', delay, 'seconds', 'total_journals', cast(n as double),"
                " 'count', 'total_data_size', mb, 'MB') as (metric_name, metric_value, metric_unit)"
            ),
        )
    )

    def counted(df: DataFrame, day: str, name: str) -> DataFrame:
        return df.groupBy(F.col(day).alias("day")).agg(
            F.lit(name).alias("metric_name"),
            F.count(F.lit(1)).cast("double").alias("metric_value"),
            F.lit("count").alias("metric_unit"),
        )

    return j.unionByName(counted(vouchers, "journal_date", "total_vouchers")).unionByName(
        counted(gl, "trx_date", "total_gl_entries")
    )


def day_status(journals: DataFrame, log: DataFrame) -> DataFrame:
    """Counts per day with the latest run-log entry of the day."""
    latest = log.groupBy("journal_date").agg(
        F.max_by(F.struct("run_status", "created_at"), F.struct("created_at", "run_id")).alias("l")
    )
    counts = journals.groupBy("journal_date").agg(
        F.count(F.lit(1)).alias("journal_count"),
        F.count_if(F.col("voucher_id").isNull()).alias("unvouchered"),
        F.sum("amount").alias("total_amount"),
    )
    return counts.join(latest, "journal_date", "left").select(
        "journal_date",
        "journal_count",
        "unvouchered",
        "total_amount",
        F.col("l.run_status").alias("last_status"),
        F.col("l.created_at").alias("last_run_at"),
    )


def batch_result(days: DataFrame) -> DataFrame:
    """``days``: one row per processed day with success, journals, vouchers."""
    done = F.count_if("success")
    return days.agg(
        F.count(F.lit(1)).alias("total_days"),
        done.alias("successful_days"),
        F.count_if(~F.col("success")).alias("failed_days"),
        F.sum("journals").alias("total_journals"),
        F.sum("vouchers").alias("total_vouchers"),
        F.round(F.try_divide(done * F.lit(100).cast("decimal(5,0)"), F.count(F.lit(1))), 2)
        .cast("decimal(7,2)")
        .alias("success_rate"),
    )


def runtime_statistics(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, min and max with the speed-up over the slowest run."""
    stats = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(value).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )
    median = quantile_cont(runs, keys, value, column="median_value")
    return stats.join(median, list(keys), "left")


def latency_percentiles(df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10000) -> DataFrame:
    p = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), accuracy)
    return (
        df.groupBy(*keys)
        .agg(p.alias("p"), F.max(value).alias("max_value"), F.count(F.lit(1)).alias("n"))
        .select(
            *keys,
            F.col("p")[0].alias("p50"),
            F.col("p")[1].alias("p95"),
            F.col("p")[2].alias("p99"),
            "max_value",
            "n",
        )
    )


def overall_totals(totals: DataFrame) -> DataFrame:
    return totals.agg(
        F.count(F.lit(1)).alias("journal_count"),
        F.sum("total_amount").cast("decimal(38,2)").alias("total_amount"),
        F.sum("tx_count").alias("transaction_count"),
        F.max("total_amount").alias("largest"),
    )
