"""The account-flag machine over exploded journal lines.

Inside one journal the machine carries the last debit account, the last credit
account and one amount x. Flags 1 and 2 set x to the line amount, flag 4 sets
x to (amount - x), other flags keep it; flags 1, 3 and 4 post a ledger row.
Each step is x -> sign * x + shift, so a run of lines composes to one such
step. Within a segment that starts at a reset, x = s * sum(s_i * shift_i) with
s the running product of signs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.numbering import TASK_ROWS, by_group_size, join_keys, spread
from ledgerloom.scratch import cut

MONEY = "decimal(20,2)"

# Columns of a line that the machine reads.
LINE = ["line_no", "dc", "account_code", "amount", "account_flag"]


def _scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], ends: Sequence[str] = ()) -> DataFrame:
    """Running state per key from columns reset, sign and shift.

    Adds seen (a reset so far), run_sign and run_value: x after the row is
    run_value, plus run_sign * x_in while nothing was reset. Sums run over the
    whole key and what stood before the last reset is taken off, so all
    windows share one sort. ``ends`` adds the last debit (D) and credit (C).
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    odd = F.sum((F.col("sign") < 0).cast("int")).over(w) % 2
    run = df.withColumns(
        {f"_{side.lower()}": F.last(F.when(F.col("dc") == side, F.col("account_code")), ignorenulls=True).over(w) for side in ends}
        | {"run_sign": F.when(odd == 1, -1).otherwise(1), "seen": F.coalesce(F.max("reset").over(w), F.lit(False))}
    )
    step = F.col("run_sign") * F.col("shift")
    run = run.withColumn("_sum", F.sum(step).over(w))
    before = F.last(F.when(F.col("reset"), F.col("_sum") - step), ignorenulls=True).over(w)
    total = F.col("_sum") - F.coalesce(before, F.lit(0).cast("decimal(38,2)"))
    return run.withColumn("run_value", (F.col("run_sign") * total).cast(MONEY)).drop("_sum")


def _steps(lines: DataFrame) -> DataFrame:
    flag, amount = F.col("account_flag"), F.col("amount")
    return (
        lines.where(amount > 0)
        .withColumn("reset", flag.isin(1, 2))
        .withColumn("sign", F.when(flag == 4, -1).otherwise(1))
        .withColumn("shift", F.when(flag.isin(1, 2, 4), amount).otherwise(F.lit(0)).cast(MONEY))
    )


def _emit(df: DataFrame, x_after: Column, debit: Column, credit: Column, keys: Sequence[str]) -> DataFrame:
    flag, amount = F.col("account_flag"), F.col("amount")
    posted = F.when(flag == 4, amount - x_after).otherwise(x_after).cast(MONEY)
    return df.where(flag.isin(1, 3, 4)).select(
        *keys, "line_no", F.coalesce(debit, F.lit("")).alias("acc_debit"),
        F.coalesce(credit, F.lit("")).alias("acc_credit"), posted.alias("amount"),
    )


def _in_one_task(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    run = _scan(_steps(lines), keys, order, ends="DC")
    return _emit(run, F.col("run_value"), F.col("_d"), F.col("_c"), keys)


def _over_many_tasks(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Same result with each journal cut into ranges that are combined after.

    Ranges follow the order of the keys, so only the first journal of a range can have begun in an earlier one: what
    is carried into a range is one row, whatever the number of journals.
    """
    laid = _steps(spread(lines.where("amount > 0"), keys, order, keep=[*keys, *LINE]))
    local_keys = [*keys, "_part"]
    run = _scan(laid, local_keys, ["_pos"], ends="DC")

    # At most one journal per range goes on in the next one.
    outer = F.struct(*keys)
    rims = laid.groupBy("_part").agg(F.min_by(outer, "_pos").alias("a"), F.max_by(outer, "_pos").alias("z"))
    rims = rims.select("_part", F.explode(F.array_distinct(F.array("a", "z"))).alias("k")).select("_part", "k.*")
    cut_up = F.broadcast(cut(rims.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys), "cut-up"))
    parts = _scan(join_keys(laid, cut_up, keys, "left_semi"), local_keys, ["_pos"], ends="DC")
    ends = parts.groupBy(*local_keys).agg(
        F.max_by(F.struct("seen", "run_sign", "run_value", "_d", "_c"), "_pos").alias("e")
    ).select(
        *local_keys, F.col("e.seen").alias("reset"), F.col("e.run_sign").alias("sign"),
        F.col("e.run_value").alias("shift"), F.col("e._d").alias("d_end"), F.col("e._c").alias("c_end"),
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lag = Window.partitionBy(*keys).orderBy("_part")
    heads = _scan(ends, keys, ["_part"]).select(
        *local_keys,
        F.lag("run_value", 1, 0).over(lag).cast(MONEY).alias("x_in"),
        F.last("d_end", ignorenulls=True).over(before).alias("d_in"),
        F.last("c_end", ignorenulls=True).over(before).alias("c_in"),
    )
    # A journal cut up has a row per range, and a range at most two such journals.
    joined = join_keys(run, F.broadcast(cut(heads, "heads")), local_keys, "left")
    x_in = F.coalesce("x_in", F.lit(0).cast(MONEY))
    x_after = F.when(F.col("seen"), F.col("run_value")).otherwise(F.col("run_value") + F.col("run_sign") * x_in)
    return _emit(
        joined, x_after, F.coalesce("_d", "d_in"), F.coalesce("_c", "c_in"), keys
    )


def flagged_gl_rows(
    lines: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = TASK_ROWS
) -> DataFrame:
    """Two-sided ledger rows; journals above ``limit`` lines use many tasks."""
    return by_group_size(
        lines.select(*dict.fromkeys([*keys, *order, *LINE])),
        keys,
        lambda df: _in_one_task(df, keys, order),
        lambda df: _over_many_tasks(df, keys, order),
        limit,
    )


def one_sided_gl_rows(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One ledger row per posting line with only its own side filled."""
    return lines.where(F.col("account_flag").isin(1, 3, 4)).select(
        *keys,
        "line_no",
        F.when(F.col("dc") == "D", F.col("account_code")).alias("acc_debit"),
        F.when(F.col("dc") == "C", F.col("account_code")).alias("acc_credit"),
        "amount",
    )


def last_line_per_number(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of lines with the same number the one written last survives."""
    rest = [c for c in lines.columns if c not in keys and c != "line_no"]
    best = lines.groupBy(*keys, "line_no").agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("b")
    )
    return best.select(*keys, "line_no", *[F.col("b")[c].alias(c) for c in rest])
