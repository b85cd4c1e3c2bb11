"""Row numbers and running state that never put one group into one task.

A plain ``row_number()`` window sends a whole group to one task. Here rows are
range-partitioned on (keys, order), so a hot key spreads over many tasks. The
layout is written once before the positions are used, because a recomputed
range partitioning may place rows differently.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.scratch import cut, small_side

# monotonically_increasing_id(): partition index above, position in the low 33 bits.
POSITION_BITS = 33

# Largest frame or group that one sorting (and spilling) window task takes.
TASK_ROWS = 1_000_000


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the right side's keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str] | None = None) -> DataFrame:
    """Sorted, written layout with ``_part`` (range index) and ``_pos`` in it; ``keep`` names the columns that are written."""
    cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    laid = cut(laid if keep is None else laid.select(*dict.fromkeys(keep), "_mid"), "layout")
    return (
        laid.withColumn("_part", F.shiftright("_mid", POSITION_BITS))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
        .drop("_mid")
    )


def number_rows(
    df: DataFrame,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    column: str = "seq",
    start: int = 1,
) -> DataFrame:
    """Gap-free numbers per key in ``order`` (which should be total)."""
    keys = list(keys)
    laid = spread(df, keys, order)
    sizes = laid.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    # One row per key and range: the prefix sum is over at most all ranges.
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(
        "_before", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("bigint"))
    ).drop("_n")
    if not keys:
        offsets = F.broadcast(offsets)  # one row per range partition
    number = F.col("_pos") - F.col("_first") + F.col("_before") + F.lit(start)
    return join_keys(laid, offsets, [*keys, "_part"]).select(
        *df.columns, number.cast("bigint").alias(column)
    )


def number_small(
    df: DataFrame,
    order: Sequence[Column | str],
    column: str = "seq",
    limit: int = TASK_ROWS,
) -> DataFrame:
    """Numbers over an aggregate: one sort while it has at most ``limit`` rows."""
    small = cut(df, "ranked")
    if small.count() > limit:
        return number_rows(small, order, column=column)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return small.withColumn(column, F.row_number().over(w).cast("bigint"))


def by_group_size(
    df: DataFrame,
    keys: Sequence[str],
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    limit: int = TASK_ROWS,
) -> DataFrame:
    """``small`` for groups that fit one task, ``large`` for the hot ones; with a limit below 1 all are hot."""
    keys = list(keys)
    if limit < 1:
        return large(df)
    hot = cut(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys),
        "hot",
    )
    if hot.isEmpty():
        return small(df)
    return small(join_keys(df, hot, keys, "left_anti")).unionByName(
        large(join_keys(df, hot, keys, "left_semi"))
    )


def number_in_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], column: str = "seq", limit: int = TASK_ROWS
) -> DataFrame:
    """Row numbers per key: one window where groups fit a task, else ranges."""

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return part.withColumn(column, F.row_number().over(w).cast("bigint"))

    return by_group_size(df, keys, plain, lambda part: number_rows(part, order, keys=keys, column=column), limit)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group by ``order`` values (ascending), by aggregation.

    ``min_by`` combines before the shuffle, so no group is sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_b")
    )
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def _steps(value: str) -> Column:
    """Whole number that never falls as the value grows: sixteen to a doubling, some 75,000 over all numbers there are."""
    v = F.col(value).cast("double")
    step = F.floor(F.least(F.log2(F.abs(v)) * 16, F.lit(20_000.0))) + 20_001
    return F.when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0).cast("bigint"))


def quantile_cont(
    df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, column: str = "median", stored: bool = False
) -> DataFrame:
    """Exact interpolated quantile per key, safe for hot keys.

    Rows are counted by coarse steps of the value first, so only those of the one or two steps that hold the
    quantile are counted by value; ranks come from prefix counts over the range layout, so only two rows per key are
    picked in the end. The values are read twice: ``stored`` says that ``df`` is a written table, otherwise they are written.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    if not stored:
        known = cut(known, "values")
    known = known.withColumn("_step", _steps(value))
    target = (F.col("_total") - 1).cast("decimal(20,0)") * F.lit(str(q)).cast("decimal(9,8)")
    low, high = F.floor(target), F.ceil(target)
    holds = ((F.col("_lo") <= low) & (low < F.col("_hi"))) | ((F.col("_lo") <= high) & (high < F.col("_hi")))
    whole = Window.partitionBy(*keys)  # a key has a bounded number of steps
    coarse = known.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_n"))
    coarse = coarse.withColumn("_hi", F.sum("_n").over(whole.orderBy("_step"))).withColumn("_total", F.sum("_n").over(whole))
    coarse = coarse.withColumn("_lo", F.col("_hi") - F.col("_n"))
    picked = cut(coarse.where(holds).select(*keys, "_step", "_lo", "_total"), "steps")
    near = join_keys(known, small_side(picked.select(*keys, "_step")), [*keys, "_step"], "left_semi")
    counted = near.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    laid = spread(counted, keys, [value])
    within = Window.partitionBy(*keys, "_part").orderBy("_pos")
    local = laid.withColumn("_upto", F.sum("_c").over(within))
    sizes = laid.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # No row lies between two picked steps, so a key's picked rows follow those below its first one.
    below = picked.groupBy(*keys).agg(F.min("_lo").alias("_below"), F.max("_total").alias("_total"))
    offsets = join_keys(
        sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_before")), below, keys
    ).select(*keys, "_part", (F.col("_before") + F.col("_below")).alias("_before"), "_total")
    ranked = join_keys(local, offsets, [*keys, "_part"]).select(
        *keys,
        value,
        (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_lo"),
        (F.col("_before") + F.col("_upto")).alias("_hi"),
        "_total",
    )
    hits = ranked.where(holds).withColumn("_frac", target - low)
    a, b = F.min(value), F.max(value)
    return hits.groupBy(*keys).agg((a + (b - a) * F.max("_frac")).alias(column))
