"""Sketches per day that merge over any period: medians and other quantiles, and distinct counts.

A quantile sketch answers with a value whose rank is off by a bounded share of the rows (``rank_error``), a distinct
sketch with a count off by a bounded share of it (``count_error``). Both are small binary columns of a daily table, so a
month or a year is a merge of days and never reads the rows again. The exact forms stay in ``reports``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 800
DISTINCT_BITS = 14


def rank_error(k: int = QUANTILE_K) -> float:
    """Bound of the rank's error as a share of the rows, at 99 % confidence, for one quantile."""
    return 2.296 / k**0.9021


def count_error(bits: int = DISTINCT_BITS) -> float:
    """Bound of a distinct count's relative error, three standard deviations."""
    return 3 * 1.04 / 2 ** (bits / 2)


def daily_sketches(
    rows: DataFrame, day: str, keys: Sequence[str], amounts: Sequence[str] = (), distinct: Sequence[str] = (), k: int = QUANTILE_K, bits: int = DISTINCT_BITS
) -> DataFrame:
    """Per day and key: rows, a quantile sketch ``<c>_quantiles`` per amount and ``<c>_distinct`` per counted column.

    NULLs are in no sketch.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"{c}_quantiles") for c in amounts]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(f"{c}_distinct") for c in distinct]
    return rows.groupBy(F.to_date(day).alias("day"), *keys).agg(*aggs)


def merged_sketches(daily: DataFrame, period: Column, keys: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """The daily sketches of each ``period`` (a column over ``day``) as one."""
    aggs = [F.sum("rows").alias("rows")]
    for c in daily.columns:
        if c.endswith("_quantiles"):
            aggs.append(F.kll_merge_agg_double(c, k).alias(c))
        elif c.endswith("_distinct"):
            aggs.append(F.hll_union_agg(c).alias(c))
    return daily.groupBy(period.alias("period"), *keys).agg(*aggs)


def quantile(column: str, share: float = 0.5) -> Column:
    """Value at ``share`` of an amount's sketch."""
    return F.kll_sketch_get_quantile_double(F.col(f"{column}_quantiles"), F.lit(share))


def distinct_count(column: str) -> Column:
    return F.hll_sketch_estimate(f"{column}_distinct")


def rank_bounds(rows: DataFrame, estimates: DataFrame, keys: Sequence[str], amount: str, estimate: str) -> DataFrame:
    """Per key: share of rows below the estimate, and up to it, by comparing all rows with it."""
    met = rows.where(F.col(amount).isNotNull()).join(estimates.select(*keys, estimate), list(keys))
    value = F.col(amount).cast("double")
    n = F.count(F.lit(1))
    below, upto = F.count_if(value < F.col(estimate)), F.count_if(value <= F.col(estimate))
    return met.groupBy(*keys).agg(n.alias("rows"), (below / n).alias("below"), (upto / n).alias("upto"))
