"""Sketches of days merged over periods against exact quantiles and counts."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import sketches as K


def test_merged_quantiles_stay_within_the_rank_error(spark):
    frame = spark.range(60_000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 31).cast("int")).alias("day"),
        F.when(F.col("id") % 7 > 0, "a").alias("key"),
        F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(10_000_019)).cast("decimal(20,2)")).alias("amount"),
    )
    daily = K.daily_sketches(frame, "day", ["key"], amounts=["amount"], distinct=["amount"])
    month = K.merged_sketches(daily, F.trunc("day", "MM"), ["key"])
    shares = (0.01, 0.25, 0.5, 0.9, 0.99)
    got = {r.key: r for r in month.select("key", "rows", K.distinct_count("amount").alias("n"), *[K.quantile("amount", s).alias(f"q{s}") for s in shares]).collect()}
    values = {k: np.sort([float(r.amount) for r in frame.where(F.col("key").eqNullSafe(k) & F.col("amount").isNotNull()).collect()]) for k in (None, "a")}
    assert sum(r["rows"] for r in got.values()) == 60_000
    for k, x in values.items():
        for s in shares:
            rank = np.searchsorted(x, got[k][f"q{s}"]) / len(x)
            assert abs(rank - s) <= K.rank_error() + 1 / len(x)
        assert abs(got[k].n - len(set(x))) <= K.count_error() * len(set(x))


def test_errors_shrink_with_the_size_of_a_sketch():
    assert K.rank_error(1600) < K.rank_error(800) < K.rank_error(200) < 0.02
    assert K.count_error(16) < K.count_error(12) < 0.06
