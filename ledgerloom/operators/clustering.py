"""k-means whose result can be computed again anywhere: whole numbers, centres from hashes, ties by cluster number.

Features are scaled to whole numbers between 0 and ``SCALE`` by their least and largest value. The first centres are
the distinct scaled points whose MD5 comes first. A Lloyd step assigns each point to its nearest centre by a fold in
the row and adds the points of a cluster up before the exchange; a centre is the mean, cut to a whole number.
Sums are decimals, so neither the order of rows nor the number of tasks changes a digit. Only the centres, k times
the number of features, come to the driver.

A missing feature is scaled as 0; a feature with one value only is 0 everywhere. With fewer distinct points than k
there are that many clusters. A cluster that loses all points keeps its centre. An empty table gives an empty frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.scratch import cut

SCALE = 1_000_000


def scaled_points(features: DataFrame, columns: list[str], scale: int = SCALE) -> DataFrame:
    """``features`` with ``_x``, an array of whole numbers."""
    exact = {c: F.col(c).cast("decimal(28,6)") for c in columns}
    ends = features.agg(*[f(e).alias(f"{n}_{c}") for c, e in exact.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def scaled(c: str) -> Column:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        if lo is None or lo == hi:
            return F.lit(0).cast("bigint")
        part = (exact[c] - F.lit(lo)) * F.lit(scale).cast("decimal(8,0)")
        return F.coalesce(F.call_function("div", part, F.lit(hi - lo)), F.lit(0)).cast("bigint")

    return features.withColumn("_x", F.array(*[scaled(c) for c in columns]))


def first_centres(points: DataFrame, k: int) -> list[list[int]]:
    """The k distinct points whose MD5 comes first."""
    distinct = points.select("_x").distinct()
    return [list(r["_x"]) for r in distinct.orderBy(F.md5(F.array_join(F.col("_x").cast("array<string>"), ",")), "_x").limit(k).collect()]


def nearest(centres: list[list[int]], point: str = "_x") -> Column:
    """Struct of the squared distance and the number of the nearest centre, the smaller number in a tie."""
    gaps = [
        F.struct(
            sum(((F.get(point, F.lit(i)) - x) * (F.get(point, F.lit(i)) - x) for i, x in enumerate(c)), F.lit(0).cast("bigint")).alias("gap"),
            F.lit(j).alias("cluster"),
        )
        for j, c in enumerate(centres)
    ]
    return gaps[0] if len(gaps) == 1 else F.least(*gaps)


def lloyd(points: DataFrame, centres: list[list[int]], steps: int) -> list[list[int]]:
    """Centres after ``steps`` Lloyd steps, fewer if they stand still."""
    for _ in range(steps):
        width = range(len(centres[0]))
        placed = points.select("_x", nearest(centres)["cluster"].alias("cluster"))
        sums = placed.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.get("_x", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in width]
        )
        moved = {r["cluster"]: [int(r[f"s{i}"]) // r["n"] for i in width] for r in sums.collect()}  # k rows
        after = [moved.get(j, c) for j, c in enumerate(centres)]
        if after == centres:
            break
        centres = after
    return centres


def clusters(
    features: DataFrame, columns: list[str], k: int = 4, steps: int = 10, centres: list[list[int]] | None = None
) -> tuple[DataFrame, list[list[int]]]:
    """``features`` with cluster and gap (squared distance in scaled units), and the centres.

    ``centres``, scaled, start the steps if given; with ``steps=0`` they are used as they are.
    """
    points = cut(scaled_points(features, columns), "points")
    start = first_centres(points, k) if centres is None else centres
    if not start:
        return points.drop("_x").withColumns({"cluster": F.lit(None).cast("int"), "gap": F.lit(None).cast("bigint")}), []
    final = lloyd(points, start, steps)
    near = points.withColumn("_n", nearest(final))
    return near.withColumns({"cluster": F.col("_n.cluster"), "gap": F.col("_n.gap")}).drop("_x", "_n"), final
