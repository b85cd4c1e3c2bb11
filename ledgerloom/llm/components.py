"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of each node (large: the greater ones) move to its smallest neighbour."""
    sides = edges.union(edges.select("v", "u")) if large else edges
    sides = sides.toDF("u", "v")
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = sides.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all nodes that aren't the smallest of their component.

    ``edges`` has two columns of comparable ids. Each round writes the edge table, which never grows in rows
    beyond nodes and edges; the last one is a star around the smallest node of each component.
    """
    u, v = (F.col(c) for c in edges.columns)
    now = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    state = None
    while True:
        now = written(now, name)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = seen
        now = _stars(_stars(now, large=True), large=False)
