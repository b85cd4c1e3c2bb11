"""Relations between journals, accounts and policies as an edge table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgerloom.operators.clustering import clusters
from ledgerloom.scratch import cut


#: Neighbours of a node one join task takes.
HUB = 100_000


def edges(lines: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct weighted edges in both directions, from one written table.

    Whole numbers travel and are written as they are; names are made as the edges are read.
    """
    as_text = {c: not isinstance(lines.schema[c].dataType, IntegralType) for c in (left, right)}
    ends = {name: F.col(c).cast("string") if as_text[c] else F.col(c) for name, c in (("_l", left), ("_r", right))}
    pairs = lines.groupBy(*[c.alias(name) for name, c in ends.items()]).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    one = cut(pairs, "edges").select(
        F.concat(F.lit(f"{left}:"), F.col("_l").cast("string")).alias("src"),
        F.concat(F.lit(f"{right}:"), F.col("_r").cast("string")).alias("dst"),
        "n",
        "amount",
    )
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", "amount"))


def reach(edge: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(node, hop) of everything within ``hops`` of the seeds, at its least hop.

    Each hop joins the distinct new nodes with the edges once; pairs of nodes
    are never formed.
    """
    seen = cut(seeds.select(F.col("node"), F.lit(0).alias("hop")).distinct(), "hop0")
    frontier = seen.select("node")
    for hop in range(1, hops + 1):
        found = edge.join(frontier, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        fresh = cut(found.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), f"hop{hop}")
        seen = seen.unionByName(fresh)
        frontier = fresh.select("node")
    return seen


def adjacency(edge: DataFrame, most: int = HUB) -> tuple[DataFrame, DataFrame]:
    """(src, part, dst), the neighbours of a node in parts of about ``most``, and (src, parts) of the nodes with more than one."""
    pairs = cut(edge.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "pairs")
    hubs = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("parts")).where("parts > 1")
    hubs = cut(hubs, "hubs")
    part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")
    return cut(pairs.join(hubs, "src", "left").select("src", part.alias("part"), "dst"), "adjacency"), hubs


def reach_from_each(edge: DataFrame, seeds: DataFrame, hops: int = 3, most: int = HUB) -> DataFrame:
    """(seed, node, hop): what each seed reaches within ``hops``, at its least hop, the seed itself at hop 0.

    Edges are written once. A node with more than ``most`` neighbours is joined in parts, each of which meets a copy
    of its frontier rows, so neither the neighbours of a hub nor what comes of them stand in one task. A missing
    seed reaches nothing; a seed without edges reaches itself.
    """
    near, hubs = adjacency(edge, most)
    start = seeds.select(F.col("node").alias("seed")).where("seed IS NOT NULL").distinct()
    seen = fresh = cut(start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")), "hop0")
    for hop in range(1, hops + 1):
        dealt = fresh.join(hubs, F.col("node") == F.col("src"), "left").select(
            "seed", "node", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        )
        met = dealt.join(near, (dealt["node"] == near["src"]) & (dealt["part"] == near["part"]))
        found = met.select("seed", F.col("dst").alias("node")).distinct()
        fresh = cut(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)), f"hop{hop}")
        seen = seen.unionByName(fresh)
    return seen


def node_features(edge: DataFrame) -> DataFrame:
    """Degree, edge count and mean/std of the edge amounts per node; ``std_cents`` comes from exact sums, in cents."""
    cents = (F.col("amount") * 100).cast("decimal(18,0)")
    n, s, q = F.count("amount").cast("decimal(12,0)"), F.sum(cents).cast("decimal(19,0)"), F.sum((cents * cents).cast("decimal(38,0)"))
    spread = (n * q).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")
    std = F.round(F.sqrt(spread.cast("double") / (n * (n - 1)).cast("double"))).cast("bigint")
    return edge.groupBy(F.col("src").alias("node")).agg(
        F.when(n > 1, std).otherwise(F.lit(0)).cast("bigint").alias("std_cents"),
        F.count(F.lit(1)).alias("degree"),
        F.sum("n").alias("edge_count"),
        F.avg("amount").alias("mean_amount"),
        F.coalesce(F.stddev_samp(F.col("amount").cast("double")), F.lit(0.0)).alias("std_amount"),
    )


def risk_bucket(score: Column) -> Column:
    return (
        F.when(score > F.lit(Decimal("0.7")), "HIGH").when(score > F.lit(Decimal("0.4")), "MEDIUM").otherwise("LOW")
    )


def cluster_risk(
    features: DataFrame, columns: list[str], k: int = 4, steps: int = 10, centres: list[list[int]] | None = None
) -> DataFrame:
    """Cluster, distance to its centre, that distance as a share of the largest one, and its bucket."""
    placed, _ = clusters(features, columns, k, steps, centres)
    placed = cut(placed, "clusters")
    top = placed.agg(F.max("gap")).first()[0] or 1
    far = F.sqrt(F.col("gap").cast("double"))
    score = far / F.sqrt(F.lit(top).cast("double"))
    measured = placed.withColumn("distance", far).withColumn("risk_score", score).drop("gap")
    return measured.withColumn("risk_bucket", risk_bucket(F.col("risk_score")))
