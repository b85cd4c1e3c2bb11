"""Hash trees over ordered leaves, with proofs that one leaf belongs to a published root.

The leaves of a tree are numbered by ``order`` and joined ``fanout`` at a time, level by level, so a cell never holds
more than ``fanout`` hashes, however many leaves there are; the last node of a level may have fewer children. Leaves
and inner nodes are hashed with different first letters, so neither can stand for the other, and a leaf's hash covers
its name. A tree of one leaf has the leaf's hash as root. A missing hash counts as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.numbering import number_rows
from ledgerloom.scratch import cut

FANOUT = 16


def leaf_hash(name: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("#", F.lit("L"), name.cast("string"), F.coalesce(content, F.lit(""))), 256)


def node_hash(children: Column) -> Column:
    """Hash of a list of child hashes."""
    return F.sha2(F.concat(F.lit("N"), F.array_join(children, "")), 256)


def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, by null-safe equality of ``keys``."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if not keys:
        return left.crossJoin(other)
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def _children(place: str = "place") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(place, "hash"))), lambda x: x["hash"])


def hash_levels(leaves: DataFrame, keys: list[str], name: str, content: str, fanout: int = FANOUT) -> DataFrame:
    """(keys, level, place, size, hash, name): all nodes; ``size`` counts the nodes of the level, 1 at the root.

    ``leaves`` have one row per ``name`` within ``keys``; places follow the order of the names from 0. A level is
    written before the next is built, and there are log(leaves) of them.
    """
    if fanout < 2:
        raise ValueError("a node needs two children at least")
    slim = leaves.select(*keys, F.col(name).alias("name"), leaf_hash(F.col(name), F.col(content)).alias("hash"))
    placed = number_rows(slim, ["name"], keys=keys, column="place").withColumn("place", F.col("place") - 1)
    placed = cut(placed, "leaves")
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    out = _with(placed, sizes, keys).select(*keys, F.lit(0).alias("level"), "place", "size", "hash", "name")
    out = now = cut(out, "level0")
    level = 0
    while not now.where("size > 1").isEmpty():
        level += 1
        up = now.where("size > 1").withColumn("_up", F.expr(f"place div {fanout}"))
        up = up.groupBy(*keys, "_up").agg(_children().alias("_c"), F.expr(f"any_value(size + {fanout - 1}) div {fanout}").alias("size"))
        now = cut(
            up.select(
                *keys, F.lit(level).alias("level"), F.col("_up").alias("place"), "size", node_hash(F.col("_c")).alias("hash"),
                F.lit(None).cast(out.schema["name"].dataType).alias("name"),
            ),
            f"level{level}",
        )
        out = out.unionByName(now)
    return out


def roots(levels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, height, root): what is published of a tree."""
    return levels.where("size = 1").select(*keys, F.col("level").alias("height"), F.col("hash").alias("root"))


def inclusion_proofs(levels: DataFrame, wanted: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """(keys, name, proof) for the leaves of ``wanted`` (keys, name).

    A proof is a list of steps from the leaf up, each with the hashes before and after the own one among its parent's
    children: at most ``fanout`` - 1 hashes a level. Names that are no leaf have no proof.
    """
    all_ = levels.where("size > 1").groupBy(*keys, "level", F.expr(f"place div {fanout}").alias("_up"))
    families = cut(all_.agg(_children().alias("_c")), "families")
    asked = wanted.select(*keys, "name").distinct()
    found = levels.where("level = 0").select(*keys, "name", "place")
    met = _with(_with(found, asked, [*keys, "name"], "left_semi"), roots(levels, keys).drop("root"), keys)
    steps = F.when(F.col("height") > 0, F.sequence(F.lit(0), F.col("height") - 1)).otherwise(F.array().cast("array<int>"))
    path = met.select(*keys, "name", "place", F.explode_outer(steps).alias("level"))
    path = path.withColumn("_at", F.expr(f"place div cast(round(pow({fanout}, level)) as bigint)"))
    path = path.withColumn("_up", F.expr(f"_at div {fanout}")).withColumn("_in", F.expr(f"cast(_at % {fanout} as int)"))
    joined = _with(path, families, [*keys, "level", "_up"], "left")
    step = F.struct(
        "level",
        F.slice("_c", F.lit(1), F.col("_in")).alias("before"),
        F.slice("_c", F.col("_in") + 2, F.lit(fanout)).alias("after"),
    )
    return joined.groupBy(*keys, "name").agg(F.array_sort(F.collect_list(F.when(F.col("_c").isNotNull(), step))).alias("proof"))


def proven_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hash and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: node_hash(F.concat(s["before"], F.array(h), s["after"])))
