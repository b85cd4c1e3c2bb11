import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit as A
from ledgerloom.operators import clustering as CL
from ledgerloom.operators import graph as GR
from ledgerloom.operators import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(leaves, fanout):
    now, height = [sha(f"L#{name}#{content or ''}") for name, content in sorted(leaves)], 0
    while len(now) > 1:
        now = [sha("N" + "".join(now[i : i + fanout])) for i in range(0, len(now), fanout)]
        height += 1
    return height, now[0]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_roots_and_proofs_against_plain_version(spark, fanout):
    trees = {"one": 1, "two": 2, "nine": 9, "many": 83, None: 5}
    rows = [(k, i * 7, None if i == 3 else f"c{i}") for k, n in trees.items() for i in range(n)]
    leaves = spark.createDataFrame(rows, "tree string, seg long, head string")
    levels = M.hash_levels(leaves, ["tree"], "seg", "head", fanout)
    got = {r["tree"]: (r["height"], r["root"]) for r in M.roots(levels, ["tree"]).collect()}
    assert got == {k: plain_root([(s, h) for t, s, h in rows if t == k], fanout) for k in trees}

    wanted = leaves.select("tree", F.col("seg").alias("name")).union(spark.createDataFrame([("one", 999)], "tree string, name long"))
    proofs = M.inclusion_proofs(levels, wanted, ["tree"], fanout)
    back = {(r["tree"], r["name"]): r for r in proofs.collect()}
    assert len(back) == len(rows)  # no proof of what is no leaf
    assert max(len(s["before"]) + len(s["after"]) for r in back.values() for s in r["proof"]) <= fanout - 1
    heads = {(t, s): h for t, s, h in rows}
    for key, r in back.items():
        h = sha(f"L#{key[1]}#{heads[key] or ''}")
        for s in r["proof"]:
            h = sha("N" + "".join([*s["before"], h, *s["after"]]))
        assert h == got[key[0]][1]
    mine = proofs.join(leaves, (F.col("name") == F.col("seg")) & proofs["tree"].eqNullSafe(leaves["tree"]))
    ends = mine.select(proofs["tree"], M.proven_root(M.leaf_hash(F.col("seg"), F.col("head")), F.col("proof")).alias("root")).distinct()
    assert {r["tree"]: r["root"] for r in ends.collect()} == {k: v[1] for k, v in got.items()}


def test_tree_of_no_leaves_and_bad_fanout(spark):
    none = spark.createDataFrame([], "tree string, seg long, head string")
    assert M.roots(M.hash_levels(none, ["tree"], "seg", "head"), ["tree"]).count() == 0
    with pytest.raises(ValueError):
        M.hash_levels(none, ["tree"], "seg", "head", 1)


def test_changed_first_event_of_a_segment_is_found_in_a_slice(spark):
    rows = [(i, "JOURNAL", "a" if i % 2 else "b", i % 5, "JOURNAL_CREATED", i // 6) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, entity_type string, entity_id string, user_id long, event_type string, day long")
    events = events.withColumn("event_timestamp", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,cast(day as int),0,0,event_id)"))
    cut = F.col("day")
    tree = A.chain_tree(A.build_hash_chain(events, cut), fanout=2)
    tops = M.roots(tree, A.CHAIN)
    part = events.where("day between 4 and 7")
    proofs = M.inclusion_proofs(tree, part.select(*A.CHAIN, F.col("day").alias("name")), A.CHAIN, fanout=2)
    assert A.verify_segments(part, proofs, tops, cut).count() == 0
    # 25 is the first event of entity a on day 4; the chain built over the altered event links without a gap.
    altered = part.withColumn("event_type", F.when(F.col("event_id") == 25, "X").otherwise(F.col("event_type")))
    linked = altered.join(A.build_hash_chain(altered, cut).drop(*A.CHAIN), "event_id")
    assert A.verify_hash_chain(linked, sliced=True).count() == 0
    found = A.verify_segments(altered, proofs, tops, cut).collect()
    assert [(r["entity_id"], r["segment"], r["error"]) for r in found] == [("a", 4, "ROOT_MISMATCH")]
    gone = A.verify_segments(part.where("day <> 6"), proofs, tops, cut).collect()
    assert {(r["entity_id"], r["segment"], r["error"]) for r in gone} == {("a", 6, "SEGMENT_MISSING"), ("b", 6, "SEGMENT_MISSING")}
    more = A.verify_segments(events.where("day between 4 and 8"), proofs, tops, cut).collect()
    assert {(r["segment"], r["error"]) for r in more} == {(8, "SEGMENT_UNKNOWN")}


def test_clusters_against_plain_lloyd_and_any_partitioning(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(1000), rnd.choice([0.25, 0.5, 90.0]) + rnd.random()) for i in range(400)] + [(400, None, 3.0)]
    df = spark.createDataFrame(rows, "node long, x long, y double").withColumn("y", F.col("y").cast("decimal(18,6)"))
    points = {r["node"]: tuple(r["_x"]) for r in CL.scaled_points(df, ["x", "y"]).collect()}
    assert points[400][0] == 0 and all(0 <= v <= CL.SCALE for p in points.values() for v in p)
    centres = sorted(set(points.values()), key=lambda p: (hashlib.md5(",".join(map(str, p)).encode()).hexdigest(), p))[:4]

    def near(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centres))

    for _ in range(6):
        members = {}
        for p in points.values():
            members.setdefault(near(p)[1], []).append(p)
        centres = [tuple(sum(c) // len(members[j]) for c in zip(*members[j])) if j in members else c for j, c in enumerate(centres)]
    for parts in (1, 7):
        got, final = CL.clusters(df.repartition(parts), ["x", "y"], k=4, steps=6)
        assert [tuple(c) for c in final] == centres
        assert {r["node"]: (r["gap"], r["cluster"]) for r in got.collect()} == {n: near(p) for n, p in points.items()}


def test_clusters_of_odd_tables(spark):
    none = spark.createDataFrame([], "node long, x long")
    assert GR.cluster_risk(none, ["x"]).count() == 0
    same = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "node long, x long")
    rows = GR.cluster_risk(same, ["x"], k=4).collect()
    assert {(r["cluster"], r["risk_score"], r["risk_bucket"]) for r in rows} == {(0, 0.0, "LOW")}
    two = spark.createDataFrame([(1, 0), (2, 100)], "node long, x long")
    placed, centres = CL.clusters(two, ["x"], k=2, steps=0, centres=[[0], [CL.SCALE], [0]])
    assert {r["node"]: r["cluster"] for r in placed.collect()} == {1: 0, 2: 1} and len(centres) == 3
