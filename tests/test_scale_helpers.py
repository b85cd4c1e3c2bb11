"""The skew-safe helpers against brute force, with groups forced to split."""

import random
import statistics
from collections import defaultdict
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import graph, matching, numbering, parts, reports, sequences
from ledgerloom.scratch import scratch_root, small_side

RELAXED = dict(deadline=None, max_examples=5, suppress_health_check=[HealthCheck.function_scoped_fixture])


def skewed(spark, n=600, seed=1):
    """A third of the rows share one key; some keys are NULL."""
    rng = random.Random(seed)
    rows = [(("hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])), i, Decimal(rng.randint(1, 40))) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, id int, v decimal(20,2)").repartition(7)


def test_numbers_are_gap_free_per_key(spark):
    rows, df = skewed(spark)
    got = defaultdict(list)
    for r in numbering.number_rows(df, ["v", "id"], keys=["k"]).collect():
        got[r.k].append((r.seq, r.v, r.id))
    assert sum(map(len, got.values())) == len(rows)
    for members in got.values():
        members.sort()
        assert [m[0] for m in members] == list(range(1, len(members) + 1))
        assert [m[1:] for m in members] == sorted(m[1:] for m in members)


def test_global_numbers_start_where_asked(spark):
    rows, df = skewed(spark)
    got = sorted((r.seq, r.id) for r in numbering.number_rows(df, ["id"], start=5).collect())
    assert got == [(i + 5, i) for i in range(len(rows))]


def test_small_numbering_falls_back_to_ranges(spark):
    _, df = skewed(spark, 90)
    for limit in (10, 1000):
        got = sorted((r.seq, r.id) for r in numbering.number_small(df, ["id"], limit=limit).collect())
        assert got == [(i + 1, i) for i in range(90)]


def test_by_group_size_routes_only_hot_keys(spark):
    rows, df = skewed(spark)
    out = numbering.by_group_size(
        df, ["k"], lambda d: d.withColumn("route", F.lit("small")), lambda d: d.withColumn("route", F.lit("large")), limit=190
    )
    got = out.groupBy("k", "route").count().collect()
    assert {r.k for r in got if r.route == "large"} == {"hot"}
    assert sum(r["count"] for r in got) == len(rows)


@settings(**RELAXED)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(-50, 50)), min_size=1, max_size=60))
def test_median_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(k, Decimal(v)) for k, v in rows], "k string, v decimal(20,2)")
    got = {r.k: float(r.median) for r in numbering.quantile_cont(df, ["k"], "v").collect()}
    by_key = defaultdict(list)
    for k, v in rows:
        by_key[k].append(v)
    assert got == {k: float(statistics.median(vs)) for k, vs in by_key.items()}


def test_quantile_of_a_hot_key(spark):
    rows, df = skewed(spark)
    got = {r.k: float(r.median) for r in numbering.quantile_cont(df, ["k"], "v").collect()}
    assert got["hot"] == statistics.median([float(v) for k, _, v in rows if k == "hot"])


def test_list_parts_hold_every_value_once(spark):
    rows, df = skewed(spark)
    out = parts.distinct_list_parts(df, ["k"], "id", "ids", max_items=20).collect()
    seen = defaultdict(list)
    for r in out:
        values = r.ids.split(",")
        assert len(values) == r.n_ids
        seen[r.k] += values
    assert len({r.part_no for r in out if r.k == "hot"}) > 1
    for key, values in seen.items():
        assert sorted(map(int, values)) == sorted(i for k, i, _ in rows if k == key)


def test_day_journal_details_add_up(spark):
    rows = [("1A" if i % 3 else "1B", None if i % 4 else "4C", Decimal(i + 1), f"R{i % 37}", f"D{i % 5}") for i in range(300)]
    gl = spark.createDataFrame(rows, "acc_debit string, acc_credit string, amount decimal(20,2), reference_1 string, description string")
    gl = gl.withColumn("trx_date", F.lit("2024-07-18").cast("date"))
    heads = {(r.account_debit, r.account_credit): r for r in reports.account_pair_journals(gl).collect()}
    sums = defaultdict(lambda: [0, 0])
    for r in reports.account_pair_details(gl).collect():
        for k, v in enumerate((r.amount, r.tx_count)):
            sums[r.account_debit, r.account_credit, r.kind][k] += v
    assert len(heads) == 4
    for key, head in heads.items():
        for kind in ("ref", "desc"):
            assert sums[(*key, kind)] == [head.total_amount, head.tx_count]


def test_modal_value_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "z"), (2, "z"), (2, "a")], "k int, v string")
    assert {r.k: r.m for r in parts.modal_value(df, ["k"], "v", "m").collect()} == {1: "a", 2: "z"}


@settings(**RELAXED)
@given(st.sets(st.integers(0, 200), min_size=1, max_size=60))
def test_missing_ranges_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s bigint").repartition(5)
    missing = set()
    for r in sequences.missing_ranges(df, "s").collect():
        assert r.missing == r.last_missing - r.first_missing + 1
        missing |= set(range(r.first_missing, r.last_missing + 1))
    assert missing == set(range(min(values), max(values) + 1)) - values


def test_sequence_check_counts(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 5, 9)], "s bigint")
    assert tuple(sequences.sequence_check(df, "s").first()) == (5, 1, 9, 2, 5, 1)


def test_previous_value_equals_lag(spark):
    _, df = skewed(spark)
    got = sorted(map(tuple, sequences.with_previous(df, ["id"], "v", "p", keys=["k"]).select("id", "p").collect()))
    w = Window.partitionBy("k").orderBy("id")
    assert got == sorted(map(tuple, df.select("id", F.lag("v").over(w)).collect()))


def test_as_of_equals_brute_force(spark):
    rng = random.Random(3)
    facts = [(i, rng.choice(["h", "h", "x"]), rng.randint(0, 100)) for i in range(150)]
    versions = [(k, t, f"{k}{t}") for k, t in {(rng.choice(["h", "x"]), rng.randint(0, 100)) for _ in range(40)}]
    got = matching.as_of(
        spark.createDataFrame(facts, "id int, k string, t int"), spark.createDataFrame(versions, "k string, f int, v string"),
        ["k"], "t", "f", ["v"], ["id"],
    )
    want = {}
    for i, k, t in facts:
        fits = [(f, v) for vk, f, v in versions if vk == k and f <= t]
        want[i] = max(fits)[1] if fits else None
    assert {r.id: r.v for r in got.collect()} == want


def test_top_per_group(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 1, "c")], "k int, p int, v string")
    assert sorted(map(tuple, numbering.top_per_group(df, ["k"], [F.col("p")]).collect())) == [(1, 3, "b"), (2, 1, "c")]


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_large_side_is_not_broadcast(spark):
    df = spark.range(50)
    assert "broadcast" not in small_side(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in small_side(df, 100)._jdf.queryExecution().logical().toString().lower()


def test_empty_frames_pass_through(spark):
    df = spark.createDataFrame([], "k string, id int, v decimal(20,2)")
    assert numbering.number_rows(df, ["id"], keys=["k"]).isEmpty()
    assert numbering.quantile_cont(df, ["k"], "v").isEmpty()
    assert numbering.number_in_groups(df, ["k"], ["id"]).isEmpty()
    assert parts.distinct_list_parts(df, ["k"], "id", "ids", 10).isEmpty()
    assert sequences.sequence_check(df.select("id"), "id").first().row_count == 0


def test_numbers_in_groups_agree_over_both_routes(spark):
    _, df = skewed(spark)
    one = sorted(map(tuple, numbering.number_in_groups(df, ["k"], ["id"]).select("id", "seq").collect()))
    two = sorted(map(tuple, numbering.number_in_groups(df, ["k"], ["id"], limit=50).select("id", "seq").collect()))
    assert one == two


def test_reach_from_each_seed_with_split_hubs(spark):
    rng = random.Random(5)
    pairs = [("hub", f"n{i}") for i in range(60)] + [(f"n{rng.randrange(60)}", f"m{rng.randrange(30)}") for _ in range(50)]
    both = pairs + [(b, a) for a, b in pairs]
    edge = spark.createDataFrame([*both, both[0], (None, "n1"), ("n1", None)], "src string, dst string")
    seeds = ["hub", "n3", "m5", "alone", "alone", None]
    near = defaultdict(set)
    for a, b in both:
        near[a].add(b)
    want = set()
    for seed in set(seeds) - {None}:
        seen, last = {seed}, {seed}
        want.add((seed, seed, 0))
        for hop in (1, 2, 3):
            last = {b for a in last for b in near[a]} - seen
            seen |= last
            want |= {(seed, b, hop) for b in last}
    for most in (7, 100):
        rows = graph.reach_from_each(edge, spark.createDataFrame([(s,) for s in seeds], "node string"), 3, most).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert graph.reach_from_each(edge.limit(0), spark.createDataFrame([], "node string")).collect() == []


def test_pages_of_day_journals_hold_the_whole_lists(spark):
    rows = [(1, "a", "b", kind, f"v{i:03}", Decimal(i), i) for kind, n in (("ref", 45), ("desc", 20), ("one", 1)) for i in range(n)]
    schema = "trx_date int, account_debit string, account_credit string, kind string, value string, amount decimal(30,2), tx_count bigint"
    frame = spark.createDataFrame(rows, schema).repartition(5)
    for limit in (1000, 10):
        pages = reports.account_pair_pages(frame, 20, limit).collect()
        assert sorted((p.kind, p.page, p.n_lines) for p in pages) == [("desc", 1, 20), ("one", 1, 1), ("ref", 1, 20), ("ref", 2, 20), ("ref", 3, 5)]
        flat = [(p.trx_date, p.account_debit, p.account_credit, p.kind, *x) for p in pages for x in p.lines]
        assert sorted(flat) == sorted(rows)
        assert all(p.page_amount == sum(x.amount for x in p.lines) for p in pages)
        ref = [x.value for p in sorted(pages, key=lambda p: p.page) if p.kind == "ref" for x in p.lines]
        assert ref == sorted(ref)
    assert reports.account_pair_pages(frame.limit(0), 20).collect() == []
