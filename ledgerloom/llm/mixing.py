"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, shuffled by a seeded hash, form blocks of ``block_rows``. Target weights are whole ticks w out of
W = 2^40, so they are the given weights but for one part in 10^12. Block j of a source may start from slot
floor(j W / w) on (its release) and must have had its slot by ceil((j + 1) W / w) (its deadline); at each slot the
released block with the earliest deadline goes next. The full load makes this schedule feasible without idle
slots, so every source stays within one block of its target at every slot. When a source has run out, the others
go on from their releases, or, with ``repeat``, it starts again until each source has been used once in full.

The schedule is a loop of the driver over blocks, a sixteenth of the rows, that reads only the number of blocks of
each source; it is written as a table (source, block, slot) and joined to the rows by (source, block).

A null source is a source of its own, null and empty texts are rows like any other, equal rows take
neighbouring places, and an empty table gives an empty frame.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import hash_bucket, numbered, source_key, written

PERIOD = 1000
#: Ticks the weights are rounded to for the schedule.
FINE = 1 << 40


def tempered_weights(docs: DataFrame, power: float = 0.7) -> DataFrame:
    """Target weights (_source, weight) that flatten the sources' shares of rows by ``power``."""
    counts = docs.groupBy(source_key().alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("_source", F.pow(F.col("_n").cast("double"), F.lit(power)).alias("weight"))


def ticks_of(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """Weights as whole ticks that add up to ``period``: one each at least, then by largest remainder.

    One row per source; more sources than ``period`` raise an error, since each needs a slot.
    """
    everything = Window.partitionBy()
    shared = weights.select(
        "_source",
        F.col("weight").cast("double").alias("weight"),
        F.count(F.lit(1)).over(everything).alias("_m"),
        F.sum(F.col("weight").cast("double")).over(everything).alias("_all"),
    ).withColumn("_part", F.col("weight") / F.col("_all") * (F.lit(period) - F.col("_m")))
    shared = shared.withColumn("_floor", F.floor("_part"))
    order = Window.orderBy(F.desc(F.col("_part") - F.col("_floor")), F.asc("_source"))
    left = F.lit(period) - F.col("_m") - F.sum("_floor").over(everything)
    extra = F.when(F.row_number().over(order) <= left, 1).otherwise(0)
    ticks = (1 + F.col("_floor") + extra).cast("long")
    fits = F.when(F.col("_m") > period, F.raise_error(F.lit("more sources than slots in a period")).cast("long"))
    return shared.select("_source", F.coalesce(fits, ticks).alias("ticks"))


def period_slots(ticks: DataFrame, period: int = PERIOD) -> DataFrame:
    """(_source, ticks, _turn, _slot): one short period of the schedule as a SQL fold, ``period`` rows; tests compare it."""
    sources = ticks.agg(F.sort_array(F.collect_list(F.struct("_source", "ticks"))).alias("s")).where(F.size("s") > 0)
    ready = (
        f"transform(filter(sequence(0, size(s) - 1), i -> get(a.used, i) < get(s, i).ticks"
        f" AND get(a.used, i) * {period} div get(s, i).ticks <= t), i -> struct("
        f"((get(a.used, i) + 1) * {period} + get(s, i).ticks - 1) div get(s, i).ticks AS due, i AS i))"
    )
    step = (
        f"get(transform(array(array_min({ready}).i), p -> struct("
        "transform(a.used, (u, i) -> IF(i = p, u + 1, u)) AS used,"
        " concat(a.picks, array(struct(p AS p, get(a.used, p) AS turn))) AS picks)), 0)"
    )
    start = "struct(transform(s, x -> 0) AS used, CAST(array() AS array<struct<p:int,turn:int>>) AS picks)"
    picks = sources.select("s", F.expr(f"aggregate(sequence(0, {period - 1}), {start}, (a, t) -> {step}).picks").alias("picks"))
    slots = picks.select("s", F.posexplode("picks").alias("_slot", "pick"))
    return slots.select(
        F.expr("get(s, pick.p)._source").alias("_source"),
        F.expr("get(s, pick.p).ticks").alias("ticks"),
        F.col("pick.turn").alias("_turn"),
        "_slot",
    )


def schedule(ticks: list[int], blocks: list[int], period: int, repeat: bool = False):
    """Arrays (source, turn, slot) of the blocks in their order, and the slot at which the first source has run out.

    ``ticks`` add up to ``period``. With ``repeat`` turns go on until turn ``blocks - 1`` of each source is placed.
    The last blocks of the first pass are then asked for as soon as they may all have been placed, and later
    only if another block would miss its deadline.
    """
    if not repeat:
        source, turn, slot, through, _ = _earliest(ticks, blocks, period, None)
        return source, turn, slot, through
    ready, extra = max((b - 1) * period // w + 1 for w, b in zip(ticks, blocks)), len(ticks)
    while True:
        source, turn, slot, through, met = _earliest(ticks, blocks, period, ready + extra)
        if met:
            return source, turn, slot, through
        extra *= 2


def _earliest(ticks, blocks, period, last):
    """One run by earliest deadline; ``last`` bounds the deadlines of the first pass, whose sources start again."""
    source, turn, slot = array("i"), array("q"), array("q")
    used, left, at, through = [0] * len(ticks), sum(blocks) if last is None else len(ticks), 0, None
    coming, ready = [(0, i) for i in range(len(ticks))], []
    while left:
        while coming and coming[0][0] <= at:
            i = heapq.heappop(coming)[1]
            due = -(-(used[i] + 1) * period // ticks[i])
            heapq.heappush(ready, (min(due, last) if last is not None and used[i] == blocks[i] - 1 else due, i))
        if not ready:
            at = coming[0][0]
            continue
        due, i = heapq.heappop(ready)
        if last is None and used[i] == blocks[i]:  # it has run out: its slot goes to the others from here on
            through = at if through is None else through
            continue
        if last is not None and due <= at:
            return source, turn, slot, at, False
        source.append(i)
        turn.append(used[i])
        slot.append(at)
        used[i] += 1
        at += 1
        left -= last is None or used[i] == blocks[i]
        heapq.heappush(coming, (used[i] * period // ticks[i], i))
    return source, turn, slot, at if through is None else through, True


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    block_rows: int = 16,
    period: int = FINE,
    seed: int = 29,
    repeat: bool = False,
) -> DataFrame:
    """``docs`` with ``mix_slot`` (long), ``mix_row`` (place in its block) and ``in_mix``.

    ``weights`` (_source as given by ``source_key``, weight) defaults to ``tempered_weights``; sources without
    a weight are left out. ``in_mix`` is true up to the slot at which the first source has run out: so far the
    mixture meets its target; all rows have a place in either case. With ``repeat`` a source starts again,
    until the slowest has been used once in full, so the whole result meets the target; ``mix_epoch`` counts.
    ``mix_ticks`` is the share of a source in thousandths. The added columns take the place of columns of these names.
    """
    weights = tempered_weights(docs) if weights is None else weights
    ticks = written(ticks_of(weights, period), "ticks")
    docs = docs.drop("mix_slot", "mix_row", "in_mix", "mix_epoch", "mix_ticks")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        source_key().alias("_source"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_hash"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_tie"),
    )
    return _placed(keyed, ticks, docs.columns, block_rows, repeat)


def _placed(keyed, ticks, columns, block_rows, repeat) -> DataFrame:
    ties = [F.col("_row.doc_id"), F.col("_tie")]
    ranked = numbered(keyed, ["_source"], F.col("_hash"), hash_bucket(F.col("_hash")), ties, "_rank")
    ranked = ranked.withColumn("_block", F.expr(f"_rank div {block_rows}"))
    slots = scheduled(keyed, ticks, block_rows, repeat)
    return ranked.join(slots, ["_source", "_block"]).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in columns],
        "mix_slot",
        F.expr(f"CAST(_rank % {block_rows} AS int)").alias("mix_row"),
        "in_mix",
        "mix_epoch",
        "mix_ticks",
    )


def scheduled(keyed: DataFrame, ticks: DataFrame, block_rows: int, repeat: bool) -> DataFrame:
    """(_source, _block, mix_epoch, mix_slot, in_mix, mix_ticks): one row per block and epoch."""
    spark = keyed.sparkSession
    counts = keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("_n")).join(ticks, "_source")
    sources = sorted((r._source, r.ticks, -(-r._n // block_rows)) for r in counts.collect())  # one row per source
    names, w, blocks = zip(*sources) if sources else ((), (), ())
    source, turn, slot, through = schedule(w, blocks, sum(w), repeat) if sources else ([], [], [], 0)
    source, turn, slot = np.array(source, np.int32), np.array(turn, np.int64), np.array(slot, np.int64)
    size = np.array(blocks, np.int64)[source] if len(source) else turn
    columns = {"_at": source, "_block": turn % np.maximum(size, 1), "mix_epoch": turn // np.maximum(size, 1), "mix_slot": slot}
    places = spark.createDataFrame(pa.table(columns | {"in_mix": np.full(len(slot), True) if repeat else slot < through}))
    places = written(places, "slots")
    known = [(k, name, t * PERIOD / sum(w)) for k, (name, t, _) in enumerate(sources)]
    named = spark.createDataFrame(known, "_at int, _source string, mix_ticks double")
    return places.join(named, "_at").drop("_at")
