"""Document fingerprints by locally consistent parsing.

A text is a row of bytes. Each level first folds runs of one symbol, then tosses coins deterministically: a
symbol's label becomes the lowest bit in which it differs from its left neighbour, and that bit's value; some
rounds leave six labels, equal ones never side by side. A phrase starts at each local maximum of the labels, and
the hash of its symbols is its name, a symbol of the next level. Labels look a few symbols to the left only, so
equal substrings get the same names inside, wherever they stand.

The fingerprint keeps, for the names of each of two levels (phrases of about 10 and 30 bytes), the least hash of
each of 32 bins; likeness is the share of filled bins that agree. An empty or null text has empty bins only; it
is like another such text (1.0) and unlike every other (0.0). Equal texts have equal fingerprints.

To pair each document with the next one in doc_id order, rows are dealt by ranges of doc_id and sorted
there; the first row of each range is also sent to the end of the range before, and that of the first range to
the last. A null doc_id comes after all others; rows that share a doc_id are ordered by their text. An empty
table gives an empty frame, other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import shuffle_partitions

U64 = np.uint64
LEVELS, BINS, EMPTY = (2, 3), 32, 0xFFFF
BATCH_BYTES = 1 << 20
LAST = 2**63 - 1
#: Ranges of doc_id with about equal numbers of rows; each is cut further by width, into MOST_CUTS at most.
RANGES, RANGE_ROWS, MOST_CUTS = 64, 2_000, 1_024
#: Odd multipliers by place in a phrase; no phrase is longer.
PLACES = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, U64), dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def tossed(label: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One round: twice the lowest differing bit, plus that bit of the label."""
    one = label.dtype.type(1)
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[start] = label[start] ^ one
    apart = label ^ left
    low = np.bitwise_count((apart & (~apart + one)) - one)
    return (low << np.uint8(1)) | ((label >> low.astype(label.dtype)) & one).astype(np.uint8)


def phrases(symbol: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of a level, and which of them begin a text."""
    new = start.copy()
    new[1:] |= symbol[1:] != symbol[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.r_[at, len(symbol)]).astype(U64)
    label, start = symbol[at], start[at]
    name = mix(label.astype(U64) + length * U64(0xA24BAED4963EE407))
    for _ in range(rounds):
        label = tossed(label, start)
    label = label.astype(np.int8)
    left, right = np.full(len(label), -1, np.int8), np.full(len(label), -1, np.int8)
    left[1:], right[:-1] = label[:-1], label[1:]
    left[start] = -1
    right[:-1][start[1:]] = -1
    cut = np.flatnonzero(start | ((label > left) & (label > right)))
    size = np.diff(np.r_[cut, len(label)])
    place = np.arange(len(label)) - np.repeat(cut, size)
    total = np.add.reduceat(name * PLACES[place], cut)
    return mix(total + size.astype(U64)), start[cut]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of bins (uint16) for each text."""
    out = np.full(len(texts) * len(LEVELS) * BINS, 0xFFFFFFFF, np.uint32)
    filled = [k for k, t in enumerate(texts) if t]
    if filled:
        symbol = np.frombuffer(b"".join(texts[k] for k in filled), np.uint8)
        start = np.zeros(len(symbol), bool)
        sizes = np.fromiter((len(texts[k]) for k in filled), np.int64, len(filled))
        start[np.cumsum(sizes) - sizes] = True
        owner = np.array(filled)
        for level in range(1, max(LEVELS) + 1):
            symbol, start = phrases(symbol, start, 3 if level == 1 else 4)
            if level in LEVELS:
                row = owner[np.cumsum(start) - 1] * len(LEVELS) + LEVELS.index(level)
                bins = row * BINS + (symbol & U64(BINS - 1)).astype(np.int64)
                np.minimum.at(out, bins, (symbol >> U64(32)).astype(np.uint32))
    short = (out & np.uint32(0xFFFF)).astype(np.uint16)
    short[(short == EMPTY) & (out != 0xFFFFFFFF)] = EMPTY - 1
    return short.reshape(len(texts), len(LEVELS) * BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins filled in either fingerprint that agree, row by row."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _judge(rows: list[tuple]) -> pa.RecordBatch:
    """``rows``: (doc_id, text) in order; the last one only stands after the others."""
    texts = [t for _, t in rows]
    changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    prints = fingerprints([t.encode() for t in texts])
    after = fingerprints(changed)
    own = prints[:-1]
    columns = [
        [i for i, _ in rows[:-1]],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(t).hexdigest() for t in changed],
        [x.astype(">u2").tobytes().hex() for x in own],
        [x.astype(">u2").tobytes().hex() for x in after],
        likeness(own, after),
        likeness(own, prints[1:]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], NAMES)


def _run(batches):
    held, size = [], 0
    for batch in batches:
        for last, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_head", "doc_id", "text"))):
            text = text or ""
            held.append((doc_id, text))
            size += len(text)
            if last or size >= BATCH_BYTES and len(held) > 1:
                yield _judge(held)
                held, size = ([], 0) if last else (held[-1:], len(text))
    if held:
        raise ValueError("a range without the first row of the next one")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last half of its signs (rounded down) replaced by as many from the start of the next
    text. The text is shuffled once.
    """
    spark = docs.sparkSession
    count = docs.count()
    sub = max(1, min(MOST_CUTS, -(-count // (RANGES * RANGE_ROWS))), -(-shuffle_partitions(spark) // RANGES))
    probes = [k / RANGES for k in range(RANGES + 1)]
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", probes, 1 / (4 * RANGES))})
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    if len(cuts) > 1:
        array = "array(" + ",".join(f"{c}L" for c in cuts) + ")"
        cell = f"least(greatest(size(filter({array}, c -> c <= _id)), 1), {len(cuts) - 1})"
        lo, hi = f"{array}[_cell - 1]", f"{array}[_cell]"
        inside = f"CAST((least(greatest(_id, {lo}), {hi}) - {lo}) / ({hi} - {lo}) * {sub} AS int)"
        placed = docs.select(key.alias("_id"), "doc_id", "text").withColumn("_cell", F.expr(cell))
        placed = placed.withColumn("_range", F.expr(f"_cell * {sub + 1} + {inside}")).drop("_cell")
    else:
        placed = docs.select(key.alias("_id"), "doc_id", "text").withColumn("_range", F.lit(0))
    # One row per range: RANGES * (MOST_CUTS + 1) rows of three numbers at most, so they may be broadcast.
    firsts = placed.groupBy("_range").agg(F.min("_id").alias("_first"))
    order = Window.orderBy("_range")
    before = F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy()))
    spots = firsts.select(F.col("_range").alias("_of"), "_first", before.alias("_before"))
    at = (placed["_range"] == spots["_of"]) & (placed["_id"] == spots["_first"])
    heads = placed.join(F.broadcast(spots), at).groupBy("_before").agg(F.first("_id").alias("_id"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    heads = heads.select("_id", F.lit(None).cast("long").alias("doc_id"), "text", F.col("_before").alias("_range"), F.lit(True).alias("_head"))
    rows = placed.select("_id", F.col("doc_id").cast("long").alias("doc_id"), "text", "_range", F.lit(False).alias("_head"))
    dealt = rows.unionByName(heads).repartition(shuffle_partitions(spark), "_range")
    dealt = dealt.sortWithinPartitions("_range", "_head", "_id", F.coalesce("text", F.lit("")))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("_head", "doc_id", "text").mapInArrow(_run, schema)
