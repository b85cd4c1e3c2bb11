"""Removal of word passages that an earlier document holds, by prefix-partitioned suffix trees.

Of all suffixes (places in texts) only those at anchors are dealt out: in each window of words the place whose
next ``prefix`` words hash lowest, the leftmost of equals. Windows with equal words have their anchor at the
same offset, so the suffixes of a repeat always meet under the prefix of their anchor. Prefixes that stand in one
document only have no inner node and are left at once. The occurrences of a prefix are cut to the
words their windows cover (``segment``); equal segments are one class, decided by its smallest doc_id. The
different segments of a prefix form one subtree, built in a task by doubling: names of depth 1, 2, 4, ... words,
then of a whole window. A node of that depth holds equal windows, and its smallest doc_id keeps them.

A prefix with more than ``crowd`` different segments gets the longest prefix instead, a whole window: its
subtrees are single nodes, whose smallest doc_id is found by partial aggregation. So no task holds a hot group.

Words are maximal stretches of signs other than blank and 0x09-0x0D. A null or empty text has no words; a null
doc_id counts as the greatest. Rows that share a doc_id, or have none, never remove each other's words; each row is
judged by its own windows, since places belong to a row's doc_id and text (``place``, a hash of both, beside the id).
Empty tables give empty frames; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import shuffle_partitions, slices, written

U64 = np.uint64
WINDOW = 50
PREFIX = 10
CROWD = 4_000
LAST = 2**63 - 1
STEP = U64(0x9E3779B97F4A7C15)
BACK = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK_WORDS = 400_000


def words_of(text) -> list[bytes]:
    return text.encode().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on, put together from stretches of 1, 2, 4, ... words."""
    out, done, have, part = None, 0, 1, h
    while True:
        if size & have:
            if out is None:
                out, done = part, have
            else:
                n = len(h) - done - have + 1
                out, done = mix(out[:n] * STEP + part[done : done + n] + U64(have)), done + have
        if have * 2 > size:
            return out
        n = len(h) - 2 * have + 1
        part = mix(part[:n] * STEP + part[have : have + n])
        have *= 2


def lowest(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost lowest value of each stretch of ``width`` values."""
    at, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(v[right] < v[left], right, left)
        have += step
    return at


class Powers:
    """Powers of STEP and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def reach(self, n: int):
        while len(self.up) < n:
            m = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * (self.up[-1] * STEP)])
                self.down = np.concatenate([self.down, self.down * (self.down[-1] * BACK)])
            assert len(self.up) == 2 * m
        return self.up, self.down


def occurrences(words: list[bytes], powers: Powers, window: int = WINDOW, prefix: int = PREFIX):
    """Of each anchor: its prefix's hash, its segment's hash, its first window and the number of its windows."""
    if len(words) < window:
        return None
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), U64, len(words))
    key = grams(h, prefix)
    anchor = lowest(key, window - prefix + 1)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(anchor)])
    up, down = powers.reach(len(words) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(h * up[: len(h)], dtype=U64)])
    segment = mix((total[first + count + window - 1] - total[first]) * down[first] + count.astype(U64))
    return key[anchor[first]], segment, first, count


def find_occurrences(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(key, seg, id, place, los, n): each segment of each document once, with all words it starts at."""

    def folded(places, found):
        key, seg, lo, n = (np.concatenate(x) for x in zip(*found))
        row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        by = np.lexsort((lo, seg, key, row))
        key, seg, lo, n, row = (x[by] for x in (key, seg, lo, n, row))
        new = np.r_[True, (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]) | (row[1:] != row[:-1])]
        at = np.flatnonzero(new)
        los = pa.ListArray.from_arrays(pa.array(np.r_[at, len(lo)].astype(np.int32)), pa.array(lo.astype(np.int32)))
        ids, hashes = (np.array(x, np.int64)[row[at]] for x in zip(*places))
        arrays = [pa.array(key[at].view(np.int64)), pa.array(seg[at].view(np.int64)), pa.array(ids), pa.array(hashes), los, pa.array(n[at].astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["key", "seg", "id", "place", "los", "n"])

    def run(batches):
        powers = Powers()
        for batch in slices(batches):
            places, found = [], []
            for id_, place, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_place", "text"))):
                got = occurrences(words_of(text), powers, window, prefix)
                if got is not None:
                    places.append((id_, place))
                    found.append(got)
            if found:
                yield folded(places, found)

    return docs.select("_id", "_place", "text").mapInArrow(run, "key long, seg long, id long, place long, los array<int>, n int")


def _cutter(window: int, whole: bool):
    """Task that cuts the words of segments out of texts; ``whole``: hashes of whole windows instead."""
    names = ["name", "id", "place", "lo"] if whole else ["key", "id", "place", "lo", "n", "words"]
    kinds = [pa.binary(), *[pa.int64()] * 2, pa.int32()] if whole else [*[pa.int64()] * 3, *[pa.int32()] * 2, pa.binary()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        rows: list[tuple] = []
        for batch in slices(batches):
            for id_, place, text, spots in zip(*(batch.column(c).to_pylist() for c in ("_id", "_place", "text", "_spots"))):
                words = words_of(text)
                for spot in spots:
                    key, lo, n = spot["key"], spot["lo"], spot["n"]
                    if whole:
                        for s in range(lo, lo + n):
                            digest = xxhash.xxh3_128(b" ".join(words[s : s + window])).digest()
                            rows.append((digest, id_, place, s))
                    else:
                        rows.append((key, id_, place, lo, n, b" ".join(words[lo : lo + n + window - 1])))
                    if len(rows) >= 20_000:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    return run


def repeated_windows(segments: list[list[bytes]], groups: np.ndarray, ids: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Of each segment a bit per window: it also stands in a segment of the same group with a smaller id."""
    codes: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    flat = np.fromiter((codes.setdefault(w, len(codes)) for s in segments for w in s), np.int64, lengths.sum())
    offset = np.cumsum(lengths) - lengths
    name = np.unique(np.repeat(groups, lengths) * (len(codes) + 1) + flat, return_inverse=True)[1]
    depth = 1
    while depth * 2 <= window:
        pair = name[: len(name) - depth] * (len(flat) + 1) + name[depth:]
        name = np.unique(pair, return_inverse=True)[1]
        depth *= 2
    owner = np.repeat(np.arange(len(segments)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offset[owner] + place
    node = np.unique(name[start] * (len(flat) + 1) + name[start + window - depth], return_inverse=True)[1]
    least = np.full(node.max() + 1, LAST, np.int64)
    np.minimum.at(least, node, ids[owner])
    bits = np.where(ids[owner] > least[node], np.int64(1) << place, 0)
    return np.bitwise_or.reduceat(bits, np.cumsum(counts) - counts)


def _subtrees(window: int):
    """Task over rows sorted by key: builds the subtrees of whole groups, some groups at a time."""

    def flush(rows):
        key, ids, place, lo, n, texts = (list(x) for x in zip(*rows))
        groups = np.unique(np.array(key, np.int64), return_inverse=True)[1].astype(np.int64)
        mask = repeated_windows(
            [t.split(b" ") for t in texts], groups, np.array(ids, np.int64), np.array(n, np.int64), window
        )
        hit = np.flatnonzero(mask)
        found = [np.array(ids, np.int64)[hit], np.array(place, np.int64)[hit], np.array(lo, np.int32)[hit], mask[hit]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "place", "lo", "mask"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "place", "lo", "n", "words"))):
                if row[0] != last and size >= CHUNK_WORDS:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += row[4] + window - 1
                last = row[0]
        if held:
            yield flush(held)

    return run


def marked_windows(docs: DataFrame, near: DataFrame, window: int, crowd: int) -> DataFrame:
    """(id, place, los, mask): bit b is set if the windows that start b words after each of ``los`` are to be removed."""
    segments = near.groupBy("key", "seg").agg(F.min("id").alias("_first"))
    # Written, so that the joins below read plain exchanges, of which Spark splits a hot key's.
    sizes = written(segments.groupBy("key").agg(F.count(F.lit(1)).alias("_m")), "segment-counts")
    judged = near.join(segments.join(sizes, "key"), ["key", "seg"])
    full = F.expr("shiftleft(1L, n) - 1")
    copies = judged.where("id > _first").select("id", "place", "los", full.alias("mask"))
    firsts = judged.where("id = _first AND _m > 1").select("key", "id", "place", F.explode("los").alias("lo"), "n", "_m")

    def cut(rows: DataFrame, whole: bool, schema: str) -> DataFrame:
        spots = rows.groupBy("id", "place").agg(F.collect_list(F.struct("key", "lo", "n")).alias("_spots"))
        met = (docs["_id"] == spots["id"]) & (docs["_place"] == spots["place"])
        return docs.join(spots, met).drop("id", "place").mapInArrow(_cutter(window, whole), schema)

    groups = cut(firsts.where(F.col("_m") <= crowd), False, "key long, id long, place long, lo int, n int, words binary")
    trees = groups.repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    split = trees.mapInArrow(_subtrees(window), "id long, place long, lo int, mask long").select("id", "place", F.array("lo").alias("los"), "mask")
    windows = written(cut(firsts.where(F.col("_m") > crowd), True, "name binary, id long, place long, lo int"), "windows")
    least = written(windows.groupBy("name").agg(F.min("id").alias("_first")), "first-windows")
    crowded = windows.join(least, "name").where("id > _first")
    return copies.union(split).union(crowded.select("id", "place", F.array("lo").alias("los"), F.lit(1).cast("long").alias("mask")))


ADDED = ["n_words", "n_removed", "kept_sha256", "kept_text"]


def _remover(window: int):
    def run(batches):
        for batch in slices(batches):
            removed, kept, total, digest = [], [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("_marks").to_pylist()):
                words = words_of(text)
                total.append(len(words))
                if marks and len(words) >= window:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for mark in marks:
                        bits = mark["mask"]
                        while bits:
                            low = (bits & -bits).bit_length() - 1
                            for s in mark["los"]:
                                if s + low + window <= len(words):
                                    edge[s + low] += 1
                                    edge[s + low + window] -= 1
                            bits &= bits - 1
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, stay.tolist()) if k]
                removed.append(total[-1] - len(words))
                rest = b" ".join(words)
                kept.append(rest.decode())
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"),
                    pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(kept, pa.string()),
                ],
                ["_row", *ADDED],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, crowd: int = CROWD) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and kept_text (kept words joined by blanks).

    A word goes if a window of ``window`` words around it also starts in a document with a smaller doc_id.
    Prefixes and first-copy tables are written to the shared folder; texts are shuffled once.
    The added columns take the place of columns of these names.
    """
    if not prefix < window <= prefix + 61:
        raise ValueError("a window must be longer than its prefix, by 61 words at most")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("_row")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(id_.alias("_id"), F.xxhash64(id_, "text").alias("_place"), "text", row)
    seen = written(find_occurrences(rows, window, prefix), "anchors")
    shared = seen.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    shared = written(shared, "shared-prefixes")
    near = written(seen.join(shared, "key", "left_semi"), "shared-anchors")
    # Dealt once, by id and text: both joins below read the same exchange.
    keys = ["_place", "_id"]
    placed = rows.repartition(shuffle_partitions(docs.sparkSession), *keys)
    marks = marked_windows(placed, near, window, crowd).withColumnsRenamed({"id": "_id", "place": "_place"})
    lists = marks.groupBy(*keys).agg(F.collect_list(F.struct("los", "mask")).alias("_marks"))
    joined = placed.join(lists, keys, "left")
    schema = T.StructType([rows.schema["_row"]]).add("n_words", "long").add("n_removed", "long")
    schema = schema.add("kept_sha256", "string").add("kept_text", "string")
    return joined.mapInArrow(_remover(window), schema).select("_row.*", *ADDED)
