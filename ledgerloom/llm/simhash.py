"""SimHash near-duplicates by binary trie self-joins.

The fingerprint of a text has a bit set if over half of its shingle hashes have it. Equal fingerprints are
one class, so copies never form pairs. Two classes within the budget of d bits agree in at least one of d + 1
blocks of bits; per block, the fingerprints are turned so that it comes first, dealt out by its value, and each
task joins its tries with themselves (``tries``). A task hands on one spanning forest of the links it finds,
not the links; components of the forests are the groups.

A block value with more than ``crowded`` fingerprints is dealt out again by pairs of its nodes 4 bits
further down, so that no task holds all of it.

A null or empty text has no shingles, fingerprint zero, and is linked like any other. Equal rows fall into one
class. A row without doc_id keeps its fingerprint and takes the group of its class. Empty tables give empty
frames; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import shuffle_partitions, written
from ledgerloom.llm.components import components
from ledgerloom.llm.tries import merge, runs, trie_pairs

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U64 = np.uint64
#: Rows of a task of the self-join.
TASK_ROWS = 300_000


@dataclass(frozen=True)
class Trie:
    """Bits [start, start + width) of the fingerprint, cut into blocks; links differ there in less bits than blocks."""

    start: int
    width: int
    blocks: tuple[int, ...]


@dataclass(frozen=True)
class Scheme:
    """How texts are hashed and compared. ``distinct`` counts a repeated shingle once."""

    shingle: int = 4
    words: int = 1
    distinct: bool = False
    budget: int = 4
    tries: tuple[Trie, ...] = (Trie(0, 64, (13, 13, 13, 13, 12)),)
    crowded: int = 50_000


#: 64 bits, 4-word shingles, links up to 4 bits: found without exception.
PLAIN = Scheme()
#: Five-word shingles and a similarity of 0.8: equal-sized sets of Jaccard similarity 0.8 have cosine 8/9, at
#: which a bit differs with probability acos(8/9)/pi = 0.1515, that is 78 of 512 bits on average with a standard
#: deviation of 8; one such deviation is allowed on top. Eight tries of 32 bits with 3 errors each find 0.91 of the
#: pairs at that border, 0.98 at similarity 0.85 and over 0.99 from 0.88 on.
SIMILAR = Scheme(5, 8, True, 86, tuple(Trie(32 * k, 32, (8, 8, 8, 8)) for k in range(8)))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, U64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    firsts = np.r_[0, ends[:-1] + 1][:n].tolist()
    lasts = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(firsts, lasts)), U64, n)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Word k of the bits of a hash: the hash itself, then further ones mixed from it."""
    if not k:
        return h
    x = h + U64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fingerprint(h: np.ndarray, words: int) -> list[int]:
    """Bits set in over half of the hashes, as signed 64-bit words."""
    if not len(h):
        return [0] * words
    out = []
    for k in range(words):
        count = np.zeros(64, np.int64)
        bits = mixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8)
        for s in range(0, len(bits), 255):  # counts of 255 rows fit a byte
            count += np.unpackbits(bits[s : s + 255], axis=1).sum(0, dtype=np.uint8)
        out.append(int(np.packbits(count * 2 > len(h)).view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, scheme: Scheme = PLAIN) -> DataFrame:
    """doc_id and the words f0, f1, ... of the fingerprint of every row."""
    names = [f"f{k}" for k in range(scheme.words)]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, scheme.shingle)
                rows.append(fingerprint(np.unique(h) if scheme.distinct else h, scheme.words))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * scheme.words
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _linked(scheme: Scheme):
    """Task of the self-join: rows (part, pair, node, f0, ...) to the edges of a spanning forest."""
    parts = [(t, sum(t.blocks[:k]), size) for t in scheme.tries for k, size in enumerate(t.blocks)]

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        whole = pa.Table.from_batches(batches)
        get = lambda c: whole.column(c).to_numpy()
        part, pair, node = get("part"), get("pair"), get("node")
        words = np.stack([get(f"f{k}").view(U64) for k in range(scheme.words)], 1)
        labels = np.arange(len(node))
        order = np.lexsort((node, pair, part))
        for lo, hi in zip(*runs(part[order].astype(np.int64) * 1024 + pair[order] + 1)):
            trie, turn, size = parts[part[order[lo]]]
            code = (words[:, trie.start // 64][order[lo:hi]] << U64(trie.start % 64)) & U64(
                (0xFFFFFFFFFFFFFFFF << (64 - trie.width)) & 0xFFFFFFFFFFFFFFFF
            )
            if turn:
                code = (code << U64(turn)) | ((code >> U64(64 - turn)) << U64(64 - trie.width))
            by = np.argsort(code, kind="stable")
            at, code = order[lo:hi][by], code[by]
            depth, roots = _roots(code, size, int(pair[order[lo]]))
            for i, j in trie_pairs(code, roots, depth, trie.width, len(trie.blocks) - 1):
                i, j = at[i], at[j]
                apart = labels[i] != labels[j]
                i, j = i[apart], j[apart]
                near = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64) <= scheme.budget
                merge(labels, i[near], j[near])
        joined = np.flatnonzero(labels != np.arange(len(labels)))
        yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[labels[joined]])], ["a", "b"])

    return run


def _roots(code, size, pair):
    """Node pairs to start from: each block value with itself, or the two nodes of a pair below it."""
    starts, ends = runs(code >> U64(64 - size))
    if pair < 0:
        return size, (starts, ends, starts, ends, np.zeros(len(starts), np.int64))
    u, v = divmod(pair, 16)
    cut = [np.searchsorted(code, (code[starts] >> U64(64 - size) << U64(4) | U64(w)) << U64(60 - size)) for w in (u, v)]
    last = []
    for w in (u, v):
        top = (code[starts] >> U64(64 - size) << U64(4) | U64(w)) << U64(60 - size)
        last.append(np.searchsorted(code, top | U64((1 << (60 - size)) - 1), "right"))
    keep = (last[0] > cut[0]) & (last[1] > cut[1])
    diff = np.full(len(starts), bin(u ^ v).count("1"), np.int64)
    return size + 4, tuple(x[keep] for x in (cut[0], last[0], cut[1], last[1], diff))


def links(classes: DataFrame, scheme: Scheme = PLAIN) -> DataFrame:
    """Edges (a, b) that join the classes (node, f0, ...) exactly as all links within the budget would."""
    spark = classes.sparkSession
    dealt = []
    part = 0
    for trie in scheme.tries:
        word, shift = F.col(f"f{trie.start // 64}"), trie.start % 64
        turn = 0
        for size in trie.blocks:
            value = F.shiftrightunsigned(word, 64 - shift - turn - size).bitwiseAND(F.lit((1 << size) - 1))
            below = []
            for bit in range(4):  # the next 4 bits, around the end of the trie
                at = shift + (turn + size + bit) % trie.width
                below.append(F.shiftleft(F.shiftrightunsigned(word, 63 - at).bitwiseAND(F.lit(1)), 3 - bit))
            nibble = below[0] + below[1] + below[2] + below[3]
            dealt.append(F.struct(F.lit(part).alias("part"), value.alias("value"), nibble.cast("int").alias("nibble")))
            part, turn = part + 1, turn + size
    names = [f"f{k}" for k in range(scheme.words)]
    rows = classes.select("node", *names, F.explode(F.array(*dealt)).alias("_d")).select("node", *names, "_d.*")
    crowds = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > scheme.crowded)
    marked = rows.join(crowds.select("part", "value", F.lit(True).alias("_crowd")), ["part", "value"], "left")
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda w: F.least(w, F.col("nibble")) * 16 + F.greatest(w, F.col("nibble"))
    )
    paired = marked.withColumn("pair", F.explode(F.when(F.col("_crowd"), pairs).otherwise(F.array(F.lit(-1)))))
    count = classes.count() * part
    tasks = max(shuffle_partitions(spark), -(-count // TASK_ROWS))
    spread = paired.select("part", "value", "pair", "node", *names).repartition(tasks, "part", "value", "pair")
    kind = classes.schema["node"].dataType.simpleString()
    return spread.drop("value").mapInArrow(_linked(scheme), f"a {kind}, b {kind}")


def near_groups(docs: DataFrame, scheme: Scheme = PLAIN) -> DataFrame:
    """doc_id, f0, ... and component_id, the smallest doc_id reachable over links, of every row."""
    names = [f"f{k}" for k in range(scheme.words)]
    prints = written(fingerprints(docs, scheme), "fingerprints")
    classes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("node")), "classes")
    stars = components(links(classes.where("node IS NOT NULL"), scheme), "near")
    named = classes.join(stars, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, names).select("doc_id", *names, "component_id")


def hex64(word) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))
