"""Language-model scores by context-tree weighting.

A text stands for its lower-cased words, joined by blanks and closed by an end sign. Each byte is eight binary
choices; the context of a choice is the bits of its byte so far and up to ``DEPTH`` bytes before. Every node of
the tree of contexts has Krichevsky-Trofimov estimates, and the weight of a node halves between its own estimate
and those of the contexts one byte longer. All of it follows from counts of (DEPTH + 1)-byte strings, so
training is counting.

Documents are dealt into blocks of about ``block_bytes`` of text by hash. A block sends its distinct strings and words
with their counts in training texts; they are summed over blocks, strings that share their last two context
bytes meet in one task, and the two upper levels of the tree, of a fixed size, go through the driver. For each string
this gives one log probability, which goes back to the blocks that hold the string, where texts are scored. So the
model is never whole in one place, and a task holds one block or one share of the strings.

Words are compared by 63 bits of their xxh3 hash. A null or empty text is its end sign only. Rows without
doc_id belong to training (no remainder). Equal rows get equal scores. With no training texts at all, every
estimate is that of an empty tree. Empty tables give empty frames; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import shuffle_partitions, written
from ledgerloom.llm.substring import words_of

U64 = np.uint64
DEPTH = 5
END = 255  #: not a byte of UTF-8; also stands before the first byte
UPPER = 2  #: levels of the tree above those built in tasks
BLOCK_BYTES = 32 << 20
CHUNK = 4 << 20
HALF = np.log(0.5)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = 1 << 63


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % modulus == remainder, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words)) | U64(WORD)


def string_keys(line: np.ndarray) -> np.ndarray:
    """Each byte with the DEPTH bytes before it, the latest lowest. ``line`` starts with DEPTH end signs."""
    key = np.zeros(len(line) - DEPTH, U64)
    for k in range(DEPTH + 1):
        key = (key << U64(8)) | line[k : len(line) - DEPTH + k].astype(U64)
    return key


def padded(words: list[bytes]) -> bytes:
    return bytes([END]) * DEPTH + b" ".join(words) + bytes([END])


class Tally:
    """Distinct keys with counts, folded together when they have grown."""

    def __init__(self):
        self.keys, self.counts, self.pending = np.empty(0, U64), np.empty(0, np.int64), []

    def add(self, keys, counts):
        self.pending.append((keys, counts))

    def fold(self):
        keys = np.concatenate([self.keys, *(k for k, _ in self.pending)])
        counts = np.concatenate([self.counts, *(c for _, c in self.pending)])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.keys)).astype(np.int64)
        self.pending = []


def _block_keys(table: pa.Table) -> pa.Table:
    """Distinct strings and words of a block with their counts in training texts."""
    tally, line, size = Tally(), {True: [], False: []}, 0

    def flush():
        for learn, parts in line.items():
            if parts:
                text = np.frombuffer(b"".join(p for p, _ in parts), np.uint8)
                keys = string_keys(text)
                # Strings that reach over the start of a text aren't any; each text begins with DEPTH end signs.
                ends = np.cumsum([len(p) for p, _ in parts])
                keep = np.ones(len(text), bool)
                for k in range(DEPTH):
                    keep[np.r_[0, ends[:-1]] + k] = False
                words = word_keys([w for _, ws in parts for w in ws])
                for part in (keys[keep[DEPTH:]], words):
                    found, counts = np.unique(part, return_counts=True)
                    tally.add(found, counts * int(learn))
                parts.clear()
        tally.fold()

    for batch in table.to_batches(max_chunksize=2000):
        for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
            words = tokens(text)
            line[not held].append((padded(words), words))
            size += len(line[not held][-1][0])
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    block = np.full(len(tally.keys), table.column("block")[0].as_py(), np.int32)
    return pa.table({"block": block, "key": tally.keys.view(np.int64), "n": tally.counts})


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma_half(a) + log_gamma_half(b) - log_factorial(a + b)


def log_gamma_half(n):
    """log(gamma(n + 1/2) / gamma(1/2))."""
    return _stirling(n + 0.5) - _stirling(np.float64(0.5))


def log_factorial(n):
    return _stirling(n + 1.0)


def _stirling(x):
    """Log gamma by its asymptotic series, after eight steps of the recurrence."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    x = x + 8
    inv = 1 / x
    series = inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680)))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


class Level:
    """Nodes of one depth, for each number of bits known of the byte: counts, estimates and weights."""

    def __init__(self, depth: int, keys: np.ndarray, counts: np.ndarray, below: Level | None):
        self.depth = depth
        mask = U64((1 << 8 * (depth + 1)) - 1)
        self.keys, self.at = np.unique(keys & mask, return_inverse=True)
        count = np.bincount(self.at, counts, len(self.keys))
        self.nodes, self.of, self.zeros, self.ones, self.kt, self.weight = [], [], [], [], [], []
        for k in range(8):
            value = self.keys >> U64(8 - k)
            first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            of = np.cumsum(np.r_[True, value[1:] != value[:-1]]) - 1
            bit = ((self.keys >> U64(7 - k)) & U64(1)).astype(bool)
            zeros = np.bincount(of, count * ~bit, len(first))
            ones = np.bincount(of, count * bit, len(first))
            kt = log_kt(zeros, ones)
            if below is None:
                weight = kt
            else:
                parent = np.searchsorted(value[first], below.nodes[k] & U64((1 << 8 * depth + k) - 1))
                longer = np.bincount(parent, below.weight[k], len(first))
                weight = np.logaddexp(HALF + kt, HALF + longer)
            for held, x in zip((self.nodes, self.of, self.zeros, self.ones, self.kt, self.weight), (value[first], of, zeros, ones, kt, weight)):
                held.append(x)

    def estimates(self, k: int):
        """Of each key, the estimate of its bit after k bits and the share its node gives to its own estimate."""
        of = self.of[k]
        bit = ((self.keys >> U64(7 - k)) & U64(1)).astype(bool)
        own = np.where(bit, self.ones[k][of], self.zeros[k][of])
        p = (own + 0.5) / (self.zeros[k][of] + self.ones[k][of] + 1)
        return p, np.exp(HALF + self.kt[k] - self.weight[k])[of]


def lower_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    levels: list[Level] = []
    for depth in range(DEPTH, UPPER - 1, -1):
        levels.insert(0, Level(depth, keys, counts, levels[0] if levels else None))
    return levels


def _read(batches, *columns):
    batches = list(batches)
    if not batches:
        return None
    whole = pa.Table.from_batches(batches).combine_chunks()
    return [whole.column(c).combine_chunks() for c in columns]


def _upper_sums(batches):
    """Sums over the children of each node of depth UPPER - 1: counts and log weights."""
    got = _read(batches, "key", "n")
    if got is None or not len(got[0]):
        return
    keys, counts = got[0].to_numpy().view(U64), got[1].to_numpy()
    lowest = lower_levels(keys, counts)[0]
    for k in range(8):
        above = lowest.nodes[k] & U64((1 << 8 * (UPPER - 1) + k) - 1)
        node, at = np.unique(above, return_inverse=True)
        sums = [np.bincount(at, x[k], len(node)) for x in (lowest.zeros, lowest.ones, lowest.weight)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(node), k, np.int32)), pa.array(node.astype(np.int64)), *map(pa.array, sums)],
            ["bits", "node", "zeros", "ones", "longer"],
        )


def upper_table(rows) -> list[list[np.ndarray]]:
    """[depth][bits] -> (zeros, ones, share of the own estimate) by node, for the depths 0 and 1.

    ``rows`` are the sums per node of depth 1: 255 choices for 256 contexts at most.
    """
    table: list[list[np.ndarray]] = [[], []]
    for k in range(8):
        sums = np.zeros((3, 1 << 8 + k))
        for bits, node, *values in rows:
            if bits == k:
                sums[:, node] = values
        kt = log_kt(sums[0], sums[1])
        weight = np.logaddexp(HALF + kt, HALF + sums[2])
        table[1].append(np.stack([sums[0], sums[1], np.exp(HALF + kt - weight)]))
        short = sums.reshape(3, 256, 1 << k).sum(1)
        kt0 = log_kt(short[0], short[1])
        weight0 = np.logaddexp(HALF + kt0, HALF + weight.reshape(256, 1 << k).sum(0))
        table[0].append(np.stack([short[0], short[1], np.exp(HALF + kt0 - weight0)]))
    return table


def string_scores(keys: np.ndarray, counts: np.ndarray, upper) -> np.ndarray:
    """Log10 probability of the last byte of each string after the others."""
    levels = lower_levels(keys, counts)
    total = np.zeros(len(keys))
    byte = keys & U64(255)
    last = (keys >> U64(8)) & U64(255)
    for k in range(8):
        p = None
        for level in reversed(levels):
            own, share = (x[level.at] for x in level.estimates(k))
            p = own if p is None else share * own + (1 - share) * p
        bit = ((byte >> U64(7 - k)) & U64(1)).astype(np.int64)
        known = (byte >> U64(8 - k)).astype(np.int64)
        for depth in (1, 0):
            zeros, ones, share = upper[depth][k][:, known + ((last.astype(np.int64) << k) if depth else 0)]
            own = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
            p = share * own + (1 - share) * p
        total += np.log10(p)
    return total


def _scorer(upper):
    def run(batches):
        got = _read(batches, "key", "n", "blocks")
        if got is None or not len(got[0]):
            return
        keys, counts = got[0].to_numpy().view(U64), got[1].to_numpy()
        score = string_scores(keys, counts, upper)
        for s in range(0, len(keys), 50_000):
            part = slice(s, s + 50_000)
            yield pa.RecordBatch.from_arrays(
                [got[0][part], pa.array(score[part]), got[2][part].cast(pa.list_(pa.int32()))], ["key", "value", "blocks"]
            )

    return run


def _block_scores(n_train: int, vocabulary: int, ends: int):
    total = n_train + vocabulary + 1

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        key = values.column("key").to_numpy().view(U64)
        order = np.argsort(key)
        key, value = key[order], values.column("value").to_numpy()[order]
        rows = []
        for batch in texts.to_batches(max_chunksize=2000):
            for doc_id, text, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out"))):
                words = tokens(text)
                strings = np.sort(string_keys(np.frombuffer(padded(words), np.uint8)))
                score = value[np.searchsorted(key, strings)].sum()
                counts = value[np.searchsorted(key, np.sort(word_keys(words)))] if words else np.empty(0)
                counts = np.append(counts, float(ends))
                base = np.log10((counts + 1) / total).sum()
                rows.append((doc_id, held, len(counts), int((counts > 0).sum()), n_train, float(base), float(score)))
        columns = list(zip(*rows)) if rows else [[]] * len(OUT)
        return pa.table([pa.array(c, k) for c, k in zip(columns, KINDS)], names=OUT)

    return run


OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TASK_STRINGS = 600_000


def lm_scores(docs: DataFrame, held: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    ``held`` says which rows the model must not learn from. base_score is that of the words on their own, with
    one added to each count.
    """
    spark = docs.sparkSession
    held = held_out(F.col("doc_id")) if held is None else held
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64(F.lit(11), "doc_id", F.substring("text", 1, 64)), F.lit(blocks)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), block.alias("block"))
    found = rows.groupBy("block").applyInArrow(_block_keys, "block int, key long, n long")
    # One row per distinct key; the list holds each block of documents once.
    summed = written(found.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks")), "keys")
    words, strings = summed.where("key < 0"), summed.where("key >= 0")
    seen = words.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    ends = rows.where("NOT held_out").count()
    n_train = (seen[1] or 0) + ends
    vocabulary = seen[0] + (1 if ends else 0)
    tasks = max(shuffle_partitions(spark), -(-strings.count() // TASK_STRINGS))
    near = F.expr("shiftright(key, 8) & 65535")  # the two latest context bytes
    sums = strings.select("key", "n").repartition(tasks, near).mapInArrow(_upper_sums, "bits int, node long, zeros double, ones double, longer double")
    upper = sums.groupBy("bits", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("longer"))
    table = upper_table([tuple(r) for r in upper.collect()])  # 65,280 rows at most, whatever the input
    scored = strings.repartition(tasks, near).mapInArrow(_scorer(table), "key long, value double, blocks array<int>")
    valued = scored.union(words.select("key", F.col("n").cast("double"), "blocks"))
    spread = valued.select("key", "value", F.explode("blocks").alias("block"))
    cogrouped = rows.groupBy("block").cogroup(spread.groupBy("block"))
    return cogrouped.applyInArrow(_block_scores(n_train, vocabulary, ends), SCHEMA)
