"""Quality classifier: ridge regression on random Fourier features, isotonic calibration.

Statistics of a text (lengths, shares of kinds of signs, repetition) are standardised and mapped to cosines of
random projections, which approximate a Gaussian kernel. Each partition sums its share of the normal equations, by
fold; the sums are added up by further tasks and solved on the driver, where their size is fixed. Scores of each
fold come from the other folds' equations; a monotone step function fitted to them turns scores into
probabilities, linear between the steps' centres.

All labelled rows of the training folds are used. A null or empty text has zero statistics and a score like
any other. Labels other than 0 and 1, and null labels, are left out; several labels of a document count as
several rows, several rows of a doc_id get each label. Without labels of both kinds every score is the share of
label 1 (0.5 if there are none). Empty tables give empty frames; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

FEATURES, RIDGE, SEED, GAMMA = 256, 3.0, 5, 0.04
FOLDS, BINS = 4, 2048
THRESHOLD = 0.3
STATISTICS = [
    "log_bytes", "log_words", "word_length", "long_words", "short_words", "upper", "digit", "symbol", "bang", "bar",
    "stop", "comma", "blank", "line_share", "line_length", "high_bytes", "distinct_words", "top_word", "distinct_lines",
    "capitals", "tail_signs", "entropy",
]

#: Kinds of bytes, a column each: upper case, digits, symbols, !, |, full stops, commas, white space, line ends, high bytes.
KINDS = np.zeros((256, 10))
for _column, _signs in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@[\\]^_`{}~", b"!", b"|", b".", b",", b" \t\n\r\x0b\x0c", b"\n", bytes(range(128, 256)))
):
    KINDS[list(_signs), _column] = 1


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(len(STATISTICS))
    n, m = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, symbol, bang, bar, stop, comma, blank, line, high = (counts @ KINDS) / n
    sizes = np.fromiter(map(len, words), np.int64, m)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = counts[counts > 0] / n
    return np.array([
        np.log1p(n), np.log1p(m), sizes.mean(), (sizes > 12).mean(), (sizes < 4).mean(), upper, digit, symbol, bang, bar,
        stop, comma, blank, line, np.log1p(n / len(lines)), high, len(tally) / m, max(tally.values()) / m,
        len(set(lines)) / len(lines), sum(w[:1].isupper() for w in words) / m, sum(w[-1] in TAIL for w in words) / m,
        -(share * np.log(share)).sum(),
    ])


TAIL = frozenset(b"#$%&*!|")


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row, as an array."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            values = pa.array(np.concatenate(rows) if rows else np.empty(0), pa.float64())
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, values)], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


class Kernel:
    """Standardised statistics to Fourier features of a Gaussian kernel, plus a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.project = draw.normal(0, np.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.phase = draw.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.project + self.phase), np.ones((len(x), 1))])


SIDE = FEATURES + 1


def _equations(kernel: Kernel):
    """Task: normal equations of its rows, by fold."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            z, y = kernel(_matrix(batch.column("x"))), batch.column("y").to_numpy()
            for fold in np.unique(folds):
                part = z[folds == fold]
                total = sums.setdefault(int(fold), np.zeros((SIDE, SIDE + 1)))
                total[:, :-1] += part.T @ part
                total[:, -1] += part.T @ y[folds == fold]
        yield from _packed(sums)

    return run


def _packed(sums):
    if sums:
        arrays = [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["fold", "sums"])


def _added(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for fold, part in zip(batch.column("fold").to_pylist(), batch.column("sums").to_pylist()):
            sums[fold] = sums.get(fold, 0) + np.frombuffer(part).reshape(SIDE, SIDE + 1)
    yield from _packed(sums)


def solved(sums: np.ndarray) -> np.ndarray:
    penalty = np.eye(SIDE) * RIDGE
    penalty[-1, -1] = 1e-6
    return np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])


def isotonic(bins: np.ndarray, rows: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the monotone steps that fit the shares of ones best, by pooling neighbours."""
    steps: list[list[float]] = []
    for at, n, y in zip(bins, rows, ones):
        steps.append([at * n, n, y])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last)]
    return np.array([s[0] / s[1] for s in steps]), np.array([s[2] / s[1] for s in steps])


def binned(raw: np.ndarray) -> np.ndarray:
    """Bin of a raw score; scores reach from -0.5 to 1.5, further ones fall into the outer bins."""
    return np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1)


def _bins(kernel: Kernel, weights: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            z, raw = kernel(_matrix(batch.column("x"))), np.zeros(batch.num_rows)
            for fold in np.unique(folds):
                raw[folds == fold] = z[folds == fold] @ weights[int(fold)]
            y = pa.array(batch.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(binned(raw).astype(np.int32)), y], ["bin", "y"])

    return run


def _scores(kernel, weights, centres, levels):
    def run(batches):
        for batch in batches:
            if kernel is None:
                score = np.full(batch.num_rows, levels[0])
            else:
                raw = np.clip((kernel(_matrix(batch.column("x"))) @ weights + 0.5) / 2 * BINS - 0.5, 0, BINS - 1)
                score = np.clip(np.interp(raw, centres, levels), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; rows held out are those whose crc32(doc_id) mod 5 is 0."""
    remainder = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5
    rows = written(document_statistics(docs), "statistics")
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("_of"), F.col("quality").cast("double").alias("y"))
    learn = rows.join(known, rows["doc_id"] == known["_of"]).withColumn("fold", remainder.cast("int")).where("fold <> 0")
    learn = learn.select("fold", "x", "y")
    shares = learn.agg(F.count(F.lit(1)), F.sum("y"), *[
        f(F.col("x")[k]) for f in (F.avg, F.stddev_pop) for k in range(len(STATISTICS))
    ]).first()
    kernel, weights, centres, levels = None, None, None, np.array([0.5])
    if shares[0]:
        levels = np.array([shares[1] / shares[0]])
    if shares[0] and 0 < shares[1] < shares[0]:
        mean, scale = np.array(shares[2:], float).reshape(2, -1)
        kernel = Kernel(mean, np.where(scale > 1e-9, scale, 1.0))
        packed = "fold int, sums binary"
        sums = learn.mapInArrow(_equations(kernel), packed).repartition(16).mapInArrow(_added, packed)
        total: dict[int, np.ndarray] = {}
        for row in sums.collect():  # 16 tasks, 4 folds, half a megabyte each at most
            total[row.fold] = total.get(row.fold, 0) + np.frombuffer(row.sums).reshape(SIDE, SIDE + 1)
        whole = sum(total.values())
        weights = solved(whole)
        others = {fold: solved(whole - part) for fold, part in total.items()}
        bins = learn.mapInArrow(_bins(kernel, others), "bin int, y double").groupBy("bin")
        found = np.array(sorted(map(tuple, bins.agg(F.count(F.lit(1)), F.sum("y")).collect())), float)  # a row per bin
        centres, levels = isotonic(*found.T)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scores(kernel, weights, centres, levels), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
