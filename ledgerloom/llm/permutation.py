"""Nearest neighbours by a permutation index.

Pivots are unit vectors of a bounded sample. A vector is represented by its ``order`` nearest pivots, nearest first,
and posted in the inverted file of each of them with its rank there. A query adds up, over the files of its own
nearest pivots, how far the ranks are apart; a pivot that only one of the two has counts as half the order. The share
``rerank`` of a block with the least footrule distances is compared exactly.

Orders say nothing of lengths, so a block holds vectors of about one length: within a factor of 2 ** 0.125. There a
near order is a large inner product, and the best of all blocks are told apart by their exact products; with
``rerank=1`` everything is compared. Lengths are dealt into blocks by class and hash; every block of queries meets every block of the index (queries are a stated set), each
pair in one task, which returns the best ``k`` of the block. Identical vectors are one entry of the index, which
carries its ``k + 1`` smallest ids: no other can be among the nearest ``k``.

Nearness is the inner product in double precision. Vectors that are null, zero, or hold null or non-finite
components, and rows without id, take no part; of several vectors with one id each is an entry. Vectors of another
dimension than the pivots take no part either. Empty tables give empty frames; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

PIVOTS, ORDER, RERANK = 256, 64, 0.15
SAMPLE = 2_048  #: rows the pivots are chosen from
CLASSES = 8  #: length classes for a factor of two
INDEX_BLOCK, QUERY_BLOCK = 4_096, 32_768
SEED = 3


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, in double precision."""
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def _vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def choose_pivots(rows: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Unit vectors of the rows with the smallest hashes: of ``sample`` at most, so many that are far apart."""
    picked = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(sample).select("vec").collect()
    if not picked:
        return np.empty((0, 0))
    width = np.bincount([len(r.vec) for r in picked]).argmax()
    found = np.array([r.vec for r in picked if len(r.vec) == width])
    found = found / np.linalg.norm(found, axis=1, keepdims=True)
    chosen = [0]
    near = found @ found[0]
    while len(chosen) < min(pivots, len(found)):  # the first half far from those chosen, the others as they come
        if len(chosen) >= pivots // 2:
            rest = np.setdiff1d(np.arange(len(found)), chosen)
            chosen += rest[: pivots - len(chosen)].tolist()
            break
        chosen.append(int(near.argmin()))
        near = np.maximum(near, found @ found[chosen[-1]])
    return found[chosen]


def orders(vectors: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :order]


def _search(pivots: np.ndarray, order: int, rerank: float, k: int):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and index.num_rows:
            vectors, ids = _vectors(index.column("vec")), index.column("ids").to_pylist()
            query, names = _vectors(queries.column("vec")), queries.column("vec_id").to_numpy()
            ranks = orders(vectors, pivots, order)
            # Inverted files: of each pivot the entries posted there, with the rank it has for them.
            by = np.argsort(ranks, axis=None, kind="stable")
            entry, rank = np.divmod(by, ranks.shape[1])
            bounds = np.searchsorted(ranks.ravel()[by], np.arange(len(pivots) + 1))
            absent = ranks.shape[1] // 2
            take = min(len(vectors), max(16 * k, int(np.ceil(rerank * len(vectors)))))
            for name, q, own in zip(names, query, orders(query, pivots, order)):
                far = np.zeros(len(vectors), np.int32)
                for place, pivot in enumerate(own):
                    files = slice(bounds[pivot], bounds[pivot + 1])
                    far[entry[files]] += np.abs(rank[files] - place).astype(np.int32) - 2 * absent
                best = np.argpartition(far, take - 1)[:take]
                score = np.array([np.dot(v, q) for v in vectors[best]]) if take < 64 else vectors[best] @ q
                edge = np.sort(score)[-min(len(score), k + 1)]
                for at in np.flatnonzero(score >= edge - 1e-12):
                    exact = float(np.dot(vectors[best[at]], q))
                    out += [(int(name), i, exact) for i in ids[best[at]] if i != name]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    order: int = ORDER,
    rerank: float = RERANK,
    sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest rows found for each query, without itself.

    ``queries`` has the columns of ``vectors``. The pivots are fitted on a sample of ``sample`` rows at most.
    """
    rows = usable(vectors, id_, vector)
    points = choose_pivots(rows, pivots, sample)
    schema = "query_id long, vec_id long, score double"
    if not len(points):
        return rows.sparkSession.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    width = points.shape[1]
    rows = rows.where(F.size("vec") == width)
    asked = usable(queries, id_, vector).where(F.size("vec") == width)
    long = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / F.col("_long")) * (x / F.col("_long")))
    length = F.log2("_long") + F.log2(square) / 2
    rows = rows.withColumn("_long", long).withColumn("class", F.round(length * CLASSES).cast("int")).drop("_long")
    # A double has 2,100 powers of two, so there are some 17,000 classes at most.
    sizes = rows.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / INDEX_BLOCK).cast("int").alias("blocks"))
    before = F.sum("blocks").over(Window.orderBy("class")) - F.col("blocks")
    sizes = written(sizes.withColumn("before", before.cast("int")), "length-classes")
    blocks = sizes.agg(F.coalesce(F.sum("blocks"), F.lit(1)).cast("int")).first()[0]
    turns = max(1, -(-asked.count() // QUERY_BLOCK))
    same = Window.partitionBy("vec").orderBy("vec_id")
    kept = rows.withColumn("_at", F.row_number().over(same)).where(F.col("_at") <= k + 1)
    entries = kept.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("class").alias("class"))
    entries = entries.join(F.broadcast(sizes), "class")
    number = (F.col("before") + F.pmod(F.xxhash64(F.lit(1), F.col("ids")[0]), F.col("blocks"))).cast("int")
    turn = F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(turns)).cast("int")
    index = entries.select("vec", "ids", number.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    spread = asked.select("vec", "vec_id", turn.alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = spread.groupBy("turn", "block").cogroup(index.groupBy("turn", "block"))
    found = pairs.applyInArrow(_search(points, order, rerank, k), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
