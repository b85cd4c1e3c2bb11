"""Near copies among vectors by an inverted multi-index.

Vectors are scaled to length 1 and cut in halves; each half has a codebook of its own, fitted by k-means on a bounded
sample. The pairs of codes are the cells of a product grid, and every vector lives in the cell of its two nearest
codes. A vector visits cells in the order of its two squared distances to their codes (multi-sequence traversal), up to
a limit above that of its own cell. Vectors are linked if one of them visits the cell of the other and the cosine,
compared in double precision, is ``cosine`` or more.

The limit is fitted to the target recall: for sample vectors, partners are made at just the least cosine in random
directions, and partners found among them are added; the limit lets ``recall`` of both kinds meet. With ``recall=1``
every vector visits every cell, which finds all links at the cost of all pairs.

Equal vectors are one class with a multiplicity. A cell with more than ``tile`` classes or visitors is cut into blocks by
a hash, and each block of visitors meets each block of residents in a task of its own, so a hot cell is
spread. A task returns one row per linked vector: how many vectors it links there (each link is counted in one
task) and the least vector it reaches, not the pairs. Components come from these rows.

Null and zero vectors and those with null or non-finite components link with nothing, nor do vectors of another
dimension than most of the sample. Every row gets a row. Rows without vec_id take no part and are their own
component, null. Rows that share a vec_id but not the vector are vectors of their own; their components are named by
the smallest vec_id like all others. An empty table gives an empty frame. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.llm.components import components
from ledgerloom.llm.permutation import usable

COSINE, RECALL = 0.95, 0.999
SAMPLE = 20_000  #: rows the codebooks and the limit are fitted on
PROBES = 2_000  #: of these, for the limit
CODES = 256  #: codes of a half at most
RESIDENTS = 64  #: vectors a cell should have on average
TILE = 4_096
SEED = 5


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the division by the largest component keeps squares finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def squared(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ codes.T + (codes**2).sum(1), 0)


def codebook(points: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows; a code that loses its points stays where it was."""
    codes = points[np.linspace(0, len(points) - 1, min(size, len(points))).astype(int)].copy()
    for _ in range(rounds):
        at = squared(points, codes).argmin(1)
        count = np.bincount(at, minlength=len(codes))
        order = np.argsort(at, kind="stable")
        filled = np.flatnonzero(count)
        codes[filled] = np.add.reduceat(points[order], (np.cumsum(count) - count)[filled]) / count[filled, None]
    return codes


@dataclass(frozen=True)
class Grid:
    """Codes of the two halves, and how far beyond its own cell a vector looks."""

    first: np.ndarray
    second: np.ndarray
    limit: float = 0.0

    def excess(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance of each half to each code, above that to the nearest."""
        half = self.first.shape[1]
        out = []
        for points, codes in ((vectors[:, :half], self.first), (vectors[:, half:], self.second)):
            far = squared(points, codes)
            out.append(far - far.min(1, keepdims=True))
        return out[0], out[1]

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self.excess(vectors)
        return one.argmin(1) * len(self.second) + two.argmin(1)

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell), the cells of each vector nearest first, all vectors a step at a time.

        The frontier of a vector holds, for each code of the first half, the next code of the second half; a step
        takes the least sum and moves that place on.
        """
        one, two = self.excess(vectors)
        order1, order2 = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        near1, near2 = np.take_along_axis(one, order1, 1), np.take_along_axis(two, order2, 1)
        wide = int((near1 <= self.limit).sum(1).max())
        near1, order1 = near1[:, :wide], order1[:, :wide]
        near2 = np.hstack([near2, np.full((len(two), 1), np.inf)])
        live = np.arange(len(vectors))
        next_ = np.zeros((len(vectors), wide), np.int64)
        rows, cells = [], []
        front = near1 + near2[:, :1]
        while len(live):
            best = front[live].argmin(1)
            hit = front[live, best] <= self.limit
            live, best = live[hit], best[hit]
            place = next_[live, best]
            rows.append(live)
            cells.append(order1[live, best] * len(self.second) + order2[live, place])
            next_[live, best] = place + 1
            front[live, best] = near1[live, best] + near2[live, place + 1]
        row, cell = np.concatenate(rows), np.concatenate(cells)
        by = np.argsort(row, kind="stable")
        return row[by], cell[by]


def _between(grid: Grid, some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Limit at which one vector of each pair visits the cell of the other."""
    width = len(grid.second)
    ends = []
    for a, b in ((some, others), (others, some)):
        one, two = grid.excess(a)
        home = grid.homes(b)
        at = np.arange(len(a))
        ends.append(one[at, home // width] + two[at, home % width])
    return np.minimum(*ends)


def fit(found: np.ndarray, rows: int, cosine: float, recall: float, codes: int = CODES, residents: int = RESIDENTS) -> Grid:
    """Codebooks and limit from sample vectors of length 1, for ``rows`` vectors in all."""
    half = found.shape[1] // 2
    size = int(np.clip(np.sqrt(rows / residents), 1, codes))
    grid = Grid(codebook(found[:, :half], size), codebook(found[:, half:], size))
    if recall >= 1:
        return Grid(grid.first, grid.second, 16.0)  # beyond any two squared distances of such halves
    draw = np.random.default_rng(SEED)
    probes = found[:PROBES]
    aside = draw.standard_normal(probes.shape)
    aside -= (aside * probes).sum(1, keepdims=True) * probes
    length = np.sqrt((aside**2).sum(1, keepdims=True))
    made = probes * cosine + np.sqrt(1 - cosine**2) * aside / np.where(length > 0, length, 1)
    limit = np.quantile(_between(grid, probes, made), recall)
    one, two = np.nonzero(np.triu(probes @ probes.T >= cosine, 1))
    if len(one) > 200_000:
        keep = np.linspace(0, len(one) - 1, 200_000).astype(int)
        one, two = one[keep], two[keep]
    if len(one):
        limit = max(limit, np.quantile(_between(grid, probes[one], probes[two]), recall))
    return Grid(grid.first, grid.second, float(limit) + 1e-9)


def _coded(grid: Grid):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2_048):
                part = batch.slice(start, 2_048)
                vectors = unit(matrix(part.column("vec")))
                row, cell = grid.visits(vectors)
                ends = np.searchsorted(row, np.arange(len(vectors) + 1)).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("m"), part.column("vec"), pa.array(cell[ends[:-1]].astype(np.int32)), cells],
                    ["node", "m", "vec", "home", "cells"],
                )

    return run


def exactly(v: np.ndarray, w: np.ndarray) -> float:
    """Cosine in double precision, as a single dot product over the two lengths."""
    return float(np.dot(v, w) / (np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(w, w))))


def _least_reached(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node each side reaches over the links in ``mask``."""
    big = np.iinfo(np.int64).max
    while True:
        low = np.minimum(left, np.where(mask, right[None, :], big).min(1))
        high = np.minimum(right, np.where(mask, low[:, None], big).min(0))
        if (low == left).all() and (high == right).all():
            return left, right
        left, right = low, high


def _links(cosine: float):
    """Task over the visitors and residents of a cell: linked vectors with their counts and the least one reached."""

    def run(visitors: pa.Table, residents: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if visitors.num_rows and residents.num_rows:
            node, m, home = (visitors.column(c).to_numpy() for c in ("node", "m", "home"))
            at, n = (residents.column(c).to_numpy() for c in ("at", "n"))
            raw, held = matrix(visitors.column("vec")), matrix(residents.column("held"))
            vectors, here = unit(raw), unit(held)
            places = residents.column("seen").combine_chunks()
            owner = np.repeat(np.arange(len(at)), np.diff(places.offsets.to_numpy()))
            cells = places.flatten().to_numpy()
            homes, which = np.unique(home, return_inverse=True)
            spot = np.searchsorted(homes, cells)
            known = homes[np.minimum(spot, len(homes) - 1)] == cells
            mutual = np.zeros((len(homes), len(at)), bool)  # the resident visits the visitor's cell, too
            mutual[spot[known], owner[known]] = True
            for start in range(0, len(node), 512):
                part = slice(start, start + 512)
                near = vectors[part] @ here.T
                linked = near >= cosine
                for i, j in np.argwhere(np.abs(near - cosine) < 1e-12):
                    linked[i, j] = exactly(raw[start + i], held[j]) >= cosine
                linked &= ~mutual[which[part]] | (node[part, None] < at[None, :])
                linked &= node[part, None] != at[None, :]
                rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                if len(rows):
                    mask = linked[np.ix_(rows, columns)]
                    a, b = node[part][rows], at[columns]
                    low, high = _least_reached(mask, a, b)
                    out.append((a, mask @ n[columns], low))
                    out.append((b, m[part][rows] @ mask, high))
        arrays = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(x, pa.int64()) for x in arrays], names=["node", "links", "least"])

    return run


def _blocks(sizes: DataFrame, tile: int) -> DataFrame:
    """(cell, parts) of cells with more than ``tile`` rows: at most CODES ** 2 rows, so they can be broadcast."""
    parts = F.ceil(F.col("count") / tile).cast("int")
    return F.broadcast(sizes.where(F.col("count") > tile).select("cell", parts.alias("parts")))


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    recall: float = RECALL,
    id_: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
    codes: int = CODES,
    residents: int = RESIDENTS,
    tile: int = TILE,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: other vectors it links with, and the smallest vec_id of its component.

    The codebooks are fitted on the ``sample`` rows with the smallest hashes.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_, vector)
    classes = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least_id"))
    # Written, so that the numbers of the classes hold.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    picked = classes.orderBy(F.xxhash64(F.lit(SEED), "vec"), "node").limit(sample).select("vec").collect()
    if picked:
        width = int(np.bincount([len(r.vec) for r in picked]).argmax())
        found = unit(np.array([r.vec for r in picked if len(r.vec) == width]))
        compared = classes.where(F.size("vec") == width)
        grid = fit(found, compared.count(), cosine, recall, codes, residents)
        linked = _linked(compared, grid, cosine, tile)
        stars = components(linked.select("node", "least"), "near-vectors")
        counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
        named = classes.join(counts, "node", "left").join(stars, "node", "left").withColumn("star", F.coalesce("component", "node"))
        least = named.groupBy("star").agg(F.min("least_id").alias("component_id"))
        named = named.join(least, "star").select("vec", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    else:
        named = spark.createDataFrame([], "vec array<double>, n_links long, component_id long")
    id_of = F.col(id_).cast("long")
    all_ = vectors.select(id_of.alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("vec"))
    joined = all_.join(named, (all_["vec"] == named["vec"]) & all_["vec_id"].isNotNull(), "left").drop(named["vec"])
    component = F.coalesce("component_id", "vec_id")
    kept = F.col("vec_id").eqNullSafe(component)
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def _linked(classes: DataFrame, grid: Grid, cosine: float, tile: int) -> DataFrame:
    """(node, links, least): what each task found for a vector."""
    coded = classes.select("node", "m", "vec").mapInArrow(_coded(grid), "node long, m long, vec array<double>, home int, cells array<int>")
    coded = written(coded, "vector-cells")
    full = _blocks(coded.groupBy(F.col("home").alias("cell")).count(), tile)
    busy = _blocks(coded.select(F.explode("cells").alias("cell")).groupBy("cell").count(), tile)
    full, busy = full.withColumnRenamed("parts", "_full"), busy.withColumnRenamed("parts", "_busy")

    def dealt(frame: DataFrame, name: str, own: str, other: str) -> DataFrame:
        placed = frame.join(full, "cell", "left").join(busy, "cell", "left")
        block = F.pmod(F.xxhash64(name), F.coalesce(F.col(own), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        mine, theirs = own[1:], other[1:]
        return placed.withColumn(mine, block).withColumn(theirs, every).drop("_full", "_busy")

    visitors = dealt(coded.select("node", "m", "vec", "home", F.explode("cells").alias("cell")), "node", "_busy", "_full")
    there = [F.col(c).alias(x) for c, x in (("node", "at"), ("m", "n"), ("vec", "held"), ("cells", "seen"), ("home", "cell"))]
    residents = dealt(coded.select(*there), "at", "_full", "_busy")
    keys = ["cell", "full", "busy"]
    found = visitors.groupBy(*keys).cogroup(residents.groupBy(*keys)).applyInArrow(_links(cosine), "node long, links long, least long")
    return written(found, "vector-links")
