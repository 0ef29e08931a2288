"""Approximate nearest neighbours: stable projections, kd-trees and a chi-square stopping test.

Vectors are scaled to length 1 and projected to ``PROJECTED`` dimensions by Gaussian (2-stable) directions: the squared projected
distance of two points is their squared distance times a chi-square variable. A kd-tree over the projections (its upper part fitted on a
bounded sample, its cells indexed in full) is searched in increasing projected distance, candidates are verified on the
original vectors, and a search stops once the projected distance exceeds what a neighbour as near as the k-th found would show
with probability ``CONFIDENCE``.

A query first searches its own cell; the k-th distance found there tells which other cells can hold nearer points, and
the query is sent to those only. At a cell, rows are sorted so that its points come before the queries, which stream past the
index; memory is one cell and one batch. Cells hold ``LEAST_CELL`` to ``MOST_CELL`` points about, growing with the table.

Equal vectors are one point that carries its k + 1 least ids, all that any query can report; queries with equal vectors search once.

Cases: vectors null, empty, zero, or with null or non-finite components, and rows without vec_id take no part; ties go to the smaller
vec_id; only vectors of the query's length are its candidates; rows that repeat vec_id and vector count once, and no row with
the query's own vec_id is its neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, staged

NEAREST = 5
PROJECTED = 8
CONFIDENCE = 0.97
#: Points that the upper tree is fitted on, points of a cell, points of a leaf, candidates verified at once.
SAMPLE = 16384
LEAST_CELL, MOST_CELL, LEAF, VERIFIED = 256, 16384, 32, 256
QUERY_EVERY = 50


def chi_square_quantile(p: float, freedom: int) -> float:
    """By bisection; ``freedom`` is even."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        below = 1 - math.exp(-mid / 2) * sum((mid / 2) ** i / math.factorial(i) for i in range(freedom // 2))
        low, high = (mid, high) if below < p else (low, mid)
    return high


STRETCH = chi_square_quantile(CONFIDENCE, PROJECTED)


def directions(length: int) -> np.ndarray:
    """The Gaussian directions for vectors of a length."""
    return np.random.default_rng(977 + length).standard_normal((length, PROJECTED))


def unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Cells:
    """Upper kd-tree: heap-ordered dimensions and thresholds; the cells are the 2 ** depth leaves."""

    depth: int
    dims: np.ndarray
    cuts: np.ndarray

    def of(self, projected: np.ndarray) -> np.ndarray:
        at = np.zeros(len(projected), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (projected[np.arange(len(projected)), self.dims[at]] > self.cuts[at])
        return at - (2**self.depth - 1)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full((1, PROJECTED), -np.inf), np.full((1, PROJECTED), np.inf)
        for level in range(self.depth):
            first = 2**level - 1
            d, c = self.dims[first : 2 * first + 1], self.cuts[first : 2 * first + 1]
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            n = np.arange(len(d))
            high[2 * n, d], low[2 * n + 1, d] = c, c
        return low, high


def fitted(sample: np.ndarray, depth: int) -> Cells:
    """Split the sample at medians of the widest dimension, level by level."""
    dims, cuts = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
    parts = [sample]
    for node in range(2**depth - 1):
        own = parts[node]
        if len(own):
            dims[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            cuts[node] = np.median(own[:, dims[node]])
        above = own[:, dims[node]] > cuts[node]
        parts += [own[~above], own[above]]
        parts[node] = None
    return Cells(depth, dims, cuts)


class Index:
    """The points of one cell: leaves of a local kd-tree with their boxes."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]]):
        self.raw, self.ids = vectors, ids
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = unit(vectors)
        self.flat = self.unit @ directions(vectors.shape[1])
        order, self.leaves = [], []
        waiting = [np.arange(len(vectors))]
        while waiting:
            own = waiting.pop()
            if len(own) <= LEAF:
                self.leaves.append((len(order), len(order) + len(own)))
                order += own.tolist()
                continue
            p = self.flat[own]
            d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            ranked = own[np.argsort(p[:, d], kind="stable")]
            waiting += [ranked[: len(own) // 2], ranked[len(own) // 2 :]]
        self.order = np.array(order)
        self.low = np.stack([self.flat[self.order[i:j]].min(axis=0) for i, j in self.leaves])
        self.high = np.stack([self.flat[self.order[i:j]].max(axis=0) for i, j in self.leaves])

    def search(self, query: np.ndarray, flat: np.ndarray, bound: float, k: int) -> tuple[list[tuple[float, int]], float]:
        """The best k (score, id) in this cell, and the squared distance of the k-th (``bound`` if it is nearer)."""
        gap = np.maximum(0, np.maximum(self.low - flat, flat - self.high))
        gap = (gap * gap).sum(axis=1)
        near = np.flatnonzero(gap <= STRETCH * bound)
        found: list[tuple[float, int]] = []
        if not len(near):
            return found, bound
        points = np.concatenate([self.order[self.leaves[i][0] : self.leaves[i][1]] for i in near])
        far = self.flat[points] - flat
        far = (far * far).sum(axis=1)
        rising = np.argsort(far, kind="stable")
        points, far = points[rising], far[rising]
        norm = math.sqrt(float((query * query).sum()))
        for at in range(0, len(points), VERIFIED):
            stop = int(np.searchsorted(far[at : at + VERIFIED], STRETCH * bound, side="right"))
            some = points[at : at + stop]
            if not len(some):
                break  # the stopping test holds for all that follow
            scores = (self.raw[some] * query).sum(axis=1) / (self.norm[some] * norm)
            for i in np.flatnonzero(scores >= 1 - bound / 2 - 1e-12) if bound < 5 else range(len(some)):
                found += [(-float(scores[i]), v) for v in self.ids[some[i]]]
            found.sort()
            del found[k:]
            if len(found) == k:
                bound = min(bound, max(0.0, 2 + 2 * found[-1][0]) + 1e-12)
        return [(-s, v) for s, v in found], bound


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, length and components as doubles of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0)).withColumn("length", F.size("v")).distinct()


_ROW = "length int, cell long, query boolean, id long, v array<double>, ids array<long>, bound double"
_HIT = "id long, length int, cell long, v array<double>, bound double, score double, vec_id long"


def _vectors(column: pa.ListArray, rows: np.ndarray) -> np.ndarray:
    """Some rows of equal length as a matrix."""
    chosen = column.take(pa.array(rows))
    return chosen.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def celled(points: DataFrame, cells: dict[int, Cells], query: bool) -> DataFrame:
    """Rows with the cell that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["length"].to_numpy()
            out = np.zeros(len(batch), dtype=np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                out[rows] = cells[n].of(unit(_vectors(batch["v"], rows)) @ directions(int(n))) if n in cells else 0
            yield pa.RecordBatch.from_arrays([batch["length"], pa.array(out), pa.array(np.full(len(batch), query)), batch["id"], batch["v"], batch["ids"], pa.array(np.full(len(batch), 8.0))], names=["length", "cell", "query", "id", "v", "ids", "bound"])

    return points.select("length", "id", "v", "ids").mapInArrow(run, _ROW)


def routed(queries: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """Queries at every other cell whose box is within what the stopping test allows at their bound."""
    boxes = {n: c.boxes() for n, c in cells.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, home, bound = (batch[c].to_numpy() for c in ("length", "cell", "bound"))
            for n in np.unique(length):
                if n not in boxes:
                    continue
                low, high = boxes[n]
                rows = np.flatnonzero(length == n)
                flat = unit(_vectors(batch["v"], rows)) @ directions(int(n))
                for at in range(0, len(rows), 64):
                    some = flat[at : at + 64, None, :]
                    gap = np.maximum(0, np.maximum(low - some, some - high))
                    q, c = np.nonzero((gap * gap).sum(axis=2) <= STRETCH * bound[rows[at : at + 64], None])
                    q = rows[at : at + 64][q]
                    away = c != home[q]
                    picked = batch.take(pa.array(q[away]))
                    yield pa.RecordBatch.from_arrays([picked["length"], pa.array(c[away]), pa.array(np.ones(int(away.sum()), dtype=bool)), picked["id"], picked["v"], pa.nulls(int(away.sum()), pa.list_(pa.int64())), picked["bound"]], names=["length", "cell", "query", "id", "v", "ids", "bound"])

    return queries.select("length", "cell", "id", "v", "bound").mapInArrow(run, _ROW)


def searched(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Search each query's cell. One row a hit; a query without hits there has one row with a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            length, cell, query = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "cell", "query"))
            cuts = np.flatnonzero((length[1:] != length[:-1]) | (cell[1:] != cell[:-1]) | (query[1:] != query[:-1])) + 1
            out = []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if i == j:
                    continue
                if (length[i], cell[i]) != key:
                    key, held, index = (length[i], cell[i]), [], None
                rows = np.arange(i, j)
                vectors = _vectors(batch["v"], rows)
                if not query[i]:
                    held.append((vectors, batch["ids"].slice(i, j - i).to_pylist()))
                    continue
                if index is None and held:
                    index = Index(np.concatenate([v for v, _ in held]), [x for _, ids in held for x in ids])
                flats = unit(vectors) @ directions(int(length[i]))
                ids, bounds = batch["id"].slice(i, j - i).to_pylist(), batch["bound"].slice(i, j - i).to_pylist()
                for q, f, one, bound in zip(vectors, flats, ids, bounds):
                    hits, nearer = index.search(q, f, bound, k) if index else ([], bound)
                    out += [(one, int(length[i]), int(cell[i]), q if n == 0 else None, nearer, s, v) for n, (s, v) in enumerate(hits or [(None, None)])]
            if out:
                columns = list(zip(*out))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "length", "cell", "v", "bound", "score", "vec_id"])

    dealt = points.unionByName(queries).repartition(partitions(points.sparkSession), "length", "cell").sortWithinPartitions("length", "cell", "query")
    return dealt.mapInArrow(run, _HIT)


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row whose id ``every`` divides."""
    rows = valid(vectors)
    # the least k + 1 ids of each vector; the limit works before the shuffle, so copies don't gather
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v", "length").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    points = staged(ranked.groupBy("v", "length").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.lit(None).cast("long")))
    asking = rows.filter(F.col("vec_id") % every == 0)
    asked = staged(asking.groupBy("v", "length").agg(F.min("vec_id").alias("id")).withColumn("ids", F.lit(None).cast("array<long>")))
    # length and number of points; the lengths that share most of the sample get a tree, any other is one cell
    sizes = {r["length"]: r["n"] for r in points.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(64).collect()}
    sample = points.select("length", "v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(SAMPLE).toPandas()
    cells = {}
    for n, own in sample.groupby("length"):
        if n in sizes:
            rows_of = sizes[n]
            cell = max(LEAST_CELL, min(MOST_CELL, rows_of // 256))
            depth = max(0, min(math.ceil(math.log2(max(1, rows_of / cell))), int(math.log2(max(1, len(own) / 8)))))
            flat = unit(np.stack(own["v"].to_numpy()).astype(np.float64)) @ directions(int(n))
            cells[int(n)] = fitted(flat, depth)
    at = staged(celled(points, cells, False))
    home = staged(searched(at, celled(asked, cells, True), k + 1))
    away = searched(at, routed(home.filter(F.col("v").isNotNull()), cells), k + 1)
    hits = home.select("id", "score", "vec_id").unionByName(away.select("id", "score", "vec_id")).filter(F.col("vec_id").isNotNull())
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    lists = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    whose = asking.join(asked.select("v", "length", "id"), ["v", "length"]).select(F.col("vec_id").alias("query_id"), "id")
    own = whose.join(lists, "id").select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)).alias("at", "b"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
