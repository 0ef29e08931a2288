"""Synthetic minority rows and Tomek links over an exact distributed nearest-neighbour search.

Points of many coordinates meet on a grid of groups, measured by matrix products and checked exactly where rounding could decide.
Others are dealt to the cells of pivots whose number follows the square root of the points. A first pass inside the own cell bounds the
distance to the k-th neighbour of every point; a second pass visits only the cells the triangle
inequality cannot rule out, as a stream past one block of points at a time. Repeated points are searched once with their multiplicity, and a crowded
cell is cut into blocks that different tasks search, so neither duplicates nor a dense region end up in
one task. What leaves a task is at most k neighbours per point and block, never all pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.binning import few_valued
from riskloom.operators.ranks import hash_of, hash_rank
from riskloom.operators.splits import CLIENT, TARGET, class_sizes
from riskloom.session import checkpoint_dir, checkpointed

LEAST_PIVOTS = 64
BLOCK_ROWS = 2000
#: Queries measured at once against a block of points.
BATCH_ROWS = 1000
#: Rows of a group on the grid of all pairs, and coordinates from which the triangle inequality rules out next to nothing.
GRID_ROWS, MANY_COORDINATES = 16_000, 40
#: Rows of a region in the search of links, the rotated coordinates that a pair must pass first and next, and the rows that show the axes.
REGION_ROWS, FIRST_AXES, NEXT_AXES, SHOWN_ROWS = 32_000, 24, 128, 8192
#: Points up to which the few tiles of the grid are done before the steps of that search have started.
FEW_POINTS = 4 * GRID_ROWS


def pivots_for(points: int) -> int:
    """Pivots for so many points: their square root, so that cells grow as slowly as the table of pivots."""
    return max(LEAST_PIVOTS, math.isqrt(points))


def _pivots(points: DataFrame, key: str, n: int) -> np.ndarray:
    """``n`` points chosen by the hash of their key: the square root of all, small enough for the driver."""
    rows = points.select("v", hash_of(key, "pivot").alias("h")).orderBy("h").limit(n).collect()
    return np.array([r["v"] for r in rows], dtype="float64")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of two sets of points, block against block."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _assign(points: DataFrame, key: str, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot of each point and the distance to it."""

    def run(batches):
        for pdf in (whole.iloc[i : i + BATCH_ROWS] for whole in batches for i in range(0, len(whole), BATCH_ROWS)):
            d = _distances(np.stack(pdf["v"].to_numpy()), pivots)
            cell = d.argmin(axis=1)
            yield pdf.assign(cell=cell.astype("int32"), to_pivot=d[np.arange(len(d)), cell])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(run, f"{fields}, cell int, to_pivot double")


def _best(key: str, k: int):
    """Nearest k of a block of points for a block of queries, self left out."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({key: [], "nb": [], "dist": [], "mult": []})
        d = _distances(np.stack(queries["v"].to_numpy()), np.stack(points["v"].to_numpy()))
        qk, pk = queries[key].to_numpy(), points[key].to_numpy()
        d[qk[:, None] == pk[None, :]] = np.inf
        m = min(k, len(points))
        # ties at the edge are broken by key, so the answer does not depend on the blocks
        edge = np.partition(d, m - 1, axis=1)[:, m - 1]
        rows, cols = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        order = np.lexsort((pk[cols], d[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < m
        rows, cols = rows[first], cols[first]
        return pd.DataFrame({key: qk[rows], "nb": pk[cols], "dist": d[rows, cols], "mult": points["mult"].to_numpy()[cols]})

    return run


def _search(queries: DataFrame, points: DataFrame, key: str, k: int) -> DataFrame:
    """Neighbours of queries among the points of the same (cell, block, qblock), at most k each.

    Points come first in a stream sorted by block, then the queries batch by batch, so a task holds one block of points and
    one batch whatever the number of queries that ask for it.
    """
    search, place = _best(key, k), ["cell", "block", "qblock"]
    both = points.select(*place, F.lit(0).alias("asks"), key, "v", "mult").unionByName(queries.select(*place, F.lit(1).alias("asks"), key, "v", F.lit(1).cast("bigint").alias("mult")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for where, pdf in batch.groupby(place, sort=False):
                if where != at:
                    at, held = where, []
                stored, asked = pdf[pdf["asks"] == 0], pdf[pdf["asks"] == 1]
                if len(stored):
                    held.append(stored)
                if len(asked) and held:
                    if len(held) > 1:
                        held = [pd.concat(held, ignore_index=True)]
                    for i in range(0, len(asked), BATCH_ROWS):
                        yield search(asked.iloc[i : i + BATCH_ROWS], held[0])

    return both.repartition(*place).sortWithinPartitions(*place, "asks").mapInPandas(run, f"`{key}` bigint, nb bigint, dist double, mult bigint")


def _paired(asking: DataFrame, stored: DataFrame, condition: Column | None = None) -> DataFrame:
    """Every packed row beside every other: a task reads one partition of each, nothing is copied for the grid or shuffled."""
    return asking.join(stored.hint("shuffle_replicate_nl"), F.lit(True) if condition is None else condition)


def _packed(points: DataFrame, key: str, groups: int) -> DataFrame:
    """(keys, mults, coordinates): the points of a group by hash as one packed row, a partition each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(pdf[key].to_numpy("int64"), pdf["mult"].to_numpy("int64"), np.stack(pdf["v"].to_numpy())) for pdf in batches if len(pdf)]
        if held:
            keys, mults, v = (np.concatenate(x) for x in zip(*held))
            yield pd.DataFrame({"keys": [keys.tobytes()], "mults": [mults.tobytes()], "coordinates": [v.tobytes()]})

    placed = points.select(F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).cast("int").alias("g"), key, "mult", "v")
    return placed.repartitionById(groups, F.col("g")).mapInPandas(run, "keys binary, mults binary, coordinates binary")


def _squares(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and a bound of their rounding for each query."""
    qq, pp = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", p, p)
    d = q @ p.T
    d *= -2.0
    d += qq[:, None]
    d += pp[None, :]
    return d, 8 * np.finfo(float).eps * (q.shape[1] + 4) * (qq + pp.max())


def _all_pairs(points: DataFrame, key: str, k: int, width: int, groups: int) -> DataFrame:
    """Neighbours without pruning: groups of queries meet groups of points on a grid, one tile in memory at a time."""
    packed = checkpointed(_packed(points, key, groups))
    asking = packed.select(F.col("keys").alias("q_keys"), F.col("coordinates").alias("q_coordinates"))

    def opened(keys, coordinates) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(keys, "int64"), np.frombuffer(coordinates).reshape(-1, width)

    def tile(qk, qv, held) -> pd.DataFrame:
        out = []
        for pk, pm, pv in held:
            d, slack = _squares(qv, pv)
            d[qk[:, None] == pk[None, :]] = np.inf
            m = min(k, len(pk))
            # whatever rounding may have moved over the edge is measured again, coordinate by coordinate
            edge = np.partition(d, m - 1, axis=1)[:, m - 1]
            r, c = np.nonzero(d <= (edge + 2 * slack)[:, None])
            keep = np.isfinite(d[r, c])
            r, c = r[keep], c[keep]
            out.append(pd.DataFrame({key: qk[r], "nb": pk[c], "dist": _between(qv, pv, r, c), "mult": pm[c]}))
        found = pd.concat(out, ignore_index=True).sort_values([key, "dist", "nb"])
        return found[found.groupby(key).cumcount() < k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                (qk, qv), (pk, pv), pm = opened(r.q_keys, r.q_coordinates), opened(r.keys, r.coordinates), np.frombuffer(r.mults, "int64")
                held = [(pk[i : i + BLOCK_ROWS], pm[i : i + BLOCK_ROWS], pv[i : i + BLOCK_ROWS]) for i in range(0, len(pk), BLOCK_ROWS)]
                for i in range(0, len(qk), BLOCK_ROWS):
                    yield tile(qk[i : i + BLOCK_ROWS], qv[i : i + BLOCK_ROWS], held)

    return _paired(asking, packed).mapInPandas(run, f"`{key}` bigint, nb bigint, dist double, mult bigint")


def _lengths(d: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _between(q: np.ndarray, p: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of stated pairs, coordinate by coordinate."""
    return np.concatenate([np.empty(0)] + [_lengths(q[r[i : i + 20_000]] - p[c[i : i + 20_000]]) for i in range(0, len(r), 20_000)])


def _nearest(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k nearest of what several blocks returned."""
    w = Window.partitionBy(key).orderBy("dist", "nb")
    return found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def exact_neighbours(points: DataFrame, key: str, k: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, nb, dist, mult, rk): the k nearest distinct points of every distinct point.

    ``points`` has a bigint key, ``v`` (array of doubles) and ``mult`` (rows at that point). Few coordinates are pruned by pivots; with
    many, where hardly a cell can be ruled out, groups meet on a grid instead of sending every point to every cell.
    """
    shown = points.select(F.size("v").alias("n")).first()
    if shown is not None and shown["n"] > MANY_COORDINATES:
        return _nearest(_all_pairs(points, key, k, shown["n"], max(1, -(-points.count() // GRID_ROWS))), key, k)
    piv = _pivots(points, key, pivots or pivots_for(points.count()))
    if not len(piv):
        return points.sparkSession.createDataFrame([], f"`{key}` bigint, nb bigint, dist double, mult bigint, rk int")
    placed = checkpointed(_assign(points, key, piv))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("to_pivot").alias("radius"))
    sized = placed.join(cells, "cell")
    # blocks of a cell: even by hash, as many as its size asks for
    blocks = F.greatest(F.ceil(F.col("size") / block_rows), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64(F.col(key)), blocks).cast("int")
    stored = sized.withColumns({"block": part, "blocks": blocks})
    # first pass: each block against itself gives an upper bound of the k-th distance
    search = _best(key, k)
    own = stored.groupBy("cell", "block").applyInPandas(lambda pdf: search(pdf, pdf), f"`{key}` bigint, nb bigint, dist double, mult bigint")
    first = _nearest(own, key, k)
    bound = first.groupBy(key).agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("ub"))
    # second pass: cells whose ball may hold something nearer than the bound
    # one row per pivot, bounded by the pivot count
    shape = [(r["cell"], int(max(1, -(-r["size"] // block_rows))), r["radius"]) for r in cells.collect()]
    balls = {c: (b, rad) for c, b, rad in shape}

    def reach(batches):
        ids = np.array(sorted(balls), dtype="int32")
        radii, parts = (np.array([balls[i][j] for i in ids]) for j in (1, 0))
        for pdf in (whole.iloc[i : i + BATCH_ROWS] for whole in batches for i in range(0, len(whole), BATCH_ROWS)):
            d = _distances(np.stack(pdf["v"].to_numpy()), piv[ids])
            ub = pdf["ub"].fillna(np.inf).to_numpy()
            r, c = np.nonzero(d - radii[None, :] <= ub[:, None])
            # every block of a crowded cell is asked; the queries of one are cut in as many parts
            blocks = parts[c]
            r, c = np.repeat(r, blocks), np.repeat(c, blocks)
            block = np.arange(len(r)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            yield pd.DataFrame({
                key: pdf[key].to_numpy()[r], "v": pdf["v"].to_numpy()[r], "cell": ids[c], "block": block.astype("int32"),
                "qblock": (pdf["h"].to_numpy()[r] % parts[c]).astype("int32"),
            })

    asking = stored.select(key, "v", F.xxhash64(F.col(key), F.lit(1)).alias("h")).join(bound, key, "left")
    sent = asking.mapInPandas(reach, f"`{key}` bigint, v array<double>, cell int, block int, qblock int")
    meet = stored.select("cell", "block", key, "v", "mult", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qblock"))
    return _nearest(_search(sent, meet, key, k), key, k)


# -- links of many coordinates -----------------------------------------------------------------


class _Axes:
    """Rotated coordinates, leading axes first, and regions of about equal size along them.

    Both come from shown points and decide only how much is ruled out early: a distance along some axes, with
    what is left of each point as one more coordinate, is never above the true one.
    """

    def __init__(self, shown: np.ndarray, depth: int) -> None:
        self.centre = shown.mean(axis=0)
        self.axes = np.linalg.eigh(np.cov(shown - self.centre, rowvar=False))[1][:, ::-1][:, :NEXT_AXES].copy()
        self.depth, self.axis, self.cut = depth, np.zeros(2**depth, "int64"), np.zeros(2**depth)
        z, held = self.rotated(shown), {0: np.arange(len(shown))}
        for node in range(2**depth - 1):
            own = held.pop(node)
            if len(own) > 1:
                axis = int(z[own].var(axis=0).argmax())
                x = np.sort(z[own, axis])
                # the change of value nearest to the middle, so that a frequent value does not fill one side
                steps = np.flatnonzero(x[1:] > x[:-1])
                if len(steps):
                    at = steps[np.abs(steps + 1 - len(x) / 2).argmin()]
                    self.axis[node], self.cut[node] = axis, x[at]
            right = z[own, self.axis[node]] > self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]

    def rotated(self, v: np.ndarray) -> np.ndarray:
        """Coordinates along the axes, and the length of the rest."""
        v = v - self.centre
        z = v @ self.axes
        rest = np.einsum("ij,ij->i", v, v) - np.einsum("ij,ij->i", z, z)
        return np.column_stack([z, np.sqrt(np.maximum(rest, 0.0))]).astype("float32")

    def region(self, v: np.ndarray) -> np.ndarray:
        z, node = self.rotated(v), np.zeros(len(v), "int64")
        for _ in range(self.depth):
            node = 2 * node + 1 + (z[np.arange(len(v)), self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def _squared(z: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", z, z)


def _spans(q: np.ndarray, p: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the true distance of stated pairs is at least and at most, single precision allowed for."""
    low, high = np.empty(len(r)), np.empty(len(r))
    for i in range(0, len(r), 50_000):
        a, b = q[r[i : i + 50_000]], p[c[i : i + 50_000]]
        s = _squared(a - b).astype("float64")
        far = 4e-6 * (np.sqrt(_squared(a)) + np.sqrt(_squared(b)))
        low[i : i + 50_000] = np.sqrt(s) * (1 - 1e-4) - far
        high[i : i + 50_000] = np.sqrt(s + 4.0 * a[:, -1] * b[:, -1]) * (1 + 1e-4) + far
    return low, high


def _bounds(z: np.ndarray) -> np.ndarray:
    """What the distance of each point to its nearest is at most, by the one that looks nearest; infinite if it is alone."""
    if len(z) < 2:
        return np.full(len(z), np.inf)
    zz, at = _squared(z), np.empty(len(z), "int64")
    for i in range(0, len(z), 256):
        d = (-2 * z[i : i + 256]) @ z.T
        d += zz
        own = np.arange(len(d))
        d[own, i + own] = np.inf
        at[i : i + 256] = d.argmin(axis=1)
    return _spans(z, z, np.arange(len(z)), at)[1]


def _in_reach(z: np.ndarray, edge: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Points that are not farther than their edge (squared) from the box around the others."""
    gap = np.maximum(np.maximum(others.min(axis=0) - z, z - others.max(axis=0)), 0)
    return np.flatnonzero(_squared(gap) <= edge)


def _within(qz: np.ndarray, q_most: np.ndarray, pz: np.ndarray, p_most: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(r, c, low, high) of the pairs that may lie within both their distances: by boxes, then by one matrix product along few axes, then along more."""

    def few(z: np.ndarray) -> np.ndarray:
        return np.column_stack([z[:, :FIRST_AXES], np.sqrt(_squared(z[:, FIRST_AXES:]))])

    qf, pf, qq, pp = few(qz), few(pz), _squared(qz), _squared(pz)
    # more than single precision can move a squared distance; far edges are cut at what no pair exceeds, lest they swallow its digits
    slack = 8 * np.finfo("float32").eps * (FIRST_AXES + 5) * (qq.max() + pp.max())
    far = 2 * (qq.max() + pp.max())
    q_edge, p_edge = ((np.minimum(most * most, far) + slack).astype("float32") for most in (q_most, p_most))
    rows, cols = _in_reach(qf, q_edge, pf), _in_reach(pf, p_edge, qf)
    left = np.column_stack([-2 * qf, _squared(qf) - q_edge, np.ones(len(qf))])[rows].astype("float32")
    right = np.ascontiguousarray(np.column_stack([pf, np.ones(len(pf)), _squared(pf)])[cols].astype("float32").T)
    for i in range(0, len(rows), 512):
        found = []
        for j in range(0, len(cols), 2048):
            r, c = np.divmod(np.flatnonzero(left[i : i + 512] @ right[:, j : j + 2048] <= 0), min(2048, len(cols) - j))
            found.append((rows[r + i], cols[c + j]))
        if found:
            r, c = (np.concatenate(x) for x in zip(*found))
            low, high = _spans(qz, pz, r, c)
            near = low <= np.minimum(q_most[r], p_most[c])
            yield r[near], c[near], low[near], high[near]


def _not_beaten(at: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Pairs that no other pair of the same point is sure to undercut."""
    best = np.full(n, np.inf)
    np.minimum.at(best, at, high)
    return low <= best[at]


def _measured(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Add the distance of each pair, coordinate by coordinate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in (whole.iloc[i : i + BATCH_ROWS] for i in range(0, len(whole), BATCH_ROWS)):
                yield pdf.drop(columns=["a", "b"]).assign(dist=_lengths(np.stack(pdf["a"].to_numpy()) - np.stack(pdf["b"].to_numpy())))

    first, second = (vectors.select(F.col(key).alias(k), F.col("v").alias(v)) for k, v in (("one", "a"), ("other", "b")))
    both = pairs.select("one", "other").join(first, "one").join(second, "other")
    return both.mapInPandas(run, "one bigint, other bigint, dist double")


def _staged(df: DataFrame) -> DataFrame:
    """A narrow table written and read again, so that its joins are planned by its true size."""
    path = f"{checkpoint_dir(df.sparkSession)}/links-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _side(packed: DataFrame, side: str) -> DataFrame:
    return packed.select([F.col(c).alias(f"{side}_{c}") for c in packed.columns])


def _opened(r, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(getattr(r, f"{side}_keys"), "int64")
    return keys, np.frombuffer(getattr(r, f"{side}_most")), np.frombuffer(getattr(r, f"{side}_axes"), "float32").reshape(len(keys), -1)


def _row(keys: np.ndarray, most: np.ndarray, z: np.ndarray) -> dict:
    return {"keys": [keys.tobytes()], "most": [most.tobytes()], "axes": [z.tobytes()]}


def links_of_many(points: DataFrame, key: str, region_rows: int = REGION_ROWS) -> DataFrame:
    """Ids of points of opposite classes that are each the nearest neighbour of the other, ties by key.

    ``points`` has a bigint key, ``v`` and ``cls``, null for a point that takes part only as a neighbour. The points of a region bound each
    other's nearest distance along the axes; pairs of two classes that may lie within both bounds are measured, and the ends of the links they
    leave are looked up among all points. Regions are packed once and read pair by pair, so what is written grows as the points do.
    """
    empty = points.sparkSession.createDataFrame([], f"`{key}` bigint")
    n = points.count()
    if n < 2:
        return empty
    axes = _Axes(_pivots(points, key, SHOWN_ROWS), max(0, math.ceil(math.log2(n / region_rows))))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                yield pdf.drop(columns="v").assign(z=[row.tobytes() for row in axes.rotated(v)], region=axes.region(v))

    rotated = checkpointed(points.select(key, "cls", "v").mapInPandas(placed, f"`{key}` bigint, cls string, z binary, region bigint"))
    # one row a region
    sizes = {r["region"]: r["count"] for r in rotated.groupBy("region").count().collect()}
    parts = [-(-sizes.get(i, 0) // region_rows) for i in range(2**axes.depth)]
    start = [int(x) for x in np.cumsum(parts) - parts]
    pieces, offset = (F.get(F.array(*[F.lit(x) for x in xs]), F.col("region").cast("int")) for xs in (parts, start))
    spread = rotated.select(key, "cls", "z", (offset + F.pmod(F.xxhash64(F.col(key)), pieces)).cast("int").alias("g"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            own = pd.concat(held, ignore_index=True)
            keys, z = own[key].to_numpy("int64"), np.frombuffer(b"".join(own["z"]), "float32").reshape(len(own), -1)
            most = _bounds(z)
            for c, i in own.groupby("cls", dropna=False).indices.items():
                yield pd.DataFrame(_row(keys[i], most[i], z[i]) | {"cls": [None if pd.isna(c) else c]})

    packed = checkpointed(spread.repartitionById(sum(parts), F.col("g")).mapInPandas(pack, "keys binary, most binary, axes binary, cls string"))

    def opposite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, p = _opened(r, "q"), _opened(r, "p")
                # the side whose bounds are tighter rules out more
                if np.median(p[1]) < np.median(q[1]):
                    q, p = p, q
                found = []
                for at in _within(q[2], q[1], p[2], p[1]):
                    stay = _not_beaten(at[0], at[2], at[3], len(q[0]))
                    found.append([x[stay] for x in at])
                if found:
                    i, j, low, high = (np.concatenate(x) for x in zip(*found))
                    stay = _not_beaten(j, low, high, len(p[0]))
                    yield pd.DataFrame({"one": q[0][i[stay]], "other": p[0][j[stay]]})

    pairs = _staged(_paired(_side(packed, "q"), _side(packed, "p"), F.col("q_cls") < F.col("p_cls")).mapInPandas(opposite, "one bigint, other bigint"))
    ids = _staged(pairs.select(F.explode(F.array("one", "other")).alias(key)).distinct())
    vectors = checkpointed(points.select(key, "v").join(ids, key, "left_semi"))
    measured = checkpointed(_measured(pairs, vectors, key))
    both = measured.unionByName(measured.select(F.col("other").alias("one"), F.col("one").alias("other"), "dist"))
    w = Window.partitionBy("one").orderBy("dist", "other")
    best = both.withColumn("rk", F.row_number().over(w)).filter("rk = 1").drop("rk")
    back = best.select(F.col("one").alias("other"), F.col("other").alias("one"))
    ends = _staged(best.join(back, ["one", "other"], "left_semi"))
    asked = ends.count()
    if not asked:
        return empty

    def pack_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            own = pd.concat(held, ignore_index=True)
            keys, others = own["one"].to_numpy("int64"), own["other"].to_numpy("int64")
            yield pd.DataFrame(_row(keys, own["dist"].to_numpy("float64"), axes.rotated(np.stack(own["v"].to_numpy()))) | {"others": [others.tobytes()]})

    blocks = -(-asked // region_rows)
    asking = ends.join(vectors.withColumnRenamed(key, "one"), "one").withColumn("g", F.pmod(F.xxhash64("one"), F.lit(blocks)).cast("int"))
    asking = checkpointed(asking.repartitionById(blocks, F.col("g")).mapInPandas(pack_ends, "keys binary, most binary, axes binary, others binary"))

    def nearer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, p, others = _opened(r, "q"), _opened(r, "p"), np.frombuffer(r.q_others, "int64")
                for i, j, _, high in _within(q[2], q[1], p[2], np.full(len(p[0]), np.inf)):
                    third = (p[0][j] != q[0][i]) & (p[0][j] != others[i])
                    i, j, high = i[third], j[third], high[third]
                    lost = np.unique(i[high < q[1][i]])
                    open_ = ~np.isin(i, lost)
                    yield pd.DataFrame({"one": q[0][lost], "other": q[0][lost], "sure": True})
                    yield pd.DataFrame({"one": q[0][i[open_]], "other": p[0][j[open_]], "sure": False})

    found = _staged(_paired(_side(asking, "q"), _side(packed.drop("cls"), "p")).mapInPandas(nearer, "one bigint, other bigint, sure boolean"))
    sure = found.filter("sure").select("one").distinct()
    # what the axes leave open is measured
    doubt = _staged(found.filter("NOT sure").join(sure, "one", "left_anti").select("one", "other"))
    ids = _staged(doubt.select(F.explode(F.array("one", "other")).alias(key)).distinct())
    third = _measured(doubt, checkpointed(points.select(key, "v").join(ids, key, "left_semi")), key).withColumnsRenamed({"other": "third", "dist": "to_third"})
    beaten = third.join(ends, "one").filter("to_third < dist OR (to_third = dist AND third < other)").select("one")
    lost = _staged(sure.unionByName(beaten).distinct())
    kept = ends.join(lost, "one", "left_anti").join(lost.withColumnRenamed("one", "other"), "other", "left_anti")
    return kept.select(F.col("one").alias(key))


# -- synthetic minority rows -------------------------------------------------------------------


def split_columns(df: DataFrame, features: Iterable[str]) -> tuple[list[str], list[str]]:
    """(continuous, nominal): columns with at most two values are nominal."""
    features = list(features)
    few = few_valued(df, features)
    return [c for c in features if not few[c]], [c for c in features if few[c]]


def distinct_points(df: DataFrame, features: list[str], vector: Column, id_col: str) -> DataFrame:
    """One row per distinct point: its smallest id, coordinates and multiplicity."""
    return df.withColumn("v", vector).groupBy("v", *features).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("mult"))


def _above(column: str, low: float):
    """Predicate of a neighbour with the upper of the two values."""
    return lambda x: x[column] > low


def synthetic_minority(
    df: DataFrame, features: Iterable[str], seed: int | str = 0, k: int = 5, id_col: str = CLIENT, target: str = TARGET
) -> DataFrame:
    """Rows of the frame plus synthetic minority rows, to the size of the majority.

    A synthetic row starts at a minority row, picks one of its k nearest minority neighbours and lies
    between the two in the continuous columns; a nominal column takes the commonest value of the
    neighbours. Features must be numeric and already scaled. New ids are negative.
    """
    features = list(features)
    sizes = class_sizes(df, target)
    minor, major = sorted(sizes, key=lambda c: sizes[c])[0], max(sizes, key=lambda c: sizes[c])
    need = sizes[major] - sizes[minor]
    continuous, nominal = split_columns(df, features)
    rows = df.filter(F.col(target) == minor).select(F.col(id_col).cast("bigint").alias(id_col), *[F.col(c).cast("double").alias(c) for c in features])
    rows = checkpointed(rows)
    # nominal differences weigh like the median deviation of the continuous columns
    dev = rows.agg(*[F.stddev_samp(c).alias(f"d{i}") for i, c in enumerate(continuous)]).first() if continuous else []
    spread = [d for d in dev if d is not None]
    penalty = float(np.median(spread)) if spread else 1.0
    ends = rows.agg(*[F.array(F.min(c), F.max(c)).alias(f"e{i}") for i, c in enumerate(nominal)]).first() if nominal else []
    spans = {c: (low, (high - low) or 1.0) for c, (low, high) in zip(nominal, ends)}
    unit = {c: (F.col(c) - a) / s for c, (a, s) in spans.items()}
    vector = F.array(*[F.col(c) for c in continuous], *[e * penalty for e in unit.values()])
    points = checkpointed(distinct_points(rows, features, vector, id_col))
    near = exact_neighbours(points, id_col, k)
    # a point repeated m times is its own neighbour m - 1 times, before any other
    twins = points.filter("mult > 1").select(id_col, F.col(id_col).alias("nb"), F.lit(0.0).alias("dist"), (F.col("mult") - 1).alias("mult"), F.lit(0).alias("rk"))
    near = near.unionByName(twins)
    w = Window.partitionBy(id_col).orderBy("rk").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum("mult").over(w), F.lit(0))).filter(F.col("before") < k)
    near = near.withColumn("take", F.least("mult", F.lit(k) - F.col("before")))
    values = points.select(F.col(id_col).alias("nb"), F.struct(*features).alias("nv"))
    wide = near.join(values, "nb").select(id_col, "rk", "take", "nv")
    # at most k entries per point
    lists = wide.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rk", "take", "nv"))).alias("nbs"))
    base = hash_rank(rows.select(id_col, *features), id_col, seed, name="pos")
    copies = F.floor((F.lit(need) + sizes[minor] - F.col("pos")) / sizes[minor]).cast("int")
    same = points.select(F.col(id_col).alias("rep"), *features)
    started = base.withColumn("n_new", copies).filter("n_new > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n_new"))))
    started = started.join(same, features).join(lists.withColumnRenamed(id_col, "rep"), "rep")
    flat = F.flatten(F.transform("nbs", lambda x: F.array_repeat(x["nv"], x["take"].cast("int"))))

    def draw(what: str) -> Column:
        h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col("j").cast("string"), F.lit(f"{what}|{seed}")))
        return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint")

    picked = started.withColumn("all", flat).withColumns(
        {"pick": F.get("all", F.pmod(draw("neighbour"), F.size("all").cast("bigint")).cast("int")), "gap": draw("gap") / float(16**12)}
    )
    new = {c: F.col(c) + F.col("gap") * (F.col(f"pick.{c}") - F.col(c)) for c in continuous}
    for c, (a, s) in spans.items():
        ones = F.size(F.filter("all", _above(c, a)))
        new[c] = F.when(ones * 2 > F.size("all"), F.lit(a + s)).otherwise(F.lit(a))
    made = picked.select(
        (-(F.col("pos") * (need // max(1, sizes[minor]) + 2) + F.col("j"))).cast("bigint").alias(id_col),
        *[new[c].alias(c) for c in features],
        F.lit(minor).cast(dict(df.dtypes)[target]).alias(target),
    )
    return df.select(F.col(id_col).cast("bigint").alias(id_col), *[F.col(c).cast("double").alias(c) for c in features], target).unionByName(made)


def tomek_links(df: DataFrame, features: Iterable[str], id_col: str = CLIENT, target: str = TARGET) -> DataFrame:
    """Ids in a Tomek link: two rows of opposite classes, each the nearest neighbour of the other."""
    features = list(features)
    vector = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), target, vector.alias("v"))
    points = checkpointed(
        rows.groupBy("v").agg(
            F.min(id_col).alias(id_col), F.max(id_col).alias("last"), F.count(F.lit(1)).alias("mult"), F.min(target).alias("lo"), F.max(target).alias("hi")
        )
    )
    # a repeated point is at distance zero of its twins; it links only when there are two, of opposite classes
    twins = points.filter("mult = 2 AND lo <> hi").select(F.explode(F.array(id_col, "last")).alias(id_col))
    cls = F.when(F.col("mult") == 1, F.col("lo").cast("string")).alias("cls")
    if len(features) > MANY_COORDINATES and points.count() > FEW_POINTS:
        return links_of_many(points.select(id_col, "v", cls), id_col).unionByName(twins).distinct()
    single = points.filter("mult = 1").select(id_col, "lo").withColumnRenamed("lo", "cls")
    near = exact_neighbours(points.select(id_col, "v", "mult"), id_col, 1).select(id_col, "nb")
    one = near.join(single, id_col).join(single.select(F.col(id_col).alias("nb"), F.col("cls").alias("other")), "nb")
    back = one.select(F.col(id_col).alias("nb"), F.col("nb").alias(id_col))
    mutual = one.filter("cls <> other").join(back, [id_col, "nb"], "left_semi").select(id_col)
    return mutual.unionByName(twins).distinct()


def synthetic_without_links(
    df: DataFrame, features: Iterable[str], seed: int | str = 0, k: int = 5, id_col: str = CLIENT, target: str = TARGET
) -> DataFrame:
    """Synthetic minority rows, then every row of a Tomek link removed."""
    features = list(features)
    grown = checkpointed(synthetic_minority(df, features, seed, k, id_col, target))
    return grown.join(tomek_links(grown, features, id_col, target), id_col, "left_anti")
