"""Embedding whitening by an incremental eigendecomposition.

A component c of a vector becomes the whole number floor(1024 * c) + 100000. Every partition keeps count, exact sums and the
eigendecomposition of its centred scatter, and raises it by one rank for each distinct vector of a batch (weighted by its copies): the
eigenvalues are the roots of the secular equation, entries that would not move are deflated, and the eigenvectors are built from weights
recomputed from the roots, which keeps them orthogonal. Spectra of partitions are joined by successive rank-one updates (one for the
distance of the means, one for each eigenvalue of the other) in a tree of joins. A last Rayleigh-Ritz step over all vectors, centred by the
exact means, gives the eigenvectors to double precision.

Vectors of each length are a fit of their own; a fit's state is length x length numbers, and fits are
brought to the driver in groups of bounded size, one after the other.

Cases: vectors null, or with null or non-finite entries are dropped, empty ones have no components; equal rows count each; rows without
vec_id take part. Entries beyond 2 ** 53 are taken as 2 ** 53. A component without variance (below 1e-12 of the first) is whitened
to 0 and doesn't count for identity_error; explained is 0 where the trace is. A deviation that a long can't hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import tree

COMPONENTS = 8
SCALE, SHIFT, MOST = 1024, 100_000, 2.0**53
#: Numbers of the fits that the driver holds at once.
HELD = 1 << 22
#: Steps of the root finder; it needs about six.
STEPS = 60
NO_VARIANCE = 1e-12
EPS = float(np.finfo(np.float64).eps)


def grid(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers of the components."""
    return np.clip(np.floor(SCALE * vectors), -MOST, MOST).astype(np.int64) + SHIFT


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """d[j] minus the i-th eigenvalue of diag(d) + rho z z' (row i, column j), without cancellation.

    ``d`` rises strictly, z has no zeros, rho > 0. The i-th root lies between d[i] and the next pole. Each is found as a distance from its
    nearer pole, by interpolating with the two poles around it, inside a bracket that is halved when a step leaves it.
    """
    k, weights = len(d), rho * z * z
    width = np.append(np.diff(d), weights.sum() * (1 + 4 * EPS * k))
    rows = np.arange(k)
    gaps = d[None, :] - d[:, None]
    at_middle = 1 + (weights / (gaps - width[:, None] / 2)).sum(axis=1)
    from_left = (at_middle >= 0) | (rows == k - 1)
    origin = np.where(from_left, rows, rows + 1)
    delta = gaps[origin]
    low = np.where(from_left, 0.0, -width / 2)
    high = np.where(from_left, np.where(rows == k - 1, width, width / 2), 0.0)
    t = (low + high) / 2
    left, right = delta[rows, rows], delta[rows, np.minimum(rows + 1, k - 1)]
    below = rows[None, :] <= rows[:, None]
    last = rows == k - 1
    for _ in range(STEPS):
        far = delta - t[:, None]
        terms = weights / far
        f = 1 + terms.sum(axis=1)
        found = np.abs(f) <= 4 * EPS * (1 + np.abs(terms).sum(axis=1))
        if found.all():
            break
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        slopes = terms / far
        both = slopes.sum(axis=1)
        psi = np.where(below, slopes, 0.0).sum(axis=1)
        x, y = left - t, right - t
        a, b, c = (x + y) * f - x * y * both, x * y * f, f - x * psi - y * (both - psi)
        root = np.sqrt(np.maximum(0.0, a * a - 4 * b * c))
        step = np.where(a <= 0, (a - root) / (2 * np.where(c == 0, 1.0, c)), 2 * b / np.where(a + root == 0, 1.0, a + root))
        rest = f - both * x  # the last root has one pole: f is about rest + slope / distance
        step[last] = (x + both * x * x / np.where(rest == 0, 1.0, rest))[last]
        new = t + step
        found |= np.abs(step) <= EPS * np.abs(t)
        if found.all():
            break
        t = np.where(found, t, np.where((new > low) & (new < high), new, (low + high) / 2))
    return delta - t[:, None]


def raised(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and the eigenvectors of vectors diag(values) vectors' + rho v v', rho >= 0."""
    z = vectors.T @ v
    size = float(np.sqrt(z @ z))
    if not rho * size * size > 0:
        return values, vectors
    z, rho = z / size, rho * size * size
    most = max(abs(float(values[0])), abs(float(values[-1])), rho)
    same = np.diff(values) <= 8 * EPS * most
    if same.any():  # of equal eigenvalues only one moves: a reflection turns their part of z into one entry
        vectors = vectors.copy()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for i, j in zip(edges[::2], edges[1::2] + 1):
            part = z[i:j]
            norm = np.copysign(np.sqrt(part @ part), part[-1])
            if norm:
                mirror = part.copy()
                mirror[-1] += norm
                mirror /= np.sqrt(mirror @ mirror)
                z[i:j] = 0.0
                z[j - 1] = -norm
                vectors[:, i:j] -= 2 * np.outer(vectors[:, i:j] @ mirror, mirror)
    moves = rho * np.abs(z) > 8 * EPS * most
    if not moves.any():
        return values, vectors
    d, own = values[moves], z[moves]
    far = secular_roots(d, own, rho)
    k = len(d)
    roots = d - np.diagonal(far)
    # the weights for which the roots are exact: products of ratios, each at most 1
    gaps = d[None, :] - d[:, None]
    i, j = np.indices((k, k))
    other = np.where(i < j, i, np.minimum(i + 1, k - 1))
    base = np.where(i < k - 1, gaps[other, j], 1.0)
    exact = np.sqrt(np.abs(np.prod(far / base, axis=0))) * np.where(own < 0, -1.0, 1.0)
    turn = exact[:, None] / far.T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[moves], out_vectors[:, moves] = roots, vectors[:, moves] @ turn
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums and eigendecomposition of the centred scatter of some vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(length: int) -> Spectrum:
        return Spectrum(0, [0] * length, np.zeros(length), np.eye(length))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def add(self, x: np.ndarray, copies: int) -> None:
        """One vector of whole numbers, ``copies`` times."""
        if self.n:
            self.values, self.vectors = raised(self.values, self.vectors, x - self.mean(), self.n * copies / (self.n + copies))
        self.n += copies
        self.sums = [s + copies * c for s, c in zip(self.sums, x.tolist())]

    def join(self, other: Spectrum) -> None:
        """All vectors of another spectrum."""
        apart, rho = other.mean() - self.mean(), self.n * other.n / (self.n + other.n)
        self.values, self.vectors = raised(self.values, self.vectors, apart, rho)
        for d, q in zip(other.values, other.vectors.T):
            if d > 0:
                self.values, self.vectors = raised(self.values, self.vectors, q, float(d))
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]


@dataclass(frozen=True)
class Whitener:
    """A fit: count, exact sums, unit components by falling eigenvalue, the eigenvalues and their sum."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def lively(self) -> np.ndarray:
        """Components that have variance."""
        return self.values > NO_VARIANCE * max(float(self.values[0]), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Whitened leading components of rows of whole numbers."""
        scale = np.where(self.lively, 1 / np.sqrt(np.where(self.lively, self.values, 1.0)), 0.0)
        return (x - self.mean) @ self.components * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - sum) ** 2 over the dimensions, exact."""
        size = ((x - self.mean) ** 2).sum(axis=1) * float(self.n) ** 2
        most = max(map(abs, self.sums), default=0)
        if most < 2**62 and float(np.abs(x).max(initial=0)) * self.n < 2**62 and size.max(initial=0) < 2**62:
            off = self.n * x - np.array(self.sums, dtype=np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = (sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist())
        return [e if e < 2**63 else None for e in exact]


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and components as doubles of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("v").isNotNull() & finite & (F.size("v") > 0))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and whole numbers of the vectors of each length in a batch."""
    column = batch["v"]
    lengths = column.value_lengths().to_numpy()
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, grid(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), length))


_STATE = "length bigint, part bigint, n bigint, sums array<string>, numbers binary"


def _state(length: int, part: int, n: int, sums: list[int], numbers: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([length], pa.int64()), pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string())), pa.array([numbers.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["length", "part", "n", "sums", "numbers"])


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(bytes(raw), dtype=np.float64)


def _spectrum(state) -> Spectrum:
    """The spectrum that a state holds."""
    length, numbers = state["length"], _numbers(state["numbers"])
    return Spectrum(state["n"], [int(s) for s in state["sums"]], numbers[:length].copy(), numbers[length:].reshape(length, length).copy())


def spectra(rows: DataFrame) -> DataFrame:
    """One spectrum for each length of the rows of ``valid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Spectrum] = {}
        for batch in batches:
            for length, _, x in _by_length(batch):
                spectrum = own.setdefault(length, Spectrum.empty(length))
                distinct, copies = np.unique(x, axis=0, return_counts=True)
                for one, many in zip(distinct, copies.tolist()):
                    spectrum.add(one, many)
        for length, s in sorted(own.items()):
            yield _state(length, TaskContext.get().partitionId(), s.n, s.sums, np.concatenate([s.values, s.vectors.ravel()]))

    def join(held: dict, own: dict) -> dict:
        s = _spectrum(held)
        s.join(_spectrum(own))
        return {"n": s.n, "sums": [str(x) for x in s.sums], "numbers": np.concatenate([s.values, s.vectors.ravel()]).tobytes()}

    return tree(rows.select("vec_id", "v").mapInArrow(run, _STATE), "length", join)


def scatters(rows: DataFrame, centres: dict[int, np.ndarray], axes: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each length of ``axes``, the scatter of the centred rows along its axes, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in _by_length(batch):
                if length in axes:
                    y = (x - centres[length]) @ axes[length]
                    own[length] = own.get(length, 0) + y.T @ y
        for length, g in sorted(own.items()):
            yield _state(length, TaskContext.get().partitionId(), 0, [], g.ravel())

    summed = tree(rows.mapInArrow(run, _STATE), "length", lambda held, own: {"numbers": (_numbers(held["numbers"]) + _numbers(own["numbers"])).tobytes()})
    return {r["length"]: _numbers(r["numbers"]).reshape(axes[r["length"]].shape[1], -1) for r in summed.collect()}  # a state for each length of the group


def refined(rows: DataFrame, found: dict[int, Spectrum], components: int = COMPONENTS) -> dict[int, Whitener]:
    """The Rayleigh-Ritz step: the covariance of all rows along the eigenvectors found, diagonalised."""
    axes = {k: np.linalg.qr(s.vectors[:, ::-1])[0] for k, s in found.items()}
    centres = {k: s.mean() for k, s in found.items()}
    out = {}
    for k, g in scatters(rows, centres, axes).items():
        values, turn = np.linalg.eigh((g + g.T) / (2 * found[k].n))
        whole = axes[k] @ turn[:, ::-1][:, :components]
        whole *= np.where(np.take_along_axis(whole, np.abs(whole).argmax(axis=0)[None, :], axis=0) < 0, -1.0, 1.0)
        out[k] = Whitener(found[k].n, found[k].sums, whole, values[::-1][:components], float(values.sum()))
    return out


def fits(rows: DataFrame, components: int = COMPONENTS) -> Iterator[dict[int, Whitener]]:
    """Fits of all lengths, in groups whose states together hold at most ``HELD`` numbers (or one state)."""
    states = spectra(rows)
    groups: list[list[int]] = [[]]
    for length in sorted(r["length"] for r in states.select("length").distinct().collect()):
        if groups[-1] and sum(k * k for k in groups[-1]) + length * length > HELD:
            groups.append([])
        groups[-1].append(length)
    for own in groups:
        found = {r["length"]: _spectrum(r) for r in states.filter(F.col("length").isin(own)).collect()}
        if found:
            yield refined(rows, found, components)


def identity_errors(rows: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """For each length, the largest entry by which the covariance of the whitened rows differs from the identity."""
    scaled = {k: m.components[:, m.lively] / np.sqrt(m.values[m.lively]) for k, m in models.items() if m.lively.any()}
    got = scatters(rows, {k: m.mean for k, m in models.items()}, scaled)
    return {k: float(np.abs(g / models[k].n - np.eye(len(g))).max()) for k, g in got.items()}


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: one row for each remaining vector and component."""
    rows = valid(vectors)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    out = rows.sparkSession.createDataFrame([], schema)
    for models in fits(rows, components):
        out = out.unionByName(_projected(rows, models, identity_errors(rows, models), schema))
    return out


def _projected(rows: DataFrame, models: dict[int, Whitener], errors: dict[int, float], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, own, x in _by_length(batch):
                if length not in models:
                    continue
                m = models[length]
                k, n = len(m.values), len(own)
                ids = batch["vec_id"].take(pa.array(np.repeat(own, k)))
                explained = np.tile(m.values / m.trace if m.trace > 0 else np.zeros(k), n)
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m.n)), pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))]
                columns += [pa.array(m.whitened(x).ravel()), pa.array(explained), pa.array(np.full(n * k, errors.get(length, 0.0)))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
