"""Ridge logistic regressions of many cells at once: one aggregate of the rows per Newton step.

A cell is a fitting part, such as all rows outside one fold of one seed. A step reads every row once and sums, for all cells,
loss, gradient and Hessian as matrices inside the tasks; what leaves a task is a few numbers for each pair of features and cell,
whatever its rows, and partial sums are joined in a tree. The equations of each cell are solved on the driver: their size depends on
features and cells only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.splits import CLIENT, TARGET
from riskloom.operators.stages import quoted

#: Partial sums joined by one task of a level.
FAN = 32
STEPS, TOLERANCE = 60, 1e-9


@dataclass(frozen=True)
class Fit:
    """One cell: coefficients on the columns scaled by the cell's own mean and deviation, and the largest entry of the gradient."""

    seed: int | None
    fold: int | None
    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercept: float
    gradient: float
    loss: float
    steps: int

    def plain(self) -> tuple[np.ndarray, float]:
        """Coefficients on the columns as they are, and the intercept."""
        raw = self.coefficients / self.scale
        return raw, float(self.intercept - raw @ self.mean)


def summed(parts: DataFrame, tasks: int) -> np.ndarray:
    """The sum of (part, numbers) rows, ``FAN`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["numbers"].to_pylist()):
                own = np.frombuffer(raw, dtype=np.float64)
                if key is not None and part != key:
                    yield _numbers(key, total)
                total = total + own if part == key else own
                key = part
        if key is not None:
            yield _numbers(key, total)

    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN}")).repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, "part bigint, numbers binary")
    rows = parts.collect()  # one row, or none without data
    return np.frombuffer(bytes(rows[0]["numbers"]), dtype=np.float64) if rows else np.zeros(0)


def _numbers(part: int, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([numbers.tobytes()], pa.binary())], names=["part", "numbers"])


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1).astype(np.float64)


def _masks(seeds: list[int], cells: list):
    """A function giving rows x cells of a batch: whether a row helps to fit a cell."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        if not seeds:
            return np.ones((len(batch), 1))
        own = {s: batch[f"_own{i}"].to_numpy(zero_copy_only=False) for i, s in enumerate(seeds)}
        return np.stack([own[s] != f for s, f in cells], axis=1).astype(np.float64)

    return of


class Cells:
    """A numeric matrix with the fold of every row for each seed, ready to be fitted and scored cell by cell."""

    def __init__(self, matrix: DataFrame, features: Iterable[str], folds: DataFrame | None = None, target: str = TARGET, id_col: str = CLIENT):
        self.features, self.target, self.id_col = tuple(features), target, id_col
        self.seeds: list[int] = []
        self.cells: list[tuple[int | None, int | None]] = [(None, None)]
        rows = matrix
        own = []
        if folds is not None:
            found = sorted((r["seed"], r["fold"]) for r in folds.select("seed", "fold").distinct().collect())
            self.cells, self.seeds = found, sorted({s for s, _ in found})
            marks = folds.groupBy(id_col).agg(*[F.max(F.when(F.col("seed") == s, F.col("fold"))).cast("double").alias(f"_own{i}") for i, s in enumerate(self.seeds)])
            rows = matrix.join(marks, id_col, "left")
            own = [f"_own{i}" for i in range(len(self.seeds))]
            met = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in own]).first()
            lost = {s: met["n"] - met[c] for s, c in zip(self.seeds, own) if met[c] != met["n"]}
            if lost:
                raise ValueError(f"rows of the matrix without a fold, by seed: {lost}")
        self.rows = rows.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)], F.col(target).cast("double").alias("_y"), *own, quoted(id_col).alias("_id"))
        self.tasks = self.rows.rdd.getNumPartitions()

    def _sum(self, kernel) -> np.ndarray:
        """The sum of ``kernel(x, y, masks)`` over all rows."""
        width, masks = len(self.features), _masks(self.seeds, self.cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if len(batch):
                    x = _matrix(batch, width)
                    if np.isnan(x).any():
                        raise ValueError("the matrix has missing values")
                    own = kernel(x, batch["_y"].to_numpy(zero_copy_only=False), masks(batch))
                    total = own if total is None else total + own
            if total is not None:
                yield _numbers(TaskContext.get().partitionId(), total)

        # one level only while the tasks fit one fan; the tasks of the scan may differ from those of the plan
        return summed(self.rows.mapInArrow(run, "part bigint, numbers binary"), max(2, self.tasks))

    def fit(self, balanced: bool = False, c: float = 1.0) -> list[Fit]:
        """Newton steps for all cells together; a cell that has converged is left out of the next steps."""
        p, m = len(self.features), len(self.cells)
        moments = self._sum(lambda x, y, w: np.concatenate([w.sum(axis=0), w.T @ y, (w.T @ x).ravel(), (w.T @ (x * x)).ravel()]))
        n, ones = moments[:m], moments[m : 2 * m]
        if ((ones == 0) | (ones == n)).any():
            raise ValueError("a fitting part has one class only")
        mean = moments[2 * m : 2 * m + m * p].reshape(m, p) / n[:, None]
        spread = np.sqrt(np.maximum(0.0, moments[2 * m + m * p :].reshape(m, p) / n[:, None] - mean**2) * (n / np.maximum(n - 1, 1))[:, None])
        scale = np.where(spread > 1e-9 * np.maximum(1.0, np.abs(mean)), spread, np.inf)  # a constant column has no coefficient
        weight = np.stack([n / (2 * (n - ones)), n / (2 * ones)], axis=1) if balanced else np.ones((m, 2))
        theta, best = np.zeros((m, p + 1)), np.full(m, np.inf)
        step, gradient, used = np.zeros((m, p + 1)), np.full(m, np.inf), np.zeros(m, dtype=int)
        active = np.arange(m)
        for turn in range(STEPS):
            loss, g, h = self._derivatives(active, theta, mean, scale, weight)
            done = []
            for k, cell in enumerate(active):
                ridge = np.append(theta[cell, :p], 0.0) / c
                value = loss[k] + theta[cell, :p] @ theta[cell, :p] / (2 * c)
                if value > best[cell] + 1e-12 * abs(best[cell]):  # too far: half the way back
                    step[cell] /= 2
                    theta[cell] -= step[cell]
                    continue
                best[cell], used[cell] = value, turn
                slope = g[k] + ridge
                gradient[cell] = np.abs(slope).max()
                if gradient[cell] <= TOLERANCE * n[cell]:
                    done.append(cell)
                    continue
                step[cell] = -np.linalg.solve(h[k] + np.diag(np.append(np.full(p, 1 / c), 0.0)), slope)
                theta[cell] += step[cell]
            active = np.setdiff1d(active, done)
            if not len(active):
                break
        else:
            raise ValueError(f"no convergence within {STEPS} steps")
        return [Fit(*self.cells[i], self.features, mean[i], scale[i], theta[i, :p], float(theta[i, p]), float(gradient[i]), float(best[i]), int(used[i])) for i in range(m)]

    def _derivatives(self, active, theta, mean, scale, weight):
        p = len(self.features)

        def kernel(x, y, w):
            out = []
            for cell in active:
                rows = w[:, cell] > 0
                z = np.append((x[rows] - mean[cell]) / scale[cell], np.ones((int(rows.sum()), 1)), axis=1)
                own, eta = y[rows], z @ theta[cell]
                each = weight[cell][own.astype(int)]
                chance = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                loss = each @ (np.logaddexp(0, eta) - own * eta)
                out += [[loss], z.T @ (each * (chance - own)), ((z * (each * chance * (1 - chance))[:, None]).T @ z).ravel()]
            return np.concatenate(out)

        got = self._sum(kernel).reshape(len(active), -1)
        return got[:, 0], got[:, 1 : p + 2], got[:, p + 2 :].reshape(len(active), p + 1, p + 1)

    def scores(self, fits: Sequence[Fit]) -> DataFrame:
        """(id, target, seed, k, held, score): every row under every cell; ``held`` rows are those outside the fitting part."""
        width, masks, plain = len(self.features), _masks(self.seeds, self.cells), [f.plain() for f in fits]
        raw, shift = np.stack([b for b, _ in plain], axis=1), np.array([a for _, a in plain])
        seeds, folds = np.array([f.seed or 0 for f in fits], dtype=np.int32), np.array([f.fold or 0 for f in fits], dtype=np.int32)
        kind = self.rows.schema["_id"].dataType
        schema = T.StructType([T.StructField(self.id_col, kind), T.StructField(self.target, T.IntegerType()), T.StructField("seed", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("held", T.BooleanType()), T.StructField("score", T.DoubleType())])
        names = schema.fieldNames()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m = len(batch), len(seeds)
                eta = _matrix(batch, width) @ raw + shift
                own = np.repeat(np.arange(n), m)
                y = batch["_y"].to_numpy(zero_copy_only=False).astype(np.int32)
                columns = [batch["_id"].take(pa.array(own)), pa.array(y[own]), pa.array(np.tile(seeds, n)), pa.array(np.tile(folds, n)), pa.array((masks(batch) == 0).ravel()), pa.array((1 / (1 + np.exp(-np.clip(eta, -500, 500)))).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return self.rows.mapInArrow(run, schema)


def coefficients(spark, fits: Sequence[Fit]) -> DataFrame:
    """(seed, fold, feature, coefficient, plain): the coefficients of every cell, scaled and as they meet the columns."""
    rows = [(f.seed, f.fold, name, float(b), float(r)) for f in fits for name, b, r in zip((*f.features, "(intercept)"), (*f.coefficients, f.intercept), (*f.plain()[0], f.plain()[1]))]
    return spark.createDataFrame(rows, "seed int, fold int, feature string, coefficient double, plain double")
