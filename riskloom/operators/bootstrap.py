"""Class-preserving resampling without a shuffle of draws.

The rows of a class are cut into buckets by the hash of their id. For every replicate the draws of a class are first
counted per bucket (a multinomial over the bucket sizes, made by tasks that hold no rows), and each bucket then makes its own
draws in the task that holds its rows. What is shuffled is each row once and one count per bucket and replicate; statistics leave a task as
sums per replicate. Draws are arithmetic modulo a prime, so that any engine can rebuild them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranks import hash_of

#: Fixed values of the draws: the prime, and what a replicate, a class and a bucket add to a stream's number.
PRIME = 2**31 - 1
STEPS = (1103515245, 69069, 40692)
#: Rows of a bucket, about. It bounds the memory of a task.
BUCKET_ROWS = 32_768
#: Draws made at once, drawn rows of an output batch, replicates whose counts travel together.
CHUNK, BATCH, TOGETHER = 1 << 20, 1 << 16, 16


def seed_number(seed: int | str) -> int:
    """A number for any seed."""
    return int(hashlib.md5(str(seed).encode()).hexdigest()[:7], 16)


def mixed(x):
    """x ** 5 modulo the prime, which permutes the numbers below it."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


@dataclass(frozen=True)
class Stream:
    """The numbers of one replicate and class; of one bucket, or of the choice among buckets (bucket -1)."""

    start: int
    stride: int

    @staticmethod
    def of(seed: int, replicate: int, ordinal: int, bucket: int = -1) -> Stream:
        a, b, c = STEPS
        start = mixed((replicate * a + (ordinal + 1) * b + (bucket + 1) * c + seed) % PRIME)
        return Stream(start, 1 + mixed((start + 1) % PRIME) % (PRIME - 1))

    def numbers(self, k: np.ndarray) -> np.ndarray:
        return mixed((self.start + k * self.stride) % PRIME)

    def positions(self, k: np.ndarray, size: int) -> np.ndarray:
        """Positions below any size, from two numbers each."""
        first = self.numbers(k)
        return (first * (PRIME + 1) + mixed((first + self.start) % PRIME)) % size


@dataclass(frozen=True)
class Plan:
    """Classes in order with their sizes, rows of each bucket, replicates and seed."""

    sizes: dict
    buckets: dict[int, np.ndarray]
    replicates: int
    seed: int

    def counts(self, replicate: int, ordinal: int) -> np.ndarray:
        """How many draws of a class fall into each of its buckets."""
        stream, ends = Stream.of(self.seed, replicate, ordinal), np.cumsum(self.buckets[ordinal])
        out = np.zeros(len(ends), dtype=np.int64)
        for at in range(0, int(ends[-1]), CHUNK):
            k = np.arange(at, min(at + CHUNK, int(ends[-1])))
            out += np.bincount(np.searchsorted(ends, stream.positions(k, int(ends[-1])), side="right"), minlength=len(ends))
        return out

    def weights(self, replicate: int, ordinal: int, bucket: int, draws: int) -> np.ndarray:
        """How often each row of a bucket is drawn."""
        rows = int(self.buckets[ordinal][bucket])
        return np.bincount(Stream.of(self.seed, replicate, ordinal, bucket).numbers(np.arange(draws)) % rows, minlength=rows)


def dealt(df: DataFrame, sizes: Mapping, replicates: int, seed: int | str, id_col: str, target: str, bucket_rows: int) -> tuple[DataFrame, Plan]:
    """Rows with class ordinal, bucket and hash, and the plan of their draws."""
    classes = sorted(sizes)
    ordinal = F.coalesce(*[F.when(F.col(target) == c, i) for i, c in enumerate(classes)])
    wide = {i: -(-sizes[c] // bucket_rows) for i, c in enumerate(classes)}
    number = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint")
    rows = df.withColumn("_h", hash_of(id_col, seed)).withColumn("_class", ordinal).filter(F.col("_class").isNotNull())
    rows = rows.withColumn("_bucket", (number % F.coalesce(*[F.when(F.col("_class") == i, n) for i, n in wide.items()])).cast("int"))
    held = {i: np.zeros(n, dtype=np.int64) for i, n in wide.items()}
    # one row a bucket, that is one for each bucket_rows rows
    for r in rows.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r["_class"]][r["_bucket"]] = r["n"]
    return rows, Plan({c: sizes[c] for c in classes}, held, replicates, seed_number(seed))


def _choices(spark, plan: Plan, parts: int) -> DataFrame:
    """(class, bucket, replicates, draws): the multinomial counts, each task making those of its replicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for at in range(0, len(ids), TOGETHER):
                own = ids[at : at + TOGETHER]
                for ordinal, rows in plan.buckets.items():
                    counts = np.stack([plan.counts(int(r), ordinal) for r in own])
                    n = len(rows)
                    columns = [pa.array(np.full(n, ordinal, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array([own.astype(np.int32).tobytes()] * n), pa.array([c.tobytes() for c in counts.T.astype(np.int64)])]
                    yield pa.RecordBatch.from_arrays(columns, names=["_class", "_bucket", "_replicates", "_draws"])

    return spark.range(1, plan.replicates + 1, 1, parts).mapInArrow(run, "_class int, _bucket int, _replicates binary, _draws binary")


def _buckets(batches: Iterator[pa.RecordBatch], plan: Plan, columns: list[str]) -> Iterator[tuple[int, int, np.ndarray, pa.Table]]:
    """Class, bucket, draws of each replicate and rows of every bucket of a sorted partition."""
    key, draws, held = None, None, []

    def whole():
        return key[0], key[1], draws, pa.Table.from_batches(held)

    for batch in batches:
        kinds = [batch[c].to_numpy() for c in ("_class", "_bucket", "_row")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in kinds], axis=0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            own = (int(kinds[0][i]), int(kinds[1][i]))
            if own != key:
                if held:
                    yield whole()
                key, draws, held = own, np.zeros(plan.replicates + 1, dtype=np.int64), []
            if kinds[2][i]:
                held.append(batch.select(columns).slice(i, j - i))
            else:
                for r, n in zip(batch["_replicates"][i:j].to_pylist(), batch["_draws"][i:j].to_pylist()):
                    draws[np.frombuffer(r, dtype=np.int32)] = np.frombuffer(n, dtype=np.int64)
    if held:
        yield whole()


def _met(rows: DataFrame, plan: Plan, id_col: str, parts: int) -> DataFrame:
    """Each bucket's counts, then its rows in the order of their hash, in one partition."""
    met = rows.withColumn("_row", F.lit(1)).unionByName(_choices(rows.sparkSession, plan, parts).withColumn("_row", F.lit(0)), allowMissingColumns=True)
    return met.repartition(parts, "_class", "_bucket").sortWithinPartitions("_class", "_bucket", "_row", "_h", id_col)


def drawn_rows(rows: DataFrame, plan: Plan, columns: list[str], id_col: str, parts: int) -> DataFrame:
    """The drawn rows with ``replicate`` and ``weight``, straight from the task of their bucket."""
    schema = rows.select(*columns).schema.add("replicate", "integer").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ordinal, bucket, draws, own in _buckets(batches, plan, columns):
            picked, replicates, weights, held = [], [], [], 0
            for r in range(1, plan.replicates + 1):
                w = plan.weights(r, ordinal, bucket, int(draws[r]))
                at = np.flatnonzero(w)
                picked.append(at)
                replicates.append(np.full(len(at), r, dtype=np.int32))
                weights.append(w[at])
                held += len(at)
                if held >= BATCH or r == plan.replicates:
                    out = own.take(pa.array(np.concatenate(picked))).append_column("replicate", pa.array(np.concatenate(replicates))).append_column("weight", pa.array(np.concatenate(weights)))
                    yield from out.combine_chunks().to_batches()
                    picked, replicates, weights, held = [], [], [], 0

    return _met(rows, plan, id_col, parts).mapInArrow(run, schema)


def drawn_sums(rows: DataFrame, plan: Plan, names: Iterable[str], id_col: str, parts: int) -> DataFrame:
    """(replicate, name, total, weight): weighted totals of value columns over the drawn rows that have one.

    A task keeps two numbers for each replicate and name, and sends on no more than these.
    """
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, plan.replicates, len(names)))
        seen = False
        for ordinal, bucket, draws, own in _buckets(batches, plan, names):
            seen = True
            values = np.stack([own[c].to_numpy().astype(np.float64) for c in names], axis=1)
            there = ~np.isnan(values)
            both = np.concatenate([np.where(there, values, 0.0), there], axis=1)
            for r in range(1, plan.replicates + 1):
                got = plan.weights(r, ordinal, bucket, int(draws[r])) @ both
                sums[:, r - 1] += got.reshape(2, -1)
        if seen:
            lists = [[list(sums[k, :, i]) for i in range(len(names))] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(x, pa.list_(pa.float64())) for x in lists)], names=["name", "total", "weight"])

    part = _met(rows, plan, id_col, parts).mapInArrow(run, "name string, total array<double>, weight array<double>")
    each = part.select("name", F.posexplode(F.arrays_zip("total", "weight")).alias("at", "s"))
    return each.groupBy("name", (F.col("at") + 1).alias("replicate")).agg(F.sum("s.total").alias("total"), F.sum("s.weight").alias("weight"))
