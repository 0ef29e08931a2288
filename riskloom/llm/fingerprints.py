"""Quartile bucket digests of whole texts and their bounded difference.

A window of four bytes slides over the UTF-8 text (four zero bytes follow its end) and yields three
triplets; each is hashed to one of 128 buckets. The digest is the logarithmic length, two ratios of the
quartiles and, for each bucket, the quarter its count falls in (two bits). Equal texts have equal digests.

The difference of two digests sums the steps between quarters (three steps count double) and the bounded
differences of length and ratios; likeness is ``2 ** (-difference / 64)``: 1 for equal digests, never negative.

Cases: a null text is empty; an empty text has no triplets and all its buckets are in the lowest quarter.
Rows that repeat a doc_id follow one another by text; a null doc_id comes after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from riskloom.llm.common import partitions

BUCKETS = 128
#: Offsets of the second and third byte of each triplet inside the window.
TRIPLETS = ((1, 2), (1, 3), (2, 3))
WINDOW = 4
#: Bytes handled at once; longer texts are counted piece by piece.
PIECE = 1 << 18
#: Texts of a batch handled at once.
SLICE = 256
#: Steps of length per doubling, bounds of the header's differences.
LENGTH_STEPS, LENGTH_BOUND, RATIO_BOUND = 8, 24, 8
HALVING = 64.0
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_LOWEST = -(1 << 63)


def _count(pieces: list[tuple[int, bytes]], counts: np.ndarray) -> None:
    """Add the triplets of the pieces; each piece carries ``WINDOW`` more bytes than it has positions."""
    lengths = np.array([len(p) for _, p in pieces]) - WINDOW
    data = np.frombuffer(b"".join(p for _, p in pieces), dtype=np.uint8).astype(np.uint32)
    owners = np.empty(2 * len(pieces), dtype=np.int64)
    owners[0::2], owners[1::2] = [i for i, _ in pieces], len(counts) - 1
    spans = np.empty(2 * len(pieces), dtype=np.int64)
    spans[0::2], spans[1::2] = lengths, WINDOW
    base = np.repeat(owners * BUCKETS, spans)[:-WINDOW]
    n = len(base)
    first = data[:n] * _MULTIPLIERS[0]
    second, third = data * _MULTIPLIERS[1], data * _MULTIPLIERS[2]
    flat = counts.reshape(-1)
    for salt, (j, k) in enumerate(TRIPLETS, 1):
        h = first + second[j : j + n]
        h += third[k : k + n]
        h += _MULTIPLIERS[3] * np.uint32(salt)
        h ^= h >> np.uint32(15)
        h *= _MULTIPLIERS[1]
        h >>= np.uint32(25)
        found = base + h
        low = int(base.min())
        got = np.bincount(found - low)
        flat[low : low + len(got)] += got


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of ``2 + BUCKETS // 4`` bytes for each text."""
    counts = np.zeros((len(texts) + 1, BUCKETS), dtype=np.int64)
    waiting, held = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        t += bytes(WINDOW)
        for start in range(0, len(t) - WINDOW, PIECE):
            piece = t[start : start + PIECE + WINDOW] if len(t) > PIECE + WINDOW else t
            waiting.append((i, piece))
            held += len(piece)
            if held >= PIECE:
                _count(waiting, counts)
                waiting, held = [], 0
    if waiting:
        _count(waiting, counts)
    counts = counts[:-1]
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * q // 4 - 1] for q in (1, 2, 3))
    codes = ((counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])).astype(np.uint8)
    quads = codes.reshape(len(counts), BUCKETS // 4, 4)
    body = quads[:, :, 0] << 6 | quads[:, :, 1] << 4 | quads[:, :, 2] << 2 | quads[:, :, 3]
    lengths = np.array([len(t) for t in texts], dtype=np.float64)
    steps = np.minimum(255, np.floor(np.log2(1 + lengths) * LENGTH_STEPS)).astype(np.uint8)
    top = np.maximum(q3, 1)
    ratios = (np.minimum(15, q1 * 16 // top) << 4 | np.minimum(15, q2 * 16 // top)).astype(np.uint8)
    return np.concatenate([steps[:, None], ratios[:, None], body], axis=1)


_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int16)
_BYTE = np.zeros((256, 256), dtype=np.int16)
for _shift in (0, 2, 4, 6):
    _codes = np.arange(256) >> _shift & 3
    _BYTE += _STEP[_codes[:, None], _codes[None, :]]


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded difference scores of two stacks of digests, row by row."""
    a16, b16 = a.astype(np.int32), b.astype(np.int32)
    score = _BYTE[a[:, 2:], b[:, 2:]].sum(axis=1, dtype=np.int64)
    score += np.minimum(LENGTH_BOUND, np.abs(a16[:, 0] - b16[:, 0]))
    for shift in (4, 0):
        score += np.minimum(RATIO_BOUND, np.abs((a16[:, 1] >> shift & 15) - (b16[:, 1] >> shift & 15)))
    return score


def _stacked(texts: pa.Array) -> np.ndarray:
    """Digests of a batch, a slice of it at a time, so that a worker holds few copies of the texts beside the batch."""
    out = np.empty((len(texts), 2 + BUCKETS // 4), dtype=np.uint8)
    for start in range(0, len(texts), SLICE):
        part = texts.slice(start, SLICE).cast(pa.binary())
        out[start : start + len(part)] = digests([t or b"" for t in part.to_pylist()])
    return out


def _hexes(stack: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in stack], pa.string())


def _stack(hexes: pa.Array) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes.to_pylist())), dtype=np.uint8).reshape(len(hexes), -1)


@arrow_udf(T.StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """Hexadecimal digest of each text."""
    return _hexes(_stacked(texts))


@arrow_udf(T.DoubleType())
def likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    """Likeness of two digests, 0 to 1."""
    if not len(a):
        return pa.array([], pa.float64())
    return pa.array(np.exp2(-difference(_stack(a), _stack(b)) / HALVING))


@arrow_udf(T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]))
def judged(edited: pa.Array, own: pa.Array, following: pa.Array) -> pa.Array:
    """Digest of each edited text and the likeness of the own digest to it and to the next one, by one worker."""
    stack = _stacked(edited)
    near = [pa.array([], pa.float64())] * 2
    if len(edited):
        mine = _stack(own)
        near = [pa.array(np.exp2(-difference(mine, x) / HALVING)) for x in (stack, _stack(following))]
    return pa.StructArray.from_arrays([_hexes(stack), *near], ["fingerprint", "near_edited", "near_next"])


def _bucket(bounds: np.ndarray):
    """How many of the descending ``bounds`` are not below an id: its run in descending order."""
    rising = bounds[::-1].copy()

    @arrow_udf(T.LongType())
    def of(keys: pa.Array) -> pa.Array:
        return pa.array(len(rising) - np.searchsorted(rising, keys.to_numpy(zero_copy_only=False), side="left"), pa.int64())

    return of


def with_successors(docs: DataFrame, key: Column, carried: list[str]) -> DataFrame:
    """Each row with the ``carried`` columns of the next row by descending ``key``; the first follows the last.

    The ids are cut into runs whose bounds are ids that exist; the first row of every run is also dealt to the
    run before it, so that each run finds its successors alone. Runs are as many as the shuffle partitions times
    eight, and only their bounds reach the driver.
    """
    runs = 8 * partitions(docs.sparkSession)
    keyed = docs.withColumn("__key", F.coalesce(key.cast("long"), F.lit(_LOWEST)))
    found = keyed.agg(F.percentile_approx("__key", [i / runs for i in range(1, runs + 1)], 20 * runs).alias("p"), F.max("__key").alias("m")).first()
    bounds = np.array(sorted({*(found["p"] or ()), *([] if found["m"] is None else [found["m"]])}, reverse=True), dtype=np.int64)
    last = len(bounds)
    at = keyed.withColumn("__run", _bucket(bounds)(F.col("__key")))
    opens = F.col("__key").isin(bounds.tolist()) if last <= 64 else F.array_contains(F.lit(bounds.tolist()), F.col("__key"))
    before = F.when(F.col("__run") > 1, F.col("__run") - 1).otherwise(F.lit(last))
    dealt = at.withColumn("__in", F.explode(F.when(opens, F.array(F.struct(F.col("__run").alias("r"), F.lit(False).alias("g")), F.struct(before.alias("r"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(F.col("__run").alias("r"), F.lit(False).alias("g"))))))
    dealt = dealt.withColumns({"__run": F.col("__in.r"), "__ghost": F.col("__in.g")}).drop("__in")
    w = Window.partitionBy("__run").orderBy(F.col("__ghost"), F.col("__key").desc(), *carried)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).filter(~F.col("__ghost")).drop("__key", "__run", "__ghost")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every document's digest, its successor's digest and the text whose last third comes from the successor."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fingerprint", fingerprint("text"))
    chained = with_successors(base, F.col("doc_id"), ["text", "fingerprint"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    return chained.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")


def document_digests(docs: DataFrame) -> DataFrame:
    """Digests of all documents and of their edited texts, with the likeness to both."""
    # the hash comes before the workers, so that rows that wait for their answer hold the edited text once
    pairs = edited_pairs(docs).withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("__j", judged("edited", "fingerprint", "next_fingerprint"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("__j.fingerprint").alias("edited_fingerprint"), F.col("__j.near_edited"), F.col("__j.near_next"),
    )
