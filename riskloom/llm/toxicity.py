"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text, lower-cased and framed by blanks, is the set of its hashed character n-grams (3, 4 and 5 code points).
Each n-gram's feature value is the logarithm of the ratio of its smoothed frequencies in toxic and other texts;
a logistic classifier is trained on these values, and its weights are multiplied with the ratios into one table.

The classifier is fitted on a bounded sample of labelled texts: of each label the lowest by a hash of the id, up to ``SAMPLE`` texts and
``MOST_TOTAL`` code points together. A text longer than ``MOST_CHARS`` gives a span of that length, its place drawn by the hash, so a label that
only has long texts is learned too. The intercept is corrected for the share of each label among all labelled rows. Scoring reads
every whole text.

Cases: null and empty texts get the score of a text without n-grams; labels other than 0 and 1 teach nothing;
of labels that repeat a doc_id the highest counts; without labels of both kinds every score is their share, or 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from riskloom.llm.common import remainder

ORDERS = (3, 4, 5)
BITS = 20
#: Most labelled texts of each label that the fit reads.
SAMPLE = 1500
#: Code points learned of one text, and of all texts of a label (the last one taken may exceed it); scoring reads whole texts.
MOST_CHARS, MOST_TOTAL = 60_000, 20_000_000
#: n-grams found in fewer sampled texts carry no weight.
LEAST_TEXTS = 3
#: And so do those whose chi-square statistic against the label is smaller: in long texts their noise would add up.
LEAST_EVIDENCE = 11.0
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.02, 1e-4
HELD_OUT_OF = 5
_K = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)
#: Code points hashed at once.
PIECE = 1 << 20


def _hashes(text: str):
    """Hashed n-grams of a text, in arrays of bounded size."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    reach = max(ORDERS) - 1
    for start in range(0, len(codes), PIECE):
        c = codes[start : start + PIECE + reach]
        rolled = c
        for n in range(2, reach + 2):
            if len(rolled) < 2:
                break
            rolled = rolled[:-1] * _K + c[n - 1 :]
            if n in ORDERS:
                h = (rolled ^ rolled >> np.uint32(15)) * _MIX
                yield ((h + np.uint32(n)) * _MIX) >> np.uint32(32 - BITS)


def ngrams(text: str, seen: np.ndarray) -> np.ndarray:
    """The set of a text's hashed n-grams; ``seen`` is a table of false values and is left as it was."""
    for h in _hashes(text):
        seen[h] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass(frozen=True)
class Classifier:
    """Weights of n-grams that have one, and the intercept."""

    ids: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.ids] = self.weights
        return out


def train(texts: list[str], labels: np.ndarray, shares: tuple[float, float]) -> Classifier:
    """Fit on texts; ``shares`` are the counts of labels 0 and 1 among all labelled rows."""
    total = shares[0] + shares[1]
    if len(set(labels.tolist())) < 2:
        share = min(1 - 1e-6, max(1e-6, shares[1] / total)) if total else 1e-6
        return Classifier(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), float(np.log(share / (1 - share))))
    seen, counts = np.zeros(1 << BITS, dtype=bool), np.zeros((2, 1 << BITS), dtype=np.int32)
    for t, y in zip(texts, labels):
        counts[y][ngrams(t, seen)] += 1
    n0, n1 = int((labels == 0).sum()), int((labels == 1).sum())
    both = counts[0] + counts[1]
    excess = counts[1] - both * n1 / (n0 + n1)
    spread = both * (1 - both / (n0 + n1)) * (n0 / (n0 + n1)) * (n1 / (n0 + n1))
    kept = np.flatnonzero((both >= LEAST_TEXTS) & (excess**2 >= LEAST_EVIDENCE * np.maximum(spread, 1e-9)))
    sides = [(1 + counts[y][kept]) / (2 + (labels == y).sum()) for y in (0, 1)]
    ratios = np.log(sides[1] / sides[0])
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    rows = [p[p >= 0] for p in (place[ngrams(t, seen)] for t in texts)]  # a second reading, so that only kept n-grams are held
    weights, intercept = np.zeros(len(kept)), 0.0
    first, second, first_b, second_b = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    balance = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    random, step = np.random.default_rng(7), 0
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            flat = np.concatenate([rows[i] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])
            z = np.bincount(owner, weights=(weights * ratios)[flat], minlength=len(chosen)) + intercept
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[chosen]) * balance[chosen] / len(chosen)
            gradient = np.bincount(flat, weights=error[owner], minlength=len(kept)) * ratios + DECAY * weights
            step += 1
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            first_b, second_b = 0.9 * first_b + 0.1 * error.sum(), 0.99 * second_b + 0.01 * error.sum() ** 2
            up, down = 1 - 0.9**step, 1 - 0.99**step
            weights -= RATE * (first / up) / (np.sqrt(second / down) + 1e-6)
            intercept -= RATE * (first_b / up) / (np.sqrt(second_b / down) + 1e-6)
    intercept += float(np.log(max(shares[1], 1) / max(shares[0], 1)))
    return Classifier(kept, (weights * ratios).astype(np.float32), intercept)


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on the labelled documents outside the held-out fold."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.filter(remainder(F.col("doc_id"), HELD_OUT_OF) != 0).withColumn("order", F.xxhash64("doc_id"))
    shares = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # the lowest hashes of each label: every partition and then the driver keep no more than the bound
    chosen = None
    for y in (0, 1):
        part = marks.filter(F.col("toxic") == y).orderBy("order", "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    start = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.greatest(F.length(text) - MOST_CHARS, F.lit(0)) + 1).cast("int")
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("text", F.substring(text, start + 1, F.lit(MOST_CHARS)))
    # rows that repeat an id come once each, within the same bound
    found = found.select("order", "doc_id", "toxic", "text").orderBy("order", "doc_id", "text").limit(2 * SAMPLE)
    before = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy("order", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < MOST_TOTAL).orderBy("order", "doc_id", "text").toArrow()
    return train(found["text"].to_pylist(), found["toxic"].to_numpy(), (float(shares.get(0, 0)), float(shares.get(1, 0))))


def scorer(model: Classifier):
    """A column function giving the score of texts; the model's size is bounded by the table of n-grams."""

    @arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        table, seen = model.table(), np.zeros(1 << BITS, dtype=bool)
        z = np.array([float(table[ngrams(t, seen)].sum(dtype=np.float64)) if t else 0.0 for t in (x.as_py() for x in texts)])
        return pa.array(1 / (1 + np.exp(-np.clip(z + model.intercept, -500, 500))), pa.float64())

    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = scorer(fit(docs, labels))
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT_OF) == 0).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
