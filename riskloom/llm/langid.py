"""Language identification by a byte-level convolutional network.

A text's UTF-8 bytes are cut into windows of fixed length (the last one padded with zero bytes). Filters of three
widths run over every window and see the first bytes of the next one, the largest response of each filter is kept,
and a softmax layer turns these into probabilities. A text's prediction is the language with the highest mean
log-probability over its windows, each weighing its number of bytes.

The network is trained in numpy on windows spread over a bounded sample of labelled texts: at most about ``SAMPLE``
texts of each language, chosen by a hash of the id. The responses are sums of table look-ups, one table for
each place of a filter; for use, the tables of neighbouring places are joined, so that two bytes cost one look-up.

Cases: null texts and texts without a letter are ``und`` with score 0; null languages teach nothing; without any
labelled text every prediction is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from riskloom.llm.common import remainder

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
REACH = max(WIDTHS) - 1
#: Labelled texts of each language and windows of each text that the fit reads, about.
SAMPLE, WINDOWS = 400, 4
EPOCHS, BATCH, RATE = 8, 32, 0.01
HELD_OUT_OF, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Windows run through the network at once.
AT_ONCE = 512


@dataclass(frozen=True)
class Network:
    """Learned languages, tables (place, byte, filter) of each width, filter offsets, softmax weights and offsets."""

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    offsets: np.ndarray
    weights: np.ndarray
    shifts: np.ndarray


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, answers: np.ndarray, languages: tuple[str, ...]) -> Network:
    """Fit on windows (rows of ``WINDOW + REACH`` bytes) by gradient steps with moments."""
    random = np.random.default_rng(11)
    places = sum(WIDTHS)
    # one stack of tables for all places of all widths, so that a step is one update
    tables = random.normal(0, 0.3, (places, 256, FILTERS)).astype(np.float32)
    parts = {"tables": tables, "offsets": np.zeros(len(WIDTHS) * FILTERS, np.float32), "weights": random.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), "shifts": np.zeros(len(languages), np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in parts.items()} for _ in range(2))
    starts, step = np.cumsum((0, *WIDTHS)), 0
    shares = np.bincount(answers, minlength=len(languages)).astype(np.float64)
    balance = (len(answers) / len(languages) / np.maximum(shares, 1)).astype(np.float32)
    for epoch in range(EPOCHS):
        order = random.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x, y = windows[chosen], answers[chosen]
            n = np.arange(len(x))[:, None]
            peaks, where = [], []
            for w, width in enumerate(WIDTHS):
                response = sum(parts["tables"][starts[w] + k][x[:, k : k + WINDOW]] for k in range(width))
                best = response.argmax(axis=1)
                where.append(best)
                peaks.append(np.take_along_axis(response, best[:, None, :], axis=1)[:, 0, :])
            peak = np.concatenate(peaks, axis=1) + parts["offsets"]
            hidden = np.maximum(peak, 0)
            error = np.exp(_log_softmax(hidden @ parts["weights"] + parts["shifts"]))
            error[np.arange(len(x)), y] -= 1
            error *= (balance[y] / len(x))[:, None]
            back = (error @ parts["weights"].T) * (peak > 0)
            gradient = {"weights": hidden.T @ error + 1e-4 * parts["weights"], "shifts": error.sum(axis=0), "offsets": back.sum(axis=0), "tables": 1e-5 * parts["tables"]}
            for w, width in enumerate(WIDTHS):
                g = back[:, w * FILTERS : (w + 1) * FILTERS]
                for k in range(width):
                    np.add.at(gradient["tables"], (starts[w] + k, x[n, where[w] + k], np.arange(FILTERS)[None, :]), g)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, g in gradient.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                parts[k] = (parts[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(languages, tuple(parts["tables"][starts[w] : starts[w + 1]] for w in range(len(WIDTHS))), parts["offsets"], parts["weights"], parts["shifts"])


class Joined:
    """A network with the tables of neighbouring places joined: pairs of bytes index one row."""

    def __init__(self, net: Network):
        two, three, four = net.tables
        pair = lambda t, k: (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS)
        self.net = net
        self.head = np.ascontiguousarray(np.concatenate([pair(two, 0), pair(three, 0), pair(four, 0)], axis=1))
        self.third = np.ascontiguousarray(three[2])
        self.tail = pair(four, 2)

    def log_probabilities(self, padded: np.ndarray, closing: np.ndarray) -> np.ndarray:
        """One row for each window of a byte array holding whole windows and ``REACH`` bytes more.

        ``closing``: windows that end a text; the places from which a filter would see the next text don't count.
        """
        out = []
        count = (len(padded) - REACH) // WINDOW
        for start in range(0, count, AT_ONCE):
            n = min(AT_ONCE, count - start)
            data = padded[start * WINDOW : (start + n) * WINDOW + REACH]
            size = n * WINDOW
            pairs = data[:-1].astype(np.int32) << 8 | data[1:]
            response = self.head.take(pairs[:size], axis=0)
            response[:, FILTERS : 2 * FILTERS] += self.third.take(data[2 : size + 2], axis=0)
            response[:, 2 * FILTERS :] += self.tail.take(pairs[2 : size + 2], axis=0)
            response = response.reshape(n, WINDOW, -1)
            response[closing[start : start + n], WINDOW - REACH :] = -np.inf
            while response.shape[1] > 1:  # halving keeps the maximum over whole blocks
                half = response.shape[1] // 2
                response = np.maximum(response[:, :half], response[:, half:])
            hidden = np.maximum(response[:, 0] + self.net.offsets, 0)
            out.append(_log_softmax(hidden @ self.net.weights + self.net.shifts))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)), np.float32)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its probability for each non-empty text."""
        counts = np.array([-(-len(t) // WINDOW) for t in texts])
        ends = np.cumsum(counts)
        sums = np.zeros((len(texts), len(self.net.languages)))
        at = 0
        while at < len(texts):  # whole texts up to a bound of windows; one longer text is alone
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8 * AT_ONCE, side="right")))
            run = b"".join(t + bytes(-len(t) % WINDOW) for t in texts[at:upto])
            last = ends[at:upto] - (ends[at - 1] if at else 0) - 1
            closing = np.zeros(last[-1] + 1, dtype=bool)
            closing[last] = True
            got = self.log_probabilities(np.frombuffer(run + bytes(REACH), dtype=np.uint8), closing)
            owner = np.repeat(np.arange(at, upto), counts[at:upto])
            weight = np.full(len(owner), float(WINDOW))
            weight[last] = [((len(t) - 1) % WINDOW) + 1 for t in texts[at:upto]]
            for k in range(sums.shape[1]):
                sums[at:upto, k] += np.bincount(owner - at, weights=got[:, k] * weight, minlength=upto - at)
            at = upto
        mean = sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]
        p = np.exp(_log_softmax(mean))
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def sample(docs: DataFrame) -> DataFrame:
    """lang and windows (binary) of a bounded sample of each language's labelled texts outside the held-out fold."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return known.select("lang", "doc_id", F.lit(None).cast("binary").alias("window")).limit(0)
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, SAMPLE / n)))])[F.col("lang")]
    fraction = (F.xxhash64(F.lit(3), "doc_id") / F.lit(2.0**64)) + 0.5
    raw = F.encode(F.col("text"), "utf-8")
    length = F.length(raw)
    spread = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.floor(k * F.greatest(length - WINDOW, F.lit(0)) / F.lit(max(1, WINDOWS - 1))).cast("int"))
    cut = F.transform(F.array_distinct(spread), lambda at: F.substring(raw, at + 1, F.lit(WINDOW + REACH)))
    return known.filter(fraction < share).select("lang", "doc_id", F.explode(cut).alias("window")).filter(F.length("window") > 0)


def fit(docs: DataFrame) -> Network | None:
    """Train on the sample; None if there is nothing to learn from."""
    found = sample(docs).toPandas().sort_values(["lang", "doc_id", "window"], kind="stable")
    if not len(found):
        return None
    languages = tuple(sorted(found["lang"].unique()))
    size = WINDOW + REACH
    rows = np.frombuffer(b"".join(bytes(w).ljust(size, b"\0") for w in found["window"]), dtype=np.uint8).reshape(-1, size)
    answers = found["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()
    return train(rows, answers, languages)


def predictor(net: Network):
    """A column function giving language and score of texts."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @arrow_udf(schema)
    def predict(texts: pa.Array) -> pa.Array:
        joined = Joined(net)
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        some = [i for i, t in enumerate(raw) if t]
        languages, scores = [UNKNOWN] * len(raw), np.zeros(len(raw))
        if some:
            best, p = joined.predict([raw[i] for i in some])
            for i, b, s in zip(some, best, p):
                languages[i], scores[i] = net.languages[b], s
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    net = fit(docs)
    text = F.col("text").cast("string")
    letters = text.isNotNull() & text.rlike(r"\p{L}")
    base = docs.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT).alias("held_out"), F.when(letters, text).alias("seen"))
    if net is None:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return base.withColumn("found", predictor(net)("seen")).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
