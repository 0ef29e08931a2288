"""Language-model scores of whole texts by a gated recurrent network with a class-factored softmax.

Gates and candidates use x / (1 + |x|), which costs a fraction of a tanh. Texts (A-Z lower-cased) are words between white space and one end. The commonest ``WORDS`` training tokens are outputs of the network,
``CLASS`` neighbouring ranks to a class: a class is predicted from the state, then the word inside it. All other words are one more
class, inside which a word has its smoothed share of the corpus counts; words never seen share one more count. So the probabilities of all
texts add up, and the untrained network equals the base model.

Every training document is learned from once, by truncated backpropagation in numpy: lanes of documents advance window by window, and the state
is carried from window to window until a document ends. Training goes in rounds of growing shares of the documents; in a round every task
starts from the same parameters and trains on its own documents, and the parameters are averaged, weighed by tokens. Scoring
carries the state through each document in the same way.

Counts are gathered in blocks: a task emits blocks of about ``BLOCK`` code points with the block's own list of distinct words, so only these lists meet
in the shuffles and a word in every document is one row a block.

Cases: null and empty texts are the end alone; rows that repeat doc_id, or have none, are documents of their own, and the latter are learned
from; without training documents the score is the base score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import remainder, staged, tree

WORDS, CLASS, HIDDEN = 1024, 64, 16
#: Documents read side by side, steps of a window, windows filled at once, code points of a block.
LANES, STEPS, AHEAD, BLOCK = 384, 20, 8, 9_000_000
#: Hundredths of the documents that each round learns from, and step sizes.
ROUNDS, RATES = (4, 16, 30, 50), (0.05, 0.05, 0.04, 0.03)
#: Squared steps that weights start with; offsets, which start at their corpus shares, are slow to leave them.
WEIGHTS_PAST, SHIFTS_PAST = 10.0, 1e4
#: Windows that a stream of documents is dealt to at least, by fewer lanes where it is short: to learn, many steps; to score, few.
LEARNED, SCORED = 160, 8
HELD_OUT_OF, HELD_OUT = 7, 2
#: Bound of a logit, so that its exponential is finite.
LIMIT = np.float32(80)


@dataclass(frozen=True)
class Counts:
    """Training tokens in all (N) and distinct (V), and the counts of the words that are outputs, the end first."""

    tokens: int
    distinct: int
    top: tuple[int, ...]

    @property
    def whole(self) -> int:
        return self.tokens + self.distinct + 1

    @property
    def rest(self) -> int:
        """The smoothed count of everything that is no output."""
        return self.whole - sum(self.top) - len(self.top)


@dataclass
class Network:
    """Input tables of the gates (reset, update, candidate), recurrent weights, class and word layers, and the squared steps so far.

    Word rows are padded to whole classes; padding has an offset of -1e9. The last input row stands for all words that are no outputs.
    """

    parts: dict[str, np.ndarray]
    past: dict[str, np.ndarray]

    @staticmethod
    def start(counts: Counts) -> Network:
        """The network that predicts corpus shares whatever it has read."""
        random = np.random.default_rng(19)
        n = len(counts.top)
        classes = -(-n // CLASS)
        share = np.full(classes * CLASS, -1e9)
        share[:n] = np.log(np.array(counts.top) + 1.0)
        sums = np.append([np.log(np.exp(share[k : k + CLASS]).sum()) for k in range(0, len(share), CLASS)], math.log(counts.rest))
        parts = {
            "inputs": random.normal(0, 0.1, (classes * CLASS + 1, 3 * HIDDEN)), "turn": random.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), "shift": np.zeros((1, HIDDEN)),
            "classes": np.zeros((HIDDEN, classes + 1)), "class_shift": sums[None, :], "words": np.zeros((classes * CLASS, HIDDEN)), "word_shift": share[:, None],
        }
        return Network({k: v.astype(np.float32) for k, v in parts.items()}, {k: np.full((len(v), 1), SHIFTS_PAST if k.endswith("_shift") else WEIGHTS_PAST, dtype=np.float32) for k, v in parts.items()})

    @property
    def outputs(self) -> int:
        return len(self.parts["words"])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for own in (self.parts, self.past) for x in own.values()])

    def filled(self, numbers: np.ndarray) -> Network:
        """A network of this shape with other numbers."""
        out, at = [], 0
        for own in (self.parts, self.past):
            new = {}
            for k, v in own.items():
                new[k] = numbers[at : at + v.size].reshape(v.shape).copy()
                at += v.size
            out.append(new)
        return Network(*out)

    def forward(self, state: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each step (steps, lanes, hidden) and, to train, what each step needs again."""
        p, h = self.parts, HIDDEN
        given = p["inputs"].take(inputs, axis=0)
        out, steps = np.empty((*inputs.shape, h), dtype=np.float32), []
        anew = fresh.any(axis=1)
        for t in range(len(inputs)):
            if anew[t]:
                state = np.where(fresh[t][:, None], np.float32(0), state)
            turned = state @ p["turn"]
            gates = _softsign(given[t, :, : 2 * h] + turned[:, : 2 * h])
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            reset, update = gates[:, :h], gates[:, h:]
            inner = turned[:, 2 * h :] + p["shift"]
            candidate = reset * inner
            candidate += given[t, :, 2 * h :]
            candidate = _softsign(candidate)
            np.subtract(state, candidate, out=out[t])
            out[t] *= update
            out[t] += candidate
            if keep:
                steps.append((state, reset, update, inner, candidate))
            state = out[t]
        return out, steps

    def classes_of(self, targets: np.ndarray) -> np.ndarray:
        return np.where(targets == self.outputs, self.outputs // CLASS, targets // CLASS)

    def likelihoods(self, states: np.ndarray, targets: np.ndarray, gradient: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of the probability of each target (of its class, where it is no output); with ``gradient``, adds to it and returns the states' own."""
        p, n, classes = self.parts, len(targets), self.outputs // CLASS
        own = self.classes_of(targets)
        order = np.argsort(own.astype(np.uint16), kind="stable")  # tokens of a class lie together
        states, targets, own = np.ascontiguousarray(states.take(order, axis=0).T), targets[order], own[order]
        ends, rows = np.searchsorted(own, np.arange(classes + 2)), np.arange(n)
        z = p["classes"].T @ states + (p["class_shift"] - p["class_shift"].max()).T
        np.minimum(z, LIMIT, out=z)
        found = z[own, rows]
        e = np.exp(z, out=z)
        total = e.sum(axis=0)
        found = found - np.log(total)
        back = None
        if gradient is not None:
            e /= total
            e[own, rows] -= 1
            gradient["classes"] = states @ e.T
            gradient["class_shift"] = e.sum(axis=1)[None, :]
            back = p["classes"] @ e
            gradient["words"], gradient["word_shift"] = np.zeros_like(p["words"]), np.zeros_like(p["word_shift"])
        for c in range(classes):
            i, j, first = ends[c], ends[c + 1], c * CLASS
            if i == j:
                continue
            weights, shift, h = p["words"][first : first + CLASS], p["word_shift"][first : first + CLASS], states[:, i:j]
            z = weights @ h
            z += shift - shift.max()
            np.minimum(z, LIMIT, out=z)
            which, at = targets[i:j] - first, rows[: j - i]
            chosen = z[which, at]
            e = np.exp(z, out=z)
            total = e.sum(axis=0)
            found[i:j] += chosen - np.log(total)
            if gradient is not None:
                e /= total
                e[which, at] -= 1
                gradient["words"][first : first + CLASS] = e @ h.T
                gradient["word_shift"][first : first + CLASS, 0] = e.sum(axis=1)
                back[:, i:j] += weights.T @ e
        out = np.empty(n, dtype=np.float32)
        out[order] = found
        if back is not None:
            placed = np.empty((n, HIDDEN), dtype=np.float32)
            placed[order] = back.T
            back = placed
        return out, back

    def learn(self, state: np.ndarray, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, rate: float) -> np.ndarray:
        """One step on a window; returns the state behind it."""
        p, h = self.parts, HIDDEN
        states, steps = self.forward(state, inputs, fresh, True)
        used, gradient = targets >= 0, {}
        if used.all():
            used = slice(None)  # a full window is taken as it is
            due = self.likelihoods(states.reshape(-1, h), targets.ravel(), gradient)[1].reshape(states.shape)
        else:
            due = np.zeros_like(states)
            due[used] = self.likelihoods(states[used], targets[used], gradient)[1]
        gates, inner = np.empty((*inputs.shape, 3 * h), dtype=np.float32), np.empty_like(states)
        carry = np.zeros_like(state)
        anew = fresh.any(axis=1)
        one, half = np.float32(1), np.float32(0.5)
        back_gates, back_inner = np.ascontiguousarray(p["turn"][:, : 2 * h].T), np.ascontiguousarray(p["turn"][:, 2 * h :].T)
        for t in range(len(inputs) - 1, -1, -1):
            before, reset, update, turned, candidate = steps[t]
            d, own = due[t], gates[t]
            d += carry
            slope = one - np.abs(candidate)
            slope *= slope
            slope *= d
            slope *= one - update
            own[:, 2 * h :] = slope
            np.multiply(slope, reset, out=inner[t])
            # a gate g is half a softsign and a half, so its slope is (1 - |2 g - 1|) ** 2 / 2
            for k, gate, reached in ((0, reset, slope * turned), (1, update, d * (before - candidate))):
                slope_g = one - np.abs(gate + gate - one)
                slope_g *= slope_g
                slope_g *= half
                np.multiply(slope_g, reached, out=own[:, k * h : (k + 1) * h])
            carry = own[:, : 2 * h] @ back_gates
            carry += inner[t] @ back_inner
            carry += d * update
            if anew[t]:
                carry[fresh[t]] = 0
        before = np.stack([s[0] for s in steps]).reshape(-1, h)
        gradient["turn"] = np.concatenate([before.T @ gates.reshape(-1, 3 * h)[:, : 2 * h], before.T @ inner.reshape(-1, h)], axis=1)
        gradient["shift"] = inner.sum(axis=(0, 1))[None, :]
        for k, g in gradient.items():
            self.past[k] += (g * g).mean(axis=1, keepdims=True)
            p[k] -= rate * g / np.sqrt(self.past[k])
        flat = inputs[used].ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        ids = flat[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids, g = ids[first], np.add.reduceat(gates[used].reshape(-1, 3 * h).take(order, axis=0), first, axis=0)
        self.past["inputs"][ids] += (g * g).mean(axis=1, keepdims=True)
        p["inputs"][ids] -= rate * g / np.sqrt(self.past["inputs"][ids])
        return states[-1]


def _softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def windows(docs: Iterator[tuple[int, np.ndarray]], lanes: int, first: int):
    """Documents (key, ids) dealt to lanes: inputs, targets, starts and keys (steps x lanes), and which lanes of the last window go on.

    The input is the token before; a document starts with ``first``. Empty places have target and key -1. Lanes are filled for
    ``AHEAD`` windows at once.
    """
    current: list[tuple[int, np.ndarray] | None] = [None] * lanes
    at = [0] * lanes
    size = AHEAD * STEPS
    while True:
        inputs, targets, keys = np.zeros((lanes, size), dtype=np.int32), np.full((lanes, size), -1, dtype=np.int32), np.full((lanes, size), -1, dtype=np.int64)
        fresh = np.zeros((lanes, size), dtype=bool)
        for k in range(lanes):
            slot = 0
            while slot < size:
                if current[k] is None:
                    current[k], at[k] = next(docs, None), 0
                    if current[k] is None:
                        break
                key, ids = current[k]
                n, i = min(size - slot, len(ids) - at[k]), at[k]
                targets[k, slot : slot + n] = ids[i : i + n]
                if i:
                    inputs[k, slot : slot + n] = ids[i - 1 : i + n - 1]
                else:
                    fresh[k, slot], inputs[k, slot] = True, first
                    inputs[k, slot + 1 : slot + n] = ids[: n - 1]
                keys[k, slot : slot + n] = key
                slot, at[k] = slot + n, i + n
                if at[k] == len(ids):
                    current[k] = None
        for start in range(0, size, STEPS):
            going = np.flatnonzero(targets[:, start] >= 0)
            if not len(going):
                return
            if len(going) < lanes:  # a lane without a token has no more documents
                inputs, targets, fresh, keys = (x[going] for x in (inputs, targets, fresh, keys))
                current, at, lanes = [current[k] for k in going], [at[k] for k in going], len(going)
            yield (*(np.ascontiguousarray(x[:, start : start + STEPS].T) for x in (inputs, targets, fresh, keys)), going)


def split_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens of each text (its end counted), all tokens as places in the list of distinct words, and that list, the end first."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    flat = lists.flatten()
    there = pc.not_equal(flat, "")  # white space at the ends of a text leaves empty words
    words = flat.filter(there).dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())[there.to_numpy(zero_copy_only=False)]
    lengths = np.bincount(owner, minlength=len(texts)) + 1
    places = np.zeros(int(lengths.sum()), dtype=np.int32)
    inside = np.ones(len(places), dtype=bool)
    inside[np.cumsum(lengths) - 1] = False
    places[inside] = words.indices.to_numpy() + 1
    return lengths, places, pa.concat_arrays([pa.array([""], pa.large_string()), words.dictionary])


def blocks(docs: DataFrame) -> DataFrame:
    """One row a block: its documents, its distinct words with their training counts, and its tokens as places in that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 32, 0

        def block(ids, held, texts):
            nonlocal count
            lengths, flat, words = split_words(texts)
            learned = np.repeat(~np.array(held), lengths)
            columns = [pa.array([base + count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64()))]
            # two planes: most places are small, and the upper one compresses to almost nothing
            columns += [pa.array([(flat & 0xFFFF).astype(np.uint16).tobytes()]), pa.array([(flat >> 16).astype(np.uint16).tobytes()])]
            one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
            columns += [one, pa.array([np.bincount(flat[learned], minlength=len(words))], pa.list_(pa.int64()))]
            count += 1
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "held", "length", "lower", "upper", "word", "n"])

        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for doc, out, text in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), batch["text"]):
                ids.append(doc)
                held.append(out)
                texts.append(text.as_py())
                size += len(texts[-1] or "") + 8
                if size >= BLOCK:
                    yield block(ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield block(ids, held, texts)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT).alias("held"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "block bigint, doc_id array<bigint>, held array<boolean>, length array<bigint>, lower binary, upper binary, word array<string>, n array<bigint>")


_DOC = "doc_id bigint, held boolean, length bigint, known bigint, base double, rest double, ids binary"


def prepared(docs: DataFrame) -> tuple[DataFrame, Counts]:
    """One row a document: held out, tokens, known tokens, base score, share of the score inside the rest class, and ids of its tokens; and the counts."""
    blocked = staged(blocks(docs))
    asked = blocked.select("block", F.posexplode(F.arrays_zip("word", "n")).alias("at", "w")).select("block", "at", "w.word", "w.n")
    counts = staged(asked.groupBy("word").agg(F.sum("n").alias("n")))
    sums = counts.agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    is_end = F.col("word") == ""
    top = counts.filter(F.col("n") > 0).orderBy(is_end.desc(), F.col("n").desc(), "word").limit(WORDS).select("word", "n").collect()  # at most WORDS rows
    known = Counts(sums["tokens"] or 0, sums["distinct"] or 0, tuple(r["n"] for r in top))
    ranks = docs.sparkSession.createDataFrame([(r["word"], i) for i, r in enumerate(top)], "word string, rank int")
    # ranks: at most WORDS rows
    answers = asked.select("block", "at", "word").join(counts.join(F.broadcast(ranks), "word", "left").hint("shuffle_hash"), "word")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("at", "n", "rank")).alias("answer"))
    answers = answers.select("block", F.col("answer.at").alias("at"), F.col("answer.n").alias("n"), F.col("answer.rank").alias("rank"))
    outputs = len(Network.start(known).parts["words"]) if top else 0
    whole, rest = math.log10(known.whole), math.log10(max(1, known.rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own = batch.slice(k, 1)
                at = own["at"].flatten().to_numpy(zero_copy_only=False)
                n, rank = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
                n[at] = own["n"].flatten().to_numpy(zero_copy_only=False)
                rank[at] = own["rank"].flatten().fill_null(outputs).to_numpy(zero_copy_only=False)
                places = np.frombuffer(own["lower"][0].as_py(), np.uint16).astype(np.int64) | np.frombuffer(own["upper"][0].as_py(), np.uint16).astype(np.int64) << 16
                lengths = own["length"].flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(lengths) - lengths
                logs = np.log10(n + 1.0)
                sums = [np.add.reduceat(v[places], starts) for v in ((n > 0).astype(np.int64), logs - whole, np.where(rank == outputs, logs - rest, 0.0))]
                raw = rank[places].astype(np.uint16).tobytes()
                ids = [raw[2 * i : 2 * (i + m)] for i, m in zip(starts.tolist(), lengths.tolist())]
                columns = [own["doc_id"].flatten(), own["held"].flatten(), own["length"].flatten(), *(pa.array(s) for s in sums), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held", "length", "known", "base", "rest", "ids"])

    return staged(blocked.drop("word", "n").join(answers, "block").mapInArrow(run, _DOC)), known


def _lanes(batch: pa.RecordBatch, least: int) -> int:
    """Lanes for a stream whose first batch is ``batch``, so that it makes ``least`` windows or more."""
    return max(4, min(LANES, sum(batch["length"].to_pylist()) // (least * STEPS)))


def train(ready: DataFrame, known: Counts) -> Network:
    """Rounds of training on the documents of ``prepared`` that are not held out."""
    network = Network.start(known)
    # the part of the documents that a round reads follows their content, so reruns agree
    place = F.pmod(F.xxhash64("doc_id", "length", F.lit(5)), F.lit(100))
    done = 0
    for share, rate in zip(ROUNDS, RATES):
        start = network

        def run(batches: Iterator[pa.RecordBatch], start=start, share=share, rate=rate) -> Iterator[pa.RecordBatch]:
            net, tokens, state, first = start.filled(start.flat()), 0, None, next(batches, None)

            def documents() -> Iterator[tuple[int, np.ndarray]]:
                batch = first
                while batch is not None:
                    for raw in batch["ids"]:
                        yield 0, np.frombuffer(raw.as_py(), dtype=np.uint16)
                    batch = next(batches, None)

            if first is None:
                return
            for inputs, targets, fresh, _, going in windows(documents(), _lanes(first, LEARNED), 0):
                state = np.zeros((len(going), HIDDEN), dtype=np.float32) if state is None else state[going]
                state = net.learn(state, inputs, targets, fresh, rate)
                tokens += int((targets >= 0).sum())
            columns = [pa.array([0], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(tokens)]), pa.array([(net.flat() * np.float64(tokens)).astype(np.float32).tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "part", "tokens", "numbers"])

        own = ready.filter(~F.col("held") & (place >= done) & (place < done + share)).select("length", "ids")
        numbers = lambda state: np.frombuffer(state["numbers"], dtype=np.float32)
        summed = tree(own.mapInArrow(run, "model bigint, part bigint, tokens double, numbers binary"), "model", lambda a, b: {"tokens": a["tokens"] + b["tokens"], "numbers": (numbers(a) + numbers(b)).tobytes()})
        for r in summed.collect():  # one row: the model
            network = network.filled((np.frombuffer(bytes(r["numbers"]), dtype=np.float32) / np.float64(r["tokens"])).astype(np.float32))
        done += share
    return network


def scored_batches(batches: Iterator[pa.RecordBatch], network: Network, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Scores of documents, the state carried through each; a document leaves once its last token is scored, ``most`` or so at a time."""
    first, state = next(batches, None), None
    if first is None:
        return
    facts: dict[int, list] = {}
    sums: dict[int, float] = {}
    due: dict[int, int] = {}

    def documents() -> Iterator[tuple[int, np.ndarray]]:
        batch, key = first, 0
        while batch is not None:
            columns = [batch[c].to_pylist() for c in ("doc_id", "held", "length", "known", "base", "rest")]
            for raw, *own in zip(batch["ids"], *columns):
                facts[key], sums[key], due[key] = own, 0.0, own[2]
                yield key, np.frombuffer(raw.as_py(), dtype=np.uint16)
                key += 1
            batch = next(batches, None)

    def finished() -> Iterator[pa.RecordBatch]:
        over = [k for k, n in due.items() if not n]
        made = [[*own[:5], sums.pop(k) / math.log(10) + own[5]] for k in over for own in [facts.pop(k)]]
        for k in over:
            del due[k]
        if made:
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=["doc_id", "held", "length", "known", "base", "score"])

    for inputs, targets, fresh, keys, going in windows(documents(), _lanes(first, SCORED), 0):
        state = np.zeros((len(going), HIDDEN), dtype=np.float32) if state is None else state[going]
        states, _ = network.forward(state, inputs, fresh, False)
        state = states[-1]
        used = targets >= 0
        found, _ = network.likelihoods(states[used], targets[used])
        own, at, n = np.unique(keys[used], return_inverse=True, return_counts=True)
        for key, x, k in zip(own.tolist(), np.bincount(at, weights=found).tolist(), n.tolist()):
            sums[key] += x
            due[key] -= k
        if len(facts) > most:
            yield from finished()
    yield from finished()


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    ready, known = prepared(docs)
    tokens = F.lit(known.tokens).cast("bigint").alias("train_tokens")
    if not known.top:
        return ready.select("doc_id", F.col("held").alias("held_out"), F.col("length").alias("n_tokens"), F.col("known").alias("n_known"), tokens, F.col("base").alias("base_score"), F.col("base").alias("score"))
    network = train(ready, known)

    scored = ready.mapInArrow(lambda batches: scored_batches(batches, network), "doc_id bigint, held boolean, length bigint, known bigint, base double, score double")
    return scored.select("doc_id", F.col("held").alias("held_out"), F.col("length").alias("n_tokens"), F.col("known").alias("n_known"), tokens, F.col("base").alias("base_score"), "score")
