"""Cross-tokenizer alignment by interval coalescing.

Two encodings of one text are two rows of byte intervals. All tokens of both are sorted by start (lexsort), the running
maximum of their ends is taken, and a group breaks where a start reaches it; inside a group every A token is linked to every
B token. A byte-level tokenizer (A, which meets a blank and the text) and a piece tokenizer (B, which puts that blank
itself) are supported.

Texts are cut at single blanks between Latin characters: there a token of either kind ends, whatever its Unicode tables say,
so each part is encoded by the libraries once and remembered (a bounded memory, which changes no result).

How many documents hold an id pair linked is counted in blocks: a task emits blocks of at most ``BLOCK`` (document, pair) entries with
the block's own list of distinct pairs. Only those lists meet in the shuffles (a pair that every document holds is one row a
block), and each block gets back the counts of its own pairs. A document with more pairs is dealt to several blocks by ranges of A ids; of groups
with many links only distinct ids are paired, with their multiplicities.

Cases: null and empty texts, and texts whose tokens do not give back the blank and the text, have no tokens: zeros and an empty string. Rows that
repeat doc_id, or have none, are documents of their own. Texts are encoded whole; of one text at a time all tokens are held.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import staged

#: Characters aligned at once, (document, pair) entries of a block.
BATCH_CHARS, BLOCK = 400_000, 1 << 18
#: Parts that a worker remembers before it forgets those not seen since it last did, and the longest kept.
REMEMBERED, LONGEST = 150_000, 32
#: Groups with more links are reduced to distinct ids before they are paired.
WIDE = 64
#: A single blank between visible characters of the Latin blocks (none of which is white space).
CUT = re.compile("(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")
MARK = "▁"
#: Stands for the ids of a part that its tokens don't give back.
_BROKEN = (b"", b"")


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible ones stand for themselves, the rest follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


@dataclass(frozen=True)
class Pair:
    """The files of both tokenizers, as they travel with a plan; their size doesn't depend on the data."""

    a: str
    b: bytes

    @staticmethod
    def of(a_path: str, b_path: str) -> Pair:
        return Pair(Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes())


@dataclass
class Alignment:
    """Tokens of some texts in one row: ids, group of each token, and where each text's tokens begin and end."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    group_ends: np.ndarray

    @property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """A and B tokens of each group."""
        n = int(self.group_ends[-1])
        return np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)

    @property
    def text_of_group(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.group_ends) - 1), np.diff(self.group_ends))


def coalesce(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and B token, given the bytes of each; both sides cover the same bytes."""
    ends = np.concatenate([np.cumsum(a_lengths), np.cumsum(b_lengths)])
    starts = ends - np.concatenate([a_lengths, b_lengths])
    side = np.zeros(len(starts), dtype=np.int8)
    side[len(a_lengths) :] = 1
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(starts), dtype=np.int64)
    group[order[1:]] = np.cumsum(starts[order[1:]] >= reach[:-1])
    return group[: len(a_lengths)], group[len(a_lengths) :]


class Aligner:
    """Encodes and aligns texts with one pair of tokenizers."""

    def __init__(self, pair: Pair):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(pair.a)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pair.b)
        of_char = byte_characters()
        vocabulary = self.first.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace(MARK, " ").encode())
        if any(MARK in p[1:].lstrip(MARK) for p in map(self.second.id_to_piece, range(self.second.get_piece_size()))):
            raise ValueError("pieces that cross a blank are not supported")
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.b_bits = len(self.b_bytes).bit_length()
        self.pair_bits = self.b_bits + len(self.a_bytes).bit_length()
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.broken = False
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.printed = pa.array([f"{i}{s}".encode() for s in (",", "|", ";", "") for i in range(self.width)], pa.large_binary())

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of parts by the libraries; a part whose tokens don't give it back is marked."""
        wholes = [(" " + p).encode() for p in parts]
        ends = np.cumsum([len(w) for w in wholes])
        runs, same = [], np.ones(len(parts), dtype=bool)
        firsts = [e.ids for e in self.first.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        for found, printed, size in ((firsts, self.a_bytes, self.a_size), (self.second.encode(parts, num_threads=1), self.b_bytes, self.b_size)):
            flat = array("i", chain.from_iterable(found))
            past = np.cumsum(list(map(len, found)))
            raw, cuts = flat.tobytes(), (4 * past).tolist()
            runs.append([raw[i:j] for i, j in zip([0, *cuts], cuts)])
            ids = np.frombuffer(raw, dtype=np.int32)
            if not np.array_equal(np.cumsum(size[ids])[past - 1], ends) or b"".join(map(printed.__getitem__, flat)) != b"".join(wholes):
                same &= np.array([b"".join([printed[x] for x in ids]) == w for ids, w in zip(found, wholes)])
        self.broken |= not same.all()
        self.known.update(zip(parts, zip(*runs)) if same.all() else ((p, pair if ok else _BROKEN) for p, pair, ok in zip(parts, zip(*runs), same.tolist())))

    def align(self, texts: list[str | None]) -> Alignment:
        """Encode and align some texts."""
        parts = [CUT.split(t) if t else [] for t in texts]
        found = [list(map(self.known.get, own)) for own in parts]
        missing = {p for own, ids in zip(parts, found) if None in ids for p, f in zip(own, ids) if f is None}
        if missing:
            older = self.older
            self.known.update((p, older[p]) for p in missing if p in older)
            missing = [p for p in missing if p not in older]
            if missing:
                self._learn(missing)
        a_runs, b_runs = [], []
        for own, ids in zip(parts, found):
            if None in ids:
                ids = [f or self.known[p] for p, f in zip(own, ids)]
            whole = not (self.broken and _BROKEN in ids)
            a_runs.append(b"".join([f[0] for f in ids]) if whole else b"")
            b_runs.append(b"".join([f[1] for f in ids]) if whole else b"")
        a_counts, b_counts = ([len(r) // 4 for r in runs] for runs in (a_runs, b_runs))
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, {p: f for p, f in self.known.items() if len(p) <= LONGEST}
        a, b = (np.frombuffer(b"".join(runs), dtype=np.int32) for runs in (a_runs, b_runs))
        a_group, b_group = coalesce(self.a_size[a], self.b_size[b])
        a_ends, b_ends = (np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in (a_counts, b_counts))
        groups = int(a_group[-1]) + 1 if len(a) else 0
        return Alignment(a, b, a_group, b_group, a_ends, b_ends, np.append(a_group, groups)[a_ends])

    def digests(self, al: Alignment) -> list[str]:
        """SHA-256 of each text's groups written as decimal ids, '' without tokens."""
        n_a, n_b = al.sizes
        past_a, past_b = np.cumsum(n_a), np.cumsum(n_b)
        a, b = al.a.astype(np.int64), al.b.astype(np.int64)
        a[past_a - 1] += self.width
        b[past_b - 1] += 2 * self.width
        some = np.flatnonzero(np.diff(al.b_ends))
        b[al.b_ends[some + 1] - 1] += self.width
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + (past_b - n_b)[al.a_group]] = a
        codes[np.arange(len(b)) + past_a[al.b_group]] = b
        written = self.printed.take(pa.array(codes))
        ends = np.frombuffer(written.buffers()[1], dtype=np.int64)[al.a_ends + al.b_ends] if len(codes) else np.zeros(len(al.a_ends), dtype=np.int64)
        data = memoryview(written.buffers()[2] or b"")
        return [hashlib.sha256(data[i:j]).hexdigest() if i < j else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def links(self, al: Alignment) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """First and last text (exclusive), then text, pair and number of links of each distinct (text, pair) among them, by text.

        At most about ``BLOCK`` links before counting; a text with more comes in several parts, no pair in two of them.
        """
        n_a, n_b = al.sizes
        owner = al.text_of_group
        sides = []
        wide = np.flatnonzero(n_a * n_b > WIDE)
        for ids, group in ((al.a, al.a_group), (al.b, al.b_group)):
            times = np.ones(len(ids), dtype=np.int64)
            if len(wide):
                is_wide = np.zeros(len(n_a), dtype=bool)
                is_wide[wide] = True
                inside = is_wide[group]
                keys, many = np.unique(group[inside] << 32 | ids[inside], return_counts=True)
                group, ids, times = (np.concatenate([x[~inside], y]) for x, y in ((group, keys >> 32), (ids, keys & 0xFFFFFFFF), (times, many)))
                order = np.argsort(group, kind="stable")
                group, ids, times = group[order], ids[order], times[order]
            sides.append((ids.astype(np.int64), group, times))
        (a, a_group, a_times), (b, b_group, b_times) = sides
        partners = np.bincount(b_group, minlength=len(n_b))
        first = np.cumsum(partners) - partners
        fans = partners[a_group]
        texts = len(al.group_ends) - 1
        per_text = np.bincount(owner[a_group], weights=fans, minlength=texts).astype(np.int64)
        starts = np.searchsorted(owner[a_group], np.arange(texts + 1))
        plain = not len(wide)

        def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            fan = fans[rows]
            entry = np.repeat(rows, fan)
            other = first[a_group[entry]] + np.arange(len(entry)) - np.repeat(np.cumsum(fan) - fan, fan)
            keys = owner[a_group[entry]] << self.pair_bits | a[entry] << self.b_bits | b[other]
            if plain:
                keys, many = np.unique(keys, return_counts=True)
            else:
                order = np.argsort(keys, kind="stable")
                keys, at = np.unique(keys[order], return_index=True)
                many = np.add.reduceat((a_times[entry] * b_times[other])[order], at) if len(keys) else np.zeros(0, dtype=np.int64)
            return keys >> self.pair_bits, keys & ((1 << self.pair_bits) - 1), many

        at = 0
        while at < texts:
            upto = at + 1
            if per_text[at] > BLOCK:
                rows = np.arange(starts[at], starts[at + 1])
                rows = rows[np.argsort(a[rows], kind="stable")]
                load = np.cumsum(fans[rows]) // BLOCK
                ids = a[rows]
                # an id's rows stay together: a part ends where the id changes behind a full load
                new = np.flatnonzero(ids[1:] != ids[:-1]) + 1
                cuts = [c for c, x, y in zip(new.tolist(), load[np.concatenate([[0], new[:-1]])].tolist(), load[new].tolist()) if y > x]
                for i, j in zip([0, *cuts], [*cuts, len(rows)]):
                    yield at, upto, *counted(rows[i:j])
            else:
                held = per_text[at]
                while upto < texts and held + per_text[upto] <= BLOCK:
                    held += per_text[upto]
                    upto += 1
                yield at, upto, *counted(np.arange(starts[at], starts[upto]))
            at = upto


_ALIGNERS: dict[int, tuple[Pair, Aligner]] = {}


def _aligner(pair: Pair) -> Aligner:
    """One aligner for each pair of files in a worker process; what it remembers serves later tasks."""
    key = hash((pair.a, pair.b))
    if key not in _ALIGNERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its share of the cores
        _ALIGNERS[key] = (pair, Aligner(pair))
    return _ALIGNERS[key][1]


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """doc_ids and texts, at most about ``BATCH_CHARS`` characters at once; one longer text is alone."""
    for batch in batches:
        start, texts, held = 0, [], 0
        for k in range(len(batch)):
            text = batch.column(1)[k].as_py()
            if texts and held + len(text or "") > BATCH_CHARS:
                yield batch.column(0).slice(start, len(texts)), texts
                start, texts, held = k, [], 0
            texts.append(text)
            held += len(text or "")
        if texts:
            yield batch.column(0).slice(start, len(texts)), texts


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, and for each group how many A and B tokens end by its end (a_ends, b_ends)."""
    pair = Pair.of(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(pair)
        for ids, texts in _in_batches(batches):
            al = aligner.align(texts)
            n_a, n_b = al.sizes
            owner, columns = al.text_of_group, [ids]
            for values, ends in ((al.a, al.a_ends), (al.b, al.b_ends)):
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)))
            for sizes, ends in ((n_a, al.a_ends), (n_b, al.b_ends)):
                columns.append(pa.ListArray.from_arrays(pa.array(al.group_ends.astype(np.int32)), pa.array((np.cumsum(sizes) - ends[owner]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


_PER_TEXT = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")
_BLOCK = ", ".join(f"{c} array<bigint>" for c in _PER_TEXT) + ", digest array<string>, block bigint, pair array<bigint>, docs array<bigint>, ends array<bigint>, places binary, links binary"


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a block: what is known of its documents, its distinct pairs with the number of documents that hold each, and every document's (place of the pair, links)."""
    pair = Pair.of(a_path, b_path)

    def block(number: int, pieces: list) -> pa.RecordBatch:
        """One row of what several runs of texts hold."""
        facts, counts, pairs, many = zip(*pieces)
        distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
        columns = [pa.array([np.concatenate([f[k] for f in facts])], pa.list_(pa.int64())) for k in range(len(_PER_TEXT) - 1)]
        columns.insert(1, pa.array([[x for f in facts for x in f[-2]]], pa.list_(pa.int64())))
        columns += [pa.array([[x for f in facts for x in f[-1]]], pa.list_(pa.string())), pa.array([number], pa.int64())]
        columns += [pa.array([distinct], pa.list_(pa.int64())), pa.array([np.bincount(place, minlength=len(distinct))], pa.list_(pa.int64()))]
        columns += [pa.array([np.cumsum(np.concatenate(counts))], pa.list_(pa.int64())), pa.array([place.astype(np.uint16 if len(distinct) <= 1 << 16 else np.int32).tobytes()]), pa.array([np.concatenate(many).astype(np.int64).tobytes()])]
        return pa.RecordBatch.from_arrays(columns, names=[*_PER_TEXT, "digest", "block", "pair", "docs", "ends", "places", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, base, row, number = _aligner(pair), TaskContext.get().partitionId() << 40, 0, 0
        pieces, held = [], 0
        for ids, texts in _in_batches(batches):
            al = aligner.align(texts)
            n_a, n_b = al.sizes
            links = np.bincount(al.text_of_group, weights=n_a * n_b, minlength=len(texts)).astype(np.int64)
            numbers = [np.arange(row, row + len(texts)) + base, np.diff(al.a_ends), np.diff(al.b_ends), np.diff(al.group_ends), links]
            doc_ids, digests = ids.to_pylist(), aligner.digests(al)
            row += len(texts)
            for start, stop, text, pairs, many in aligner.links(al):
                size = len(pairs) + stop - start
                if pieces and held + size > BLOCK:
                    yield block(base + number, pieces)
                    pieces, held, number = [], 0, number + 1
                counts = np.bincount(text - start, minlength=stop - start)
                pieces.append(([*[n[start:stop] for n in numbers], doc_ids[start:stop], digests[start:stop]], counts, pairs, many))
                held += size
        if pieces:
            yield block(base + number, pieces)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _BLOCK)


def pair_counts(blocked: DataFrame, b_bits: int) -> DataFrame:
    """pair, documents that hold it, and whether no other pair of its A id is held by more."""
    counts = staged(blocked.select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.docs").alias("docs")))
    most = counts.groupBy(F.shiftright("pair", b_bits).alias("a")).agg(F.max("docs").alias("most"))
    return counts.join(most, F.shiftright("pair", b_bits) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: counts of tokens, groups and links, the digest of its groups, links to an A id's commonest partners, sum of counts."""
    blocked = staged(blocks(docs, a_path, b_path))
    pair = Pair.of(a_path, b_path)
    counts = pair_counts(blocked, _aligner(pair).b_bits)
    asked = blocked.select("block", F.posexplode("pair").alias("at", "pair"))
    answers = asked.join(counts, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "docs", "best"))).alias("answer"))
    answers = answers.select("block", F.col("answer.docs").alias("counts"), F.col("answer.best").cast("array<int>").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own = {c: batch[c].slice(k, 1) for c in batch.schema.names}
                flat = lambda c: own[c].flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
                ends, many = flat("ends"), np.frombuffer(own["links"][0].as_py(), dtype=np.int64)
                raw = own["places"][0].as_py()
                places = np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * len(many) else np.int32)
                counts, best = (flat(c) if len(many) else np.zeros(1, dtype=np.int64) for c in ("counts", "best"))
                sums = []
                for values in (best, counts):
                    past = np.concatenate([[0], np.cumsum(values[places] * many)]) if len(many) else np.zeros(1, dtype=np.int64)
                    sums.append(pa.array(np.diff(past[np.concatenate([[0], ends])]).astype(np.int64)))
                columns = [own[c].flatten() for c in (*_PER_TEXT, "digest")] + sums
                yield pa.RecordBatch.from_arrays(columns, names=[*_PER_TEXT, "groups_sha256", "n_best", "count_sum"])

    schema = ", ".join(f"{c} bigint" for c in _PER_TEXT) + ", groups_sha256 string, n_best bigint, count_sum bigint"
    parts = blocked.drop("pair", "docs").join(answers, "block", "left").mapInArrow(run, schema)
    same = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    return parts.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")
