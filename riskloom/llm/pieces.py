"""Exact merge-type piece encoding by backtracking, and decoding.

A text is encoded as the merges would encode it, without running them: from left to right take the longest
piece (Aho-Corasick), keep it if it is compatible with the piece before it, else the next shorter one, else give
the position up for good (a bit per position) and go back. Two pieces are compatible if merging their
joined text gives back just these two; those answers are kept.

A piece never holds a blank after another character and never a character outside the vocabulary, so a text is
cut before runs of blanks and around unknown characters; each such chunk is encoded once and remembered (a bounded
memory, which changes no result). Runs of two and more blanks, whose pieces share one rank, are merged outright.

Cases: null and empty texts have no ids; unknown characters become their bytes; any length is encoded whole.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks remembered by a worker before it starts afresh.
REMEMBERED = 500_000

codecs.register_error("one-for-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


@dataclass(frozen=True)
class Vocabulary:
    """What an encoder needs of a model: pieces with ranks, the bytes, what decoding prints for each id."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    printed: tuple[bytes, ...]
    splits_lines: bool


def vocabulary(model_path: str) -> Vocabulary:
    """Read a merge-type model with byte fallback and plain normalisation; any other kind is refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    probe = "ﬁ① a  b\tc\n éé "
    if model.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("only models that change nothing but blanks are supported")
    pieces, byte_ids, printed = {}, {}, []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            printed.append(bytes([int(p[3:5], 16)]))
        elif model.is_control(i):
            printed.append(b"")
        elif model.is_unknown(i):
            printed.append(" ⁇ ".encode())
        else:
            pieces[p] = (i, model.get_score(i))
            printed.append(p.replace(MARK, " ").encode())
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte fallback")
    for p in pieces:
        if any(c not in pieces for c in p) or re.search(f"[^{MARK}]{MARK}", p) or re.match(f"{MARK}{MARK}+[^{MARK}]", p):
            raise ValueError(f"piece {p!r} crosses a chunk")
    return Vocabulary(pieces, tuple(byte_ids[b] for b in range(256)), tuple(printed), "\n" not in pieces)


class _Remembered(dict):
    """Ids of a chunk, computed when first asked for."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[chunk] = array("i", self.compute(chunk)).tobytes()
        return ids


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text_of = {i: p for p, (i, _) in vocabulary.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for p, (i, _) in vocabulary.pieces.items():
            self.automaton.add_word(p, (len(p) - 1, i))
        self.automaton.make_automaton()
        self.size = [len(self.text_of.get(i, "")) for i in range(len(vocabulary.printed))]
        self.shorter = [-1] * len(self.size)  # the longest piece that begins each piece
        for p, (i, _) in vocabulary.pieces.items():
            self.shorter[i] = next((vocabulary.pieces[p[:k]][0] for k in range(len(p) - 1, 0, -1) if p[:k] in vocabulary.pieces), -1)
        self.known = {p for p in vocabulary.pieces if len(p) == 1}
        self.compatible: dict[int, bool] = {}
        self.marked = _Remembered(lambda w: self.chunk_ids(MARK + w))
        self.bare = _Remembered(self.chunk_ids)
        self.newline = array("i", self.chunk_ids("\n")).tobytes()
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.printed = pa.array(vocabulary.printed, pa.binary())
        self.special = np.ones(len(self.size), dtype=bool)
        self.special[[*vocabulary.byte_ids, *self.text_of]] = False

    def merged(self, text: str) -> list[int]:
        """The ids that merging yields: always the best-ranked neighbours, the leftmost among equals."""
        parts, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < n:
                joined = parts[left] + parts[after[left]]
                if joined in self.v.pieces:
                    heapq.heappush(heap, (-self.v.pieces[joined][1], left, joined))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left]
            if not parts[left] or right >= n or parts[left] + parts[right] != joined:
                continue
            parts[left], parts[right] = joined, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [self.v.pieces[p][0] for p in parts if p]

    def _fits(self, last: int, token: int) -> bool:
        """Whether merging the joined text of two pieces gives these two; of a first piece, whether merging builds it."""
        if len(self.compatible) > 4 * REMEMBERED:
            self.compatible.clear()
        both = [token] if last < 0 else [last, token]
        answer = self.compatible[last << 20 | token] = self.merged("".join(map(self.text_of.__getitem__, both))) == both
        return answer

    def backtracked(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n = len(text)
        longest = [0] * n
        for end, (reach, i) in self.automaton.iter(text):  # at one start, longer pieces end later
            longest[end - reach] = i
        failed, any_failed = bytearray((n >> 3) + 1), False
        size, shorter, compatible = self.size, self.shorter, self.compatible
        ids: list[int] = []
        pos, last, token, end = 0, -1, longest[0], 0
        while True:
            while token >= 0:
                end = pos + size[token]
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    fits = compatible.get(last << 20 | token)
                    if self._fits(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                if end == n:
                    return ids
                pos, last, token = end, token, longest[end]
            elif not ids:
                return self.merged(text)
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                any_failed = True
                token = ids.pop()
                pos -= size[token]
                last = ids[-1] if ids else -1
                token = shorter[token]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk: runs of known characters are encoded, other characters become bytes."""
        out: list[int] = []
        run = 0
        for i, c in enumerate(chunk):
            if c not in self.known:
                out += self._run_ids(chunk[run:i])
                out += [self.v.byte_ids[b] for b in c.encode()]
                run = i + 1
        return out + self._run_ids(chunk[run:])

    def _run_ids(self, run: str) -> list[int]:
        if not run:
            return []
        return self.merged(run) if run.startswith(MARK * 2) else self.backtracked(run)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as native 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        first = True
        for line in text.split("\n") if self.v.splits_lines else [text]:
            if not first:
                out.append(self.newline)
            words = line.split(" ")
            if "" in words or MARK in line:
                marked = (MARK if first else "") + line.replace(" ", MARK)
                out += map(self.bare.__getitem__, self.chunks.findall(marked))
            else:
                out.append((self.marked if first else self.bare)[words[0]])
                out += map(self.marked.__getitem__, words[1:])
            first = False
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return array("i", self.encode_bytes(text)).tolist()

    def decode_lists(self, ids: pa.ListArray) -> list[str]:
        """Texts of lists of ids: pieces and bytes joined, the first blank taken off, each broken byte replaced."""
        offsets, heads = ids.offsets.to_numpy(), ids.values.to_numpy()
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.printed.take(ids.values)), b"").to_pylist()
        special = self.special[heads].nonzero()[0]
        for k in np.unique(np.searchsorted(offsets, special, side="right") - 1):
            joined[k] = self._in_parts(heads[offsets[k] : offsets[k + 1]].tolist())
        return [r if isinstance(r, str) else (r[1:] if self.text_of.get(int(heads[i]), "").startswith(MARK) else r).decode("utf-8", "one-for-each-byte") for r, i in zip(joined, np.minimum(offsets[:-1], max(0, len(heads) - 1)))] if len(heads) else [""] * len(ids)

    def _in_parts(self, ids: list[int]) -> str:
        """Decoding with control or unknown ids, which end a run of bytes."""
        out, run, fresh = [], b"", True
        for i in ids:
            if self.special[i]:
                out += [run.decode("utf-8", "one-for-each-byte"), self.v.printed[i].decode()]
                run = b""
            else:
                run += self.v.printed[i][1:] if fresh and self.text_of.get(i, "").startswith(MARK) else self.v.printed[i]
            fresh = fresh and not self.v.printed[i]
        return "".join(out) + run.decode("utf-8", "one-for-each-byte")

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0]


_ENCODERS: dict[int, tuple[Vocabulary, Encoder]] = {}


def _encoder(v: Vocabulary) -> Encoder:
    """One encoder for each vocabulary in a worker process; what it remembers serves later tasks."""
    key = hash((len(v.pieces), v.printed))
    if key not in _ENCODERS:
        _ENCODERS[key] = (v, Encoder(v))
    return _ENCODERS[key][1]


#: Characters encoded into one output batch.
BATCH_CHARS = 4_000_000


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and decoded text of every document. The vocabulary goes to the tasks with the plan; it never grows."""
    v = vocabulary(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(v)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start = 0
            while start < len(batch):
                raw, held, end = [], 0, start
                while end < len(batch) and (end == start or held < BATCH_CHARS):
                    t = texts[end].as_py() or ""
                    held += len(t)
                    raw.append(encoder.encode_bytes(t))
                    end += 1
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), lists, pa.array(encoder.decode_lists(lists), pa.string())], names=["doc_id", "ids", "decoded"])
                start = end

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Counts and digests of ids and decoded texts."""
    return encoded(docs, model_path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
