"""Chat formatting: a finite-state machine over roles, text segments and loss flags from a declarative template.

The template names the marks around a conversation and around each role's turn, which roles' texts bear loss, and from which
state a role may follow. Formatting reads the turns of a conversation in order and emits one row a turn: its segments (mark, text,
mark), each with a loss flag, and whether the order has been valid so far. Control strings inside roles and texts get an
escape mark after their first character, and escape marks are doubled, so a mark in the output is always the template's; reading back
undoes both. The output is read back by the marks alone.

Turns are dealt by conversation and sorted by turn inside a partition; the machine, the digests and the reader are streams that hold
one batch, whatever a conversation's length. A conversation is a chain and stays in one partition.

Cases: a null text or role is empty; a role that the template doesn't know gets the general marks and makes the order
invalid, as does a turn out of order; equal turn numbers go by role and text; a null conv_id is a conversation of its own; a null turn comes first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import partitions


@dataclass(frozen=True)
class Template:
    """Marks and rules. ``turns``: role -> (mark before, mark after, loss). ``order``: state -> roles that may follow."""

    begin: str
    turns: dict[str, tuple[str, str, bool]]
    other: tuple[str, str, str]  # before the role's name, between it and the text, after the text
    controls: tuple[str, ...]
    order: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    escape: str = "\\"
    patterns: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        longest = sorted(self.controls, key=len, reverse=True)
        self.patterns["escape"] = re.compile("|".join(re.escape(c) for c in longest))
        if any(self.escape in c for c in self.controls) or any(len(c) < 2 for c in self.controls):
            raise ValueError("a control string has at least two characters and no escape mark")
        for a in self.controls:
            if any(a[-k:] == b[:k] for b in self.controls for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"{a!r} overlaps a control string")
        self.patterns["unescape"] = re.compile(re.escape(self.escape) + "(.|$)", re.DOTALL)

    def escaped(self, text: str) -> str:
        """``text`` without control strings."""
        e = self.escape
        return self.patterns["escape"].sub(lambda m: m[0][0] + e + m[0][1:], text.replace(e, e + e))

    def unescaped(self, text: str) -> str:
        """The text that was escaped."""
        return self.patterns["unescape"].sub(lambda m: m[1], text)

    def segments(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        """The (text, loss) segments of a turn."""
        if role in self.turns:
            before, after, loss = self.turns[role]
            marks = before, after
        else:
            head, middle, tail = self.other
            marks, loss = (head + self.escaped(role) + middle, tail), False
        return [(self.begin * first + marks[0], False), (self.escaped(text), loss), (marks[1], False)]

    def parsed(self, formatted: str) -> tuple[str, str, bool]:
        """(role, text, loss) of one formatted turn, by its marks alone."""
        body = formatted.removeprefix(self.begin)
        for role, (before, after, loss) in self.turns.items():
            if body.startswith(before) and body.endswith(after):
                return role, self.unescaped(body[len(before) : len(body) - len(after)]), loss
        head, middle, tail = self.other
        role, _, text = body.removeprefix(head).partition(middle)
        return self.unescaped(role), self.unescaped(text.removesuffix(tail)), False


#: The production template.
INSTRUCT = Template(
    begin="<s>",
    turns={
        "system": ("<<SYS>> ", " <</SYS>>", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("[ANS] ", " </s>", True),
    },
    other=("[ROLE] ", " [/ROLE] ", " [/TURN]"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ANS]", "[ROLE]", "[/ROLE]", "[/TURN]"),
    order={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("user", "assistant"),
)


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns of one conversation together and in order."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_NOBODY = object()


def formatted(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row a turn, in order: conv_id, place, segments, valid (the order so far, and whether it may end here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, good, place = _NOBODY, "start", True, 0
        for batch in batches:
            out = [[], [], [], [], []]
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
                if now is _NOBODY or conv != now:
                    now, state, good, place = conv, "start", True, 0
                good = good and role in template.order.get(state, ())
                state = role
                parts = [{"text": t, "loss": x} for t, x in template.segments(role, text, place == 0)]
                for column, value in zip(out, (conv, place, parts, good, good and role in template.ends)):
                    column.append(value)
                place += 1
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], _SEGMENT), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.bool_())], names=["conv_id", "place", "segments", "valid", "may_end"])

    return _ordered(turns).mapInArrow(run, "conv_id long, place long, segments array<struct<text: string, loss: boolean>>, valid boolean, may_end boolean")


def read_back(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of each conversation, from the formatted turns only; ``rows`` come as ``formatted`` leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        now, held = _NOBODY, None

        def closed():
            return [now, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4], held[5]]

        for batch in batches:
            done = []
            for conv, segments, may_end in zip(batch["conv_id"].to_pylist(), batch["segments"].to_pylist(), batch["may_end"].to_pylist()):
                if now is _NOBODY or conv != now:
                    if held:
                        done.append(closed())
                    now, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                whole = "".join(s["text"] for s in segments)
                role, text, _ = template.parsed(whole)
                held[0] += 1
                held[1].update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        learned = template.unescaped(s["text"])
                        held[2] += len(learned)
                        held[3].update(learned.encode())
                held[4] += len(whole)
                held[5] = may_end
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), types)], names=names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


#: A conversation of control strings that the query adds.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    """All turns and those of conversation -1."""
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(probe)
