"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has bit k set if more than half of the 64-bit hashes of its word 3-shingles (repeats included) have it set.
Fingerprints that differ in at most ``LINK`` = 3 bits are linked, and the classes are the connected components.

Linked fingerprints agree up to one bit in their low or in their high half. The anchors of a half are a covering code of radius 1: the
words of the perfect Hamming code on 31 of its 32 bits, with either value of the last bit. A fingerprint's home is the nearest
anchor of each half (the bit at the syndrome is flipped), and it is replicated to every anchor within the covering radius plus the
threshold that a partner's home can be at: home, the 15 code words at distance two, and home with the last bit flipped. At each anchor the
fingerprints that live there are compared with those that visit, over all 64 bits.

Only distinct fingerprints take part, so copies cost nothing. At an anchor the comparison runs in blocks of homes of bounded size
(crowded anchors are split, and their visitors are dealt to every block), and what leaves is a forest over what was
found connected, never the pairs. Components come from rounds of alternating large and small stars on staged edges.

Cases: a null text and a text without words have fingerprint zero, linked like any other; fewer than three words are one shingle;
rows that repeat a doc_id are all returned, each with its own fingerprint; rows without doc_id get no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from riskloom.llm.common import partitions, quoted, spare, staged

SHINGLE, SEED, LINK = 3, 42, 3
#: Homes compared at once at an anchor, and visitors at once with them.
BLOCK, VISITORS = 2048, 1024
#: Shingle hashes counted at once.
PIECE = 1 << 16
_SIGN = np.uint64(1 << 63)


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle, in arrays of bounded size."""
    words = text.lower().split()  # of bytes: only A-Z change, and only the six blanks split
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    lows, highs = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(lows[at : at + PIECE], highs[at : at + PIECE])], dtype=np.uint64)


def fingerprint_of(text: bytes) -> int:
    """The 64-bit fingerprint."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # sums of bytes that stay bytes
            ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
        total += len(h)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist()))


@arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed integers."""
    found = np.array([fingerprint_of(t or b"") for t in texts.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    return pa.array(found.view(np.int64), pa.int64())


def _anchors() -> np.ndarray:
    """For each syndrome, what to add to a 32-bit word to reach its home, then the other anchors to visit (0: none)."""
    out = np.zeros((32, 17), dtype=np.uint64)
    bit = lambda i: 1 << (i - 1)  # noqa: E731  bit of place i, 1 to 31; the last bit has no place
    for s in range(32):
        home = bit(s) if s else 0
        out[s, 0] = home
        if s:
            out[s, 1:16] = [bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s]
        out[s, 16] = home | 1 << 31
    return out


_REACH = _anchors()
_PARITY = np.array([bin(i).count("1") & 1 for i in range(256)], dtype=np.uint8)


def syndromes(half: np.ndarray) -> np.ndarray:
    """XOR of the places of the set bits of 32-bit words."""
    out = np.zeros(len(half), dtype=np.int64)
    for b in range(5):
        mask = np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> b & 1))
        masked = half & mask
        folded = masked ^ masked >> np.uint64(16)
        folded ^= folded >> np.uint64(8)
        out |= _PARITY[(folded & np.uint64(255)).astype(np.int64)].astype(np.int64) << b
    return out


def placed(prints: DataFrame) -> DataFrame:
    """(anchor, home, fp) of each distinct fingerprint: twice at home, and as a visitor at every anchor in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4096):
                own = fp[at : at + 4096]
                anchors, homes, prints = [], [], []
                for h in (0, 1):
                    half = own >> np.uint64(32 * h) & np.uint64(0xFFFFFFFF)
                    s = syndromes(half)
                    reach = half[:, None] ^ _REACH[s]
                    wanted = np.ones(reach.shape, dtype=bool)
                    wanted[s == 0, 1:16] = False
                    tag = np.uint64(h << 32)
                    anchors += [reach[:, 0] | tag, reach[wanted] | tag]
                    homes += [np.ones(len(own), dtype=bool), np.zeros(int(wanted.sum()), dtype=bool)]
                    prints += [own, np.repeat(own, wanted.sum(axis=1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.concatenate(homes)), pa.array(np.concatenate(prints).view(np.int64))], names=["anchor", "home", "fp"])

    return prints.mapInArrow(run, "anchor long, home boolean, fp long")


class _Block:
    """The homes of one block, the visitors met so far and what is connected among them."""

    def __init__(self):
        self.homes: list[np.ndarray] = []
        self.count = 0

    def add(self, fp: np.ndarray) -> None:
        self.homes.append(fp)
        self.count += len(fp)

    def links(self, visitors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For some visitors, pairs of connected fingerprints: each visitor with its first partner, partners in a chain."""
        if len(self.homes) > 1 or (self.homes and not hasattr(self, "own")):
            self.own = np.concatenate(self.homes)
            self.homes = [self.own]
            self.root = np.arange(len(self.own))
        out = []
        for at in range(0, len(visitors), VISITORS):
            some = visitors[at : at + VISITORS]
            near = np.bitwise_count(some[:, None] ^ self.own[None, :]) <= LINK
            near &= some[:, None] != self.own[None, :]
            met = np.flatnonzero(near.any(axis=1))
            if not len(met):
                continue
            rows, cols = np.nonzero(near[met])
            first = near[met].argmax(axis=1)
            out.append((some[met], self.own[first]))
            # partners of one visitor are connected: hook their roots to the least until nothing changes
            starts = np.searchsorted(rows, np.arange(len(met)))
            while True:
                lead = self.root[cols]
                hook = np.arange(len(self.own))
                np.minimum.at(hook, lead, np.minimum.reduceat(lead, starts)[rows])
                moved = np.flatnonzero(hook != np.arange(len(hook)))
                if not len(moved):
                    break
                out.append((self.own[moved], self.own[hook[moved]]))
                while (hook[hook] != hook).any():
                    hook = hook[hook]
                self.root = hook[self.root]
        return out


def compared(dealt: DataFrame) -> DataFrame:
    """(a, b) linking fingerprints that are connected at some anchor; rows come by (anchor, block), homes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, _Block()
        for batch in batches:
            anchor, part = batch["anchor"].to_numpy(), batch["block"].to_numpy()
            home, fp = batch["home"].to_numpy(zero_copy_only=False), batch["fp"].to_numpy().view(np.uint64)
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (home[1:] != home[:-1])) + 1
            a, b = [], []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if i == j:
                    continue
                if (anchor[i], part[i]) != key:
                    key, block = (anchor[i], part[i]), _Block()
                if home[i]:
                    block.add(fp[i:j])
                elif block.count:
                    for x, y in block.links(fp[i:j]):
                        a.append(x)
                        b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) of distinct fingerprints; every link's ends are connected by them."""
    parts = partitions(prints.sparkSession)
    spots = staged(placed(prints))
    counts = spots.groupBy("anchor").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count("*").alias("all"))
    # an anchor with one home and no visitor but itself has nothing to compare
    live = counts.filter((F.col("homes") > 0) & (F.col("all") > 2)).select("anchor", F.ceil(F.col("homes") / BLOCK).cast("int").alias("blocks"))
    known = spots.join(live, "anchor")
    own = F.pmod(F.xxhash64(F.lit(9), "fp"), F.col("blocks")).cast("int")
    dealt = known.select("anchor", "home", "fp", F.explode(F.when(F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("block"))
    dealt = dealt.repartition(parts, "anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))
    found = compared(dealt)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node of its component.

    Rounds of large star (each node hands its larger neighbours to its least) and small star (its smaller ones) until the edges
    are stars. A node with many neighbours never gathers them: its least neighbour is a pre-aggregated minimum, joined back.
    """
    now = staged(edges.select("a", "b"))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))  # each node with its smaller neighbours
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("b").alias("y")), F.struct(F.col("m").alias("x"), F.col("a").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a <> b").distinct()
        now = staged(small)
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max(F.xxhash64(F.lit(1), "a", "b"))).first())
        if sign == before:
            return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = sign


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    own = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text").cast("string")).alias("fp")))
    prints = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = staged(components(links(prints.select("fp"))))
    # only fingerprints with links: their component's least doc_id
    members = found.select(F.col("node").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root").distinct())
    named = members.join(prints, "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    ids = prints.join(named.select("fp", "root").join(least, "root").select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    ids = staged(ids)  # so that both sides of the last join are dealt for it alone, and a frequent fingerprint can be split
    return own.join(ids, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component of every document."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, its least doc_id; of rows that repeat it, one stays. Rows without doc_id stay."""
    doc, n = spare(docs, "__doc", "__n")
    keep = classes(docs.select("doc_id", "text")).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(doc)).distinct()
    stay = docs.join(keep, F.col("doc_id").cast("long") == F.col(doc))
    one = stay.withColumn(n, F.row_number().over(Window.partitionBy(doc).orderBy(F.xxhash64("text")))).filter(F.col(n) == 1)
    return one.select(*[quoted(c) for c in docs.columns]).unionByName(docs.filter(F.col("doc_id").isNull()))
