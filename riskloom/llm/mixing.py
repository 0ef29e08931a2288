"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight (by the order of sources, 5, 2, 1 repeating) and a schedule: how its weight moves while training
runs from time 0 to 1, as straight lines between knots. A source's share of all words follows the weights but stops at
``MOST_PASSES`` times its size; the excess goes to the others by weight until none is above. Its documents, in the
order of a hash of their ids, form a stream that is read again from the start until the target is reached; one document of a
source may be cut at the end. The integral of a schedule says how many words are due by a time; inverting it at the middle of
each document's words gives its position, and documents are range-sorted by position.

Only DataFrame functions are used. Sizes are counted once into a narrow staged table. Prefix sums run within slices of a
source's stream (about the square root of the rows) and over the slices, so the largest source is never in one task.

Cases: a null text has size 0; null sources are one source, the last; a document of size 0 takes nothing; its position is its
source's at that point of the stream, or null if the source takes nothing; repeated rows are documents of their own that share the id.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, partitions, staged

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
#: Knots (time, weight) of the schedules, dealt to sources like the weights; each is scaled to integrate to 1.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.0)))


def words(text: Column) -> Column:
    """How many words a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row a document: id, source, size, order key. ``none`` and ``name`` say the source without nulls."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        words(F.col("text").cast("string")).alias("size"), key.alias("order"), F.xxhash64(F.col("text").cast("string")).alias("__tie"),
    )


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Each source's size and its place among the sources by code point, null last, ranked without one task for all."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("none", "name").agg(F.sum("size").alias("source_size"))
    sliced = staged(totals.repartitionByRange(partitions(spark), "none", "name").withColumn("slice", F.spark_partition_id()))
    counts = sorted((r["slice"], r["n"]) for r in sliced.groupBy("slice").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, offset = [], 0
    for s, n in counts:
        before += [F.lit(s), F.lit(offset)]
        offset += n
    base = F.create_map(*before)[F.col("slice")] if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("slice").orderBy("none", "name"))
    return sliced.withColumn("place", (within - 1 + base).cast("long")).drop("slice")


def _dealt(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Each source with its target: one level for all weights, raised until the stopped sources' excess is dealt out.

    Each round is one aggregate over the sources; it ends when no further source is stopped.
    """
    sources = staged(ranked_sources(sizes).withColumn("weight", _dealt(weights, F.col("place"))).withColumn("cap", F.col("source_size") * float(most)))
    all_of = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(1.0)).alias("w")).first()
    total, level, stopped = float(all_of["t"]), float(all_of["t"]) / all_of["w"], -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        r = sources.agg(F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("c"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if r["n"] == stopped or not r["w"]:
            break
        stopped, level = r["n"], (total - r["c"]) / r["w"]
    return sources.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)))


def time_of(share: Column, place: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time by which a schedule's integral reaches ``share`` (0 to 1) of its whole."""
    out = []
    for knots in schedules:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        whole, done, pieces = sum(areas), 0.0, []
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            rest = share * whole - done
            slope = (w1 - w0) / (t1 - t0)
            # w0 d + slope d^2 / 2 = rest, in the form that has no cancellation
            d = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
            done += area
            pieces.append((done / whole, F.least(F.lit(t1), t0 + d)))
        out.append(reduce(lambda other, p: F.when(share <= p[0], p[1]).otherwise(other), reversed(pieces[:-1]), pieces[-1][1]))
    return reduce(lambda other, k: F.when(place % len(schedules) == k, out[k]).otherwise(other), range(len(out) - 1), out[-1])


def planned(docs: DataFrame) -> DataFrame:
    """One row a document: size, source_size, target, taken words and the passes with their positions."""
    sizes = staged(sized(docs))
    rows = sizes.count()
    digits = max(1, math.ceil(math.log(max(2.0, math.sqrt(rows)), 16)))
    sliced = sizes.withColumn("slice", F.substring("order", 1, digits))
    sums = sliced.groupBy("none", "name", "slice").agg(F.sum("size").alias("slice_size"))
    rising = Window.partitionBy("none", "name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("none", "name", "slice", F.coalesce(F.sum("slice_size").over(rising), F.lit(0)).alias("slice_start"))
    starts = starts.join(targets(sizes), ["none", "name"])
    inside = Window.partitionBy("none", "name", "slice").orderBy("order", "doc_id", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["none", "name", "slice"])
    start = F.col("slice_start") + F.col("within")
    due = F.round("target").cast("long")
    passes = []
    for k in range(MOST_PASSES):
        begin = start + k * F.col("source_size")
        took = F.greatest(F.lit(0), F.least(F.col("size"), due - begin))
        share = F.when(due > 0, F.least(F.lit(1.0), (begin + took / 2) / due))
        passes.append(F.struct(took.cast("long").alias("words"), time_of(share, F.col("place")).alias("position")))
    first = F.when((due > 0) & (start < due), passes[0]["position"])
    return placed.select(
        "doc_id", F.when(~F.col("none"), F.col("name")).alias("source"), "size", "source_size", "target", "__tie", first.alias("first_position"),
        F.filter(F.array(*passes), lambda p: p["words"] > 0).alias("passes"),
    ).withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]))


def training_order(docs: DataFrame) -> DataFrame:
    """One row for each pass over a document, range-sorted by position."""
    each = planned(docs).select("doc_id", "source", "size", F.posexplode("passes").alias("pass", "p"))
    rows = each.select("doc_id", "source", "size", "pass", F.col("p.words").alias("words"), F.col("p.position").alias("position"))
    return rows.repartitionByRange(partitions(docs.sparkSession), "position", "doc_id", "pass").sortWithinPartitions("position", "doc_id", "pass")


def mix(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document, range-sorted by the position of its first pass."""
    rows = planned(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("first_position", 6).alias("first_position"))
    return rows.repartitionByRange(partitions(docs.sparkSession), "first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
