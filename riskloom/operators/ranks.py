"""Distributed ranks, prefix sums and exact quantiles.

Nothing here orders a whole table in one task. A value axis is cut into slices by approximate
quantiles; the slices only balance the work, so the results are exact whatever the approximation.
Hash ranks use the leading hex digits of a hash as slices, which are even by construction.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the edge table that every row is compared with; more tasks than this never rank one value axis.
MAX_SLICES = 16_384
SKETCH_ACCURACY = 10_000
#: Groups whose quantiles come to the driver; a larger request is an error, not a cut.
MAX_GROUPS = 100_000
#: Tasks that finish the sketches of the columns of a whole table.
SKETCH_TASKS = 32


def _slices(df: DataFrame, asked: int | None) -> int:
    """As many slices as the session asks for shuffle partitions."""
    if asked:
        return asked
    return max(2, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_SLICES))


def _edges_below(edges: Column, value: Column, n_edges: int) -> Column:
    """Number of sorted edges under a value: every w-th edge is compared first, then the w edges after it."""
    count = lambda some: F.size(F.filter(some, lambda e: e < value))
    if n_edges <= 64:
        return count(edges)
    w = math.isqrt(n_edges)
    before = w * count(F.transform(F.sequence(F.lit(w), F.lit(n_edges), F.lit(w)), lambda i: F.get(edges, i - 1)))
    return before + count(F.slice(edges, before + 1, w))


def prefix_by_value(
    df: DataFrame,
    value: str,
    keys: Iterable[str] = (),
    sums: Mapping[str, Column] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """One row per (keys, distinct value) with running totals in value order.

    ``n`` is always counted; ``sums`` adds named aggregates. Each name ``x`` comes with ``cum_x``
    (inclusive running total) and ``tot_x`` (total of the key). Equal values share one row, so ties
    never depend on row order. Keys must not be null; null values are dropped.
    """
    keys = list(keys)
    aggs = {"n": F.count(F.lit(1)), **(sums or {})}
    known = F.col(value).isNotNull()
    for k in keys:  # the last join leaves null keys out; done here, both sides below read the same rows
        known = known & F.col(k).isNotNull()
    per_value = (
        df.filter(known)
        .groupBy(*keys, value)
        .agg(*[e.alias(name) for name, e in aggs.items()])
    )
    # one set of edges serves all keys: a slice of one key is part of a slice of the whole, so no task grows
    # with a frequent key, and no row is shuffled by its bare key
    n_slices = _slices(df, slices)
    asked = [i / n_slices for i in range(1, n_slices)]
    edges = F.percentile_approx(F.col(value).cast("double"), asked, 20 * n_slices)
    # the sums are not read; with them both sides need the same collapsed values, which are then shuffled once
    about = per_value.agg(F.struct(edges.alias("edges"), *[F.sum(n).alias(n) for n in aggs])).scalar()
    cut = per_value.withColumn("_about", about)
    below = _edges_below(F.col("_about.edges"), F.col(value).cast("double"), n_slices - 1)
    sliced = cut.select(*keys, value, *aggs, F.coalesce(below, F.lit(0)).alias("_slice"))
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(n) for n in aggs])
    # at most one row per slice and key
    every = Window.partitionBy(*(keys or [F.lit(0)]))
    onwards = every.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select(
        *keys,
        "_slice",
        *[F.sum(n).over(every).alias(f"tot_{n}") for n in aggs],
        *[(F.sum(n).over(every) - F.sum(n).over(onwards)).alias(f"_off_{n}") for n in aggs],
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    running = sliced.withColumns({f"_run_{n}": F.sum(n).over(inside) for n in aggs})
    return running.join(offsets, [*keys, "_slice"]).select(
        *keys,
        value,
        *aggs,
        *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in aggs],
        *[f"tot_{n}" for n in aggs],
    )


def average_ranks(df: DataFrame, value: str, keys: Iterable[str] = (), name: str = "rank") -> DataFrame:
    """(keys, value, n, rank): the average-tie rank of every distinct value, one-based."""
    p = prefix_by_value(df, value, keys)
    return p.select(*keys, value, "n", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(name))


def hash_of(id_col: str, seed: int | str | Column) -> Column:
    """Engine-independent pseudo-random order of an id."""
    salt = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), salt))


def hash_rank(
    df: DataFrame,
    id_col: str,
    seed: int | str | Column,
    by: Iterable[str] = (),
    name: str = "hash_rank",
    digits: int = 3,
) -> DataFrame:
    """One-based rank of each row in the order of the hash of its id, within ``by``.

    The leading hex digits of the hash split each class into ``16 ** digits`` even slices, so a class
    that holds most of the rows is still ranked by many tasks.
    """
    by = list(by)
    h = df.withColumn("_h", hash_of(id_col, seed)).withColumn("_hs", F.substring("_h", 1, digits))
    counts = h.groupBy(*by, "_hs").agg(F.count(F.lit(1)).alias("_c"))
    before = (
        Window.partitionBy(*(by or [F.lit(0)])).orderBy("_hs").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(*by, "_hs", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_hs").orderBy("_h", id_col)
    return (
        h.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*by, "_hs"])
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_h", "_hs", "_rn", "_off")
    )


def unique_ranks(
    df: DataFrame, value: str, id_col: str, keys: Iterable[str] = (), name: str = "rank"
) -> DataFrame:
    """One-based rank without ties: equal values are ordered by the hash of their id.

    ``tot_n`` holds the number of ranked rows of the key. A value shared by many rows is split by
    hash slices, so it does not land in one task.
    """
    keys = list(keys)
    start = prefix_by_value(df, value, keys).select(
        *keys, value, (F.col("cum_n") - F.col("n")).alias("_start"), "tot_n"
    )
    inner = hash_rank(df.filter(F.col(value).isNotNull()), id_col, "tie", [*keys, value], "_tie")
    return (
        inner.join(start, [*keys, value]).withColumn(name, F.col("_start") + F.col("_tie")).drop("_start", "_tie")
    )


def _long(df: DataFrame, columns: Mapping[str, Column], by: list[str]) -> DataFrame:
    """(by, _feature, _value) rows of several numeric expressions, NULLs left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("_feature"), e.cast("double").alias("_value"))
            for name, e in columns.items()
        ]
    )
    return (
        df.select(*by, F.explode(pairs).alias("_p"))
        .select(*by, "_p._feature", "_p._value")
        .filter(F.col("_value").isNotNull())
    )


def exact_quantiles(
    df: DataFrame,
    columns: Iterable[str] | Mapping[str, Column],
    probs: Iterable[float],
    by: Iterable[str] = (),
) -> dict[tuple, list[float | None]]:
    """Linearly interpolated quantiles of many columns, exact, in two scans.

    The first scan brackets every asked position with a quantile sketch. The second keeps the values inside
    the brackets, which are few, counts what lies between them, and reads the exact order statistics off
    running totals that many tasks compute. A bracket that misses its position is widened to the whole range
    and read again in the same way. Returns ``{(*by, column): [one value per prob]}``; a column without data is absent.
    """
    by, probs = list(by), [float(p) for p in probs]
    exprs = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    spark = df.sparkSession
    margin = 3.0 / SKETCH_ACCURACY
    asked = [q for p in probs for q in (max(0.0, p - margin), min(1.0, p + margin))]
    groups = _sketches(df, exprs, by, asked)
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"quantiles of more than {MAX_GROUPS} groups are not read on the driver")
    brackets = []
    for group, sketches in groups:
        for name, s in zip(exprs, sketches):
            if not s["n"]:
                continue
            for j, p in enumerate(probs):
                pos = p * (s["n"] - 1)
                k = math.floor(pos)
                lo = s["lo"] if k == 0 else s["q"][2 * j]
                hi = s["hi"] if k + 1 >= s["n"] - 1 else s["q"][2 * j + 1]
                brackets.append((*group, name, j, lo, hi, k, pos - k, s["lo"], s["hi"]))
    found = _read_brackets(df, exprs, by, brackets, spark)
    missed = [b for b in brackets if tuple(b[: len(by) + 2]) not in found]
    if missed:
        wide = [(*b[: len(by) + 2], b[-2], b[-1], *b[len(by) + 4 :]) for b in missed]
        found.update(_read_brackets(df, exprs, by, wide, spark))
    out: dict[tuple, list[float | None]] = {}
    for (*key, j), v in found.items():
        out.setdefault(tuple(key), [None] * len(probs))[j] = v
    return out


def _sketches(df: DataFrame, exprs: Mapping[str, Column], by: list[str], asked: list[float]) -> list[tuple[tuple, list]]:
    """(group, count, ends and approximate quantiles of each column) of every group, one group more than allowed at most.

    Without groups the columns are dealt to several keys, so that several tasks merge the sketches that the partitions
    send: one task would merge all columns of all partitions.
    """
    values = [e.cast("double") for e in exprs.values()]
    slots = len(values) if by else math.ceil(len(values) / SKETCH_TASKS)
    dealt = [values[i : i + slots] for i in range(0, len(values), slots)]
    if len(dealt) > 1:
        parts = [F.struct(F.lit(k).alias("k"), *[(part[i] if i < len(part) else F.lit(None).cast("double")).alias(f"v{i}") for i in range(slots)]) for k, part in enumerate(dealt)]
        rows, keys, slot = df.select(F.explode(F.array(*parts)).alias("_x")), [F.col("_x.k").alias("_k")], [F.col(f"_x.v{i}") for i in range(slots)]
    else:
        rows, keys, slot = df, by, values
    sketch = lambda v: F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile_approx(v, asked, SKETCH_ACCURACY).alias("q"))
    found = rows.groupBy(*keys).agg(*[sketch(v).alias(f"_s{i}") for i, v in enumerate(slot)])
    # without groups a row for each key, which are few
    found = (found.limit(MAX_GROUPS + 1) if by else found).collect()
    if len(dealt) == 1:
        return [(tuple(row[b] for b in by), [row[f"_s{i}"] for i in range(slots)]) for row in found]
    of_key = {row["_k"]: row for row in found}
    return [((), [of_key[i // slots][f"_s{i % slots}"] for i in range(len(values))])] if of_key else []


def _read_brackets(df, exprs, by, brackets, spark) -> dict[tuple, float]:
    """Exact interpolated values of the brackets that contain their position."""
    if not brackets:
        return {}
    dtypes = dict(df.dtypes)
    keys = [*by, "_feature"]
    named = ", ".join([f"`{b}` {dtypes[b]}" for b in by] + ["_feature string"])
    spans: dict[tuple, list[list[float]]] = {}
    for b in sorted(brackets, key=lambda b: (b[len(by) + 2], b[len(by) + 3])):
        merged, (lo, hi) = spans.setdefault(b[: len(by) + 1], []), b[len(by) + 2 : len(by) + 4]
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    read = spark.createDataFrame([(*k, [x for x, _ in v], [x for _, x in v]) for k, v in spans.items()], f"{named}, _los array<double>, _his array<double>")
    asked = spark.createDataFrame([(*b[: len(by) + 2], *b[len(by) + 4 : len(by) + 6]) for b in brackets], f"{named}, _j int, _k bigint, _frac double")
    value, passed = F.col("_value"), F.col("_passed")
    # the two tables hold one row per group, column and probability at most, built on the driver: safe to broadcast
    cells = _long(df, exprs, by).join(F.broadcast(read), keys).withColumn("_passed", F.size(F.filter("_his", lambda h: h < value)))
    # a span is cut into parts of equal width, one task each; what lies between two spans is one count in part -1
    lo, hi, parts = F.get("_los", passed), F.get("_his", passed), _slices(df, None)
    inside = F.coalesce(lo <= value, F.lit(False))
    part = F.least(F.lit(parts - 1), F.coalesce(F.floor(F.try_divide(value - lo, hi - lo) * parts).cast("int"), F.lit(0)))
    counts = cells.groupBy(*keys, "_passed", F.when(inside, part).otherwise(-1).alias("_part"), F.when(inside, value).alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*keys, "_passed", "_part").agg(F.sum("_c").alias("_t"))
    # at most one row per part of a span
    before = Window.partitionBy(*keys).orderBy("_passed", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_passed", "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    order = Window.partitionBy(*keys, "_passed", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_run", F.sum("_c").over(order)).join(offsets, [*keys, "_passed", "_part"]).filter("_part >= 0")
    at, last = F.col("_k"), F.col("_off") + F.col("_run")
    first = last - F.col("_c")
    rows = (
        run.join(F.broadcast(asked), keys)
        .filter((first <= at + 1) & (at < last))
        .groupBy(*keys, "_j", "_frac")
        .agg(
            F.max(F.when((first <= at) & (at < last), F.col("_at"))).alias("_a"),
            F.max(F.when((first <= at + 1) & (at + 1 < last), F.col("_at"))).alias("_b"),
        )
        .collect()
    )
    keys = [*keys, "_j"]
    found = {}
    for r in rows:
        if r["_a"] is None or (r["_b"] is None and r["_frac"] > 0):
            continue
        step = 0.0 if r["_frac"] == 0 else (r["_b"] - r["_a"]) * r["_frac"]
        found[tuple(r[x] for x in keys)] = r["_a"] + step
    return found
