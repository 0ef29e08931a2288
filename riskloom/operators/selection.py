"""Redundant pairs, IV selector, stability across folds and the selection register."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.operators.binning import distinct_edges, numbers_of, zero_one
from riskloom.operators.gram import pairwise_pearson
from riskloom.operators.ranks import exact_quantiles, prefix_by_value
from riskloom.operators.stages import ID, TARGET, ColumnDropModel, _Stage, quoted
from riskloom.operators.woe import information_value, iv_of, woe_table
from riskloom.session import checkpointed

EVENT = " > 0"


# -- redundancy --------------------------------------------------------------------------------


def redundant_pairs(
    df: DataFrame, columns: Iterable[str], table_of: Mapping[str, str], declared: Iterable[tuple[str, str]] = ()
) -> DataFrame:
    """Pairs of columns of different tables over the redundancy threshold or in the review band.

    One Gram matrix gives every pairwise-complete correlation, the "above zero" event of each
    non-negative magnitude included. Declared pairs always appear. The target is not read.
    """
    columns = sorted(numbers_of(df, columns))
    flags = zero_one(df, columns)
    lows = df.agg(*[F.min(quoted(c)).alias(f"l{i}") for i, c in enumerate(columns)]).first()
    events = [c for i, c in enumerate(columns) if not flags[c] and lows[f"l{i}"] is not None and lows[f"l{i}"] >= 0]
    wide = df.select(
        *[quoted(c).cast("double").alias(c) for c in columns],
        *[F.when(quoted(c).isNotNull(), (quoted(c) > 0).cast("double")).alias(c + EVENT) for c in events],
    )
    r = pairwise_pearson(wide, [*columns, *(c + EVENT for c in events)])
    spark = df.sparkSession
    # one row per column, built from the column list
    meta = spark.createDataFrame([(c, table_of.get(c, ""), bool(flags[c])) for c in columns], "c string, tbl string, is_flag boolean")

    def side(x: str) -> DataFrame:
        return meta.select(F.col("c").alias(x), F.col("tbl").alias(f"table_{x}"), F.col("is_flag").alias(f"flag_{x}"))

    base = r.join(side("a"), "a").join(side("b"), "b")
    is_event = F.col("b").endswith(EVENT)
    against = r.filter(is_event).select(
        F.col("a").alias("f"), F.regexp_replace("b", f"{EVENT}$", "").alias("m"), F.col("r").alias("r_event")
    )
    mixed = F.col("flag_a") != F.col("flag_b")
    f = F.when(F.col("flag_a"), F.col("a")).otherwise(F.col("b"))
    m = F.when(F.col("flag_a"), F.col("b")).otherwise(F.col("a"))
    base = base.withColumns({"f": F.when(mixed, f), "m": F.when(mixed, m)}).join(against, ["f", "m"], "left")
    wanted = spark.createDataFrame([tuple(sorted(p)) for p in declared] or [("", "")], "a string, b string").withColumn("declared", F.lit(True))
    base = base.join(wanted, ["a", "b"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))
    both = F.col("flag_a") & F.col("flag_b")
    limit = F.when(both, P.REDUNDANT_FLAGS).otherwise(P.REDUNDANT_PEARSON)
    over = (F.abs("r") > limit) | (F.coalesce(F.abs("r_event"), F.lit(0.0)) > P.REDUNDANT_FLAGS)
    zone = (
        F.when(over, "above")
        .when(~both & (F.abs("r") >= P.REVIEW_PEARSON), "band")
        .when(F.col("declared"), "declared")
    )
    kind = F.when(both, "FF").when(mixed, "FM").otherwise("MM")
    return (
        base.filter((F.col("table_a") != F.col("table_b")) | F.col("declared"))
        .select("a", "b", "table_a", "table_b", kind.alias("kind"), "r", "r_event", "n", zone.alias("zone"), F.col("declared").cast("int").alias("declared"))
        .filter(F.col("zone").isNotNull())
    )


def pair_rows(df: DataFrame, pairs: list[tuple[str, str]], target: str = TARGET) -> DataFrame:
    """(pair, a, b, la, lb, y): the rows of each pair on which both columns have a value, as numbers and as text.

    The values of a row are one array and the pairs are places in it, so the plan doesn't grow with the pairs.
    """
    columns = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(columns)}
    numbers = set(numbers_of(df, columns))
    values = F.array(*[(quoted(c) if c in numbers else F.lit(None)).cast("double") for c in columns])
    texts = F.array(*[quoted(c).cast("string") for c in columns])
    places = df.sparkSession.createDataFrame([(i, at[a], at[b]) for i, (a, b) in enumerate(pairs)], "pair int, ia int, ib int")
    # one row a pair of columns, built from the list
    every = places.agg(F.array_sort(F.collect_list(F.struct("pair", "ia", "ib"))).alias("_pairs"))
    rows = df.select(F.col(target).cast("double").alias("y"), values.alias("_v"), texts.alias("_t")).filter("y IS NOT NULL").join(F.broadcast(every))
    both = F.filter("_pairs", lambda p: F.get("_t", p["ia"]).isNotNull() & F.get("_t", p["ib"]).isNotNull())
    each = rows.select("y", "_v", "_t", F.explode(both).alias("p"))
    return each.select(F.col("p.pair").alias("pair"), "y", F.get("_v", F.col("p.ia")).alias("a"), F.get("_v", F.col("p.ib")).alias("b"), F.get("_t", F.col("p.ia")).alias("la"), F.get("_t", F.col("p.ib")).alias("lb"))


def contingency(df: DataFrame, pairs: list[tuple[str, str]], target: str = TARGET) -> DataFrame:
    """(pair, bin_a, bin_b, n, bads): the crossed bins of every pair in one aggregate, with bins of the pair's own rows."""
    rows = pair_rows(df, pairs, target)
    quantiles = exact_quantiles(rows, ["a", "b"], [i / P.MAX_BINS for i in range(P.MAX_BINS + 1)], ["pair"])
    # eleven numbers for each column of a pair
    edges = rows.sparkSession.createDataFrame(
        [(i, *[list(distinct_edges(quantiles[i, side])) if (i, side) in quantiles else None for side in ("a", "b")]) for i in range(len(pairs))],
        "pair int, ea array<double>, eb array<double>",
    )
    met = rows.join(F.broadcast(edges), "pair")
    inside = lambda x, e: F.coalesce((F.col(x) > F.element_at(e, 1)) & (F.col(x) < F.element_at(e, -1)), F.lit(False))
    wide = met.groupBy("pair").agg(F.bool_or(inside("a", "ea")).alias("wide_a"), F.bool_or(inside("b", "eb")).alias("wide_b"))

    def binned(x: str) -> Column:
        inner = F.slice(f"e{x}", 2, F.greatest(F.size(f"e{x}") - 2, F.lit(0)))
        return F.when(F.col(f"wide_{x}"), F.size(F.filter(inner, lambda e: e < F.col(x))).cast("string")).otherwise(F.col(f"l{x}"))

    return met.join(F.broadcast(wide), "pair").groupBy("pair", binned("a").alias("bin_a"), binned("b").alias("bin_b")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bads"))


def resolve_redundancy(
    df: DataFrame, pairs: Iterable[tuple[str, str]], protected: Iterable[str] = (), target: str = TARGET, min_iv: float = P.MIN_IV
) -> DataFrame:
    """Which column of each pair stays: IV inside the other, protection, then IV alone.

    Everything is measured on the rows where both have a value, with bins of those rows; the four readings of a pair are sums of
    its crossed bins.
    """
    pairs, protected = list(pairs), set(protected)
    crossed = checkpointed(contingency(df, pairs, target))

    def reading(name: str, bin_: str, stratum: Column) -> DataFrame:
        return crossed.select("pair", F.lit(name).alias("feature"), stratum.alias("stratum"), F.col(bin_).alias("bin"), "n", "bads")

    all_ = F.lit("all")
    four = [reading("iv_a", "bin_a", all_), reading("iv_b", "bin_b", all_), reading("inc_a", "bin_a", F.col("bin_b")), reading("inc_b", "bin_b", F.col("bin_a"))]
    counts = reduce(DataFrame.unionByName, four).groupBy("pair", "feature", "stratum", "bin").agg(F.sum("n").alias("n"), F.sum("bads").alias("bads"))
    measured = iv_of(woe_table(counts, by=["pair"]), ["pair"])
    wide = measured.groupBy("pair").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("feature") == x, F.col("iv"))).alias(x) for x in ("iv_a", "iv_b", "inc_a", "inc_b")])
    index = df.sparkSession.createDataFrame([(i, a, b, a in protected, b in protected) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string, pa boolean, pb boolean")
    t = index.join(wide, "pair")
    a_in, b_in = F.col("inc_a") >= min_iv, F.col("inc_b") >= min_iv
    pa, pb = F.col("pa"), F.col("pb")
    keep = (
        F.when(pa & pb, "both")
        .when(pa, F.when(b_in, "both").otherwise("a"))
        .when(pb, F.when(a_in, "both").otherwise("b"))
        .when(a_in & b_in, "both")
        .when(a_in, "a")
        .when(b_in, "b")
        .when(F.col("iv_a") >= F.col("iv_b"), "a")
        .otherwise("b")
    )
    motive = (
        F.when(pa & pb, "both protected")
        .when(pa | pb, "one protected")
        .when(a_in & b_in, "each adds to the other")
        .when(a_in | b_in, "only one adds to the other")
        .otherwise("neither adds, higher IV alone")
    )
    return t.select("a", "b", "n", "iv_a", "iv_b", "inc_a", "inc_b", keep.alias("keep"), motive.alias("motive"))


# -- selector ----------------------------------------------------------------------------------


# Roles that one origin may not hold together
EXCLUSIVE = (
    ("discard", "protected"),
    ("loser", "protected"),
    ("loser", "discard"),
    ("loser", "winner"),
    ("source", "protected"),
    ("source", "loser"),
    ("source", "winner"),
    ("source", "recovered"),
)


def column_groups(columns: Iterable[str]) -> dict[str, list[str]]:
    """Origin -> its columns: itself where it is a column, else the dummies that carry it before an underscore."""
    groups: dict[str, list[str]] = {}
    columns = list(columns)
    for c in columns:
        for i in (i for i, ch in enumerate(c) if ch == "_"):
            groups.setdefault(c[:i], []).append(c)
    return groups | {c: [c] for c in columns}


def declared_roles(settings: Mapping) -> list[tuple[str, str, str | None]]:
    """(origin, role, other) rows of a selector's settings, contradictions refused.

    ``other`` is the presence column of a candidate, the motive of a discard, a winner of a loser and a
    recovered column of a source; winners and recovered columns get a row of their own.
    """
    rows = [(o, "candidate", presence) for o, presence in settings.get("candidates", {}).items()]
    rows += [(o, "discard", motive) for o, motive in settings.get("discards", {}).items()]
    rows += [(o, "protected", None) for o in settings.get("protected", [])]
    for role, back, links in (("loser", "winner", "redundant"), ("source", "recovered", "sources")):
        for o, others in settings.get(links, {}).items():
            rows += [(o, role, x) for x in others] + [(x, back, o) for x in others]
    held: dict[str, set[str]] = {}
    for o, role, _ in rows:
        held.setdefault(o, set()).add(role)
    clashes = {o: pair for o, roles in held.items() for pair in EXCLUSIVE if roles.issuperset(pair)}
    clashes |= {o: ("loser", "no candidate") for o, roles in held.items() if "loser" in roles and "candidate" not in roles}
    if clashes:
        raise ValueError(f"roles that exclude each other: {dict(sorted(clashes.items()))}")
    return rows


def origin_frame(df: DataFrame, groups: Mapping[str, list[str]], presence: Mapping[str, str | None], categorical: Iterable[str], target: str = TARGET) -> tuple[DataFrame, dict[str, Column]]:
    """One column per origin (its position in ``groups``), NULL outside its presence, and the population of each.

    A dummy group becomes one text per combination; a categorical code becomes text.
    """
    categorical = set(categorical)
    out, where = [], {}
    for i, (o, group) in enumerate(groups.items()):
        plain = len(group) == 1 and o not in categorical
        e = quoted(group[0]) if plain else F.concat_ws("|", *[quoted(c).cast("string") for c in group])
        if presence.get(o):
            e = F.when(quoted(presence[o]) == 1, e)
            where[f"o{i}"] = F.col(f"o{i}").isNotNull()
        out.append(e.alias(f"o{i}"))
    return df.select(*out, target), where


def verdicts(iv: DataFrame, roles: DataFrame, min_iv: float = P.MIN_IV) -> DataFrame:
    """(origin, iv, motive) of every measured origin; the motive is NULL where it stays.

    ``roles`` holds (origin, role, other, there), where ``there`` says that ``other`` is in the frame.
    An origin speaks for itself by its discard or its IV. A loser goes anyway while a winner stays, a source
    stays anyway while something it recovers does, so losers are joined to the first verdicts and sources to both.
    """
    role = F.col("role")
    asks = roles.groupBy("origin").agg(
        F.max(F.when(role == "discard", F.col("other"))).alias("ruling"),
        (F.bool_or(role == "candidate") & ~F.bool_or(role == "protected")).alias("judged"),
        F.max(F.when(role.isin("loser", "source"), role)).alias("hangs"),
    )
    low = F.format_string(f"IV %.4f below {min_iv:.4f}", "iv")
    own = F.coalesce("ruling", F.when(F.col("judged") & (F.col("iv") < min_iv), low))
    opinions = iv.join(asks, "origin").select("origin", "iv", "hangs", own.alias("own"))

    def staying(kind: str, known: DataFrame) -> DataFrame:
        gone = known.filter("motive IS NOT NULL").select(F.col("origin").alias("other"), F.lit(True).alias("gone"))
        left = F.array_sort(F.collect_list(F.when(F.col("there") & F.col("gone").isNull(), F.col("other"))))
        links = roles.filter(role == kind).join(gone, "other", "left").groupBy("origin").agg(left.alias("left"))
        return opinions.join(links, "origin")

    free = opinions.filter("hangs IS NULL").select("origin", "iv", F.col("own").alias("motive"))
    some = F.size("left") > 0
    beaten = F.concat(F.lit("redundant with "), F.array_join("left", ", "))
    losers = staying("loser", free).select("origin", "iv", F.when(some, beaten).otherwise(F.concat("own", F.lit("; no winner left"))).alias("motive"))
    settled = free.unionByName(losers)
    sources = staying("source", settled).select("origin", "iv", F.when(~some, F.concat("own", F.lit("; recovers nothing"))).alias("motive"))
    return settled.unionByName(sources)


class IvSelector(_Stage):
    """Drops what has no predictive power of its own, origin by origin.

    Settings: ``candidates`` (origin -> presence column or None), ``discards`` (origin -> motive),
    ``protected``, ``categorical``, ``redundant`` (loser -> winners) and ``sources`` (presence source ->
    what it recovers). Columns without a decision pass through. The fitted state holds one row per declared origin.
    """

    model = ColumnDropModel

    def state_of(self, df):
        target, spark = self.get("target", TARGET), df.sparkSession
        if target not in df.columns:
            raise ValueError("the IV selector needs the target")
        settings = {n: self.get(n, {}) for n in ("candidates", "discards", "protected", "redundant", "sources")}
        rows = declared_roles(settings)
        groups = column_groups(c for c in df.columns if c not in (ID, target))
        needed = {o for o, role, _ in rows if role != "recovered"}
        if lost := sorted(needed - set(groups)):
            raise KeyError(f"origins missing from the frame: {lost}")
        measured = sorted({o for o, role, _ in rows if role not in ("winner", "recovered")})
        if not measured:
            return {"iv": {}, "motives": {}, "dropped": [], "kept": df.columns}
        frame, where = origin_frame(df, {o: groups[o] for o in measured}, settings["candidates"], self.get("categorical", []), target)
        names = spark.createDataFrame([(f"o{i}", o) for i, o in enumerate(measured)], "feature string, origin string")
        found = information_value(frame, [f"o{i}" for i in range(len(measured))], target, where=where)
        roles = spark.createDataFrame([(*r, r[2] in groups) for r in rows], "origin string, role string, other string, there boolean")
        # one row per declared origin; read once, so that the three verdicts share one measurement
        ivs = [(r["origin"], r["iv"]) for r in names.join(found, "feature", "left").select("origin", "iv").collect()]
        decided = verdicts(spark.createDataFrame(ivs, "origin string, iv double"), roles, self.get("min_iv", P.MIN_IV)).collect()
        motives = {r["origin"]: r["motive"] for r in decided if r["motive"] is not None}
        dropped = sorted({c for o in motives for c in groups[o]})
        return {"iv": {r["origin"]: r["iv"] for r in decided}, "motives": motives, "dropped": dropped, "kept": [c for c in df.columns if c not in dropped]}


# -- stability and register --------------------------------------------------------------------


def fold_counts(df: DataFrame, folds: DataFrame, columns: Iterable[str], target: str = TARGET, id_col: str = ID) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(feature, v, label, n0.., b0..): rows and bads of every value outside each (seed, fold), and the cells in order.

    Rows are counted once, by value and own folds; what fits a fold is the total less the fold's own count. A row meets its folds
    in one join whatever the number of seeds, and no row is repeated for the folds that it helps to fit.
    """
    columns = list(columns)
    seeds = sorted(r["seed"] for r in folds.select("seed").distinct().collect())
    k = folds.agg((F.max("fold") + 1).alias("k")).first()["k"]
    own = folds.groupBy(id_col).agg(*[F.max(F.when(F.col("seed") == s, F.col("fold"))).alias(f"_own{i}") for i, s in enumerate(seeds)])
    numbers = set(numbers_of(df, columns))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (quoted(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("v"),
                F.coalesce(quoted(c).cast("string"), F.lit(P.NULL_LEVEL)).alias("label"),
            )
            for c in columns
        ]
    )
    y = F.col(target).cast("double")
    rows = df.filter(F.col(target).isNotNull()).select(id_col, y.alias("_y"), F.explode(cells).alias("x")).join(own, id_col)
    parts = {}
    for i in range(len(seeds)):
        there = F.col(f"_own{i}").isNotNull()
        parts |= {f"tn{i}": F.count_if(there), f"tb{i}": F.sum(F.when(there, F.col("_y")).otherwise(0.0))}
        for g in range(k):
            inside = F.col(f"_own{i}") == g
            parts |= {f"n{i}_{g}": F.count_if(inside), f"b{i}_{g}": F.sum(F.when(inside, F.col("_y")).otherwise(0.0))}
    grouped = rows.groupBy("x.feature", "x.v", "x.label").agg(*[e.alias(n) for n, e in parts.items()])
    cells_of = [(i, s, g) for i, s in enumerate(seeds) for g in range(k)]
    outside = [
        e for w, (i, _, g) in enumerate(cells_of)
        for e in ((F.col(f"tn{i}") - F.col(f"n{i}_{g}")).alias(f"n{w}"), (F.col(f"tb{i}") - F.col(f"b{i}_{g}")).alias(f"b{w}"))
    ]
    return checkpointed(grouped.select("feature", "v", "label", *outside)), [(s, g) for _, s, g in cells_of]


def _fold_edges(counts: DataFrame, width: int) -> DataFrame:
    """(feature, w, edges, many): distinct tenths of every numeric column in each fitting part, and whether it has more than two values."""
    named = prefix_by_value(counts, "v", ["feature"], {f"n{w}": F.sum(f"n{w}") for w in range(width)})
    each = named.select("feature", "v", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"n{w}").alias("n"), F.col(f"cum_n{w}").alias("cum"), F.col(f"tot_n{w}").alias("tot")) for w in range(width)])).alias("c"))
    each = each.select("feature", "v", "c.*").filter("n > 0")
    many = each.groupBy("feature", "w").agg((F.count(F.lit(1)) > 2).alias("many"))
    probs = F.array(*[F.lit(i / P.MAX_BINS) for i in range(P.MAX_BINS + 1)])
    first, last = F.col("cum") - F.col("n"), F.col("cum")

    def hit(p: Column) -> Column:
        at = p * (F.col("tot") - 1)
        k = F.floor(at)
        return F.struct(p.alias("p"), (at - k).alias("frac"), ((first <= k) & (k < last)).alias("a"), ((first <= k + 1) & (k + 1 < last)).alias("b"))

    hits = F.filter(F.transform(probs, hit), lambda h: h["a"] | h["b"])
    found = each.select("feature", "w", "v", F.explode(hits).alias("h")).groupBy("feature", "w", "h.p", "h.frac").agg(F.max(F.when(F.col("h.a"), F.col("v"))).alias("a"), F.max(F.when(F.col("h.b"), F.col("v"))).alias("b"))
    value = F.col("a") + F.when(F.col("frac") > 0, (F.col("b") - F.col("a")) * F.col("frac")).otherwise(0.0)
    # eleven numbers a column and fold
    edges = found.groupBy("feature", "w").agg(F.array_sort(F.collect_list(F.struct("p", value.alias("e")))).alias("es"))
    return edges.select("feature", "w", F.array_distinct(F.col("es.e")).alias("edges")).join(many, ["feature", "w"])


def fold_iv(
    df: DataFrame, folds: DataFrame, columns: Iterable[str], target: str = TARGET, id_col: str = ID
) -> DataFrame:
    """(feature, seed, fold, iv): IV of each column on the fitting part of every fold, bins refitted there."""
    counts, cells = fold_counts(df, folds, columns, target, id_col)
    width = len(cells)
    each = counts.select("feature", "v", "label", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"n{w}").alias("n"), F.col(f"b{w}").alias("b")) for w in range(width)])).alias("c"))
    each = each.select("feature", "v", "label", "c.*").filter("n > 0")
    # one row per fold and column: safe to broadcast
    met = each.join(F.broadcast(_fold_edges(counts, width)), ["feature", "w"], "left")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    index = F.size(F.filter(inner, lambda e: e < F.col("v"))).cast("string")
    binned = F.when(F.col("many") & F.col("v").isNotNull(), index).otherwise(F.col("label"))
    bins = met.groupBy("feature", "w", F.lit("all").alias("stratum"), binned.alias("bin")).agg(F.sum("n").alias("n"), F.sum("b").alias("bads"))
    iv = iv_of(woe_table(bins, by=["w"]), ["w"])
    names = df.sparkSession.createDataFrame([(w, int(s), g) for w, (s, g) in enumerate(cells)], "w int, seed int, fold int")
    return iv.join(names, "w").select("feature", "seed", "fold", "iv")


def stability(
    df: DataFrame, folds: DataFrame, iv: Mapping[str, float], decides: Iterable[str],
    band: tuple[float, float] = P.IV_BAND, min_iv: float = P.MIN_IV, target: str = TARGET, id_col: str = ID,
) -> DataFrame:
    """In how many folds each column of the review band reaches the minimum IV."""
    lo, hi = band
    inside = [c for c in decides if lo <= iv[c] < hi]
    if not inside:
        return df.sparkSession.createDataFrame([], "feature string, folds_reached bigint, n_folds bigint")
    return fold_iv(df, folds, inside, target, id_col).groupBy("feature").agg(
        F.count_if(F.col("iv") >= min_iv).alias("folds_reached"), F.count(F.lit(1)).alias("n_folds")
    )


def selection_register(
    spark, columns: Iterable[str], selector: ColumnDropModel, table_of: Mapping[str, str],
    recipe: Mapping[str, str] | None = None, pairs: Mapping[str, str] | None = None, folds: Mapping[str, int] | None = None,
    band: tuple[float, float] = P.IV_BAND, min_iv: float = P.MIN_IV,
) -> DataFrame:
    """One row per declared column: table, recipe decision, IV, band, folds, redundancy, kept, motive.

    The declared columns joined to the selector's verdicts and to its roles; a column stays unless a verdict names it.
    """
    recipe, pairs, folds = dict(recipe or {}), dict(pairs or {}), dict(folds or {})
    declared = spark.createDataFrame(
        [(c, table_of.get(c, ""), recipe.get(c), pairs.get(c), folds.get(c)) for c in columns],
        "feature string, source string, recipe string, redundancy string, folds int",
    )
    motives = selector.fitted("motives")
    decided = spark.createDataFrame([(o, v, motives.get(o)) for o, v in selector.fitted("iv").items()], "feature string, iv double, out string")
    settings = {n: selector.get(n, {}) for n in ("candidates", "discards", "protected", "redundant", "sources")}
    roles = spark.createDataFrame(declared_roles(settings), "feature string, role string, other string").groupBy("feature").agg(
        F.collect_set("role").alias("roles"), F.array_sort(F.collect_list(F.when(F.col("role") == "source", F.col("other")))).alias("recovers")
    )
    holds = lambda role: F.coalesce(F.array_contains("roles", role), F.lit(False))
    near = F.coalesce((F.col("iv") >= band[0]) & (F.col("iv") < band[1]), F.lit(False)) & holds("candidate") & ~holds("protected")
    enough = F.format_string(f"IV %.4f reaches {min_iv:.4f}", "iv")
    why = (
        F.when(holds("source"), F.concat(F.lit("recovers "), F.array_join("recovers", ", ")))
        .when(holds("protected"), "protected")
        .when(holds("loser"), F.concat(enough, F.lit("; no winner left")))
        .when(F.col("iv").isNull(), "not judged by IV")
        .otherwise(F.concat(enough, F.coalesce(F.concat(F.lit("; in "), F.when(near, F.col("folds")).cast("string"), F.lit(" folds")), F.lit(""))))
    )
    return declared.join(decided, "feature", "left").join(roles, "feature", "left").select(
        "feature", "source", "recipe", "iv", near.cast("int").alias("in_band"), F.when(near, F.col("folds")).alias("folds"),
        "redundancy", F.col("out").isNull().cast("int").alias("kept"), F.coalesce("out", why).alias("motive"),
    )
