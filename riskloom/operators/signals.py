"""Effect sizes and tests of features against a binary target, under explicit populations.

A measure is given as named expressions with an optional population each. All of them are measured in
one job: rows become (feature, value, target) and meet in one partial aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.functions import tails
from riskloom.functions.nullsafe import holds
from riskloom.operators.gram import pearson
from riskloom.operators.ranks import exact_quantiles, prefix_by_value

TARGET = "TARGET"


@dataclass(frozen=True)
class Measure:
    """One measurement: name, expression, population and the label of that population."""

    name: str
    value: Column
    where: Column | None = None
    label: str = ""


def measures(names: Iterable[str], where: Column | None = None, label: str = "") -> list[Measure]:
    """Columns by name as measures of one population."""
    return [Measure(n, F.col(n), where, label) for n in names]


def long_values(df: DataFrame, items: Iterable[Measure], target: str = TARGET, by: Iterable[str] = ()) -> DataFrame:
    """(by, feature, population, v, y): reported values of every measure inside its population."""
    cells = []
    for m in items:
        cell = F.struct(
            F.lit(m.name).alias("feature"), F.lit(m.label).alias("population"), m.value.cast("double").alias("v")
        )
        inside = m.value.isNotNull() if m.where is None else m.value.isNotNull() & holds(m.where)
        cells.append(F.when(inside, cell))
    y = F.col(target)
    return (
        df.filter(y.isNotNull())
        .select(*by, y.cast("double").alias("y"), F.explode(F.array(*cells)).alias("c"))
        .filter(F.col("c").isNotNull())
        .select(*by, "c.feature", "c.population", "c.v", "y")
    )


def flag_signal(df: DataFrame, items: Iterable[Measure], target: str = TARGET, by: Iterable[str] = ()) -> DataFrame:
    """Default rate with the flag at 1 and at 0, delta in points, pooled z and its p.

    Values other than 0 and 1 belong to neither group; a measure with an empty group is left out.
    """
    by = list(by)
    v, y = F.col("v"), F.col("y")
    g = long_values(df, items, target, by).groupBy(*by, "feature", "population").agg(
        F.count_if(v == 1).alias("n1"),
        F.count_if(v == 0).alias("n0"),
        F.coalesce(F.sum(F.when(v == 1, y)), F.lit(0.0)).alias("s1"),
        F.coalesce(F.sum(F.when(v == 0, y)), F.lit(0.0)).alias("s0"),
    )
    g = g.filter((F.col("n1") > 0) & (F.col("n0") > 0))
    rate1, rate0 = F.col("s1") / F.col("n1"), F.col("s0") / F.col("n0")
    z = pooled_z(F.col("s1"), F.col("n1"), F.col("s0"), F.col("n0"))
    return g.select(
        *by,
        "feature",
        "population",
        "n1",
        "n0",
        rate1.alias("rate1"),
        rate0.alias("rate0"),
        ((rate1 - rate0) * 100).alias("effect"),
        z.alias("z"),
    ).withColumn("p", tails.p_normal(F.col("z")))


def pooled_z(s1: Column, n1: Column, s0: Column, n0: Column) -> Column:
    """z of the difference of two proportions with the pooled variance."""
    pooled = (s1 + s0) / (n1 + n0)
    return F.try_divide(s1 / n1 - s0 / n0, F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0)))


def difference_interval(s1: Column, n1: Column, s0: Column, n0: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Difference of two proportions and its unpooled interval."""
    p1, p0 = s1 / n1, s0 / n0
    margin = z * F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    return p1 - p0, p1 - p0 - margin, p1 - p0 + margin


def rank_signal(df: DataFrame, items: Iterable[Measure], target: str = TARGET, by: Iterable[str] = ()) -> DataFrame:
    """Mann-Whitney U of the class 0 values and the absolute rank-biserial effect.

    The p is the normal one with tie and continuity corrections. A measure with one class is left out.
    """
    by = list(by)
    keys = [*by, "feature", "population"]
    p = prefix_by_value(long_values(df, items, target, by), "v", keys, {"bads": F.sum("y")})
    return mann_whitney(p, keys).withColumn("p", tails.p_normal(F.col("z")))


def mann_whitney(prefix: DataFrame, keys: Iterable[str]) -> DataFrame:
    """U, effect and z per key from running totals with ``n`` and ``bads``."""
    keys = list(keys)
    n, bads = F.col("n").cast("double"), F.col("bads")
    goods = n - bads
    rank = F.col("cum_n") - (n - 1) / 2
    g = prefix.groupBy(*keys).agg(
        F.max(F.col("tot_n").cast("double")).alias("n"),
        F.max("tot_bads").alias("n1"),
        F.sum(goods * rank).alias("_r0"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    g = g.withColumn("n0", F.col("n") - F.col("n1")).filter((F.col("n0") > 0) & (F.col("n1") > 0))
    n0, n1, total = F.col("n0"), F.col("n1"), F.col("n")
    u = F.col("_r0") - n0 * (n0 + 1) / 2
    centre = n0 * n1 / 2
    spread = F.sqrt(n0 * n1 / 12 * (total + 1 - F.col("_ties") / (total * (total - 1))))
    z = F.when(spread > 0, F.greatest(F.abs(u - centre) - 0.5, F.lit(0.0)) / spread).otherwise(0.0)
    return g.select(
        *keys, "n", "n0", "n1", u.alias("u"), F.abs(2 * u / (n0 * n1) - 1).alias("effect"), z.alias("z")
    )


def class_medians(df: DataFrame, columns: Iterable[str], target: str = TARGET) -> DataFrame:
    """(feature, median0, median1): exact median of each column in each class."""
    q = exact_quantiles(df.filter(F.col(target).isNotNull()), columns, [0.5], [target])
    wanted: dict[str, dict] = {}
    for (cls, name), (median,) in q.items():
        wanted.setdefault(name, {})[int(cls)] = median
    rows = [(c, v.get(0), v.get(1)) for c, v in wanted.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, median0 double, median1 double")


def upsert(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Old rows, with those of the same keys replaced by the new ones."""
    keys = list(keys)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def remeasure(
    df: DataFrame,
    recipe: Iterable[Mapping],
    populations: Mapping[str, Column | None],
    target: str = TARGET,
    factor: float = P.SAME_ORDER_FACTOR,
) -> DataFrame:
    """Measure again the provisional features of a recipe, each with its type, coding and population.

    A recipe entry has ``name``, ``kind`` (flag, continuous or control), ``firm`` (bool),
    ``population`` and optionally ``coding`` ("> 0") and ``effect``.
    """
    kept = [r for r in recipe if not r.get("firm") and r["kind"] != "control"]
    unknown = sorted({r["population"] for r in kept} - set(populations))
    if unknown:
        raise KeyError(f"populations without a predicate: {unknown}")
    flags, numbers = [], []
    for r in kept:
        c = F.col(r["name"])
        where = populations[r["population"]]
        if r["kind"] == "flag":
            value = F.when(c.isNotNull(), (c > 0).cast("double")) if r.get("coding") == "> 0" else c
            flags.append(Measure(r["name"], value, where, r["population"]))
        else:
            numbers.append(Measure(r["name"], c, where, r["population"]))
    spark = df.sparkSession
    cols = ["feature", "kind", "population", "effect", "n"]
    parts = []
    if flags:
        parts.append(flag_signal(df, flags, target).select("feature", F.lit("flag").alias("kind"), "population", "effect", F.col("n1").cast("double").alias("n")))
    if numbers:
        parts.append(rank_signal(df, numbers, target).select("feature", F.lit("continuous").alias("kind"), "population", "effect", "n"))
    if not parts:
        return spark.createDataFrame([], "feature string, kind string, population string, recipe_effect double, effect double, n double, quotient double, same_order int")
    measured = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    declared = spark.createDataFrame(
        [(r["name"], r["kind"], r["population"], float(r["effect"]) if r.get("effect") is not None else None) for r in kept],
        "feature string, kind string, population string, recipe_effect double",
    )
    quotient = F.try_divide("effect", "recipe_effect")
    return declared.join(measured.select(*cols), ["feature", "kind", "population"], "left").withColumns(
        {"quotient": quotient, "same_order": quotient.between(1 / factor, factor).cast("int")}
    )


# -- contingency -------------------------------------------------------------------------------


def crosstab(df: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """(a, b, n) counts with both values present, with row, column and total counts and shares."""
    a = (F.col(a) if isinstance(a, str) else a).cast("string").alias("a")
    b = (F.col(b) if isinstance(b, str) else b).cast("string").alias("b")
    counts = df.select(a, b).filter(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n")
    )
    # a cross table has one row per pair of levels, however many rows it counts
    return counts.withColumns(
        {
            "n_row": F.sum("n").over(Window.partitionBy("a")),
            "n_col": F.sum("n").over(Window.partitionBy("b")),
            "n_all": counts.agg(F.sum("n")).scalar(),
        }
    ).withColumns({"row_share": F.col("n") / F.col("n_row"), "col_share": F.col("n") / F.col("n_col"), "expected": F.col("n_row") * F.col("n_col") / F.col("n_all")})


def chi_square(table: DataFrame) -> DataFrame:
    """One row: chi-square of a cross table (Yates on a 2x2), degrees of freedom, p and Cramér's V."""
    n, e = F.col("n"), F.col("expected")
    s = table.agg(
        F.max("n_all").cast("double").alias("n"),
        F.count_distinct("a").alias("rows"),
        F.count_distinct("b").alias("cols"),
        # cells without rows add their expected count, which the identity sum(O^2/E) - N includes
        F.sum(n * n / e).alias("_q"),
        F.max(F.abs(n - e)).alias("_d"),
    )
    inv_rows = table.select("a", "n_row").distinct().agg(F.sum(1 / F.col("n_row")).alias("v")).scalar()
    inv_cols = table.select("b", "n_col").distinct().agg(F.sum(1 / F.col("n_col")).alias("v")).scalar()
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    short = F.greatest(F.col("_d") - 0.5, F.lit(0.0))
    yates = short * short * F.col("n") * inv_rows * inv_cols
    s = s.withColumns({"dof": dof, "chi2": F.when(dof == 1, yates).otherwise(F.col("_q") - F.col("n"))})
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("rows", "cols") - 1)))
    return s.select("n", "dof", "chi2", v.alias("v")).withColumn("p", tails.p_chi2(F.col("chi2"), F.col("dof").cast("double")))


def two_by_two(
    df: DataFrame,
    predicates: Mapping[str, Column],
    target: str = TARGET,
    where: Mapping[str, Column] | None = None,
    alpha: float = P.FAMILY_ALPHA,
) -> DataFrame:
    """Each predicate against the target: rates, delta in points, Fisher if a cell is under 5, else chi².

    Significance is Bonferroni over the predicates of the call.
    """
    where = dict(where or {})
    cells = []
    for name, p in predicates.items():
        cell = F.struct(F.lit(name).alias("feature"), holds(p).alias("hit"))
        cells.append(F.when(holds(where[name]), cell) if name in where else cell)
    y = F.col("y") == 1
    g = (
        df.filter(F.col(target).isNotNull())
        .select(F.col(target).alias("y"), F.explode(F.array(*cells)).alias("c"))
        .filter(F.col("c").isNotNull())
        .groupBy("c.feature")
        .agg(
            F.count_if(F.col("c.hit") & y).alias("hit_bads"),
            F.count_if(F.col("c.hit") & ~y).alias("hit_goods"),
            F.count_if(~F.col("c.hit") & y).alias("rest_bads"),
            F.count_if(~F.col("c.hit") & ~y).alias("rest_goods"),
        )
    )
    a, b, c, d = (F.col(x).cast("double") for x in ("hit_bads", "hit_goods", "rest_bads", "rest_goods"))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    short = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    chi2 = F.try_divide(n * short * short, margins)
    rate, rest = F.try_divide(a, a + b), F.try_divide(c, c + d)
    least = F.least("hit_bads", "hit_goods", "rest_bads", "rest_goods")
    g = g.withColumns(
        {
            "n_hit": F.col("hit_bads") + F.col("hit_goods"),
            "n_rest": F.col("rest_bads") + F.col("rest_goods"),
            "rate_hit": rate,
            "rate_rest": rest,
            "delta_pp": (rate - rest) * 100,
            "chi2": chi2,
            "test": F.when(least < 5, "Fisher").otherwise("Chi2"),
        }
    )
    exact = tails.p_fisher(*[F.col(x) for x in ("hit_bads", "hit_goods", "rest_bads", "rest_goods")])
    family = len(predicates)
    return (
        g.withColumns({"_pf": exact, "_pc": tails.p_chi2(F.col("chi2"), F.lit(1.0))})
        .withColumn("p", F.when(F.col("test") == "Fisher", F.col("_pf")).otherwise(F.col("_pc")))
        .withColumn("significant", (F.col("p") < alpha / family).cast("int"))
        .drop("_pf", "_pc")
    )


def flag_overlap(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Every pair of flags: Cramér's V (Yates), Jaccard, marked by each and by both. One aggregate."""
    names = list(flags)
    f = {n: holds(e) for n, e in flags.items()}
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(f[n]).alias(f"m{i}") for i, n in enumerate(names)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    aggs += [F.count_if(f[names[i]] & f[names[j]]).alias(f"b{i}_{j}") for i, j in pairs]
    one = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(names[i]).alias("a"),
                    F.lit(names[j]).alias("b"),
                    F.col(f"m{i}").alias("n_a"),
                    F.col(f"m{j}").alias("n_b"),
                    F.col(f"b{i}_{j}").alias("n_both"),
                )
                for i, j in pairs
            ]
        )
    )
    t = one.select("n", rows.alias("r")).select("n", "r.*")
    n, a, b, both = (F.col(x).cast("double") for x in ("n", "n_a", "n_b", "n_both"))
    det = F.abs(both * (n - a - b + both) - (a - both) * (b - both))
    short = F.greatest(det - n / 2, F.lit(0.0))
    chi2 = F.try_divide(n * short * short, a * b * (n - a) * (n - b))
    return t.select("a", "b", "n_a", "n_b", "n_both", F.sqrt(chi2 / n).alias("v"), F.try_divide(both, a + b - both).alias("jaccard"))


def nested_flags(wide: Column, narrow: Column, wide_name: str, narrow_name: str) -> Column:
    """Group of a row for two nested flags: none, wide only, narrow."""
    return F.when(holds(narrow), narrow_name).when(holds(wide), f"{wide_name} sin {narrow_name}").otherwise("ninguna")


# -- families of tests -------------------------------------------------------------------------


def bonferroni(table: DataFrame, family: Iterable[str] = (), p: str = "p", declared: int | None = None) -> DataFrame:
    """p times the size of its family, at most 1; a declared size that differs from the emitted fails."""
    keys = list(family) or [F.lit(0)]
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = table.withColumn("family_size", size)
    if declared is not None:
        wrong = F.raise_error(F.concat(F.lit(f"{declared} tests declared, emitted "), F.col("family_size").cast("string")))
        out = out.withColumn("family_size", F.when(F.col("family_size") == declared, F.col("family_size")).otherwise(wrong.cast("bigint")))
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * F.col("family_size")))


def decision_ranking(measured: DataFrame, states: Mapping[str, str], alpha: float = P.FAMILY_ALPHA) -> DataFrame:
    """Effects with their significance and state, strongest first; a feature without a state fails."""
    spark = measured.sparkSession
    table = spark.createDataFrame(sorted(states.items()), "feature string, state string")
    rows = bonferroni(measured).join(table, "feature", "left")
    lost = F.raise_error(F.concat(F.lit("feature without a state: "), F.col("feature"))).cast("string")
    return (
        rows.withColumn("state", F.coalesce("state", lost))
        .withColumn("significant", (F.col("p_adjusted") < alpha).cast("int"))
        .orderBy(F.abs("effect").desc(), "feature")
    )


def sweep(
    df: DataFrame, thresholds: Iterable[float], rule, kind: str = "flag", target: str = TARGET, where: Column | None = None
) -> DataFrame:
    """One measure per threshold, all in one job; ``rule(threshold)`` gives the value expression."""
    items = [Measure(str(t), rule(t), where, "sweep") for t in thresholds]
    out = flag_signal(df, items, target) if kind == "flag" else rank_signal(df, items, target)
    return out.withColumnRenamed("feature", "threshold")


def remeasure_deferred(df: DataFrame, target: str = TARGET) -> DataFrame:
    """The two deferred columns of the main table: each flag inside the strata of the one it nests in."""
    d30, d60 = F.col("DEF_30_CNT_SOCIAL_CIRCLE"), F.col("DEF_60_CNT_SOCIAL_CIRCLE")
    flag30, flag60 = holds(d30 > 0).cast("double"), holds(d60 > 0).cast("double")
    items = [
        Measure("FLAG_CONT_MOBILE", F.col("FLAG_CONT_MOBILE"), None, "global (nulo=0)"),
        Measure("DEF_60_CNT_SOCIAL_CIRCLE | DEF_30==1", flag60, d30 == 1, "DEF_30==1"),
        Measure("DEF_60_CNT_SOCIAL_CIRCLE | DEF_30==2", flag60, d30 == 2, "DEF_30==2"),
        Measure("DEF_60_CNT_SOCIAL_CIRCLE | DEF_30>=3", flag60, d30 >= 3, "DEF_30>=3"),
        Measure("DEF_30_CNT_SOCIAL_CIRCLE | DEF_60==0", flag30, d60 == 0, "DEF_60==0"),
    ]
    r = df.agg(pearson(F.col("FLAG_CONT_MOBILE"), F.col(target)).alias("r")).scalar()
    return flag_signal(df, items, target).withColumn("pearson_r", F.when(F.col("feature") == "FLAG_CONT_MOBILE", r))
