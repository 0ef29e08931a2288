"""Queries of binning, signal measures, evidence and cut-point fitting."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.operators import binning as Bn
from riskloom.operators import cuts as Q
from riskloom.operators import history as H
from riskloom.operators import panel as B
from riskloom.operators import previous as V
from riskloom.operators import reports as Rp
from riskloom.operators import signals as M
from riskloom.operators import woe as W
from riskloom.operators.gram import pairwise_pearson, spearman
from riskloom.operators.history import HISTORY_FLAGS
from riskloom.operators.panel import PANEL_FLAGS
from riskloom.operators.previous import PREVIOUS_FLAGS
from riskloom.plans import presets as Pr
from riskloom.queries import standin as S
from riskloom.queries.base import P_CUTS, RELATIVE, clients, hist_t, labels, n_if
from riskloom.queries.registry import add, cte
from riskloom.session import checkpointed

K, Y = "SK_ID_CURR", "TARGET"
TENTHS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"
NULO = P.NULL_LEVEL


# -- DuckDB generators -------------------------------------------------------------------------


def edges_sql(rel: str, c: str) -> str:
    """Distinct tenths of a column."""
    return f"SELECT list_sort(list_distinct(quantile_cont({c}, {TENTHS}))) AS e FROM {rel}"


def index_sql(c: str) -> str:
    """Right-closed bin of a value among the edges ``e``."""
    return f"len([v for v in e[2:len(e) - 1] if v < {c}])"


def qbin(rel: str, c: str, feature: str | None = None, y: str = Y, extra: str = "") -> str:
    """(feature, bin, y) of a column binned by its own tenths."""
    return f"SELECT '{feature or c}' AS feature, CASE WHEN {c} IS NULL THEN '{NULO}' ELSE CAST({index_sql(c)} AS VARCHAR) END AS bin, {y} AS y{extra} FROM {rel}, ({edges_sql(rel, c)})"


def vbin(rel: str, c: str, feature: str | None = None, y: str = Y, extra: str = "") -> str:
    """(feature, bin, y) of a column with one bin per value."""
    return f"SELECT '{feature or c}' AS feature, coalesce(CAST({c} AS VARCHAR), '{NULO}') AS bin, {y} AS y{extra} FROM {rel}"


def woe_sql(long: str, keys: str = "feature, stratum") -> str:
    """Evidence per bin of (feature, stratum, bin, y) rows."""
    return f"""SELECT {keys}, bin, n, bads, n - bads AS goods, nb AS n_stratum, pb AS part_bads, pg AS part_goods, ln(pb / pg) AS woe, (pb - pg) * ln(pb / pg) AS iv FROM (
SELECT *, (bads + 20 * tb / nb) / nullif(tb, 0) AS pb, (n - bads + 20 - 20 * tb / nb) / nullif(nb - tb, 0) AS pg FROM (
SELECT *, sum(bads) OVER w AS tb, sum(n) OVER w AS nb FROM (SELECT {keys}, bin, count(*) AS n, sum(y) AS bads FROM ({long}) GROUP BY ALL) WINDOW w AS (PARTITION BY {keys})))"""


def iv_sql(long: str, keys: str = "feature", stratum: str = "stratum") -> str:
    """IV per feature of (feature, stratum, bin, y) rows."""
    both = f"{keys}, {stratum}"
    return f"SELECT {keys}, sum(iv * n) / sum(n) AS iv, sum(n) AS n, max(b) AS n_bins FROM (SELECT {both}, any_value(n_stratum) AS n, coalesce(sum(iv), 0) AS iv, count(*) AS b FROM ({woe_sql(long, both)}) GROUP BY {both}) GROUP BY {keys}"


def union(parts) -> str:
    """UNION ALL of several texts."""
    return " UNION ALL ".join(parts)


def flag_sql(rows: str, keys: str = "feature, population") -> str:
    """Rates, delta and z of (feature, population, v, y) rows."""
    return f"""SELECT *, rate1 * 100 - rate0 * 100 AS effect, (rate1 - rate0) / sqrt(pp * (1 - pp) * (1 / n1 + 1 / n0)) AS z FROM (
SELECT {keys}, n1, n0, s1 / n1 AS rate1, s0 / n0 AS rate0, (s1 + s0) / (n1 + n0) AS pp FROM (SELECT {keys}, {n_if('v = 1')} AS n1, {n_if('v = 0')} AS n0,
coalesce(sum(y) FILTER (WHERE v = 1), 0) AS s1, coalesce(sum(y) FILTER (WHERE v = 0), 0) AS s0 FROM ({rows}) GROUP BY ALL) WHERE n1 > 0 AND n0 > 0)"""


def rank_sql(rows: str, keys: str = "feature, population") -> str:
    """U, effect and z of (feature, population, v, y) rows."""
    return f"""SELECT {keys}, n, n0, n1, u, abs(2 * u / (n0 * n1) - 1) AS effect, CASE WHEN s > 0 THEN greatest(abs(u - n0 * n1 / 2) - 0.5, 0) / s ELSE 0 END AS z FROM (
SELECT *, r0 - n0 * (n0 + 1) / 2 AS u, sqrt(n0 * n1 / 12 * (n + 1 - ties / (n * (n - 1)))) AS s FROM (
SELECT {keys}, count(*)::DOUBLE AS n, sum(1 - y)::DOUBLE AS n0, sum(y)::DOUBLE AS n1, sum((1 - y) * (r + (t - 1) / 2)) AS r0, sum(t * t - 1)::DOUBLE AS ties FROM (
SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY v) AS r, count(*) OVER (PARTITION BY {keys}, v)::DOUBLE AS t FROM ({rows}) WHERE v IS NOT NULL) GROUP BY {keys}) WHERE n0 > 0 AND n1 > 0)"""


def value_rows(rel: str, items) -> str:
    """(feature, population, v, y) rows of (name, expression, condition, label) items."""
    return union(f"SELECT '{n}' AS feature, '{lab}' AS population, {e} AS v, {Y} AS y FROM {rel} WHERE {w or 'TRUE'}" for n, e, w, lab in items)


def drop(df, *cols):
    """The frame without its tail probabilities, which SQL cannot give."""
    return df.drop(*cols)


# -- binning -----------------------------------------------------------------------------------

_NUM = ["BUREAU_LOAN_COUNT", "BUREAU_CREDITS_PER_YEAR", "BUREAU_CURRENT_OVERDUE_SUM", "EXT_SOURCE_3"]


def _quantile_bins(s, d):
    df = clients(s, d, "h")
    counts = W.bin_counts(df, Bn.labels_of(Bn.fit_bins(df, _NUM)))
    return counts.drop("stratum")


add("B1_quantile_bins", _quantile_bins, f"SELECT feature, bin, count(*) AS n, sum(y) AS bads FROM ({union(qbin('cl_h', c) for c in _NUM)}) GROUP BY 1, 2", ("feature", "bin"))
_AGES = ("0-1a", "1-3a", "3-5a", "5-7a", "7a+")
_AGE_EDGES = (0.0, 1.0, 3.0, 5.0, 7.0, 50.0)


def _fixed(s, d):
    rows = hist_t(s, d).select(Bn.fixed_bin(-F.col("DAYS_CREDIT") / 365.25, _AGE_EDGES, _AGES).alias("bin"), Y)
    return Bn.complete_bins(W.rate_by(rows.filter(F.col("bin").isNotNull()), "bin"), _AGES)


_AGE_CASE = "CASE WHEN a > 0 AND a <= 1 THEN '0-1a' WHEN a > 1 AND a <= 3 THEN '1-3a' WHEN a > 3 AND a <= 5 THEN '3-5a' WHEN a > 5 AND a <= 7 THEN '5-7a' WHEN a > 7 AND a <= 50 THEN '7a+' END"
add(
    "B2_fixed_bins",
    _fixed,
    "SELECT i AS bin_order, b AS bin, coalesce(n, 0) AS n, rate FROM (VALUES (0, '0-1a'), (1, '1-3a'), (2, '3-5a'), (3, '5-7a'), (4, '7a+')) AS t(i, b) LEFT JOIN ("
    f"SELECT {_AGE_CASE} AS bin, count(*) AS n, avg({Y}) AS rate FROM (SELECT -DAYS_CREDIT / 365.25 AS a, {Y} FROM hist_t) GROUP BY 1) g ON g.bin = t.b",
    ("bin",),
)
_VAL = ["BUREAU_OVERDUE_UNION", "HAS_BEEN_PROLONGED", "CODE_GENDER", "NAME_TYPE_SUITE"]


def _value_bins(s, d):
    df = clients(s, d, "h")
    bins = Bn.fit_bins(df, _VAL)
    t = W.bin_counts(df, {c: (bins[c].label() if c not in ("BUREAU_OVERDUE_UNION", "HAS_BEEN_PROLONGED") else bins[c].label(F.col(c).cast("int"))) for c in _VAL})
    return t.drop("stratum")


add("B3_value_bins", _value_bins, f"SELECT feature, bin, count(*) AS n, sum(y) AS bads FROM ({union(vbin('cl_h', c) for c in _VAL)}) GROUP BY 1, 2", ("feature", "bin"))
_TESTED = ["BUREAU_LOAN_COUNT", "BUREAU_OVERDUE_UNION", "FLAG_EMAIL", "EXT_SOURCE_1"]


def _flag_tests(s, d):
    df = clients(s, d, "h")
    few, zo = Bn.few_valued(df, _TESTED), Bn.zero_one(df, _TESTED)
    return s.createDataFrame([(c, int(few[c]), int(zo[c])) for c in _TESTED], "feature string, two_valued int, zero_one int")


add(
    "B4_flag_tests",
    _flag_tests,
    union(f"SELECT '{c}' AS feature, CASE WHEN count(DISTINCT {c}) <= 2 THEN 1 ELSE 0 END AS two_valued, CASE WHEN {n_if(f'{c} NOT IN (0, 1)')} = 0 THEN 1 ELSE 0 END AS zero_one FROM cl_h" for c in _TESTED),
    ("feature",),
)

# -- signal ------------------------------------------------------------------------------------

_HISTORY = "HAS_BUREAU_HISTORY = 1"
_FLAGS = [("HAS_BUREAU_HISTORY", "HAS_BUREAU_HISTORY", None, "global (nulo=0)")] + [
    (c, c, _HISTORY, "con historial") for c in ("BUREAU_OVERDUE_UNION", "BUREAU_COUNT_COLA", "HAS_BEEN_PROLONGED", "BUREAU_DAYS_CREDIT_UPDATE_FLAG")
]
_RANKED = [
    ("BUREAU_LOAN_COUNT", "BUREAU_LOAN_COUNT", None, "no nulos (auto-cond.)"),
    ("BUREAU_CREDITS_PER_YEAR", "BUREAU_CREDITS_PER_YEAR", _HISTORY, "con historial"),
    ("EXT_SOURCE_3", "coalesce(EXT_SOURCE_3, 0e0)", None, "global (fill 0)"),
    ("BUREAU_DAYS_CREDIT_MIN", "BUREAU_DAYS_CREDIT_MIN", "BUREAU_CLOSED_COUNT > 0", "con créditos cerrados"),
]


def items(specs):
    """Measures of (name, expression, condition, label)."""
    return [M.Measure(n, F.expr(e), None if w is None else F.expr(w), lab) for n, e, w, lab in specs]


_FP = ("feature", "population")
add("M1_flag_signal", lambda s, d: drop(M.flag_signal(clients(s, d, "h"), items(_FLAGS)), "p"), f"SELECT * EXCLUDE (pp) FROM ({flag_sql(value_rows('cl_h', _FLAGS))})", _FP)
add("M2_rank_signal", lambda s, d: drop(M.rank_signal(clients(s, d, "h"), items(_RANKED)), "p"), rank_sql(value_rows("cl_h", _RANKED)), _FP)
add(
    "M2_class_medians",
    lambda s, d: M.class_medians(clients(s, d, "h"), ["BUREAU_LOAN_COUNT", "BUREAU_CREDITS_PER_YEAR"]),
    union(f"SELECT '{c}' AS feature, median({c}) FILTER (WHERE {Y} = 0) AS median0, median({c}) FILTER (WHERE {Y} = 1) AS median1 FROM cl_h" for c in ("BUREAU_LOAN_COUNT", "BUREAU_CREDITS_PER_YEAR")),
    ("feature",),
)
_OLD = [(n, e, None, "global") for n, e, _, _ in _FLAGS]


def _upserted(s, d):
    df = clients(s, d, "h")
    return drop(M.upsert(M.flag_signal(df, items(_OLD[:4])), M.flag_signal(df, items(_FLAGS[2:])), ["feature"]), "p")


add("M3_upsert_measures", _upserted, f"SELECT * EXCLUDE (pp) FROM ({flag_sql(value_rows('cl_h', _OLD[:2]))}) UNION ALL SELECT * EXCLUDE (pp) FROM ({flag_sql(value_rows('cl_h', _FLAGS[2:]))})", _FP)
_RECIPE = [
    {"name": "BUREAU_OVERDUE_UNION", "kind": "flag", "population": "con historial", "effect": 1.0},
    {"name": "BUREAU_CURRENT_OVERDUE_SUM", "kind": "flag", "coding": "> 0", "population": "con historial", "effect": 0.5},
    {"name": "BUREAU_LOAN_COUNT", "kind": "continuous", "population": "no nulos (auto-cond.)", "effect": 0.02},
    {"name": "BUREAU_CREDITS_PER_YEAR", "kind": "continuous", "population": "solo con cuota", "effect": None},
    {"name": "BUREAU_DAYS_CREDIT_MIN", "kind": "continuous", "population": "con historial", "firm": True},
    {"name": "HAS_BUREAU_HISTORY", "kind": "control", "population": "global (nulo=0)"},
]
_RE_F = [("BUREAU_OVERDUE_UNION", "BUREAU_OVERDUE_UNION", _HISTORY, "con historial"), ("BUREAU_CURRENT_OVERDUE_SUM", "CASE WHEN BUREAU_CURRENT_OVERDUE_SUM > 0 THEN 1 WHEN BUREAU_CURRENT_OVERDUE_SUM IS NOT NULL THEN 0 END", _HISTORY, "con historial")]
_RE_C = [("BUREAU_LOAN_COUNT", "BUREAU_LOAN_COUNT", None, "no nulos (auto-cond.)"), ("BUREAU_CREDITS_PER_YEAR", "BUREAU_CREDITS_PER_YEAR", "BUREAU_CREDITS_WITH_ANNUITY_COUNT > 0", "solo con cuota")]
add(
    "M4_remeasure_recipe",
    lambda s, d: M.remeasure(clients(s, d, "h"), _RECIPE, H.populations()),
    f"SELECT feature, kind, population, recipe_effect, effect, n, effect / recipe_effect AS quotient, CASE WHEN recipe_effect IS NOT NULL THEN CASE WHEN effect / recipe_effect BETWEEN 0.5 AND 2 THEN 1 ELSE 0 END END AS same_order FROM (SELECT *, CASE feature WHEN 'BUREAU_OVERDUE_UNION' THEN 1.0 WHEN 'BUREAU_CURRENT_OVERDUE_SUM' THEN 0.5 WHEN 'BUREAU_LOAN_COUNT' THEN 0.02 END AS recipe_effect FROM ("
    f"SELECT feature, 'flag' AS kind, population, effect, n1 AS n FROM ({flag_sql(value_rows('cl_h', _RE_F))}) UNION ALL SELECT feature, 'continuous', population, effect, n FROM ({rank_sql(value_rows('cl_h', _RE_C))})))",
    ("feature", "kind", "population"),
)


def _difference(s, d):
    h, y = F.col("HAS_BUREAU_HISTORY") == 1, F.col(Y).cast("double")
    one = clients(s, d, "h").agg(F.sum(F.when(~h, y)).alias("s1"), F.count_if(~h).alias("n1"), F.sum(F.when(h, y)).alias("s0"), F.count_if(h).alias("n0"))
    c = [F.col(x) for x in ("s1", "n1", "s0", "n0")]
    diff, lo, hi = M.difference_interval(*c)
    return one.select(diff.alias("diff"), lo.alias("lower"), hi.alias("upper"), M.pooled_z(*c).alias("z"))


add(
    "M5_difference_interval",
    _difference,
    "SELECT p1 - p0 AS diff, p1 - p0 - m AS lower, p1 - p0 + m AS upper, (p1 - p0) / sqrt(pp * (1 - pp) * (1 / n1 + 1 / n0)) AS z FROM (SELECT *, s1 / n1 AS p1, s0 / n0 AS p0, (s1 + s0) / (n1 + n0) AS pp, 1.96 * sqrt(s1 / n1 * (1 - s1 / n1) / n1 + s0 / n0 * (1 - s0 / n0) / n0) AS m FROM ("
    f"SELECT sum({Y}) FILTER (WHERE HAS_BUREAU_HISTORY = 0)::DOUBLE AS s1, {n_if('HAS_BUREAU_HISTORY = 0')} AS n1, sum({Y}) FILTER (WHERE HAS_BUREAU_HISTORY = 1)::DOUBLE AS s0, {n_if('HAS_BUREAU_HISTORY = 1')} AS n0 FROM cl_h))",
)
_PROP = [("PREV_REFUSED_RATIO", "PREV_REFUSED_RATIO", None, ""), ("PREV_STREET_RATIO", "PREV_STREET_RATIO", None, "")]
add(
    "M6_effect_of_proportion",
    lambda s, d: Rp.effect_or_delta(clients(s, d, "p"), items(_PROP)).drop("p"),
    f"SELECT feature, n, effect, z, CASE WHEN only01 THEN delta END AS flag_delta_pp FROM ({rank_sql(value_rows('cl_p', _PROP))}) JOIN (SELECT feature, bool_and(v IN (0, 1)) AS only01, (avg(y) FILTER (WHERE v = 1) - avg(y) FILTER (WHERE v = 0)) * 100 AS delta FROM ({value_rows('cl_p', _PROP)}) WHERE v IS NOT NULL GROUP BY 1) USING (feature)",
    ("feature",),
)
_CHI = "SELECT count(DISTINCT a) AS r, count(DISTINCT b) AS c, sum(n) AS n, sum(n * n / (nr * nc / na)) - sum(n) AS chi2 FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS nr, sum(n) OVER (PARTITION BY b) AS nc, sum(n) OVER () AS na FROM (SELECT CREDIT_ACTIVE AS a, CREDIT_TYPE AS b, count(*)::DOUBLE AS n FROM hist_raw GROUP BY 1, 2))"
_chi = lambda s, d: M.chi_square(M.crosstab(S.history(s, d), "CREDIT_ACTIVE", "CREDIT_TYPE"))
add("M7_chi_square", lambda s, d: _chi(s, d).select("n", "dof", "chi2"), f"SELECT n, (r - 1) * (c - 1) AS dof, chi2 FROM ({_CHI})")
add("M8_cramers_v", lambda s, d: _chi(s, d).select("v"), f"SELECT sqrt(chi2 / (n * (least(r, c) - 1))) AS v FROM ({_CHI})")
_TAIL = {"overdue": "AMT_CREDIT_SUM_OVERDUE > 0", "prolonged": "CNT_CREDIT_PROLONG > 0", "no annuity": "AMT_ANNUITY IS NULL", "rare": "AMT_ANNUITY > 1e7"}


def _two_sql(rel: str, preds, where=None) -> str:
    where = where or {}
    rows = union(f"SELECT '{k}' AS feature, coalesce({p}, FALSE) AS hit, {Y} AS y FROM {rel} WHERE {where.get(k, 'TRUE')}" for k, p in preds.items())
    return f"""SELECT *, n_hit::DOUBLE * 0 + (n_hit + n_rest) * power(greatest(abs(hit_bads::DOUBLE * rest_goods - hit_goods::DOUBLE * rest_bads) - (n_hit + n_rest) / 2, 0), 2) / nullif(n_hit::DOUBLE * n_rest * (hit_bads + rest_bads) * (hit_goods + rest_goods), 0) AS chi2,
CASE WHEN least(hit_bads, hit_goods, rest_bads, rest_goods) < 5 THEN 'Fisher' ELSE 'Chi2' END AS test FROM (
SELECT *, hit_bads + hit_goods AS n_hit, rest_bads + rest_goods AS n_rest, hit_bads / nullif(hit_bads + hit_goods, 0) AS rate_hit, rest_bads / nullif(rest_bads + rest_goods, 0) AS rate_rest,
(hit_bads / nullif(hit_bads + hit_goods, 0) - rest_bads / nullif(rest_bads + rest_goods, 0)) * 100 AS delta_pp FROM (
SELECT feature, {n_if('hit AND y = 1')} AS hit_bads, {n_if('hit AND y = 0')} AS hit_goods, {n_if('NOT hit AND y = 1')} AS rest_bads, {n_if('NOT hit AND y = 0')} AS rest_goods FROM ({rows}) GROUP BY 1))"""


two_by_two_sql = _two_sql
add("M9_two_by_two_tests", lambda s, d: M.two_by_two(hist_t(s, d), {k: F.expr(v) for k, v in _TAIL.items()}).drop("p", "significant"), _two_sql("hist_t", _TAIL), ("feature", "test"))
_CORR = ["BUREAU_LOAN_COUNT", "BUREAU_ACTIVE_COUNT", "BUREAU_CREDITS_PER_YEAR", "BUREAU_CURRENT_OVERDUE_SUM", "EXT_SOURCE_1", "EXT_SOURCE_3", "HAS_BUREAU_HISTORY"]
add(
    "M10_pearson_pairs",
    lambda s, d: pairwise_pearson(clients(s, d, "h"), _CORR),
    union(f"SELECT '{a}' AS a, '{b}' AS b, {n_if(f'{a} IS NOT NULL AND {b} IS NOT NULL')} AS n, CASE WHEN min({a}) FILTER (WHERE {b} IS NOT NULL) < max({a}) FILTER (WHERE {b} IS NOT NULL) AND min({b}) FILTER (WHERE {a} IS NOT NULL) < max({b}) FILTER (WHERE {a} IS NOT NULL) THEN corr({a}, {b}) END AS r FROM cl_h" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]),
    ("a", "b"),
)
add(
    "M11_spearman",
    lambda s, d: spearman(clients(s, d, "h"), "BUREAU_LOAN_COUNT", "EXT_SOURCE_3"),
    "SELECT count(*) AS n, corr(ra, rb) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM (SELECT BUREAU_LOAN_COUNT AS a, EXT_SOURCE_3 AS b FROM cl_h WHERE BUREAU_LOAN_COUNT IS NOT NULL AND EXT_SOURCE_3 IS NOT NULL))",
)
_CREDIT_FLAGS = {"has_dpd": "BB_DPD_MONTHS > 0", "recent_dpd": "BB_LAST_DPD_MONTH >= -6", "severe": "BB_WORST >= 3", "writeoff": "BB_WORST = 5"}


def _overlap_sql() -> str:
    names = list(_CREDIT_FLAGS)
    f = ", ".join(f"coalesce({e}, FALSE) AS {n}" for n, e in _CREDIT_FLAGS.items())
    pairs = union(f"SELECT '{a}' AS a, '{b}' AS b, {n_if(a)}::DOUBLE AS n_a, {n_if(b)}::DOUBLE AS n_b, {n_if(f'{a} AND {b}')}::DOUBLE AS n_both, count(*)::DOUBLE AS n FROM (SELECT {f} FROM agg_c)" for i, a in enumerate(names) for b in names[i + 1 :])
    det = "abs(n_both * (n - n_a - n_b + n_both) - (n_a - n_both) * (n_b - n_both))"
    return f"SELECT a, b, n_a, n_b, n_both, sqrt(power(greatest({det} - n / 2, 0), 2) / nullif(n_a * n_b * (n - n_a) * (n - n_b), 0)) AS v, n_both / nullif(n_a + n_b - n_both, 0) AS jaccard FROM ({pairs})"


add("M12_flag_overlap", lambda s, d: M.flag_overlap(B.aggregate_credits(S.panel(s, d)), {k: F.expr(v) for k, v in _CREDIT_FLAGS.items()}), _overlap_sql(), ("a", "b"))


def _stratified(s, d):
    rows = hist_t(s, d).withColumn("stratum", Bn.fixed_bin(-F.col("DAYS_CREDIT") / 365.25, _AGE_EDGES, _AGES)).filter("stratum IS NOT NULL")
    t = M.rank_signal(rows, M.measures(["AMT_CREDIT_SUM", "AMT_ANNUITY"]), by=["stratum"])
    return t.filter((F.col("n0") >= 5) & (F.col("n1") >= 5)).drop("p", "population")


add(
    "M13_stratified_effect",
    _stratified,
    "SELECT * FROM ("
    + rank_sql(union(f"SELECT '{c}' AS feature, {_AGE_CASE} AS stratum, {c} AS v, {Y} AS y FROM (SELECT *, -DAYS_CREDIT / 365.25 AS a FROM hist_t)" for c in ("AMT_CREDIT_SUM", "AMT_ANNUITY")), "feature, stratum")
    + ") WHERE n0 >= 5 AND n1 >= 5 AND stratum IS NOT NULL",
    ("feature", "stratum"),
)
_COMP = [("BUREAU_LOAN_COUNT", "coalesce(BUREAU_LOAN_COUNT, 0)", None, "global"), ("BUREAU_LOAN_COUNT", "BUREAU_LOAN_COUNT", _HISTORY, "con historial")]
add("M14_composition_control", lambda s, d: M.rank_signal(clients(s, d, "h"), items(_COMP)).drop("p"), rank_sql(value_rows("cl_h", _COMP)), _FP)


def _populations(s, d):
    df = clients(s, d)
    named = {**H.populations(), **B.populations(), **V.populations()}
    aggs = [(F.count(F.lit(1)) if p is None else F.count_if(F.coalesce(p, F.lit(False)))).alias(f"p{i}") for i, p in enumerate(named.values())]
    cells = F.array(*[F.struct(F.lit(n).alias("population"), F.col(f"p{i}").alias("n")) for i, n in enumerate(named)])
    return df.agg(*aggs).select(F.explode(cells).alias("x")).select("x.*")


_POPS = {
    "global (nulo=0)": "TRUE", "no nulos (auto-cond.)": "TRUE", "con historial": _HISTORY, "con créditos cerrados": "BUREAU_CLOSED_COUNT > 0", "solo con cuota": "BUREAU_CREDITS_WITH_ANNUITY_COUNT > 0",
    "global": "TRUE", "con histórico": "HAS_BUREAU_BALANCE = 1", "con historial de bureau": _HISTORY, "trayectoria evaluable": "BB_TRAJECTORY IS NOT NULL", "con estado reportado": "BB_STATUS_WORST IS NOT NULL",
    "clientes con mora": "BB_ANY_DPD_FLAG = 1", "con previas": "HAS_PREV_APPLICATION = 1", "con algún rechazo": "PREV_REFUSED_COUNT > 0", "con operación terminada": "PREV_EARLY_SETTLED_FLAG IS NOT NULL", "con finalidad informada": "PREV_URGENT_PURPOSE_RATIO IS NOT NULL",
}
add("M15_named_populations", _populations, union(f"SELECT '{k}' AS population, {n_if(v)} AS n FROM cl" for k, v in _POPS.items()), ("population",))


def _bonferroni(s, d):
    # the size of the statistic stands in for its p, which SQL cannot give
    t = M.flag_signal(clients(s, d, "h"), items(_FLAGS)).withColumn("p", 1 / (1 + F.abs("z")))
    return M.bonferroni(t, ["population"]).select("feature", "population", "family_size", "p_adjusted")


add("M17_bonferroni", _bonferroni, f"SELECT feature, population, count(*) OVER (PARTITION BY population) AS family_size, least(1.0, count(*) OVER (PARTITION BY population) / (1 + abs(z))) AS p_adjusted FROM ({flag_sql(value_rows('cl_h', _FLAGS))})", _FP)
_D30, _D60 = "CASE WHEN DEF_30_CNT_SOCIAL_CIRCLE > 0 THEN 1 ELSE 0 END", "CASE WHEN DEF_60_CNT_SOCIAL_CIRCLE > 0 THEN 1 ELSE 0 END"
_DEFERRED = [
    ("FLAG_CONT_MOBILE", "FLAG_CONT_MOBILE", None, "global (nulo=0)"),
    ("DEF_60_CNT_SOCIAL_CIRCLE | DEF_30==1", _D60, "DEF_30_CNT_SOCIAL_CIRCLE = 1", "DEF_30==1"),
    ("DEF_60_CNT_SOCIAL_CIRCLE | DEF_30==2", _D60, "DEF_30_CNT_SOCIAL_CIRCLE = 2", "DEF_30==2"),
    ("DEF_60_CNT_SOCIAL_CIRCLE | DEF_30>=3", _D60, "DEF_30_CNT_SOCIAL_CIRCLE >= 3", "DEF_30>=3"),
    ("DEF_30_CNT_SOCIAL_CIRCLE | DEF_60==0", _D30, "DEF_60_CNT_SOCIAL_CIRCLE = 0", "DEF_60==0"),
]
add(
    "M18_deferred_columns",
    lambda s, d: M.remeasure_deferred(clients(s, d, "")).drop("p"),
    f"SELECT * EXCLUDE (pp), CASE WHEN feature = 'FLAG_CONT_MOBILE' THEN (SELECT corr(FLAG_CONT_MOBILE, {Y}) FROM app1) END AS pearson_r FROM ({flag_sql(value_rows('app1', _DEFERRED))})",
    _FP,
)
_DENS = {
    "PREV_REFUSED_RATIO": "count(*)", "PREV_OVERGRANTED_RATIO": "count(g)", "PREV_STREET_RATIO": "count(PRODUCT_COMBINATION)",
    "PREV_NO_SUITE_RATIO": "count(*)", "PREV_EARLY_HOUR_RATIO": "count(*)", "PREV_URGENT_PURPOSE_RATIO": n_if("declared"),
}


def _den_sql() -> str:
    dens = ", ".join(f"{e} AS den_{i}" for i, e in enumerate(_DENS.values()))
    base = f"(SELECT * FROM agg_p JOIN (SELECT {K}, {dens} FROM prev_x GROUP BY 1) USING ({K}) JOIN lab USING ({K}))"
    rows = union(
        f"SELECT '{f}' AS feature, {m} AS minimum, CASE WHEN den_{i} >= {m} THEN 'kept' ELSE 'left out' END AS side, {f} AS v, {Y} AS y FROM {base}"
        for i, f in enumerate(_DENS)
        for m in P.DENOMINATOR_MINIMA
    )
    cte("den_rows", rows)
    rows, keys = "SELECT * FROM den_rows", "feature, minimum, side"
    spread = f"SELECT {keys} FROM ({rows}) GROUP BY ALL HAVING min(v) < max(v)"
    return f"SELECT {keys}, n, effect FROM (SELECT {keys}, count(v) AS n FROM ({rows}) WHERE v IS NOT NULL GROUP BY {keys}) LEFT JOIN (SELECT {keys}, effect FROM ({rank_sql(rows, keys)}) JOIN ({spread}) USING ({keys})) USING ({keys})"


def _den(s, d):
    t = Rp.denominator_report(S.previous(s, d), labels(s, d), P_CUTS)
    return t.select("feature", "minimum", "side", "n", "effect")


add("M19_denominator_sweep", _den, _den_sql(), ("feature", "side"))


def _recency(s, d):
    t = Rp.relative_recency_report(S.previous(s, d), labels(s, d), P_CUTS)
    return t.select("reading", "counterpart", "stratum", "n", "n_abs_only", "effect", "effect_abs", "redundancy")


_STRATA = {"todos": "r IS NOT NULL", "hasta 6m": "r > -180 AND r <= 0", "6 a 12m": "r > -365 AND r <= -180", "12 a 24m": "r > -730 AND r <= -365", "mas de 24m": "r <= -730"}


def _rec_sql() -> str:
    absolutes = {"PREV_REFUSED_RATIO > 0": "CASE WHEN PREV_REFUSED_RATIO > 0 THEN 1.0 ELSE 0.0 END", "PREV_DAYS_SINCE_REFUSED": "last_refused"}
    base = f"(SELECT *, PREV_DAYS_DECISION_MAX AS r FROM ({RELATIVE}) JOIN agg_p USING ({K}) JOIN (SELECT {K}, max(DAYS_DECISION) FILTER (WHERE NAME_CONTRACT_STATUS = 'Refused') AS last_refused FROM prev_x GROUP BY 1) USING ({K}) JOIN lab USING ({K}))"
    out = []
    for reading, others in Rp.RELATIVE_READINGS.items():
        for other in others:
            a = absolutes.get(other, other)
            for name, cond in _STRATA.items():
                out.append(f"SELECT '{reading}' AS reading, '{other}' AS counterpart, '{name}' AS stratum, {reading} AS v, {a} AS w, {Y} AS y FROM {base} WHERE {cond}")
    cte("rec_rows", union(out))
    rows, keys = "SELECT * FROM rec_rows", "reading, counterpart, stratum"

    def effect(v: str, name: str) -> str:
        data = f"SELECT {keys}, {v} AS v, y FROM ({rows}) WHERE v IS NOT NULL"
        spread = f"SELECT {keys} FROM ({data}) GROUP BY ALL HAVING min(v) < max(v)"
        delta = f"SELECT {keys}, CASE WHEN bool_and(v IN (0, 1)) THEN (avg(y) FILTER (WHERE v = 1) - avg(y) FILTER (WHERE v = 0)) * 100 END AS delta FROM ({data}) WHERE v IS NOT NULL GROUP BY {keys}"
        return f"SELECT {keys}, CASE WHEN reading LIKE '%_FLAG' THEN delta ELSE eff END AS {name} FROM ({delta}) LEFT JOIN (SELECT {keys}, effect AS eff FROM ({rank_sql(data, keys)}) JOIN ({spread}) USING ({keys})) USING ({keys})"

    counts = f"SELECT {keys}, count(v) AS n, {n_if('v IS NULL AND w IS NOT NULL')} AS n_abs_only, CASE WHEN stratum = 'todos' AND min(v) FILTER (WHERE w IS NOT NULL) < max(v) FILTER (WHERE w IS NOT NULL) AND min(w) FILTER (WHERE v IS NOT NULL) < max(w) FILTER (WHERE v IS NOT NULL) THEN abs(corr(v, w)) END AS redundancy FROM ({rows}) GROUP BY {keys}"
    return f"SELECT {keys}, n, n_abs_only, effect, effect_abs, redundancy FROM ({counts}) LEFT JOIN ({effect('v', 'effect')}) USING ({keys}) LEFT JOIN ({effect('w', 'effect_abs')}) USING ({keys})"


add("M20_relative_recency", _recency, _rec_sql(), ("reading", "counterpart", "stratum"))


def _ranking(s, d):
    t = M.flag_signal(clients(s, d, "h"), items(_FLAGS))
    states = {n: ("conservar" if i % 2 else "descartar") for i, (n, *_) in enumerate(_FLAGS)}
    return M.decision_ranking(t, states).select("feature", "effect", "state")


add("M21_decision_ranking", _ranking, f"SELECT feature, effect, CASE WHEN feature IN ('BUREAU_OVERDUE_UNION', 'HAS_BEEN_PROLONGED') THEN 'conservar' ELSE 'descartar' END AS state FROM ({flag_sql(value_rows('cl_h', _FLAGS))})", ("feature", "state"))
add(
    "M25_nested_flags",
    lambda s, d: W.rate_by(B.attach_clients(B.aggregate_credits(S.panel(s, d)), B.credit_bridge(S.history(s, d))).join(labels(s, d), K), M.nested_flags(F.col("BB_WORST") >= 3, F.col("BB_WORST") == 5, "grave", "writeoff").alias("grp")),
    "SELECT CASE WHEN BB_WORST = 5 THEN 'writeoff' WHEN BB_WORST >= 3 THEN 'grave sin writeoff' ELSE 'ninguna' END AS grp, count(*) AS n, avg(TARGET) AS rate FROM agg_c JOIN bridge USING (SK_ID_BUREAU) JOIN lab USING (SK_ID_CURR) GROUP BY 1",
    ("grp",),
)
add(
    "M26_threshold_sweep",
    lambda s, d: M.sweep(clients(s, d, "hb"), [1, 3, 6, 12, 24], lambda k: F.when(F.col("BB_MONTHS_REPORTED") >= k, F.try_divide("BB_DPD_MONTHS_COUNT", "BB_MONTHS_REPORTED")), "continuous").drop("p", "population"),
    f"SELECT feature AS threshold, n, n0, n1, u, effect, z FROM ({rank_sql(union(f'SELECT {k} AS feature, BB_DPD_MONTHS_COUNT / nullif(BB_MONTHS_REPORTED, 0) AS v, {Y} AS y FROM cl_hb WHERE BB_MONTHS_REPORTED >= {k}' for k in (1, 3, 6, 12, 24)), 'feature')})".replace("SELECT feature AS threshold", "SELECT CAST(feature AS VARCHAR) AS threshold"),
    ("threshold",),
)

# -- evidence ----------------------------------------------------------------------------------


def _woe(s, d):
    df = clients(s, d, "h")
    return W.woe_table(W.bin_counts(df, Bn.labels_of(Bn.fit_bins(df, ["EXT_SOURCE_3", "NAME_TYPE_SUITE"]))))


def strat(long: str, stratum: str = "'all'") -> str:
    """Long rows with a constant stratum."""
    return f"SELECT feature, {stratum} AS stratum, bin, y FROM ({long})"


add("V1_woe_table", _woe, woe_sql(strat(union([qbin("cl_h", "EXT_SOURCE_3"), vbin("cl_h", "NAME_TYPE_SUITE")]))), ("feature", "stratum", "bin"))
_IVC = ["BUREAU_LOAN_COUNT", "BUREAU_CREDITS_PER_YEAR", "EXT_SOURCE_1", "EXT_SOURCE_3"]
_IVV = ["BUREAU_OVERDUE_UNION", "HAS_BUREAU_HISTORY", "CODE_GENDER", "OCCUPATION_TYPE"]
add("V2_information_value", lambda s, d: W.information_value(clients(s, d, "h"), _IVC + _IVV), iv_sql(strat(union([*(qbin("cl_h", c) for c in _IVC), *(vbin("cl_h", c) for c in _IVV)]))), ("feature",))


def cond(rel: str, a: str, b: str, qa: bool, qb: bool, fa: str | None = None) -> str:
    """(feature, stratum, bin, y): a column inside the bins of another."""
    ea = f"CASE WHEN {a} IS NULL THEN '{NULO}' ELSE CAST(len([v for v in ea[2:len(ea) - 1] if v < {a}]) AS VARCHAR) END" if qa else f"coalesce(CAST({a} AS VARCHAR), '{NULO}')"
    eb = f"CASE WHEN {b} IS NULL THEN '{NULO}' ELSE CAST(len([v for v in eb[2:len(eb) - 1] if v < {b}]) AS VARCHAR) END" if qb else f"coalesce(CAST({b} AS VARCHAR), '{NULO}')"
    src = rel + (f", (SELECT e AS ea FROM ({edges_sql(rel, a)}))" if qa else "") + (f", (SELECT e AS eb FROM ({edges_sql(rel, b)}))" if qb else "")
    return f"SELECT '{fa or a}' AS feature, {eb} AS stratum, {ea} AS bin, {Y} AS y FROM {src}"


_CP = [("BUREAU_LOAN_COUNT", "EXT_SOURCE_3"), ("BUREAU_CREDITS_PER_YEAR", "EXT_SOURCE_3"), ("BUREAU_ACTIVE_COUNT", "EXT_SOURCE_1")]
add(
    "V3_conditional_iv",
    lambda s, d: W.conditional_iv(clients(s, d, "h"), _CP).select("feature", F.col("stratum").alias("inside"), "iv"),
    union(f"SELECT feature, '{b}' AS inside, iv FROM ({iv_sql(cond('cl_h', a, b, True, True))})" for a, b in _CP),
    ("feature", "inside"),
)
CANDIDATES = Pr.IV_CANDIDATES | {"BUREAU_LOAN_COUNT": "HAS_BUREAU_HISTORY", "BUREAU_CREDITS_PER_YEAR": "HAS_BUREAU_HISTORY", "BUREAU_OVERDUE_UNION": "HAS_BUREAU_HISTORY", "EXT_SOURCE_3": None}
CAND_TEXT = {"NAME_HOUSING_TYPE", "FONDKAPREMONT_MODE", "HOUSETYPE_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE", "BB_TRAJECTORY"}
CAND_FLAG = {c for c in CANDIDATES if c in {*HISTORY_FLAGS, *PANEL_FLAGS, *PREVIOUS_FLAGS, *Pr.MAIN_FLAGS, *Pr.PRESENCE}}


def _iv_report_sql() -> str:
    q = set(CANDIDATES) - CAND_TEXT - CAND_FLAG
    alone = union(f"SELECT feature, iv, n_bins FROM ({iv_sql(strat((qbin if c in q else vbin)('cl', c)))})" for c in CANDIDATES)
    inside = union(f"SELECT feature, iv AS inside FROM ({iv_sql(cond('cl', c, p, c in q, False))})" for c, p in CANDIDATES.items() if p)
    filled = union(f"SELECT '{c}' AS feature, count({c}) AS n, {f'sum({c})' if c in CAND_FLAG else 'NULL'} AS n_marked FROM cl" for c in CANDIDATES)
    return f"SELECT feature, iv, n_bins, inside AS iv_without_presence, n, n_marked, coalesce(inside, iv) AS iv_reading, CASE WHEN coalesce(inside, iv) >= 0.02 THEN 1 ELSE 0 END AS reaches FROM ({alone}) LEFT JOIN ({inside}) USING (feature) JOIN ({filled}) USING (feature)"


add("V4_iv_report", lambda s, d: W.iv_report(checkpointed(clients(s, d)), CANDIDATES), _iv_report_sql(), ("feature",))
_SUMPOS = "CASE WHEN BUREAU_CURRENT_OVERDUE_SUM > 0 THEN 1.0 WHEN BUREAU_CURRENT_OVERDUE_SUM IS NOT NULL THEN 0.0 END"
_MORA = {"BUREAU_HAS_CURRENT_OVERDUE": "BUREAU_HAS_CURRENT_OVERDUE", "BUREAU_CURRENT_OVERDUE_SUM > 0": "sum_pos"}
add(
    "V5_active_arrears",
    lambda s, d: Rp.active_arrears_report(clients(s, d, "h")),
    union(f"SELECT feature, (SELECT count({e}) FROM xx) AS n, (SELECT sum({e}) FROM xx) AS n_marked, iv AS iv_without_presence FROM ({iv_sql(cond('xx', e, 'HAS_BUREAU_HISTORY', False, False, k))})" for k, e in _MORA.items()).replace("xx", f"(SELECT *, {_SUMPOS} AS sum_pos FROM cl_h)"),
    ("feature",),
)
_TRI = "(SELECT *, CASE WHEN BUREAU_OVERDUE_UNION = 1 THEN 'con_mora' WHEN HAS_BUREAU_OVERDUE_HISTORY = 1 THEN 'reportada_cero' ELSE 'sin_reportar' END AS tri FROM cl_h WHERE HAS_BUREAU_HISTORY = 1)"
add(
    "V6_arrears_states",
    lambda s, d: Rp.arrears_state_report(clients(s, d, "h")),
    f"SELECT tri AS level, count(*) AS n, avg({Y}) AS rate, NULL AS iv FROM {_TRI} GROUP BY 1 UNION ALL "
    + union(f"SELECT '{name}', NULL, NULL, iv FROM ({iv_sql(cond(_TRI, a, b, False, False))})" for name, a, b in (("union", "BUREAU_OVERDUE_UNION", "HAS_BUREAU_HISTORY"), ("tripartita", "tri", "HAS_BUREAU_HISTORY"), ("incremental_sobre_union", "tri", "BUREAU_OVERDUE_UNION"))),
    ("level",),
)
add(
    "V7_building_count",
    lambda s, d: Rp.building_report(clients(s, d, "")),
    f"SELECT a.iv AS iv_marginal, b.iv AS iv_over_flag, (SELECT sum(HAS_BUILDING_INFO) FROM app1) AS n_with_data FROM ({iv_sql(strat(qbin('app1', 'BUILDING_INFO_COUNT')))}) a, ({iv_sql(cond('app1', 'BUILDING_INFO_COUNT', 'HAS_BUILDING_INFO', True, False))}) b",
)
_LIVE = f"(SELECT * FROM cl_p LEFT JOIN (SELECT {K}, max(CASE WHEN DAYS_LAST_DUE_1ST_VERSION > 0 AND DAYS_LAST_DUE IS NULL THEN DAYS_LAST_DUE_1ST_VERSION END) AS PREV_FUTURE_DUE_VIVAS FROM prev_clean GROUP BY 1) USING ({K}))"
add(
    "V8_live_only",
    lambda s, d: Rp.live_only_report(clients(s, d, "p"), S.previous(s, d)),
    union(f"SELECT feature, inside, iv FROM (SELECT '{b}' AS inside, feature, iv FROM ({iv_sql(cond(_LIVE, a, b, True, b.startswith('PREV')))}))" for a, b in (("PREV_FUTURE_DUE_MAX", "HAS_PREV_APPLICATION"), ("PREV_FUTURE_DUE_VIVAS", "HAS_PREV_APPLICATION"), ("PREV_FUTURE_DUE_VIVAS", "PREV_FUTURE_DUE_MAX"))),
    ("feature", "inside"),
)
_OVER = ["BUREAU_LOAN_COUNT", "BUREAU_ACTIVE_COUNT", "BUREAU_CREDITS_PER_YEAR", "BUREAU_DAYS_CREDIT_MIN", "HAS_BUREAU_HISTORY"]


def _overlap(s, d):
    return Rp.score_overlap(clients(s, d, "h"), {c: F.col("HAS_BUREAU_HISTORY") == 1 for c in _OVER}, "EXT_SOURCE_3", 0.0)


_OV_SQL = union(f"SELECT '{c}' AS feature, CASE WHEN min({c}) < max({c}) THEN corr({c}, EXT_SOURCE_3) END AS r FROM cl_h WHERE HAS_BUREAU_HISTORY = 1 AND EXT_SOURCE_3 IS NOT NULL" for c in _OVER)
add("V9_score_overlap", _overlap, f"SELECT * FROM ({_OV_SQL}) WHERE r IS NOT NULL", ("feature",))
_INC = ["BUREAU_LOAN_COUNT", "BUREAU_CREDITS_PER_YEAR", "BUREAU_DAYS_CREDIT_MIN"]
_WITH = "(SELECT * FROM cl_h WHERE HAS_BUREAU_HISTORY = 1)"
add(
    "V10_incremental_iv",
    lambda s, d: Rp.incremental_report(clients(s, d, "h"), {c: F.col("HAS_BUREAU_HISTORY") == 1 for c in _INC}, "EXT_SOURCE_3").select("feature", "n", "iv_inside", "iv_over_score"),
    union(f"SELECT a.feature, (SELECT count({c}) FROM {_WITH}) AS n, a.iv AS iv_inside, b.iv AS iv_over_score FROM ({iv_sql(strat(qbin(_WITH, c)))}) a, ({iv_sql(cond(_WITH, c, 'EXT_SOURCE_3', True, True))}) b" for c in _INC),
    ("feature",),
)

# -- cut-points --------------------------------------------------------------------------------

_HC = f"(SELECT {K}, count(*) AS n, max({Y}) AS y FROM hist_ct GROUP BY 1)"
_PC = f"(SELECT {K}, count(*) AS n, max({Y}) AS y FROM prev_t GROUP BY 1)"
_BC = f"(SELECT {K}, count(*) AS n, max({Y}) AS y FROM bridge JOIN (SELECT DISTINCT SK_ID_BUREAU FROM panel_raw) USING (SK_ID_BUREAU) JOIN lab USING ({K}) GROUP BY 1)"
_AC = f"(SELECT {K}, {n_if('DAYS_DECISION > -365')} AS n, max({Y}) AS y FROM prev_t GROUP BY 1)"


def _sweep_sql(rel: str, start: int) -> str:
    t = f"SELECT c AS cut, {n_if('n >= c')} AS marked, (avg(y) FILTER (WHERE n >= c) - avg(y) FILTER (WHERE n < c)) * 100 AS delta_pp FROM {rel}, (SELECT unnest(range({start}, (SELECT max(n) + 1 FROM {rel}))) AS c) GROUP BY 1"
    return f"SELECT *, CASE WHEN cut = (SELECT min(cut) FROM ({t}) WHERE delta_pp >= 2) THEN 1 ELSE 0 END AS chosen FROM ({t})"


add("K3_first_crossing", lambda s, d: Q.cut_sweep(Q.history_counts(Q.train_history(S.history(s, d), labels(s, d)))), _sweep_sql(_HC, 2))


def _tails(s, d):
    lab, prev = labels(s, d), S.previous(s, d)
    apps = Q.train_previous(prev, lab)
    parts = {
        "panel": (Q.panel_counts(S.panel(s, d), B.credit_bridge(S.history(s, d)), lab), 2),
        "previous": (Q.history_counts(apps), 2),
        "activity": (Q.recent_counts(apps), 1),
    }
    out = [Q.cut_sweep(c, start=k).withColumn("cut_of", F.lit(n)) for n, (c, k) in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


add("K4_count_tails", _tails, union(f"SELECT *, '{n}' AS cut_of FROM ({_sweep_sql(r, k)})" for n, r, k in (("panel", _BC, 2), ("previous", _PC, 2), ("activity", _AC, 1))), ("cut_of",))


def _p99(s, d):
    counts = Q.panel_counts(S.panel(s, d), B.credit_bridge(S.history(s, d)), labels(s, d))
    return s.createDataFrame([(Q.p99_plus_one(counts),)], "cut bigint")


add("K4_p99_plus_one", _p99, f"SELECT CAST(floor(quantile_cont(n, 0.99)) AS BIGINT) + 1 AS cut FROM {_BC}")
_GRID = [(None, -5), (-5, -2), (-2, 0), (0, 2), (2, 5), (5, 10), (10, None)]
_TERM = "(CASE WHEN CREDIT_TYPE IS DISTINCT FROM 'Credit card' THEN DAYS_CREDIT_ENDDATE END) / 365.25"
_G = union(f"SELECT {i} AS bin, {lo if lo is not None else 'NULL'} AS low, {hi if hi is not None else 'NULL'} AS high, count(*) AS n, avg({Y}) AS rate FROM hist_ct WHERE {_TERM} IS NOT NULL" + (f" AND {_TERM} > {lo}" if lo is not None else "") + (f" AND {_TERM} <= {hi}" if hi is not None else "") for i, (lo, hi) in enumerate(_GRID))
add("K5_end_date_peak", lambda s, d: Q.end_date_rates(Q.train_history(S.history(s, d), labels(s, d))), f"SELECT *, CASE WHEN row_number() OVER (ORDER BY rate DESC NULLS LAST, bin) = 1 THEN 1 ELSE 0 END AS peak FROM ({_G})")


def _over_sql() -> str:
    rows = union(f"SELECT {c} AS feature, avg(CASE WHEN g > {c} THEN 1.0 WHEN g IS NOT NULL THEN 0.0 END) AS v, max({Y}) AS y FROM prev_t GROUP BY {K} HAVING count(g) > 0" for c in P.OVERGRANT_GRID)
    delta = f"SELECT feature, (avg(y) FILTER (WHERE v > 0) - avg(y) FILTER (WHERE v = 0)) * 100 AS flag_delta_pp, min(v) < max(v) AS varies FROM ({rows}) GROUP BY 1"
    t = f"SELECT feature AS cut, n, CASE WHEN varies THEN effect END AS effect, flag_delta_pp FROM ({rank_sql(rows, 'feature')}) JOIN ({delta}) USING (feature)"
    return f"SELECT *, CASE WHEN row_number() OVER (ORDER BY effect DESC NULLS LAST, cut) = 1 THEN 1 ELSE 0 END AS chosen FROM ({t})"


add("K6_overgrant_cut", lambda s, d: Q.overgrant_sweep(Q.train_previous(S.previous(s, d), labels(s, d))), _over_sql())
def _purposes_sql(least: int, delta: float) -> str:
    return f"SELECT *, CASE WHEN n >= {least} AND delta_pp >= {delta} THEN 1 ELSE 0 END AS chosen FROM (SELECT NAME_CASH_LOAN_PURPOSE AS purpose, count(*) AS n, avg({Y}) * 100 AS rate, (avg({Y}) - (SELECT avg({Y}) FROM prev_t WHERE declared)) * 100 AS delta_pp FROM prev_t WHERE declared GROUP BY 1)"


add("K7_urgent_purposes", lambda s, d: Q.purpose_rates(Q.train_previous(S.previous(s, d), labels(s, d)), min_rows=20, threshold=0.1), _purposes_sql(20, 0.1), ("purpose",))
add("K7_default_floors", lambda s, d: Q.purpose_rates(Q.train_previous(S.previous(s, d), labels(s, d))), _purposes_sql(P.MIN_CATEGORY_ROWS, P.MIN_FLAG_DELTA_PP), ("purpose",))


def _all_cuts(s, d):
    cuts = Q.fit_auxiliary_cuts(S.history(s, d), S.panel(s, d), S.previous(s, d), B.credit_bridge(S.history(s, d)), labels(s, d), min_rows=20, threshold=0.1, strict=False)
    return s.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in cuts.items()], "name string, value string")


def _all_cuts_sql() -> str:
    def crossing(name: str, rel: str, start: int) -> str:
        return f"SELECT '{name}' AS name, CAST(CAST(min(cut) AS BIGINT) AS VARCHAR) AS value FROM ({_sweep_sql(rel, start)}) WHERE delta_pp >= 0.1"

    peak = f"(SELECT low, high FROM ({_G}) ORDER BY rate DESC NULLS LAST, bin LIMIT 1)"
    said = f"(SELECT NAME_CASH_LOAN_PURPOSE AS purpose, count(*) AS n, (avg({Y}) - (SELECT avg({Y}) FROM prev_t WHERE declared)) * 100 AS delta FROM prev_t WHERE declared GROUP BY 1)"
    return union(
        [
            f"SELECT 'bureau_enddate_tramo_min_anios' AS name, coalesce(CAST(CAST(low AS DOUBLE) AS VARCHAR), '-Infinity') AS value FROM {peak}",
            f"SELECT 'bureau_enddate_tramo_max_anios', coalesce(CAST(CAST(high AS DOUBLE) AS VARCHAR), 'Infinity') FROM {peak}",
            crossing("bureau_count_cola", _HC, 2),
            crossing("bb_many_credits_corte", _BC, 2),
            crossing("prev_count_cola", _PC, 2),
            crossing("prev_actividad_12m_cola", _AC, 1),
            f"SELECT 'prev_sobreconcesion_corte', CAST(CAST(cut AS DOUBLE) AS VARCHAR) FROM ({_over_sql()}) WHERE chosen = 1",
            f"SELECT 'prev_finalidades_urgentes', '[' || string_agg('\"' || purpose || '\"', ', ' ORDER BY purpose) || ']' FROM {said} WHERE n >= 20 AND delta >= 0.1",
        ]
    )


add("K8_fit_all_cuts", _all_cuts, _all_cuts_sql(), ("name", "value"), all_text=True)
