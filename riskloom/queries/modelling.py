"""Queries of fitted stages, selection, splits, models and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.operators import bootstrap as B
from riskloom.operators import evaluation as E
from riskloom.operators import models as L
from riskloom.operators import resample as R2
from riskloom.operators import selection as R
from riskloom.operators import splits as X
from riskloom.operators import stages as G
from riskloom.operators.features import LATE_RATIOS
from riskloom.operators.cleaning import sanitise_names
from riskloom.operators.history import HISTORY_FLAGS
from riskloom.operators.logistic import Cells, coefficients
from riskloom.operators.panel import PANEL_FLAGS, TRAJECTORIES
from riskloom.operators.previous import PREVIOUS_FLAGS
from riskloom.plans import assemble as Pl
from riskloom.plans import presets as Pr
from riskloom.queries.audits import SPLIT_SQL, folds_sql, scratch, split
from riskloom.queries.base import app, clients, n_if
from riskloom.queries.registry import add, cte
from riskloom.queries.rows import DAY_SQL, PART_SQL
from riskloom.queries.signals import CAND_FLAG, CAND_TEXT, CANDIDATES, NULO, TENTHS, cond, index_sql, iv_sql, qbin, strat, union, vbin, woe_sql
from riskloom.session import checkpointed

K, Y = "SK_ID_CURR", "TARGET"
#: Texts of the assembled table.
ASSEMBLED_TEXTS = (*[c for c in Pr.MAIN_TEXTS if c != "HORA_FRANJA"], "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "BB_TRAJECTORY")
cte("split_t", SPLIT_SQL)
cte("app_tr", f"SELECT * FROM app1 WHERE {K} IN (SELECT {K} FROM split_t WHERE split = 'train')")
cte("cl_tr", f"SELECT * FROM cl WHERE {K} IN (SELECT {K} FROM split_t WHERE split = 'train')")


def train(s, d):
    """Training part of the main table."""
    return X.only(app(s, d), "train", split(s, d))


def fit_apply(stage, s, d, *out):
    """Fit a stage on train and apply it to the whole population."""
    return stage.fit(train(s, d)).transform(app(s, d)).select(K, *out)


# -- fitted stages -----------------------------------------------------------------------------

_W = ["AMT_INCOME_TOTAL", "OWN_CAR_AGE", "CNT_CHILDREN", "AMT_REQ_CREDIT_BUREAU_QRT"]


def _lim(c: str) -> str:
    return f"(SELECT {1 if c == 'OWN_CAR_AGE' else 3} * quantile_cont({c}, 0.99) FROM app_tr)"


add("P1_winsorise", lambda s, d: fit_apply(G.Winsorizer(columns=_W), s, d, *_W), f"SELECT {K}, " + ", ".join(f"CASE WHEN {c} > {_lim(c)} THEN {_lim(c)} ELSE {c} END AS {c}" for c in _W) + " FROM app1", digits=4)
add(
    "P2_late_ratios",
    lambda s, d: fit_apply(G.LateRatioBuilder(), s, d, *LATE_RATIOS),
    f"SELECT {K}, AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0) AS ANNUITY_TO_INCOME_RATIO, CNT_CHILDREN / nullif(CNT_FAM_MEMBERS, 0) AS CHILDREN_TO_FAM_RATIO FROM app1",
)
_RARE = ["NAME_INCOME_TYPE", "NAME_TYPE_SUITE", "OCCUPATION_TYPE"]


def _grouped(c: str, least: int) -> str:
    return f"CASE WHEN coalesce({c}, '{NULO}') IN (SELECT coalesce({c}, '{NULO}') FROM app_tr GROUP BY 1 HAVING count(*) < {least}) THEN 'Other' ELSE {c} END"


add("P3_group_rare_levels", lambda s, d: fit_apply(G.RareGrouper(columns=_RARE, min_rows=200), s, d, *_RARE), f"SELECT {K}, " + ", ".join(f"{_grouped(c, 200)} AS {c}" for c in _RARE) + " FROM app1", _RARE)


def _onehot(s, d):
    m = G.OneHot(columns=["FLAG_OWN_CAR", "NAME_TYPE_SUITE"]).fit(train(s, d))
    out = m.transform(app(s, d).withColumn("NAME_TYPE_SUITE", F.when(F.col(K) % 100 == 0, "never seen").otherwise(F.col("NAME_TYPE_SUITE"))))
    return out.select(K, *[c for c in out.columns if c.startswith(("FLAG_OWN_CAR_", "NAME_TYPE_SUITE_"))])


_SUITE = f"CASE WHEN {K} % 100 = 0 THEN 'never seen' ELSE NAME_TYPE_SUITE END"
add(
    "P4_one_hot",
    _onehot,
    f"SELECT {K}, CASE WHEN FLAG_OWN_CAR = 'Y' THEN 1 ELSE 0 END AS FLAG_OWN_CAR_Y, "
    + ", ".join(f"CASE WHEN {_SUITE} = '{v}' THEN 1 ELSE 0 END AS \"NAME_TYPE_SUITE_{v}\"" for v in ("Children", "Family", "Group of people", "Unaccompanied"))
    + f", CASE WHEN {_SUITE} IS NULL THEN 1 ELSE 0 END AS NAME_TYPE_SUITE_nan FROM app1",
)
add(
    "P5_woe_encoding",
    lambda s, d: fit_apply(G.WoeEncoder(columns=["ORGANIZATION_TYPE"]), s, d, "ORGANIZATION_TYPE_WOE"),
    f"SELECT {K}, coalesce(woe, 0) AS ORGANIZATION_TYPE_WOE FROM app1 LEFT JOIN (SELECT bin, woe FROM ({woe_sql(strat(vbin('app_tr', 'ORGANIZATION_TYPE')))})) ON bin = coalesce(ORGANIZATION_TYPE, '{NULO}')",
)


def _target_mean(s, d):
    m = G.TargetMeanEncoder(columns=["OCCUPATION_TYPE"], smoothing=20.0, folds=5, seed=42).fit(train(s, d))
    fitted = m.transform_train(train(s, d)).select(K, F.col("OCCUPATION_TYPE").alias("enc"), F.lit("train").alias("part"))
    other = m.transform(X.only(app(s, d), "valid", split(s, d))).select(K, F.col("OCCUPATION_TYPE").alias("enc"), F.lit("valid").alias("part"))
    return fitted.unionByName(other)


_FT = f"SELECT {K}, coalesce(OCCUPATION_TYPE, '{NULO}') AS v, {Y} AS y, CAST('0x' || substr(md5({K} || '|42'), 1, 8) AS BIGINT) % 5 AS f FROM app_tr"
add(
    "P6_target_mean_encoding",
    _target_mean,
    f"""WITH t AS ({_FT}), lf AS (SELECT v, f, count(*) AS n, sum(y) AS s FROM t GROUP BY 1, 2), l AS (SELECT v, count(*) AS n, sum(y) AS s FROM t GROUP BY 1), g AS (SELECT count(*) AS n, sum(y) AS s FROM t), gf AS (SELECT f, count(*) AS n, sum(y) AS s FROM t GROUP BY 1)
SELECT t.{K}, CASE WHEN l.n = lf.n THEN (g.s - gf.s) / (g.n - gf.n) ELSE (l.s - lf.s + 20 * (g.s - gf.s) / (g.n - gf.n)) / (l.n - lf.n + 20) END AS enc, 'train' AS part FROM t JOIN lf ON lf.v = t.v AND lf.f = t.f JOIN l ON l.v = t.v JOIN gf ON gf.f = t.f, g
UNION ALL SELECT {K}, coalesce((l.s + 20 * g.s / g.n) / (l.n + 20), g.s / g.n), 'valid' FROM app1 LEFT JOIN l ON l.v = coalesce(OCCUPATION_TYPE, '{NULO}'), g WHERE {K} IN (SELECT {K} FROM split_t WHERE split = 'valid')""",
    ("part",),
)
_EDU = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(Pr.EDUCATION))
add("P7_ordinal_encoding", lambda s, d: fit_apply(G.OrdinalEncoder(orders={"NAME_EDUCATION_TYPE": list(Pr.EDUCATION)}), s, d, "NAME_EDUCATION_TYPE"), f"SELECT {K}, CASE NAME_EDUCATION_TYPE {_EDU} ELSE -1 END AS NAME_EDUCATION_TYPE FROM app1")
_MED = ["EXT_SOURCE_1", "OWN_CAR_AGE", "LTV"]
add("P8_median_imputation", lambda s, d: fit_apply(G.MedianImputer(columns=_MED), s, d, *_MED), f"SELECT {K}, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM app_tr)) AS {c}" for c in _MED) + " FROM app1")
_ZERO = ["BUREAU_OVERDUE_UNION", "BUREAU_DAYS_CREDIT_UPDATE_FLAG"]
add("P9_zero_imputation", lambda s, d: G.ZeroImputer(columns=_ZERO).fit(clients(s, d, "h")).transform(clients(s, d, "h")).select(K, *_ZERO), f"SELECT {K}, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _ZERO) + " FROM cl_h")
add("P10_plain_flags", lambda s, d: app(s, d).select(K, *Pr.MAIN_FLAGS[:10], "HAS_BUILDING_INFO"), f"SELECT {K}, {', '.join(Pr.MAIN_FLAGS[:10])}, HAS_BUILDING_INFO FROM app1")


def _constants(s, d):
    df = app(s, d).select(K, Y, "FLAG_EMAIL", "AGE_YEARS").withColumn("ALWAYS", F.col("FLAG_EMAIL") * 0 + 1)
    return G.ConstantDropper().fit(df).transform(df)


add("P11_drop_constants", _constants, f"SELECT {K}, {Y}, FLAG_EMAIL, AGE_YEARS FROM app1")
_SEL = {
    "candidates": CANDIDATES | {"BUREAU_ACTIVE_COUNT": "HAS_BUREAU_HISTORY"},
    "discards": {"FLAG_EMAIL": "frozen"},
    "protected": ["AGE_YEARS"],
    "redundant": {"BUREAU_ACTIVE_COUNT": ["BUREAU_LOAN_COUNT"]},
    "categorical": ["BB_TRAJECTORY"],
}
_SEL_TEXT = sorted(c for c in _SEL["candidates"] if c in CAND_TEXT and c != "BB_TRAJECTORY")


def _fitted_selector(s, d):
    """The selector fitted on the assembled table, its text candidates encoded."""
    df = clients(s, d)
    df = G.OrdinalEncoder(orders={"BB_TRAJECTORY": list(TRAJECTORIES)}).fit(df).transform(df)
    df = checkpointed(G.OneHot(columns=_SEL_TEXT).fit(df).transform(df))
    return R.IvSelector(**_SEL).fit(df)


def _selector(s, d):
    m = _fitted_selector(s, d)
    iv, out = m.fitted("iv"), m.fitted("motives")
    return s.createDataFrame([(o, v, int(o not in out)) for o, v in sorted(iv.items())], "origin string, iv double, kept int")


def _candidate_sql(c: str, presence: str | None) -> str:
    text = c in CAND_TEXT
    inside = [f"{presence} = 1"] * bool(presence) + [f"{c} IS NOT NULL"] * bool(presence and not text)
    rel = f"(SELECT * FROM cl{' WHERE ' + ' AND '.join(inside) if inside else ''})"
    return iv_sql(strat((vbin if text or c in CAND_FLAG else qbin)(rel, c)))


_SELIV = union([*(_candidate_sql(c, p) for c, p in _SEL["candidates"].items()), iv_sql(strat(qbin("cl", "AGE_YEARS")))])
cte("sel_iv", _SELIV)
add(
    "P12_iv_selector",
    _selector,
    "SELECT feature AS origin, iv, CASE WHEN feature = 'FLAG_EMAIL' THEN 0 WHEN feature = 'AGE_YEARS' THEN 1 WHEN feature = 'BUREAU_ACTIVE_COUNT' THEN CASE WHEN (SELECT iv FROM sel_iv WHERE feature = 'BUREAU_LOAN_COUNT') >= 0.02 THEN 0 WHEN iv >= 0.02 THEN 1 ELSE 0 END WHEN iv >= 0.02 THEN 1 ELSE 0 END AS kept FROM sel_iv",
    ("origin",),
)
_B = Pr.Buckets(
    median=("EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "ANNUITY_TO_INCOME_RATIO", "BUREAU_LOAN_COUNT", "BUREAU_CREDITS_PER_YEAR", "PREV_REFUSED_RATIO"),
    onehot=("FLAG_OWN_CAR", "HORA_FRANJA"),
    ordinal={"NAME_EDUCATION_TYPE": Pr.EDUCATION, "BB_TRAJECTORY": TRAJECTORIES},
    woe=("ORGANIZATION_TYPE",),
    plain=("HAS_BUREAU_HISTORY",),
    zero=("BUREAU_OVERDUE_UNION",),
)
_RAW = ["EXT_SOURCE_1", "EXT_SOURCE_3", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "BUREAU_LOAN_COUNT", "BUREAU_CREDITS_PER_YEAR", "PREV_REFUSED_RATIO", "FLAG_OWN_CAR", "HOUR_APPR_PROCESS_START", "NAME_EDUCATION_TYPE", "BB_TRAJECTORY", "ORGANIZATION_TYPE", "HAS_BUREAU_HISTORY", "BUREAU_OVERDUE_UNION"]


def _chain():
    return [
        G.Winsorizer(columns=["AMT_INCOME_TOTAL"]), G.LateRatioBuilder(), G.DomainRecoder(), G.ColumnContract(columns=list(_B.columns())), G.MedianImputer(columns=list(_B.median)),
        G.RareGrouper(columns=list(_B.onehot)), G.OneHot(columns=list(_B.onehot)), G.OrdinalEncoder(orders={c: list(v) for c, v in _B.ordinal.items()}), G.WoeEncoder(columns=list(_B.woe)), G.ZeroImputer(columns=list(_B.zero)), G.ConstantDropper(),
    ]


def _matrix(s, d):
    df = checkpointed(clients(s, d).select(K, Y, *_RAW))
    _, tr, va = Pl.fit_matrices(df, split(s, d), _chain())
    return tr.unionByName(va)


def _m(c: str, e: str | None = None) -> str:
    e = e or c
    return f"coalesce({e}, (SELECT median({e}) FROM cl_tr)) AS {c}"


_INC = "CASE WHEN AMT_INCOME_TOTAL > (SELECT 3 * quantile_cont(AMT_INCOME_TOTAL, 0.99) FROM cl_tr) THEN (SELECT 3 * quantile_cont(AMT_INCOME_TOTAL, 0.99) FROM cl_tr) ELSE AMT_INCOME_TOTAL END"
_HP = "CASE WHEN HOUR_APPR_PROCESS_START >= 6 AND HOUR_APPR_PROCESS_START < 12 THEN 'manana' WHEN HOUR_APPR_PROCESS_START >= 12 AND HOUR_APPR_PROCESS_START < 18 THEN 'tarde' WHEN HOUR_APPR_PROCESS_START IS NOT NULL THEN 'fuera de horario' END"
_PSQL = (
    f"SELECT {K}, {Y}, {_m('EXT_SOURCE_1')}, {_m('EXT_SOURCE_3')}, {_m('AMT_INCOME_TOTAL', _INC)}, {_m('AMT_ANNUITY')}, {_m('ANNUITY_TO_INCOME_RATIO', f'AMT_ANNUITY / ({_INC})')}, {_m('BUREAU_LOAN_COUNT')}, {_m('BUREAU_CREDITS_PER_YEAR')}, {_m('PREV_REFUSED_RATIO')}, "
    f"CASE WHEN FLAG_OWN_CAR = 'Y' THEN 1 ELSE 0 END AS FLAG_OWN_CAR_Y, CASE WHEN {_HP} = 'manana' THEN 1 ELSE 0 END AS HORA_FRANJA_manana, CASE WHEN {_HP} = 'tarde' THEN 1 ELSE 0 END AS HORA_FRANJA_tarde, CASE WHEN {_HP} = 'fuera de horario' THEN 1 ELSE 0 END AS \"HORA_FRANJA_fuera de horario\", "
    f"CASE WHEN {_HP} IS NULL THEN 1 ELSE 0 END AS \"HORA_FRANJA_Other\", CASE NAME_EDUCATION_TYPE {_EDU} ELSE -1 END AS NAME_EDUCATION_TYPE, CASE BB_TRAJECTORY WHEN 'sin mora' THEN 0 WHEN 'mejora' THEN 1 WHEN 'empeora' THEN 2 WHEN 'estable' THEN 3 ELSE -1 END AS BB_TRAJECTORY, "
    f"coalesce(woe, 0) AS ORGANIZATION_TYPE_WOE, HAS_BUREAU_HISTORY, coalesce(BUREAU_OVERDUE_UNION, 0) AS BUREAU_OVERDUE_UNION FROM cl LEFT JOIN (SELECT bin, woe FROM ({woe_sql(strat(vbin('cl_tr', 'ORGANIZATION_TYPE')))})) ON bin = coalesce(ORGANIZATION_TYPE, '{NULO}')"
)
add("P13_stage_chain", _matrix, _PSQL)


def _column_profile(matrix, part: str):
    """Rows, mean and range of every column of a matrix."""
    names = [c for c in matrix.columns if c not in (K, Y)]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), G.quoted(c).cast("double").alias("v")) for c in names])
    return (
        matrix.select(F.explode(cells).alias("x"))
        .groupBy("x.feature")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("x.v").alias("mean"), F.min("x.v").alias("least"), F.max("x.v").alias("most"))
        .withColumn("part", F.lit(part))
    )


def _full_chain(s, d):
    df = checkpointed(clients(s, d))
    _, tr, va = Pl.fit_matrices(df, split(s, d), Pl.feature_stages(Pr.full_buckets(), min_rows=20))
    return _column_profile(tr, "train").unionByName(_column_profile(va, "valid"))


def _capped(c: str) -> str:
    cap = f"(SELECT {G.WINSOR_FACTORS.get(c, P.WINSOR_FACTOR)} * quantile_cont({c}, 0.99) FROM cl_tr)"
    return f"CASE WHEN {c} > {cap} THEN {cap} ELSE {c} END AS {c}"


_CAPS = ", ".join(_capped(c) for c in G.WINSOR_COLUMNS)
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
cte("fc_capped", f"SELECT * REPLACE ({_CAPS}) FROM cl JOIN (SELECT {K}, split FROM split_t) USING ({K})")
cte(
    "fc_rows",
    f"SELECT * EXCLUDE (HOUR_APPR_PROCESS_START) REPLACE ({DAY_SQL} AS WEEKDAY_APPR_PROCESS_START, coalesce(OCCUPATION_TYPE, 'Sin declarar') AS OCCUPATION_TYPE), {PART_SQL} AS HORA_FRANJA, AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0) AS ANNUITY_TO_INCOME_RATIO, CNT_CHILDREN / nullif(CNT_FAM_MEMBERS, 0) AS CHILDREN_TO_FAM_RATIO FROM fc_capped",
)
_FC_TEXT = (*Pr.MAIN_TEXTS, "NAME_EDUCATION_TYPE", "BB_TRAJECTORY", "ORGANIZATION_TYPE", "OCCUPATION_TYPE")
cte("fc_numbers", f"SELECT * FROM (SELECT split AS part, CAST(COLUMNS(* EXCLUDE ({K}, {Y}, split, {', '.join(_FC_TEXT)})) AS DOUBLE) FROM fc_rows) UNPIVOT INCLUDE NULLS (v FOR feature IN (COLUMNS(* EXCLUDE (part))))")
cte("fc_median", "SELECT feature, median(v) AS md FROM fc_numbers WHERE part = 'train' GROUP BY 1")
_FC_ZERO = _quoted((*HISTORY_FLAGS, *PANEL_FLAGS, *PREVIOUS_FLAGS))
cte("fc_filled", f"SELECT part, feature, CASE WHEN feature IN ({_FC_ZERO}) THEN coalesce(v, 0) WHEN feature IN ({_quoted((*Pr.MAIN_FLAGS, *Pr.PRESENCE))}) THEN v ELSE coalesce(v, md, 0) END AS v FROM fc_numbers JOIN fc_median USING (feature)")
cte("fc_texts", f"SELECT * FROM (SELECT split AS part, {', '.join(Pr.MAIN_TEXTS)} FROM fc_rows) UNPIVOT INCLUDE NULLS (lv FOR feature IN (COLUMNS(* EXCLUDE (part))))")
cte("fc_rare", "SELECT feature, lv FROM fc_texts WHERE part = 'train' GROUP BY 1, 2 HAVING count(*) < 20")
cte("fc_grouped", "SELECT t.part, t.feature, CASE WHEN r.feature IS NOT NULL THEN 'Other' ELSE t.lv END AS lv FROM fc_texts t LEFT JOIN fc_rare r ON r.feature = t.feature AND r.lv IS NOT DISTINCT FROM t.lv")
cte("fc_levels", "SELECT feature, lv FROM (SELECT feature, lv, count(*) OVER (PARTITION BY feature) AS m, row_number() OVER (PARTITION BY feature ORDER BY lv NULLS LAST) AS i FROM (SELECT DISTINCT feature, lv FROM fc_grouped WHERE part = 'train')) WHERE m > 2 OR (m = 2 AND i = 2)")
cte("fc_cells", "SELECT part, feature, lv, count(*) AS k FROM fc_grouped GROUP BY 1, 2, 3")
cte("fc_occ", f"SELECT split AS part, OCCUPATION_TYPE AS v, {Y} AS y, CAST('0x' || substr(md5({K} || '|42'), 1, 8) AS BIGINT) % 5 AS f FROM fc_rows")
_FC_MEANS = """WITH lf AS (SELECT v, f, count(*) AS n, sum(y) AS s FROM fc_occ WHERE part = 'train' GROUP BY 1, 2), l AS (SELECT v, sum(n) AS n, sum(s) AS s FROM lf GROUP BY 1), gf AS (SELECT f, sum(n) AS n, sum(s) AS s FROM lf GROUP BY 1), g AS (SELECT sum(n) AS n, sum(s) AS s FROM lf)
SELECT part, 'OCCUPATION_TYPE' AS feature, CASE WHEN l.n = lf.n THEN (g.s - gf.s) / (g.n - gf.n) ELSE (l.s - lf.s + 20 * (g.s - gf.s) / (g.n - gf.n)) / (l.n - lf.n + 20) END AS v FROM fc_occ t JOIN lf ON lf.v = t.v AND lf.f = t.f JOIN l ON l.v = t.v JOIN gf ON gf.f = t.f, g WHERE part = 'train'
UNION ALL SELECT part, 'OCCUPATION_TYPE', coalesce((l.s + 20 * g.s / g.n) / (l.n + 20), g.s / g.n) FROM fc_occ t LEFT JOIN l ON l.v = t.v, g WHERE part = 'valid'"""
_TRAJ = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(TRAJECTORIES))
_FC_CODES = union(
    [
        f"SELECT split AS part, 'NAME_EDUCATION_TYPE' AS feature, CAST(CASE NAME_EDUCATION_TYPE {_EDU} ELSE -1 END AS DOUBLE) AS v FROM fc_rows",
        f"SELECT split, 'BB_TRAJECTORY', CAST(CASE BB_TRAJECTORY {_TRAJ} ELSE -1 END AS DOUBLE) FROM fc_rows",
        f"SELECT split, 'ORGANIZATION_TYPE_WOE', coalesce(woe, 0) FROM fc_rows LEFT JOIN (SELECT bin, woe FROM ({woe_sql(strat(vbin('cl_tr', 'ORGANIZATION_TYPE')))})) ON bin = coalesce(ORGANIZATION_TYPE, '{NULO}')",
    ]
)
cte("fc_values", f"SELECT part, feature, v FROM fc_filled UNION ALL {_FC_CODES} UNION ALL SELECT * FROM ({_FC_MEANS})")
cte("fc_profile", "SELECT part, feature, count(*) AS n, avg(v) AS mean, min(v) AS least, max(v) AS most FROM fc_values GROUP BY 1, 2")
add(
    "P14_fit_on_train_only",
    _full_chain,
    """SELECT * FROM fc_profile WHERE feature IN (SELECT feature FROM fc_profile WHERE part = 'train' AND least IS DISTINCT FROM most)
UNION ALL SELECT p.part, l.feature || '_' || coalesce(l.lv, 'nan'), p.n, coalesce(c.k, 0) / p.n, CASE WHEN coalesce(c.k, 0) = p.n THEN 1 ELSE 0 END, CASE WHEN coalesce(c.k, 0) > 0 THEN 1 ELSE 0 END
FROM fc_levels l CROSS JOIN (SELECT split AS part, count(*) AS n FROM split_t GROUP BY 1) p LEFT JOIN fc_cells c ON c.part = p.part AND c.feature = l.feature AND c.lv IS NOT DISTINCT FROM l.lv""",
    ("part", "feature"),
    digits=4,
)
_RECOVER = {
    "EXT_SOURCE_1": ("FLAG_EXT_SOURCE_1_NULL = 1"), "OWN_CAR_AGE": ("FLAG_OWN_CAR = 'N'"), "BUREAU_LOAN_COUNT": ("HAS_BUREAU_HISTORY = 0"), "BUREAU_CURRENT_OVERDUE_SUM": ("HAS_BUREAU_HISTORY = 0"),
    "BUREAU_DEBT_CREDIT_RATIO": ("HAS_BUREAU_FINANCIAL_DETAIL = 0"), "BB_STATUS_WORST": ("HAS_BUREAU_BALANCE = 0 OR BB_MONTHS_REPORTED = 0"), "BB_MONTHS_SINCE_LAST_DPD": ("HAS_BUREAU_BALANCE = 0 OR BB_ANY_DPD_FLAG = 0"), "LTV": ("FALSE"),
}
add(
    "P15_absence_recovery",
    lambda s, d: Pl.absence_recovery(clients(s, d), {c: F.expr(e) for c, e in _RECOVER.items()}),
    union(f"SELECT '{c}' AS feature, {n_if(f'{c} IS NULL')} AS missing, {n_if(f'{c} IS NULL AND ({e})')} AS recovered, {n_if(f'{c} IS NULL AND NOT coalesce({e}, FALSE)')} AS residual FROM cl" for c, e in _RECOVER.items()),
    ("feature",),
)


def _stage_reports(s, d):
    t = train(s, d)
    w = G.Winsorizer(columns=_W).fit(t).report(s).select(F.lit("winsor").alias("report"), "feature", F.lit("").alias("level"), F.col("cap").alias("value"))
    r = G.RareGrouper(columns=_RARE, min_rows=200).fit(t).report(s).select(F.lit("rare").alias("report"), "feature", "level", F.col("n").cast("double").alias("value"))
    o = G.WoeEncoder(columns=["ORGANIZATION_TYPE"]).fit(t).report(s).select(F.lit("woe").alias("report"), "feature", "level", F.col("woe").alias("value"))
    return w.unionByName(r).unionByName(o)


add(
    "P16_stage_reports",
    _stage_reports,
    union([*(f"SELECT 'winsor' AS report, '{c}' AS feature, '' AS level, {_lim(c)} AS value" for c in _W), *(f"SELECT 'rare', '{c}', coalesce({c}, '(nulo)'), count(*) FROM app_tr GROUP BY {c} HAVING count(*) < 200" for c in _RARE),
           f"SELECT 'woe', 'ORGANIZATION_TYPE', CASE WHEN bin = '{NULO}' THEN '(nulo)' ELSE bin END, woe FROM ({woe_sql(strat(vbin('app_tr', 'ORGANIZATION_TYPE')))})"]),
    ("report", "feature", "level"),
    digits=4,
)

# -- redundancy and selection ------------------------------------------------------------------

_DECL = [("BUREAU_DAYS_CREDIT_MIN", "BUREAU_LOAN_COUNT")]


def _owner(c: str) -> str:
    return "bureau" if c.startswith("BUREAU") else "bureau_balance" if c.startswith("BB") else "previous_application" if c.startswith("PREV") else ""


def _assembled(s, d):
    """The assembled table with its late ratios, materialised."""
    df = clients(s, d)
    return checkpointed(G.LateRatioBuilder().fit(df).transform(df))


def _pairs_of(df):
    """Redundant pairs among all numeric columns of the assembled table."""
    return R.redundant_pairs(df, [c for c in df.columns if c not in (K, Y)], Pr.table_of(), _DECL)


def _pairs(s, d):
    return _pairs_of(_assembled(s, d))


# every numeric column of the assembled table with its late ratios, as rows
cte("rc_wide", f"SELECT *, AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0) AS ANNUITY_TO_INCOME_RATIO, CNT_CHILDREN / nullif(CNT_FAM_MEMBERS, 0) AS CHILDREN_TO_FAM_RATIO FROM cl")
cte("rc_long", f"SELECT {K}, y, feature, val FROM (SELECT {K}, {Y} AS y, CAST(COLUMNS(* EXCLUDE ({K}, {Y}, {', '.join(ASSEMBLED_TEXTS)})) AS DOUBLE) FROM rc_wide) UNPIVOT (val FOR feature IN (COLUMNS(* EXCLUDE ({K}, y))))")
_OWNER_SQL = "CASE WHEN feature IN ('HAS_BUREAU_HISTORY') THEN 'bureau' WHEN feature = 'HAS_BUREAU_BALANCE' THEN 'bureau_balance' WHEN feature = 'HAS_PREV_APPLICATION' THEN 'previous_application' WHEN feature IN (SELECT column_name FROM (DESCRIBE SELECT * FROM cl_h)) AND feature NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM app1)) THEN 'bureau' WHEN feature LIKE 'BB%' THEN 'bureau_balance' WHEN feature LIKE 'PREV%' THEN 'previous_application' ELSE '' END"
cte("rc_cols", f"SELECT feature, bool_and(val IN (0, 1)) AS is_flag, min(val) AS low, {_OWNER_SQL} AS tbl FROM rc_long GROUP BY feature")
cte(
    "rc_pairs",
    """SELECT x.feature AS a, y.feature AS b, count(*) AS n, CASE WHEN min(x.val) < max(x.val) AND min(y.val) < max(y.val) THEN corr(x.val, y.val) END AS r,
CASE WHEN min(x.val) < max(x.val) AND min(y.val > 0) < max(y.val > 0) THEN corr(x.val, CAST(y.val > 0 AS DOUBLE)) END AS r_b, CASE WHEN min(y.val) < max(y.val) AND min(x.val > 0) < max(x.val > 0) THEN corr(y.val, CAST(x.val > 0 AS DOUBLE)) END AS r_a
FROM rc_long x JOIN rc_long y USING (SK_ID_CURR) WHERE x.feature < y.feature GROUP BY 1, 2""",
)
_DECLARED_SQL = " OR ".join(f"(a = '{min(p)}' AND b = '{max(p)}')" for p in _DECL)
cte(
    "rc_zones",
    f"""SELECT *, CASE WHEN abs(r) > CASE WHEN kind = 'FF' THEN 0.5 ELSE 0.7 END OR coalesce(abs(r_event), 0) > 0.5 THEN 'above' WHEN kind <> 'FF' AND abs(r) >= 0.6 THEN 'band' WHEN declared = 1 THEN 'declared' END AS zone FROM (
SELECT a, b, ca.tbl AS table_a, cb.tbl AS table_b, CASE WHEN ca.is_flag AND cb.is_flag THEN 'FF' WHEN ca.is_flag OR cb.is_flag THEN 'FM' ELSE 'MM' END AS kind, r,
CASE WHEN ca.is_flag AND NOT cb.is_flag AND cb.low >= 0 THEN r_b WHEN cb.is_flag AND NOT ca.is_flag AND ca.low >= 0 THEN r_a END AS r_event, n, CASE WHEN {_DECLARED_SQL} THEN 1 ELSE 0 END AS declared
FROM rc_pairs JOIN rc_cols ca ON a = ca.feature JOIN rc_cols cb ON b = cb.feature) WHERE table_a <> table_b OR declared = 1""",
)
add("R1_redundant_pairs", _pairs, "SELECT * FROM rc_zones WHERE zone IS NOT NULL", ("a", "b", "table_a", "table_b", "kind", "zone"))


def _resolved(s, d):
    df = _assembled(s, d)
    # a few rows per pair of columns, whatever the number of clients
    pairs = sorted((r["a"], r["b"]) for r in _pairs_of(df).select("a", "b").collect())
    return R.resolve_redundancy(df.select(Y, *sorted({c for p in pairs for c in p})), pairs, ["EXT_SOURCE_3"])


cte("rp_rows", f"SELECT a, b, x.{K}, x.y, x.val AS va, z.val AS vb FROM rc_zones JOIN rc_long x ON x.feature = a JOIN rc_long z ON z.feature = b AND z.{K} = x.{K} WHERE zone IS NOT NULL")
cte("rp_edges", f"SELECT a, b, count(DISTINCT va) > 2 AS wa, count(DISTINCT vb) > 2 AS wb, list_sort(list_distinct(quantile_cont(va, {TENTHS}))) AS ea, list_sort(list_distinct(quantile_cont(vb, {TENTHS}))) AS eb FROM rp_rows GROUP BY 1, 2")
_code = lambda x: f"CASE WHEN w{x} THEN CAST(len([q for q in e{x}[2:len(e{x}) - 1] if q < v{x}]) AS VARCHAR) ELSE CAST(v{x} AS VARCHAR) END"
cte("rp_codes", f"SELECT a, b, y, {_code('a')} AS qa, {_code('b')} AS qb FROM rp_rows JOIN rp_edges USING (a, b)")


def _resolve_sql() -> str:
    read = lambda name, bin_, stratum: f"SELECT a, b, '{name}' AS feature, {stratum} AS stratum, {bin_} AS bin, y FROM rp_codes"
    four = union([read("iv_a", "qa", "'all'"), read("iv_b", "qb", "'all'"), read("inc_a", "qa", "qb"), read("inc_b", "qb", "qa")])
    wide = f"SELECT a, b, max(n) AS n, {', '.join(f"max(iv) FILTER (WHERE feature = '{x}') AS {x}" for x in ('iv_a', 'iv_b', 'inc_a', 'inc_b'))} FROM ({iv_sql(four, 'a, b, feature')}) GROUP BY 1, 2"
    pa, pb = "a = 'EXT_SOURCE_3'", "b = 'EXT_SOURCE_3'"
    keep = f"CASE WHEN {pa} THEN CASE WHEN inc_b >= 0.02 THEN 'both' ELSE 'a' END WHEN {pb} THEN CASE WHEN inc_a >= 0.02 THEN 'both' ELSE 'b' END WHEN inc_a >= 0.02 AND inc_b >= 0.02 THEN 'both' WHEN inc_a >= 0.02 THEN 'a' WHEN inc_b >= 0.02 THEN 'b' WHEN iv_a >= iv_b THEN 'a' ELSE 'b' END"
    motive = f"CASE WHEN {pa} OR {pb} THEN 'one protected' WHEN inc_a >= 0.02 AND inc_b >= 0.02 THEN 'each adds to the other' WHEN inc_a >= 0.02 OR inc_b >= 0.02 THEN 'only one adds to the other' ELSE 'neither adds, higher IV alone' END"
    return f"SELECT *, {keep} AS keep, {motive} AS motive FROM ({wide})"


add("R2_resolve_redundancy", _resolved, _resolve_sql(), ("a", "b", "keep", "motive"))
_STAB = sorted(Pr.IV_CANDIDATES)


def _stability(s, d):
    df = checkpointed(clients(s, d).select(K, Y, *_STAB))
    return R.fold_iv(df, X.stratified_folds(df), _STAB)


_STAB_TEXT = [c for c in _STAB if c in CAND_TEXT]
_STAB_NUM = [c for c in _STAB if c not in CAND_TEXT]
cte("stab_rows", f"SELECT f.seed, g.k AS fold, c.* FROM (SELECT {K}, {', '.join(_STAB)}, {Y} FROM cl) c JOIN ({folds_sql(P.SEEDS, P.N_FOLDS)}) f USING ({K}), (SELECT unnest(range(0, {P.N_FOLDS})) AS k) g WHERE f.fold <> g.k")
cte("stab_num", f"SELECT seed, fold, y, feature, val FROM (SELECT seed, fold, {Y} AS y, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _STAB_NUM)} FROM stab_rows) UNPIVOT INCLUDE NULLS (val FOR feature IN ({', '.join(_STAB_NUM)}))")
cte("stab_edges", f"SELECT seed, fold, feature, count(DISTINCT val) > 2 AS many, list_sort(list_distinct(quantile_cont(val, {TENTHS}))) AS e FROM stab_num GROUP BY 1, 2, 3")
cte(
    "stab_bins",
    f"SELECT feature, seed, fold, 'all' AS stratum, CASE WHEN val IS NULL THEN '{NULO}' WHEN many THEN CAST({index_sql('val')} AS VARCHAR) ELSE CAST(val AS VARCHAR) END AS bin, y FROM stab_num JOIN stab_edges USING (seed, fold, feature) "
    + " ".join(f"UNION ALL SELECT '{c}', seed, fold, 'all', coalesce({c}, '{NULO}'), {Y} FROM stab_rows" for c in _STAB_TEXT),
)
_STAB_SQL = f"SELECT feature, seed, fold, iv FROM ({iv_sql('SELECT * FROM stab_bins', 'feature, seed, fold')})"
add("R6_fold_stability", _stability, _STAB_SQL, ("feature",))


def _band(s, d):
    df = checkpointed(clients(s, d).select(K, Y, *_STAB))
    measured = {r["feature"]: r["iv"] for r in R.information_value(df, _STAB, Y).collect()}
    return R.stability(df, X.stratified_folds(df), measured, _STAB, (0.0, float("inf")))


add("R6_folds_reached", _band, f"SELECT feature, count(*) FILTER (WHERE iv >= 0.02) AS folds_reached, count(*) AS n_folds FROM ({_STAB_SQL}) GROUP BY 1", ("feature",))


def _register(s, d):
    m, own = _fitted_selector(s, d), Pr.table_of()
    columns = [c for c in clients(s, d).columns if c not in (K, Y)]
    return R.selection_register(s, columns, m, {c: own.get(c, "") for c in columns}).select("feature", "source", "iv", "in_band", "kept", "motive")


_CAND_SQL = ", ".join(f"'{c}'" for c in _SEL["candidates"])
add(
    "R7_selection_register",
    _register,
    f"""SELECT feature, source, iv, in_band, CASE WHEN motive LIKE '%below%' OR motive LIKE 'redundant%' OR motive = 'frozen' THEN 0 ELSE 1 END AS kept, motive FROM (
SELECT feature, source, iv, CASE WHEN feature IN ({_CAND_SQL}) AND iv >= 0.015 AND iv < 0.025 THEN 1 ELSE 0 END AS in_band,
CASE WHEN feature = 'FLAG_EMAIL' THEN 'frozen' WHEN feature = 'AGE_YEARS' THEN 'protected' WHEN iv IS NULL THEN 'not judged by IV'
WHEN feature = 'BUREAU_ACTIVE_COUNT' THEN CASE WHEN (SELECT iv FROM sel_iv WHERE feature = 'BUREAU_LOAN_COUNT') >= 0.02 THEN 'redundant with BUREAU_LOAN_COUNT' ELSE printf('IV %.4f ', iv) || CASE WHEN iv < 0.02 THEN 'below' ELSE 'reaches' END || ' 0.0200; no winner left' END
ELSE printf('IV %.4f ', iv) || CASE WHEN iv < 0.02 THEN 'below' ELSE 'reaches' END || ' 0.0200' END AS motive
FROM (SELECT column_name AS feature, {_OWNER_SQL.replace('feature', 'column_name')} AS source FROM (DESCRIBE SELECT * EXCLUDE ({K}, {Y}) FROM cl)) LEFT JOIN sel_iv USING (feature))""",
    ("feature", "source", "motive"),
)

add("C23_partition_filter", lambda s, d: X.only(app(s, d), "valid", split(s, d)).select(K, Y), f"SELECT {K}, {Y} FROM split_t WHERE split = 'valid'")


def _limits(s, d):
    ref = {"AMT_INCOME_TOTAL": 100000.0, "OWN_CAR_AGE": 64.0}
    return G.Winsorizer(columns=_W).fit(train(s, d)).report(s, ref)


add(
    "K9_winsor_limits",
    _limits,
    union(
        f"SELECT '{c}' AS feature, count({c}) AS n, quantile_cont({c}, 0.99) AS percentile, {1 if c == 'OWN_CAR_AGE' else 3} AS factor, {_lim(c)} AS cap, {r} AS reference, ({_lim(c)} / {r} - 1) * 100 AS deviation_pct FROM app_tr"
        for c, r in ((c, {"AMT_INCOME_TOTAL": "100000", "OWN_CAR_AGE": "64"}.get(c, "NULL")) for c in _W)
    ),
    ("feature",),
    digits=4,
)

# -- splits and resampling ---------------------------------------------------------------------

add("X1_stratified_split", split, "SELECT * FROM split_t", ("split",))
add("X2_stratified_folds", lambda s, d: X.stratified_folds(app(s, d)), folds_sql(P.SEEDS, P.N_FOLDS))


def _context(s, d):
    return Pl.train_population(clients(s, d, "h"), split(s, d))[1]


add("X3_train_population", _context, f"SELECT {K}, {Y}, AMT_CREDIT, HAS_BUREAU_HISTORY FROM cl_h WHERE {K} IN (SELECT {K} FROM split_t WHERE split = 'train')")
_UNDER = f"SELECT {K}, {Y} FROM lab WHERE {Y} = 1 UNION ALL SELECT {K}, {Y} FROM (SELECT *, row_number() OVER (ORDER BY md5({K} || '|0'), {K}) AS rk FROM lab WHERE {Y} = 0) WHERE rk <= (SELECT sum({Y}) FROM lab)"
add("X5_undersample", lambda s, d: X.undersample(app(s, d)).select(K, Y), _UNDER)
add("X8_resampled_size", lambda s, d: X.resampled_size(X.undersample(app(s, d))), f"SELECT count(*) AS n_rows, avg({Y}) AS prevalence FROM ({_UNDER})")
_REPS = 2000


#: Rows of a bucket in the registered query: few, so that the small tables have several buckets a class.
_BUCKET = 256


def _bootstrap(s, d):
    stat = X.weighted_means({"rate": F.col(Y).cast("double"), "mean_ext3": F.col("EXT_SOURCE_3"), "mean_credit": F.col("AMT_CREDIT")})
    return X.bootstrap_interval(app(s, d).select(K, Y, "EXT_SOURCE_3", "AMT_CREDIT"), stat, _REPS, bucket_rows=_BUCKET)


def _mix(x: str) -> str:
    """x ** 5 modulo the prime."""
    p = B.PRIME
    return f"(({x} * {x} % {p}) * ({x} * {x} % {p}) % {p} * {x} % {p})"


def _streams(rel: str, bucket: str) -> str:
    """The rows of ``rel`` with start and stride of their stream of draws."""
    a, b, c = B.STEPS
    base = f"SELECT *, (rep * {a} + ({Y} + 1) * {b} + ({bucket} + 1) * {c} + {B.seed_number(42)}) % {B.PRIME} AS x0 FROM {rel}"
    return f"(SELECT *, 1 + {_mix('x1')} % {B.PRIME - 1} AS stride FROM (SELECT *, (start + 1) % {B.PRIME} AS x1 FROM (SELECT *, {_mix('x0')} AS start FROM ({base}))))"


add(
    "X9_bootstrap_interval",
    _bootstrap,
    f"""WITH h AS (SELECT *, md5({K} || '|42') AS h, count(*) OVER (PARTITION BY {Y}) AS m FROM app1),
r AS (SELECT *, row_number() OVER (PARTITION BY {Y}, b ORDER BY h, {K}) - 1 AS idx FROM (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(ceil(m / {_BUCKET}) AS BIGINT) AS b FROM h)),
bk AS (SELECT *, sum(n) OVER (PARTITION BY {Y} ORDER BY b) - n AS lo FROM (SELECT {Y}, b, count(*) AS n FROM r GROUP BY 1, 2)),
cr AS (SELECT {Y}, m, rep FROM (SELECT {Y}, count(*) AS m FROM app1 GROUP BY 1), (SELECT unnest(range(1, {_REPS + 1})) AS rep)),
ch AS (SELECT {Y}, rep, m, start, {_mix('x2')} AS f FROM (SELECT *, (start + k * stride) % {B.PRIME} AS x2 FROM (SELECT *, unnest(range(m)) AS k FROM {_streams('cr', '-1')}))),
po AS (SELECT {Y}, rep, (f * {B.PRIME + 1} + {_mix('x3')}) % m AS pos FROM (SELECT *, (f + start) % {B.PRIME} AS x3 FROM ch)),
n1 AS (SELECT a.{Y}, a.rep, b.b, b.n, count(*) AS draws FROM po a JOIN bk b ON a.{Y} = b.{Y} AND a.pos >= b.lo AND a.pos < b.lo + b.n GROUP BY 1, 2, 3, 4),
d2 AS (SELECT {Y}, rep, b, {_mix('x2')} % n AS idx FROM (SELECT *, (start + k * stride) % {B.PRIME} AS x2 FROM (SELECT *, unnest(range(draws)) AS k FROM {_streams('n1', 'b')}))),
st AS (SELECT rep, avg({Y}) AS rate, avg(EXT_SOURCE_3) AS mean_ext3, avg(AMT_CREDIT) AS mean_credit FROM d2 JOIN r USING ({Y}, b, idx) GROUP BY 1)
"""
    + union(f"SELECT '{c}' AS name, quantile_cont({c}, 0.025) AS lower, quantile_cont({c}, 0.975) AS upper FROM st" for c in ("rate", "mean_ext3", "mean_credit")),
    ("name",),
)

# -- evaluation --------------------------------------------------------------------------------

cte("sc", f"SELECT {K}, {Y} AS y, round(1 - coalesce(EXT_SOURCE_3, 0.5), 2) AS s, round(1 - coalesce(EXT_SOURCE_2, 0.5), 2) AS s2, AMT_CREDIT AS amt, EXT_SOURCE_1 FROM app1")
cte("sg", "SELECT *, sum(n) OVER w AS cn, sum(b) OVER w AS cb, sum(n) OVER () AS tn, sum(b) OVER () AS tb, sum(a) OVER () AS ta, sum(x) OVER () AS tx FROM (SELECT s, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS b, sum(amt) AS a, sum(amt * y) AS x FROM sc GROUP BY 1) WINDOW w AS (ORDER BY s)")


def scores(s, d):
    """Two scores, the target and the amount of each client; an unknown source scores one half."""
    one, half = F.lit(1.0), F.lit(0.5)
    return app(s, d).select(
        K, F.col(Y).alias("y"), F.round(one - F.coalesce("EXT_SOURCE_3", half), 2).alias("s"), F.round(one - F.coalesce("EXT_SOURCE_2", half), 2).alias("s2"), F.col("AMT_CREDIT").alias("amt"), "EXT_SOURCE_1"
    )


def _guarded(s, d):
    df = scores(s, d)
    E.guard(df, "y", "s", probability=True)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bads"), F.count_distinct("s").alias("levels"))


add("E0_input_guard", _guarded, "SELECT count(*) AS n, sum(y) AS bads, count(DISTINCT s) AS levels FROM sc")
_RANK = """SELECT auc, 2 * auc - 1 AS gini, ks, 1 - kept / tb AS top_capture, ap AS avg_precision FROM (SELECT sum(b * (cn - cb - (n - b) + (n - b) / 2)) / max(tb * (tn - tb)) AS auc,
greatest(max((tb - cb + b) / tb - ((tn - tb) - (cn - cb) + (n - b)) / (tn - tb)), 0) AS ks, sum(b * least(greatest(0.9 * tn - (cn - n), 0), n) / n) AS kept, sum(b / tb * (tb - cb + b) / (tn - cn + n)) AS ap, max(tb) AS tb FROM sg)"""
add("E1_ranking", lambda s, d: E.ranking(E.score_groups(scores(s, d), "y", "s")), _RANK)


def _curve_sql(groups: str, extra: str = "") -> str:
    part = lambda c: f"sum({c} * least(greatest(r * tn - (cn - n), 0), n) / n)"
    g = f"GROUP BY {extra}r" if extra else "GROUP BY r"
    return f"SELECT {extra}r AS rate, kb / (r * tn) AS default_rate, kx / ka AS default_amount, kb / (r * tn) / (tb / tn) - 1 AS change_rate, kx / ka / (tx / ta) - 1 AS change_amount FROM (SELECT {extra}r, {part('b')} AS kb, {part('a')} AS ka, {part('x')} AS kx, max(tn) AS tn, max(tb) AS tb, max(ta) AS ta, max(tx) AS tx FROM {groups}, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS r) {g})"


add("E2_strategy_curve", lambda s, d: E.strategy_curve(E.score_groups(scores(s, d), "y", "s", amount="amt")), _curve_sql("sg"))
add(
    "E3_partial_auc",
    lambda s, d: E.partial_auc(E.score_groups(scores(s, d), "y", "s")),
    """SELECT 0.5 * (1 + (area - 0.045) / (0.3 - 0.045)) AS partial_auc FROM (SELECT sum(w * k * (t0 + t0 + (t1 - t0) * k) / 2) AS area FROM (SELECT *, f1 - f0 AS w, CASE WHEN f1 > f0 THEN least(greatest((0.3 - f0) / (f1 - f0), 0), 1) ELSE 0 END AS k FROM (
SELECT ((tn - tb) - (cn - cb)) / (tn - tb) AS f0, ((tn - tb) - (cn - cb) + n - b) / (tn - tb) AS f1, (tb - cb) / tb AS t0, (tb - cb + b) / tb AS t1 FROM sg)))""",
)
add("E4_calibration_errors", lambda s, d: E.calibration_errors(scores(s, d), "y", "s"), "SELECT avg(power(y - s, 2)) AS brier, -avg(CASE WHEN y = 1 THEN ln(greatest(least(s, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) ELSE ln(1 - greatest(least(s, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) END) AS log_loss FROM sc")
# Newton steps over the distinct probabilities, as a recursive query
_LINE = """SELECT b AS slope, c AS intercept, 'ok' AS fit FROM (WITH RECURSIVE g AS MATERIALIZED (SELECT ln(q / (1 - q)) AS z, n, k FROM (SELECT greatest(least(s, 1 - 1e-6), 1e-6) AS q, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k FROM sc GROUP BY 1)),
steps AS (SELECT 0 AS i, 0::DOUBLE AS a, 1::DOUBLE AS b, 0::DOUBLE AS c UNION ALL
SELECT i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), c + k0 / k00 FROM (
SELECT i, a, b, c, sum(k - n * m) AS g0, sum((k - n * m) * z) AS g1, sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * z) AS h01, sum(n * m * (1 - m) * z * z) AS h11, sum(k - n * u) AS k0, sum(n * u * (1 - u)) AS k00
FROM (SELECT i, a, b, c, z, n, k, 1 / (1 + exp(-(a + b * z))) AS m, 1 / (1 + exp(-(c + z))) AS u FROM steps, g WHERE i < 25) GROUP BY 1, 2, 3, 4))
SELECT b, c FROM steps WHERE i = 25)"""
add("E4_calibration_line", lambda s, d: E.calibration_line(scores(s, d), "y", "s"), _LINE, ("fit",))
add(
    "E5_calibration_table",
    lambda s, d: E.calibration_table(scores(s, d), "y", "s", K),
    f"SELECT least(CASE WHEN rk = 1 THEN 0 ELSE ((rk - 1) * 10 - 1) // (tot - 1) END, 9) AS bin, count(*) AS n, avg(s) AS mean_p, avg(y) AS rate FROM (SELECT *, row_number() OVER (ORDER BY s, md5({K} || '|tie'), {K}) AS rk, count(*) OVER () AS tot FROM sc) GROUP BY 1",
)
_SEG = {"women": "CODE_GENDER = 'F'", "with score 1": "EXT_SOURCE_1 IS NOT NULL"}


def _segment_rows(s, d):
    return app(s, d).select(F.col(Y).alias("y"), F.round(F.lit(1.0) - F.coalesce("EXT_SOURCE_3", F.lit(0.5)), 2).alias("s"), F.col("AMT_CREDIT").alias("amt"), "CODE_GENDER", "EXT_SOURCE_1")


def _segments(s, d):
    t = E.by_segment(_segment_rows(s, d), {n: F.expr(e) for n, e in _SEG.items()}, "y", "s", "amt")
    return t["sizes"].join(t["ranking"], "segment").join(t["errors"], "segment")


def _segment_sql() -> str:
    out = []
    for n, e in _SEG.items():
        rows = f"(SELECT {Y} AS y, round(1 - coalesce(EXT_SOURCE_3, 0.5), 2) AS s FROM app1 WHERE {e})"
        groups = f"(SELECT *, sum(n) OVER w AS cn, sum(b) OVER w AS cb, sum(n) OVER () AS tn, sum(b) OVER () AS tb FROM (SELECT s, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS b FROM {rows} GROUP BY 1) WINDOW w AS (ORDER BY s))"
        rank = _RANK.replace("FROM sg)", f"FROM {groups})")
        out.append(f"SELECT '{n}' AS segment, (SELECT count(*) FROM {rows}) AS n, (SELECT sum(y) FROM {rows}) AS bads, r.*, (SELECT avg(power(y - s, 2)) FROM {rows}) AS brier, (SELECT -avg(CASE WHEN y = 1 THEN ln(s) ELSE ln(1 - s) END) FROM {rows}) AS log_loss FROM ({rank}) r")
    return union(out)


add("E6_by_segment", _segments, _segment_sql(), ("segment",))


def _segment_part(part):
    return lambda s, d: E.by_segment(_segment_rows(s, d), {n: F.expr(e) for n, e in _SEG.items()}, "y", "s", "amt")[part]


_SEG_ROWS = union(f"SELECT '{n}' AS segment, {Y} AS y, round(1 - coalesce(EXT_SOURCE_3, 0.5), 2) AS s, AMT_CREDIT AS amt FROM app1 WHERE {e}" for n, e in _SEG.items())
cte("seg_rows", _SEG_ROWS)
cte("seg_groups", "SELECT *, sum(n) OVER w AS cn, sum(b) OVER w AS cb, sum(n) OVER t AS tn, sum(b) OVER t AS tb, sum(x) OVER t AS tx, sum(a) OVER t AS ta FROM (SELECT segment, s, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS b, sum(amt) AS a, sum(amt * y) AS x FROM seg_rows GROUP BY 1, 2) WINDOW w AS (PARTITION BY segment ORDER BY s), t AS (PARTITION BY segment)")
add("E6_segment_curve", _segment_part("curve"), _curve_sql("seg_groups", "segment, "), ("segment",))
add(
    "E6_segment_line",
    _segment_part("line"),
    union(_LINE.replace("SELECT b AS slope", f"SELECT '{n}' AS segment, b AS slope").replace("FROM sc ", f"FROM seg_rows WHERE segment = '{n}' ") for n in _SEG),
    ("segment", "fit"),
)


def _fold_diffs(s, d):
    df = scores(s, d)
    folds = X.stratified_folds(df.withColumnRenamed("y", Y)).select(K, "seed", "fold")
    rows = df.join(folds, K)
    keys = ["seed", "fold"]
    a = E.ranking(E.score_groups(rows, "y", "s", keys), keys).select(*keys, F.col("auc").alias("a"))
    b = E.ranking(E.score_groups(rows, "y", "s2", keys), keys).select(*keys, F.col("auc").alias("b"))
    return checkpointed(a.join(b, keys))


add("E8_corrected_t", lambda s, d: E.corrected_t(_fold_diffs(s, d).withColumn("diff", F.col("a") - F.col("b"))).drop("p"), f"""WITH f AS ({folds_sql(P.SEEDS, P.N_FOLDS, '(SELECT ' + K + ', y AS TARGET FROM sc)')}), j AS (SELECT seed, fold, y, s, s2 FROM sc JOIN f USING ({K})),
auc AS (SELECT seed, fold, (sum(y * ra) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) - (sum(y * rb) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS d FROM (SELECT *, rank() OVER (PARTITION BY seed, fold ORDER BY s) + (count(*) OVER (PARTITION BY seed, fold, s) - 1) / 2 AS ra, rank() OVER (PARTITION BY seed, fold ORDER BY s2) + (count(*) OVER (PARTITION BY seed, fold, s2) - 1) / 2 AS rb FROM j) GROUP BY 1, 2)
SELECT count(*) AS n, avg(d) AS mean, avg(d) / sqrt((1 / count(*) + 0.25) * var_samp(d)) AS t FROM auc""")
_DL = """WITH c AS (SELECT y, CASE WHEN y = 1 THEN (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 - rank() OVER (PARTITION BY y ORDER BY s) - (count(*) OVER (PARTITION BY y, s) - 1) / 2) / n0 ELSE 1 - (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 - rank() OVER (PARTITION BY y ORDER BY s) - (count(*) OVER (PARTITION BY y, s) - 1) / 2) / n1 END AS a,
CASE WHEN y = 1 THEN (rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2 - rank() OVER (PARTITION BY y ORDER BY s2) - (count(*) OVER (PARTITION BY y, s2) - 1) / 2) / n0 ELSE 1 - (rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2 - rank() OVER (PARTITION BY y ORDER BY s2) - (count(*) OVER (PARTITION BY y, s2) - 1) / 2) / n1 END AS b
FROM sc, (SELECT sum(y) AS n1, sum(1 - y) AS n0 FROM sc)), v AS (SELECT avg(a) FILTER (WHERE y = 1) AS auc_a, avg(b) FILTER (WHERE y = 1) AS auc_b, sqrt(var_samp(a - b) FILTER (WHERE y = 1) / sum(y) + var_samp(a - b) FILTER (WHERE y = 0) / sum(1 - y)) AS se FROM c)
SELECT auc_a, auc_b, auc_a - auc_b AS diff, se, (auc_a - auc_b) / se AS z FROM v"""
add("E9_delong", lambda s, d: E.delong(scores(s, d), "y", "s", "s2").drop("p"), _DL)


def _decisions(s, d):
    return scores(s, d).select("y", (F.col("s") <= 0.75).cast("int").alias("a"), (F.col("s2") <= 0.72).cast("int").alias("b"))


_DEC = "(SELECT y, s <= 0.75 AS a, s2 <= 0.72 AS b FROM sc)"
add("E10_mcnemar", lambda s, d: E.mcnemar(_decisions(s, d), "y", "a", "b").drop("p"), f"SELECT {n_if('(a = (y = 0)) AND NOT (b = (y = 0))')} AS b, {n_if('NOT (a = (y = 0)) AND (b = (y = 0))')} AS c FROM {_DEC}")
add("E11_mcnemar_approved", lambda s, d: E.mcnemar_approved(_decisions(s, d), "y", "a", "b").drop("p"), f"SELECT {n_if('a AND NOT b')} AS only_a, {n_if('b AND NOT a')} AS only_b, {n_if('a AND NOT b AND y = 1')} AS bads_a, {n_if('b AND NOT a AND y = 1')} AS bads_b FROM {_DEC}")


def _contrast(s, d):
    t = _fold_diffs(s, d)
    rows = t.select(F.lit("m").alias("model"), F.lit("pesos").alias("strategy"), "seed", F.col("fold").alias("k"), F.col("b").alias("auc"), (1 - F.col("b")).alias("zone_rate")).unionByName(
        t.select(F.lit("m").alias("model"), F.lit("nada").alias("strategy"), "seed", F.col("fold").alias("k"), F.col("a").alias("auc"), (1 - F.col("a")).alias("zone_rate"))
    )
    return E.contrast_strategies(rows, "pesos", {"m": 1}).select("model", "strategy", "auc_mean", "zone_mean")


add("E13_contrast_strategies", _contrast, f"""WITH f AS ({folds_sql(P.SEEDS, P.N_FOLDS, '(SELECT ' + K + ', y AS TARGET FROM sc)')}), j AS (SELECT seed, fold, y, s, s2 FROM sc JOIN f USING ({K})),
auc AS (SELECT seed, fold, (sum(y * ra) - sum(y * rb)) / (sum(y) * sum(1 - y)) AS d FROM (SELECT *, rank() OVER (PARTITION BY seed, fold ORDER BY s) + (count(*) OVER (PARTITION BY seed, fold, s) - 1) / 2 AS ra, rank() OVER (PARTITION BY seed, fold ORDER BY s2) + (count(*) OVER (PARTITION BY seed, fold, s2) - 1) / 2 AS rb FROM j) GROUP BY 1, 2)
SELECT 'm' AS model, 'nada' AS strategy, avg(d) AS auc_mean, avg(d) AS zone_mean FROM auc""", ("model", "strategy"))

# -- models ------------------------------------------------------------------------------------

_MATRICES: dict[tuple[str, str], str] = {}


def encoded(s, d):
    """(train, valid): the fitted matrix of every declared column, written once for a session and folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _MATRICES:
        path = f"{scratch(s, 'encoded')}"
        _, tr, va = Pl.fit_matrices(checkpointed(clients(s, d)), split(s, d), Pl.feature_stages(Pr.full_buckets(), min_rows=20))
        sanitise_names(tr.withColumn("part", F.lit("train")).unionByName(va.withColumn("part", F.lit("valid")))).write.parquet(path)
        _MATRICES[key] = path
    both = s.read.parquet(_MATRICES[key])
    return both.filter("part = 'train'").drop("part"), both.filter("part = 'valid'").drop("part")


def features_of(df):
    """The encoded columns."""
    return [c for c in df.columns if c not in (K, Y)]


def _judged(fit):
    """Ranking of the valid part by a model fitted on the training part."""

    def run(s, d):
        tr, va = encoded(s, d)
        return E.ranking(E.score_groups(L.positive_probability(fit(tr, features_of(tr)), va), Y, "score"))

    return run


def _logistic(s, d):
    """Coefficients of the scaled logistic regression, and how far the gradient is from zero."""
    tr, _ = encoded(s, d)
    fit = Cells(tr, features_of(tr)).fit(balanced=True)
    return coefficients(s, fit).select("feature", "coefficient", "plain", F.lit(fit[0].gradient).alias("gradient"))


def _probabilities(s, d):
    tr, va = encoded(s, d)
    cells = Cells(va, features_of(tr))
    return cells.scores(Cells(tr, features_of(tr)).fit(balanced=True)).select(K, "score")


add("L1_logistic", _logistic)
add("L2_forest", _judged(lambda t, fx: L.fit_forest(t, fx, balanced=True)))
add("L3_boosted", _judged(lambda t, fx: L.fit_boosted(t, fx)))
add("L4_balanced_forest", _judged(lambda t, fx: L.fit_balanced_forest(t, fx)))
add("L6_class_one_probability", _probabilities)


def _floor(s, d):
    t = app(s, d).select(K, Y)
    folds = X.stratified_folds(t).withColumnRenamed("fold", "k")
    fit = folds.select(Y, "seed", F.explode(F.filter(F.array(*[F.lit(i) for i in range(P.N_FOLDS)]), lambda i: i != F.col("k"))).alias("k"))
    return E.constant_floor(fit, folds, Y, ["seed", "k"])


add("L7_constant_floor", _floor, f"SELECT seed, k, pd, sh * power(1 - pd, 2) + (1 - sh) * pd * pd AS brier, -(sh * ln(pd) + (1 - sh) * ln(1 - pd)) AS log_loss FROM (SELECT seed, fold AS k, avg({Y}) AS sh, (ts - sum({Y})) / (tn - count(*)) AS pd FROM ({folds_sql(P.SEEDS, P.N_FOLDS)}), (SELECT sum({Y}) AS ts, count(*) AS tn FROM lab) GROUP BY seed, fold, ts, tn)")


def _oof(s, d, balanced: bool):
    """Scores of the logistic regression of every seed and fold on the training matrix."""
    tr, _ = encoded(s, d)
    return L.logistic_folds(tr, checkpointed(X.stratified_folds(tr)), features_of(tr), balanced)


def _score_folds(s, d):
    oof, seen, _ = _oof(s, d, False)
    return L.per_fold_metrics(oof, seen, check=False)


add("L8_score_folds", _score_folds)


def _cell(s, d, part: int):
    oof, seen, _ = _oof(s, d, True)
    context = clients(s, d, "h").select(K, "AMT_CREDIT", "HAS_BUREAU_HISTORY")
    return L.compared("logistica", "pesos", oof, seen, context)[part]


add("L9_summary", lambda s, d: _cell(s, d, 0))
add("L10_strategy_cell", lambda s, d: _cell(s, d, 1))

# -- synthetic rows ----------------------------------------------------------------------------


def _scaled(s, d):
    """The training matrix with every column between its least and greatest value."""
    tr, _ = encoded(s, d)
    names = features_of(tr)
    # one row: two numbers a column
    ends = tr.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(names)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(names)]).first()
    unit = [((F.col(c).cast("double") - float(ends[f"a{i}"])) / (float(ends[f"b{i}"] - ends[f"a{i}"]) or 1.0)).alias(c) for i, c in enumerate(names)]
    return checkpointed(tr.select(K, Y, *unit)), names


def _grown(s, d):
    """Rows of each class, distinct ids, synthetic rows, and how many of their values lie in the range of the real minority."""
    df, names = _scaled(s, d)
    left = checkpointed(R2.synthetic_minority(df, names))
    # one row: the range of each feature
    ends = left.filter((F.col(Y) == 1) & (F.col(K) > 0)).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    inside = reduce(lambda x, y: x + y, [F.col(c).between(ends[f"lo{i}"] - 1e-12, ends[f"hi{i}"] + 1e-12).cast("int") for i, c in enumerate(names)])
    made = F.col(K) < 0
    return left.groupBy(Y).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(K).alias("ids"), F.count_if(made).alias("made"), F.count_if(made & (inside == len(names))).alias("made_inside"))


add(
    "X6_synthetic_minority",
    _grown,
    f"SELECT t.v AS {Y}, n, n AS ids, CASE WHEN t.v = 1 THEN n - m ELSE 0 END AS made, CASE WHEN t.v = 1 THEN n - m ELSE 0 END AS made_inside FROM (SELECT count(*) FILTER (WHERE {Y} = 0) AS n, count(*) FILTER (WHERE {Y} = 1) AS m FROM split_t WHERE split = 'train'), (VALUES (0), (1)) AS t(v)",
)


def _clean_synthetic(s, d):
    """What is left of the grown table once the rows of its Tomek links are gone."""
    left = checkpointed(R2.synthetic_without_links(*_scaled(s, d)))
    return left.groupBy(Y).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(K) < 0).alias("made"), F.count_distinct(K).alias("ids"))


add("X7_synthetic_without_links", _clean_synthetic)
#: Columns of the links that SQL can follow: whole coordinates keep equal distances equal on both engines.
_TX = {c: f"floor({c} * 1000)" for c in ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")} | {"AGE_YEARS": "floor(AGE_YEARS * 10)"} | {c: c for c in ("FLAG_WORK_PHONE", "FLAG_PHONE", "FLAG_EMAIL", "HAS_BUILDING_INFO")}
_TX_TEXT = {"OWN_CAR": "CASE WHEN FLAG_OWN_CAR = 'Y' THEN 1 ELSE 0 END", "CASH": "CASE WHEN NAME_CONTRACT_TYPE = 'Cash loans' THEN 1 ELSE 0 END"}


def _links(s, d):
    df = app(s, d)
    df = G.MedianImputer(columns=list(_TX)).fit(df).transform(df)
    return R2.tomek_links(checkpointed(df.select(K, Y, *[F.expr(e).cast("double").alias(c) for c, e in (_TX | _TX_TEXT).items()])), [*_TX, *_TX_TEXT])


_FILLED = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM app1)) AS {c}" for c in _TX)
_XS = ", ".join(f"x{i}" for i in range(len(_TX) + len(_TX_TEXT)))
_NNV = f"SELECT {K}, {Y}, {', '.join(f'{e} AS x{i}' for i, e in enumerate((_TX | _TX_TEXT).values()))} FROM (SELECT * REPLACE ({_FILLED}) FROM app1)"
_GAP = " + ".join(f"power(p.x{i} - q.x{i}, 2)" for i in range(len(_TX) + len(_TX_TEXT)))
add(
    "X7_tomek_links",
    _links,
    f"""WITH v AS ({_NNV}), u AS (SELECT {_XS}, min({K}) AS {K}, count(*) AS m, min({Y}) AS lo, max({Y}) AS hi FROM v GROUP BY {_XS}),
nn AS (SELECT p.{K} AS p, q.{K} AS q FROM u p JOIN u q ON p.{K} <> q.{K} QUALIFY row_number() OVER (PARTITION BY p.{K} ORDER BY {_GAP}, q.{K}) = 1)
SELECT x.p AS {K} FROM nn x JOIN nn y ON x.q = y.p AND y.q = x.p JOIN u ON u.{K} = x.p JOIN u w ON w.{K} = x.q WHERE u.m = 1 AND w.m = 1 AND u.lo <> w.lo
UNION SELECT v.{K} FROM v JOIN u USING ({_XS}) WHERE u.m = 2 AND u.lo <> u.hi""",
)
