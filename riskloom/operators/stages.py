"""Fitted feature stages as ML estimators and models.

Every stage is fitted on the training part and applied anywhere. Fitting is permissive with columns
that are absent; applying fails by name when a fitted column is missing. The fitted state is small and
travels as JSON inside the model, so a fitted chain is saved and loaded like any other ML model.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import params as P
from riskloom.functions.nullsafe import clip_upper
from riskloom.operators.binning import numbers_of
from riskloom.operators.cleaning import recode_domain
from riskloom.operators.features import LATE_RATIOS, add_late_ratios
from riskloom.operators.ranks import exact_quantiles, hash_of
from riskloom.operators.woe import bin_counts, woe_table
from riskloom.session import checkpoint_dir, checkpointed

ID, TARGET = "SK_ID_CURR", "TARGET"
# Winsorised columns and the ones capped at the bare percentile
WINSOR_COLUMNS = (
    "AMT_INCOME_TOTAL",
    "DEF_30_CNT_SOCIAL_CIRCLE",
    "DEF_60_CNT_SOCIAL_CIRCLE",
    "OBS_30_CNT_SOCIAL_CIRCLE",
    "AMT_REQ_CREDIT_BUREAU_QRT",
    "AMT_REQ_CREDIT_BUREAU_MON",
    "AMT_REQ_CREDIT_BUREAU_WEEK",
    "CNT_CHILDREN",
    "CNT_FAM_MEMBERS",
    "OWN_CAR_AGE",
)
WINSOR_FACTORS = {"OWN_CAR_AGE": 1.0}
UNKNOWN_CODE = -1


def quoted(name: str) -> Column:
    """Column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


class _Settings(Params):
    settings = Param(Params._dummy(), "settings", "settings as JSON", TypeConverters.toString)

    def get(self, name: str, default=None):
        """One setting."""
        return json.loads(self.getOrDefault(self.settings)).get(name, default)


class _Stage(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator whose settings are keyword arguments."""

    model: type

    def __init__(self, **settings):
        super().__init__()
        self._set(settings=json.dumps(settings))

    def state_of(self, df: DataFrame) -> dict:
        """Fitted state, from the training rows."""
        raise NotImplementedError

    def _fit(self, dataset: DataFrame):
        fitted = self.model()
        return fitted._set(settings=self.getOrDefault(self.settings), state=json.dumps(self.state_of(dataset)))


class _Fitted(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Model with its state as JSON."""

    state = Param(Params._dummy(), "state", "fitted state as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    def fitted(self, name: str, default=None):
        """One entry of the fitted state."""
        return json.loads(self.getOrDefault(self.state)).get(name, default)

    def needs(self) -> Iterable[str]:
        """Columns the fit saw and the transform must find."""
        return ()

    def apply(self, df: DataFrame) -> DataFrame:
        """The transform itself."""
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        missing = sorted(set(self.needs()) - set(dataset.columns))
        if missing:
            raise ValueError(f"fitted columns missing from the frame: {missing}")
        return self.apply(dataset)


# -- winsorising and ratios --------------------------------------------------------------------


class WinsorModel(_Fitted):
    """Caps from above at the fitted limits."""

    def needs(self):
        return self.fitted("limits")

    def apply(self, df):
        limits = self.fitted("limits")
        return df.withColumns({c: clip_upper(quoted(c), v) for c, v in limits.items()}) if limits else df

    def report(self, spark, reference: Mapping[str, float] | None = None) -> DataFrame:
        """Fitted limit of each column against an optional reference."""
        ref, n = dict(reference or {}), self.fitted("n")
        factors = self.get("factors", WINSOR_FACTORS)
        rows = []
        for c, v in self.fitted("limits").items():
            k = float(factors.get(c, P.WINSOR_FACTOR))
            base = ref.get(c)
            rows.append((c, n[c], v / k, k, v, base, None if not base else (v / base - 1) * 100))
        return spark.createDataFrame(rows, "feature string, n bigint, percentile double, factor double, cap double, reference double, deviation_pct double")


class Winsorizer(_Stage):
    """Cap at a multiple of the 99th percentile of the reported training values."""

    model = WinsorModel

    def state_of(self, df):
        columns = [c for c in self.get("columns", WINSOR_COLUMNS) if c in df.columns]
        factors = self.get("factors", WINSOR_FACTORS)
        q = exact_quantiles(df, columns, [P.WINSOR_PERCENTILE]) if columns else {}
        counts = df.agg(*[F.count(quoted(c)).alias(c) for c in columns]).first() if columns else {}
        limits = {c: float(factors.get(c, P.WINSOR_FACTOR)) * q[(c,)][0] for c in columns if (c,) in q}
        return {"limits": limits, "n": {c: counts[c] for c in limits}}


class LateRatiosModel(_Fitted):
    """Builds the ratios whose inputs were there at fit."""

    def needs(self):
        return [c for n in self.fitted("names") for c in LATE_RATIOS[n]]

    def apply(self, df):
        return add_late_ratios(df, self.fitted("names"))


class LateRatioBuilder(_Stage):
    """Notes which ratios can be built."""

    model = LateRatiosModel

    def state_of(self, df):
        return {"names": [n for n, parts in LATE_RATIOS.items() if set(parts) <= set(df.columns)]}


class DomainRecoder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Hour, weekday and occupation recoding."""

    def _transform(self, dataset):
        return recode_domain(dataset)


class ColumnContract(Transformer, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """The frame must have exactly the declared columns, besides identifier and target."""

    def __init__(self, **settings):
        super().__init__()
        self._set(settings=json.dumps(settings))

    def _transform(self, dataset):
        declared = set(self.get("columns", []))
        found = set(dataset.columns) - {ID, TARGET}
        if declared != found:
            raise ValueError(f"columns: missing {sorted(declared - found)}, unexpected {sorted(found - declared)}")
        return dataset


# -- categories --------------------------------------------------------------------------------


#: Fitted levels of a stage that travel inside the model and its expressions; more of them stay a table that is joined.
INLINE_LEVELS = 2000


def level_table(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(c, v, n): rows of every level of every column, missing included, in one aggregate."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).cast("string").alias("v")) for c in columns])
    return df.select(F.explode(cells).alias("x")).groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))


def kept_levels(table: DataFrame) -> dict:
    """Fitted state of a table of levels: its rows while there are few, else the path it was written to.

    The table is written once to the shared folder of the session and counted there. A model whose state is a path
    needs that folder for as long as it is used.
    """
    spark = table.sparkSession
    path = f"{checkpoint_dir(spark)}/levels-{uuid.uuid4().hex}"
    table.write.parquet(path)
    rows = spark.read.parquet(path).limit(INLINE_LEVELS + 1).collect()
    if len(rows) > INLINE_LEVELS:
        return {"path": path}
    return {"rows": sorted((list(r) for r in rows), key=lambda r: (r[0], r[1] is None, r[1]))}


def texts_of(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    """The listed text columns of the frame, or all of them."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return names if columns is None else [c for c in columns if c in names]


class _LevelsModel(_Fitted):
    """A model whose state is a table of levels (c, v, ...)."""

    def needs(self):
        return self.fitted("columns")

    def inline(self, c: str) -> list[list] | None:
        """Rows of one column without its name, or None when the state is a written table."""
        rows = self.fitted("rows")
        return None if rows is None else [r[1:] for r in rows if r[0] == c]

    def table(self, spark, schema: str) -> DataFrame:
        """The whole state as a frame."""
        path = self.fitted("path")
        return spark.read.parquet(path) if path else spark.createDataFrame([tuple(r) for r in self.fitted("rows")], schema)

    def met(self, df: DataFrame, c: str, key: Column) -> DataFrame:
        """The frame with ``_hit``, the written row of the column's level, or NULL."""
        table = df.sparkSession.read.parquet(self.fitted("path")).filter(F.col("c") == c)
        return df.join(table.select(F.col("v").alias("_v"), F.struct("*").alias("_hit")), key.eqNullSafe(F.col("_v")), "left").drop("_v")


class RareGrouperModel(_LevelsModel):
    """Sends rare levels to the residual; a level unseen at fit passes through."""

    def apply(self, df):
        for c in self.fitted("columns"):
            levels = self.inline(c)
            if levels is None:
                df = self.met(df, c, quoted(c))
                df = df.withColumn(c, F.when(F.col("_hit").isNotNull(), P.RESIDUAL_LEVEL).otherwise(quoted(c))).drop("_hit")
                continue
            named = [v for v, _ in levels if v is not None]
            hit = F.coalesce(quoted(c).isin(*named), F.lit(False)) if named else F.lit(False)
            if len(named) < len(levels):
                hit = hit | quoted(c).isNull()
            df = df.withColumn(c, F.when(hit, P.RESIDUAL_LEVEL).otherwise(quoted(c)))
        return df

    def report(self, spark) -> DataFrame:
        """Absorbed levels with their rows."""
        t = self.table(spark, "c string, v string, n bigint")
        return t.select(F.col("c").alias("feature"), F.coalesce("v", F.lit("(nulo)")).alias("level"), "n", F.lit(P.RESIDUAL_LEVEL).alias("residual"))


class RareGrouper(_Stage):
    """Levels with too few training rows go to one residual level per column."""

    model = RareGrouperModel

    def state_of(self, df):
        columns = texts_of(df, self.get("columns"))
        if not columns:
            return {"columns": [], "rows": []}
        few = F.col("n") < self.get("min_rows", P.MIN_CATEGORY_ROWS)
        counted = checkpointed(level_table(df, columns))
        taken = F.bool_or(F.col("v").eqNullSafe(P.RESIDUAL_LEVEL))
        # one row per column
        marks = {r["c"]: r for r in counted.groupBy("c").agg(F.bool_or(few).alias("few"), taken.alias("taken")).collect()}
        affected = [c for c in columns if c in marks and marks[c]["few"]]
        for c in affected:
            if marks[c]["taken"]:
                raise ValueError(f"{c} already has a level {P.RESIDUAL_LEVEL!r}")
        return {"columns": affected} | kept_levels(counted.filter(few))


class OneHotModel(_Fitted):
    """One 0/1 column per fitted level; an unknown level is all zeros."""

    def needs(self):
        return self.fitted("levels")

    def apply(self, df):
        levels = self.fitted("levels")
        new = {}
        for c, values in levels.items():
            for v in values[1:] if len(values) == 2 else values:
                new[f"{c}_{'nan' if v is None else v}"] = quoted(c).cast("string").eqNullSafe(F.lit(v)).cast("int")
        return df.withColumns(new).drop(*levels) if levels else df


class OneHot(_Stage):
    """Levels of each column, missing included; a two-level column keeps its second level only.

    Every level becomes a column, so the levels must be few: more than ``INLINE_LEVELS`` in all is an error.
    """

    model = OneHotModel

    def state_of(self, df):
        columns = [c for c in self.get("columns") if c in df.columns]
        levels: dict[str, list] = {c: [] for c in columns}
        rows = level_table(df, columns).limit(INLINE_LEVELS + 1).collect() if columns else []
        if len(rows) > INLINE_LEVELS:
            raise ValueError(f"one column per level: over {INLINE_LEVELS} levels in {columns}")
        for r in sorted(rows, key=lambda r: (r["v"] is None, r["v"])):
            levels[r["c"]].append(r["v"])
        return {"levels": levels}


class WoeModel(_LevelsModel):
    """Each level replaced by its evidence, unseen levels by 0; the column is renamed."""

    def apply(self, df):
        for c in self.fitted("columns"):
            key, levels = F.coalesce(quoted(c).cast("string"), F.lit(P.NULL_LEVEL)), self.inline(c)
            if levels is None:
                df = self.met(df, c, key)
                df = df.withColumn(f"{c}_WOE", F.coalesce("_hit.woe", F.lit(0.0))).drop("_hit", c)
            else:
                df = df.withColumn(f"{c}_WOE", _mapped(key, dict(levels), 0.0)).drop(c)
        return df

    def report(self, spark) -> DataFrame:
        """Evidence of each level."""
        level = F.when(F.col("v") == P.NULL_LEVEL, "(nulo)").otherwise(F.col("v"))
        return self.table(spark, "c string, v string, woe double").select(F.col("c").alias("feature"), level.alias("level"), "woe")


class WoeEncoder(_Stage):
    """Evidence per level of the training rows; needs the target."""

    model = WoeModel

    def state_of(self, df):
        target = self.get("target", TARGET)
        if target not in df.columns:
            raise ValueError("evidence needs the target: there are no bads to count without it")
        columns = texts_of(df, self.get("columns"))
        if not columns:
            return {"columns": [], "rows": []}
        real = df.agg(*[F.bool_or(quoted(c) == P.NULL_LEVEL).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        clash = [c for i, c in enumerate(columns) if real[i]]
        if clash:
            raise ValueError(f"columns with a real {P.NULL_LEVEL!r} level: {clash}")
        labels = {c: F.coalesce(quoted(c), F.lit(P.NULL_LEVEL)) for c in columns}
        woe = woe_table(bin_counts(df, labels, target)).select(F.col("feature").alias("c"), F.col("bin").alias("v"), "woe")
        return {"columns": columns} | kept_levels(woe)


def _mapped(key: Column, table: Mapping, default) -> Column:
    """Value of a fitted table by key. The table is fitted state, held by the driver."""
    if not table:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


class TargetMeanModel(_LevelsModel):
    """Smoothed target mean per level. Training rows get the mean of the other folds."""

    def apply(self, df):
        return self._encoded(df, lambda row: row[0], F.col("_hit.mean"), F.lit(self.fitted("overall")))

    def transform_train(self, df: DataFrame) -> DataFrame:
        """Encoding of the training rows, each from the folds it is not in."""
        fold = fold_of(self.get("id_col", ID), self.get("folds", 5), self.get("seed", 42))
        rest = F.get(F.array(*[F.lit(v) for v in self.fitted("overall_by_fold")]), fold)
        return self._encoded(df, lambda row: F.array(*[F.lit(v) for v in row[1]]), F.get("_hit.others", fold), rest, fold)

    def _encoded(self, df, of_row, of_hit, default, at=None) -> DataFrame:
        for c in self.fitted("columns"):
            key, levels = F.coalesce(quoted(c).cast("string"), F.lit(P.NULL_LEVEL)), self.inline(c)
            if levels is None:
                df = self.met(df, c, key).withColumn(c, F.coalesce(of_hit, default)).drop("_hit")
                continue
            pairs = F.create_map(*[x for v, *row in levels for x in (F.lit(v), of_row(row) if at is not None else F.lit(of_row(row)))])
            hit = F.try_element_at(pairs, key) if levels else F.lit(None).cast("double")
            df = df.withColumn(c, F.coalesce(F.get(hit, at) if at is not None and levels else hit, default))
        return df


def fold_of(id_col: str, folds: int, seed: int | str) -> Column:
    """Fold of a row from the hash of its id."""
    number = F.conv(F.substring(hash_of(id_col, seed), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(folds)).cast("int")


class TargetMeanEncoder(_Stage):
    """Target mean per level with an explicit smoothing weight and internal cross-fitting."""

    model = TargetMeanModel

    def state_of(self, df):
        target, folds, m = self.get("target", TARGET), self.get("folds", 5), float(self.get("smoothing", 20.0))
        columns = [c for c in self.get("columns") if c in df.columns]
        fold = fold_of(self.get("id_col", ID), folds, self.get("seed", 42))
        known = df.filter(F.col(target).isNotNull()).withColumns({"_f": fold, "_y": F.col(target).cast("double")})
        # one row per fold
        per_fold = {r["_f"]: (r["n"], r["s"]) for r in known.groupBy("_f").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")).collect()}
        n, s = (sum(v[i] for v in per_fold.values()) for i in (0, 1))
        overall = s / n if n else 0.0
        rest = []
        for f in range(folds):
            fn, fs = per_fold.get(f, (0, 0.0))
            rest.append((s - fs) / (n - fn) if n > fn else overall)
        state = {"columns": columns, "overall": overall, "overall_by_fold": rest}
        if not columns:
            return state | {"rows": []}
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(quoted(c).cast("string"), F.lit(P.NULL_LEVEL)).alias("v")) for c in columns])
        inside = [F.col("_f") == f for f in range(folds)]
        sums = known.select("_f", "_y", F.explode(cells).alias("x")).groupBy("x.c", "x.v").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_y").alias("s"),
            F.array(*[F.count_if(i) for i in inside]).alias("fn"),
            F.array(*[F.coalesce(F.sum(F.when(i, F.col("_y"))), F.lit(0.0)) for i in inside]).alias("fs"),
        )

        def others(f: int) -> Column:
            left, bads = F.col("n") - F.get("fn", F.lit(f)), F.col("s") - F.get("fs", F.lit(f))
            return F.when(left == 0, F.lit(rest[f])).otherwise((bads + m * rest[f]) / (left + m))

        mean = (F.col("s") + m * overall) / (F.col("n") + m)
        return state | kept_levels(sums.select("c", "v", mean.alias("mean"), F.array(*[others(f) for f in range(folds)]).alias("others")))


class OrdinalModel(_Fitted):
    """Position in the declared hierarchy; missing and unknown are -1."""

    def needs(self):
        return self.fitted("orders")

    def apply(self, df):
        new = {
            c: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in order]), quoted(c)) - 1, F.lit(UNKNOWN_CODE)).cast("int")
            for c, order in self.fitted("orders").items()
        }
        return df.withColumns(new) if new else df


class OrdinalEncoder(_Stage):
    """Codes of ordered categories."""

    model = OrdinalModel

    def state_of(self, df):
        return {"orders": {c: list(v) for c, v in self.get("orders").items() if c in df.columns}}


# -- imputation --------------------------------------------------------------------------------


class ImputerModel(_Fitted):
    """Missing values replaced by the fitted ones."""

    def needs(self):
        return self.fitted("values")

    def apply(self, df):
        values = self.fitted("values")
        return df.withColumns({c: F.coalesce(quoted(c).cast("double"), F.lit(float(v))) for c, v in values.items()}) if values else df


class MedianImputer(_Stage):
    """Exact median of the reported training values; a column without any is filled with 0."""

    model = ImputerModel

    def state_of(self, df):
        columns = [c for c in self.get("columns") if c in df.columns]
        q = exact_quantiles(df, numbers_of(df, columns), [0.5]) if columns else {}
        return {"values": {c: q[(c,)][0] if (c,) in q else 0.0 for c in columns}}


class ZeroImputer(_Stage):
    """Flags: what is not on record is not asserted."""

    model = ImputerModel

    def state_of(self, df):
        return {"values": {c: 0.0 for c in self.get("columns") if c in df.columns}}


class ColumnDropModel(_Fitted):
    """Drops the columns the fit marked."""

    def needs(self):
        return [c for c in self.fitted("kept") if c not in (ID, TARGET)]

    def apply(self, df):
        return df.drop(*[quoted(c) for c in self.fitted("dropped") if c in df.columns])


class ConstantDropper(_Stage):
    """Drops the columns with one single training value."""

    model = ColumnDropModel

    def state_of(self, df):
        columns = [c for c in numbers_of(df, df.columns) if c not in (ID, TARGET)]
        row = df.agg(*[(F.min(quoted(c)).eqNullSafe(F.max(quoted(c)))).alias(f"k{i}") for i, c in enumerate(columns)]).first()
        dropped = [c for i, c in enumerate(columns) if row[f"k{i}"]]
        return {"dropped": dropped, "kept": [c for c in df.columns if c not in dropped]}


def fit_transform(stages: Iterable, train: DataFrame) -> tuple[list, DataFrame]:
    """Fit a chain on the training rows. The returned training matrix is the cross-fitted one."""
    fitted, df = [], train
    for stage in stages:
        model = stage.fit(df) if isinstance(stage, Estimator) else stage
        df = model.transform_train(df) if hasattr(model, "transform_train") else model.transform(df)
        fitted.append(model)
    return fitted, df


def apply_all(fitted: Iterable, df: DataFrame) -> DataFrame:
    """Apply a fitted chain."""
    for model in fitted:
        df = model.transform(df)
    return df
