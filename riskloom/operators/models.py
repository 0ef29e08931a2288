"""Classifiers on Spark ML and their out-of-fold evaluation.

Folds are a driver loop of distributed fits; all the measures of all folds come from one table of
out-of-fold scores, in one job per measure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import evaluation as E
from riskloom.operators.logistic import Cells
from riskloom.operators.splits import CLIENT, TARGET, class_sizes, per_class, undersample
from riskloom.session import checkpointed

WEIGHT = "_weight"


def balanced_weights(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Add a weight that gives both classes the same total."""
    sizes = class_sizes(df, target)
    total = sum(sizes.values())
    return df.withColumn(WEIGHT, per_class(target, {c: total / (len(sizes) * n) for c, n in sizes.items()}))


def assembler(features: Iterable[str], out: str = "features") -> VectorAssembler:
    """Features into a vector; a missing value fails."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def fit_logistic(df: DataFrame, features: Iterable[str], target: str = TARGET, balanced: bool = False, c: float = 1.0, max_iter: int = 1000):
    """Scaled logistic regression with ridge strength 1 / (C n)."""
    df = balanced_weights(df, target) if balanced else df.withColumn(WEIGHT, F.lit(1.0))
    n = df.agg(F.sum(WEIGHT).alias("w")).first()["w"]
    model = LogisticRegression(
        featuresCol="scaled", labelCol=target, weightCol=WEIGHT, regParam=1.0 / (c * n), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-6,
    )
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[assembler(features), scaler, model]).fit(df)


def fit_forest(df: DataFrame, features: Iterable[str], target: str = TARGET, balanced: bool = False, trees: int = 100, depth: int = 12, seed: int = 0):
    """Random forest. Features are binned, so scores are comparable in rank, not in value."""
    df = balanced_weights(df, target) if balanced else df.withColumn(WEIGHT, F.lit(1.0))
    model = RandomForestClassifier(
        labelCol=target, weightCol=WEIGHT, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed
    )
    return Pipeline(stages=[assembler(features), model]).fit(df)


def fit_boosted(df: DataFrame, features: Iterable[str], target: str = TARGET, balanced: bool = False, rounds: int = 100, depth: int = 5, seed: int = 0):
    """Gradient-boosted trees."""
    df = balanced_weights(df, target) if balanced else df.withColumn(WEIGHT, F.lit(1.0))
    model = GBTClassifier(labelCol=target, weightCol=WEIGHT, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)
    return Pipeline(stages=[assembler(features), model]).fit(df)


class AveragedModel(Transformer):
    """Mean class-1 probability of several fitted models."""

    def __init__(self, models: list):
        super().__init__()
        self.models = models

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = []
        for i, m in enumerate(self.models):
            dataset = positive_probability(m, dataset, f"_p{i}")
            names.append(f"_p{i}")
        mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
        return dataset.withColumn("score", mean).drop(*names)


def fit_balanced_forest(df: DataFrame, features: Iterable[str], target: str = TARGET, samples: int = 10, trees_each: int = 10, depth: int = 12, seed: int = 0, id_col: str = CLIENT) -> AveragedModel:
    """Trees grown on balanced samples of the classes, averaged."""
    features = list(features)
    return AveragedModel(
        [
            fit_forest(undersample(df, f"{seed}.{i}", id_col, target), features, target, trees=trees_each, depth=depth, seed=seed + i)
            for i in range(samples)
        ]
    )


def positive_probability(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1; a model of anything but two classes fails."""
    if isinstance(model, AveragedModel):
        return model.transform(df).withColumnRenamed("score", name)
    last = model.stages[-1]
    if last.numClasses != 2:
        raise ValueError(f"expected the classes 0 and 1, got {last.numClasses} classes")
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def score_folds(
    matrix: DataFrame, folds: DataFrame, fit: Callable[[DataFrame, list[str]], object], features: Iterable[str],
    target: str = TARGET, id_col: str = CLIENT, with_fit_scores: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """(out-of-fold scores, fitting-part scores), one row per client, seed and fold.

    ``folds`` has one row per client and seed with the fold that evaluates it, so the two parts of a
    fold are disjoint and complete by construction.
    """
    features = list(features)
    cells: dict[int, list[int]] = {}
    for r in folds.select("seed", "fold").distinct().orderBy("seed", "fold").collect():
        cells.setdefault(r["seed"], []).append(r["fold"])
    oof, fitted = [], []
    expected = matrix.count()
    for seed, ks in cells.items():
        # the matrix meets its folds once per seed, and every fit reads what that join left
        rows = checkpointed(matrix.join(folds.filter(F.col("seed") == seed).select(id_col, "fold"), id_col))
        met = rows.count()
        if met != expected:
            raise ValueError(f"seed {seed}: {met} rows of the matrix have a fold, {expected} were given")
        for k in ks:
            train, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
            model = fit(train.drop("fold"), features)
            parts = ((test, oof), (train, fitted)) if with_fit_scores else ((test, oof),)
            for part, out in parts:
                scored = positive_probability(model, part)
                out.append(scored.select(id_col, F.col(target).cast("int").alias(target), F.lit(seed).alias("seed"), F.lit(k).alias("k"), "score"))
    return reduce(DataFrame.unionByName, oof), reduce(DataFrame.unionByName, fitted) if fitted else None


def per_fold_metrics(oof: DataFrame, fit_scores: DataFrame | None = None, target: str = TARGET, check: bool = True) -> DataFrame:
    """Ranking of every fold and the gap to its fitting part. A fold whose AUC is not above 0.5 fails."""
    keys = ["seed", "k"]
    t = E.ranking(E.score_groups(oof, target, "score", keys), keys)
    if check:
        bad = F.raise_error(F.concat(F.lit("AUC not above 0.5 in fold "), F.concat_ws("/", "seed", "k"))).cast("double")
        t = t.withColumn("auc", F.when(F.col("auc") > 0.5, F.col("auc")).otherwise(bad))
    if fit_scores is not None:
        seen = E.ranking(E.score_groups(fit_scores, target, "score", keys), keys).select(*keys, F.col("auc").alias("auc_fit"))
        t = t.join(seen, keys).withColumn("gap", F.col("auc_fit") - F.col("auc"))
    return t


def require_one_score(oof: DataFrame, id_col: str = CLIENT) -> None:
    """Fail when a client has two out-of-fold scores of the same seed."""
    if oof.groupBy("seed", id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("a client has two out-of-fold scores of one seed")


def summarise(oof: DataFrame, context: DataFrame, per_fold: DataFrame, target: str = TARGET, id_col: str = CLIENT, amount: str = "AMT_CREDIT", presence: str = "HAS_BUREAU_HISTORY") -> dict[str, DataFrame]:
    """Cross-validated AUC and gap, mean curve over seeds, AUC without history and calibration."""
    rows = oof.join(context.select(id_col, amount, presence), id_col)
    curve = E.strategy_curve(E.score_groups(rows, target, "score", ["seed"], amount), ["seed"])
    mean_curve = curve.groupBy("rate").agg(
        *[F.avg(c).alias(c) for c in ("default_rate", "default_amount", "change_rate", "change_amount")]
    )
    thin = E.ranking(E.score_groups(rows.filter(F.col(presence) == 0), target, "score", ["seed"]), ["seed"])
    line = E.calibration_line(rows, target, "score", ["seed"])
    errors = E.calibration_errors(rows, target, "score", ["seed"])
    means = [F.avg("auc").alias("auc_cv"), F.stddev_samp("auc").alias("auc_std"), F.avg("avg_precision").alias("avg_precision"), F.avg("ks").alias("ks")]
    if "gap" in per_fold.columns:
        means.append(F.avg("gap").alias("gap"))
    head = per_fold.agg(*means)
    thin_auc = thin.agg(F.avg("auc")).scalar()
    cal = line.join(errors, "seed").agg(*[F.avg(c).alias(c) for c in ("slope", "intercept", "brier", "log_loss")])
    one = head.withColumn("auc_without_history", thin_auc)
    for c in ("slope", "intercept", "brier", "log_loss"):
        one = one.withColumn(c, cal.select(c).scalar())
    return {"summary": one, "curve": mean_curve}


def logistic_folds(
    matrix: DataFrame, folds: DataFrame, features: Iterable[str], balanced: bool = False, c: float = 1.0, target: str = TARGET, id_col: str = CLIENT
) -> tuple[DataFrame, DataFrame, list]:
    """(out-of-fold scores, fitting-part scores, fits) of the scaled logistic regression of every seed and fold, all fitted together."""
    cells = Cells(matrix, features, folds, target, id_col)
    fits = cells.fit(balanced, c)
    scored = checkpointed(cells.scores(fits))
    return scored.filter("held").drop("held"), scored.filter("NOT held").drop("held"), fits


def strategy_cell(
    model: str, strategy: str, matrix: DataFrame, folds: DataFrame, fit: Callable, features: Iterable[str], context: DataFrame,
    target: str = TARGET, id_col: str = CLIENT, amount: str = "AMT_CREDIT",
) -> tuple[DataFrame, DataFrame]:
    """One cell of the comparison: its summary row, and AUC and zone arrears of each fold."""
    oof, seen = score_folds(matrix, folds, fit, features, target, id_col)
    return compared(model, strategy, checkpointed(oof), checkpointed(seen), context, target, id_col, amount)


def compared(
    model: str, strategy: str, oof: DataFrame, seen: DataFrame, context: DataFrame, target: str = TARGET, id_col: str = CLIENT, amount: str = "AMT_CREDIT"
) -> tuple[DataFrame, DataFrame]:
    """Summary row, and AUC and zone arrears of each fold, of scores made by any model."""
    require_one_score(oof, id_col)
    folds_table = per_fold_metrics(oof, seen, target)
    keys = ["seed", "k"]
    rows = oof.join(context.select(id_col, amount), id_col)
    zone = E.in_zone(E.strategy_curve(E.score_groups(rows, target, "score", keys, amount), keys), keys)
    label = {"model": F.lit(model), "strategy": F.lit(strategy)}
    per_fold = folds_table.join(zone, keys).select(*keys, "auc", "zone_rate").withColumns(label)
    return summarise(oof, context, folds_table, target, id_col, amount)["summary"].withColumns(label), per_fold


FLOOR_FEATURES = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")
