"""The fold cache: every part of every fold, whatever the layout, and a manifest that comes last."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.splits import stratified_folds
from riskloom.sources import artifacts as R

SEEDS = (0, 1, 2)


def _rows(spark, n=90):
    return spark.range(n).select(
        F.col("id").alias("SK_ID_CURR"), (F.col("id") % 3 == 0).cast("int").alias("TARGET"), F.when(F.col("id") % 7 > 0, F.col("id") / 7).alias("x")
    )


def _parts(spark, path):
    return {
        (seed, k, part): sorted(map(tuple, df.collect()), key=str)
        for seed, k, fit, held in R.read_folds(spark, path, "mark")
        for part, df in (("fit", fit), ("eval", held))
    }


def test_a_dealt_cache_writes_each_row_once_and_reads_as_the_refitted_one(spark, tmp_path):
    rows, path, plain = _rows(spark), str(tmp_path / "dealt"), str(tmp_path / "plain")
    folds = stratified_folds(rows, SEEDS).select("SK_ID_CURR", "seed", "fold")
    R.write_dealt_folds(rows, folds, rows.select("SK_ID_CURR", "TARGET"), "mark", path)
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{path}/dealt").count() == 90

    dealt = rows.join(folds, "SK_ID_CURR").localCheckpoint()

    def parts():
        for s in SEEDS:
            for k in range(5):
                for part, here in (("fit", F.col("fold") != k), ("eval", F.col("fold") == k)):
                    yield s, k, part, dealt.filter((F.col("seed") == s) & here).drop("seed", "fold")

    R.write_folds(parts(), rows.select("SK_ID_CURR", "TARGET"), "mark", plain)
    got, want = _parts(spark, path), _parts(spark, plain)
    assert len(got) == 30 and got == want
    assert R.read_fold(spark, path, 0, 0, "eval", dealt=True).dtypes == [("SK_ID_CURR", "bigint"), ("TARGET", "int"), ("x", "float")]
    assert R.read_manifest(spark, path, "mark") == [(s, k) for s in SEEDS for k in range(5)]
    assert R.read_context(spark, path, "mark").count() == 90


def test_a_dealt_cache_refuses_what_it_cannot_read_back(spark, tmp_path):
    rows, path = _rows(spark), str(tmp_path / "cache")
    folds = stratified_folds(rows, SEEDS).select("SK_ID_CURR", "seed", "fold")
    context = rows.select("SK_ID_CURR", "TARGET")
    with pytest.raises(Exception, match="no fold"):
        R.write_dealt_folds(rows, folds.filter("NOT (seed = 1 AND SK_ID_CURR = 5)"), context, "mark", path)
    with pytest.raises(FileNotFoundError):
        R.read_manifest(spark, path, "mark")
    R.write_dealt_folds(rows, folds, context, "mark", path)
    with pytest.raises(FileExistsError):
        R.write_dealt_folds(rows, folds, context, "mark", path)
    with pytest.raises(ValueError, match="something else"):
        R.read_manifest(spark, path, "other")
