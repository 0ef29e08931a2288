"""Contracts that must fail loudly, and tables read from CSV."""

import pytest
from helpers import by_key, previous
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.operators import models
from riskloom.operators.previous import truncated_history
from riskloom.sources.tables import load_table


def test_fractional_day_fails_the_oldest_day(spark):
    whole = previous(spark, [{"SK_ID_CURR": 1, "DAYS_DECISION": -100.0, "NAME_CLIENT_TYPE": "Repeater"}, {"SK_ID_CURR": 1, "DAYS_DECISION": -5.0}, {"SK_ID_CURR": 2, "DAYS_DECISION": -100.0}])
    got = by_key(whole.groupBy("SK_ID_CURR").agg(truncated_history().alias("x")))
    assert (got[1]["x"], got[2]["x"]) == (1, 0)
    broken = previous(spark, [{"SK_ID_CURR": 1, "DAYS_DECISION": -100.5}])
    with pytest.raises(PySparkException, match="fraction of a day"):
        broken.groupBy("SK_ID_CURR").agg(truncated_history().alias("x")).collect()


def test_a_client_without_fold_is_an_error(spark):
    matrix = spark.createDataFrame([(i, i % 2, float(i)) for i in range(6)], "SK_ID_CURR bigint, TARGET int, x double")
    folds = spark.createDataFrame([(i, 1, i % 2) for i in range(5)], "SK_ID_CURR bigint, seed int, fold int")
    with pytest.raises(ValueError, match="5 rows of the matrix have a fold, 6 were given"):
        models.score_folds(matrix, folds, lambda df, features: None, ["x"])


def test_main_table_from_csv_is_typed(spark, tmp_path):
    (tmp_path / "application_train.csv").write_text("SK_ID_CURR,TARGET,CODE_GENDER,DAYS_BIRTH,EXT_SOURCE_1\n7,1,F,-13.0,\n8,0,M,-20,0.5\n")
    df = load_table(spark, "application_train", str(tmp_path))
    assert dict(df.dtypes) == {"SK_ID_CURR": "bigint", "TARGET": "bigint", "CODE_GENDER": "string", "DAYS_BIRTH": "double", "EXT_SOURCE_1": "double"}
    assert df.agg(F.sum("DAYS_BIRTH")).first()[0] == -33 and df.filter("EXT_SOURCE_1 IS NULL").count() == 1
