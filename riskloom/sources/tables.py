"""Raw tables by logical name, with declared schemas: nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.functions.nullsafe import nan_to_null
from riskloom.operators.cleaning import clean_application, clean_training_application
from riskloom.operators.history import NUMBERS as HISTORY_NUMBERS, TEXTS as HISTORY_TEXTS
from riskloom.operators.previous import NUMBERS as PREVIOUS_NUMBERS, TEXTS as PREVIOUS_TEXTS

# File of each logical table
TABLE_FILES = {
    "application_train": "application_train.csv",
    "application_test": "application_test.csv",
    "bureau": "bureau.csv",
    "bureau_balance": "bureau_balance.csv",
    "previous_application": "previous_application.csv",
    "pos_cash": "POS_CASH_balance.csv",
    "credit_card": "credit_card_balance.csv",
    "installments": "installments_payments.csv",
}


def _fields(names: Iterable[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


SCHEMAS = {
    "bureau": T.StructType(
        _fields(("SK_ID_CURR", "SK_ID_BUREAU"), T.LongType())
        + _fields(HISTORY_TEXTS, T.StringType())
        + _fields(HISTORY_NUMBERS, T.DoubleType())
    ),
    "bureau_balance": T.StructType(
        [T.StructField("SK_ID_BUREAU", T.LongType()), T.StructField("MONTHS_BALANCE", T.IntegerType()), T.StructField("STATUS", T.StringType())]
    ),
    "previous_application": T.StructType(
        _fields(("SK_ID_PREV", "SK_ID_CURR"), T.LongType())
        + _fields(PREVIOUS_TEXTS, T.StringType())
        + _fields(PREVIOUS_NUMBERS, T.DoubleType())
        + _fields(("DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_TERMINATION", "AMT_DOWN_PAYMENT"), T.DoubleType())
        + _fields(("SELLERPLACE_AREA",), T.IntegerType())
    ),
}


# Text columns of the tables that have no field-by-field schema
TEXTS = (
    "NAME_CONTRACT_TYPE", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_TYPE_SUITE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE",
    "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "WEEKDAY_APPR_PROCESS_START", "ORGANIZATION_TYPE",
    "FONDKAPREMONT_MODE", "HOUSETYPE_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE", "NAME_CONTRACT_STATUS",
)


def _by_rule(header: list[str]) -> T.StructType:
    """Types of the wide tables by column name: keys and target are whole, the named texts are text, all else is a double."""
    kind = lambda c: T.StringType() if c in TEXTS else T.LongType() if c.startswith("SK_ID_") or c == "TARGET" else T.DoubleType()
    return T.StructType([T.StructField(c, kind(c)) for c in header])


def _by_name(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """A CSV with a header, its columns matched by name and typed by the declared schema."""
    header = spark.read.option("header", True).csv(path)
    if schema is None:
        schema = _by_rule(header.columns)
    have = set(header.columns)
    lacking = [f.name for f in schema.fields if f.name not in have]
    if lacking:
        raise ValueError(f"{path}: missing columns {lacking}")
    return header.select(*[header[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def load_table(
    spark: SparkSession,
    name: str,
    folder: str,
    fmt: str = "csv",
    columns: Iterable[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """One table by logical name, lazily; an unknown name fails listing the valid ones.

    ``columns`` prunes the scan. Parquet tables are read from ``<folder>/<name>.parquet``.
    """
    if name not in TABLE_FILES:
        raise ValueError(f"unknown table {name!r}, expected one of {sorted(TABLE_FILES)}")
    if fmt == "parquet":
        df = spark.read.parquet(f"{folder}/{name}.parquet")
    else:
        df = _by_name(spark, f"{folder}/{TABLE_FILES[name]}", schema or SCHEMAS.get(name))
    df = nan_to_null(df)
    return df.select(*columns) if columns else df


def load_all_tables(spark: SparkSession, folder: str, names: Iterable[str] | None = None, fmt: str = "csv") -> dict[str, DataFrame]:
    """Several tables by name."""
    return {n: load_table(spark, n, folder, fmt) for n in (names or TABLE_FILES)}


def load_auxiliaries(spark: SparkSession, folder: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Credit history, monthly panel and previous applications, in this order."""
    return tuple(load_table(spark, n, folder, fmt) for n in ("bureau", "bureau_balance", "previous_application"))


def load_clean_application(
    spark: SparkSession, folder: str, name: str = "application_train", fmt: str = "csv", schema: T.StructType | None = None
) -> DataFrame:
    """Main table, cleaned; rows are removed only when the target is there."""
    app = load_table(spark, name, folder, fmt, schema=schema)
    return clean_training_application(app) if "TARGET" in app.columns else clean_application(app)
