"""Scalar features of one row: absence flags, completeness and ratios."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.functions.nullsafe import differs, holds, ratio
from riskloom.operators.cleaning import present

# Source blocks of the absence features
BUILDING_AVERAGES = tuple(
    f"{c}_AVG"
    for c in (
        "APARTMENTS",
        "BASEMENTAREA",
        "COMMONAREA",
        "ELEVATORS",
        "ENTRANCES",
        "FLOORSMAX",
        "FLOORSMIN",
        "LANDAREA",
        "LIVINGAPARTMENTS",
        "LIVINGAREA",
        "NONLIVINGAPARTMENTS",
        "NONLIVINGAREA",
        "YEARS_BEGINEXPLUATATION",
        "YEARS_BUILD",
    )
)
BUILDING = (*BUILDING_AVERAGES, "TOTALAREA_MODE")
BUILDING_SUFFIXES = ("_AVG", "_MODE", "_MEDI")
BUILDING_TEXTS = ("FONDKAPREMONT_MODE", "HOUSETYPE_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE")
REQUEST_PREFIX = "AMT_REQ_CREDIT_BUREAU_"
REQUESTS = tuple(f"{REQUEST_PREFIX}{w}" for w in ("HOUR", "DAY", "WEEK", "MON", "QRT", "YEAR"))
SOCIAL = ("OBS_30_CNT_SOCIAL_CIRCLE", "DEF_30_CNT_SOCIAL_CIRCLE")
LATE_RATIOS = {
    "ANNUITY_TO_INCOME_RATIO": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "CHILDREN_TO_FAM_RATIO": ("CNT_CHILDREN", "CNT_FAM_MEMBERS"),
}
UNDECLARED_PURPOSES = ("XNA", "XAP")
CARD = "Credit card"


def building_block(df: DataFrame) -> list[str]:
    """Numeric building columns the frame has."""
    return sorted(c for c in df.columns if c.endswith(BUILDING_SUFFIXES) and c not in BUILDING_TEXTS)


def request_block(df: DataFrame) -> list[str]:
    """Bureau-request columns the frame has."""
    return sorted(c for c in df.columns if c.startswith(REQUEST_PREFIX))


def require_sources(df: DataFrame) -> None:
    """Both blocks exactly as declared, and the other sources present."""
    for what, declared, found in (
        ("building block", set(BUILDING), set(building_block(df))),
        ("request block", set(REQUESTS), set(request_block(df))),
    ):
        if declared != found:
            raise ValueError(f"{what}: missing {sorted(declared - found)}, unexpected {sorted(found - declared)}")
    needed = (*SOCIAL, "EXT_SOURCE_1", "EXT_SOURCE_3", "DAYS_BIRTH", "DAYS_EMPLOYED", "AMT_CREDIT", "AMT_GOODS_PRICE")
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise ValueError(f"layer 1 sources missing: {lacking}")


def completeness(columns: list[str]) -> Column:
    """How many of the columns are present in the row."""
    return reduce(add, [F.col(c).isNotNull().cast("int") for c in columns])


def all_present(columns: list[str]) -> Column:
    """1 when every column is present in the row."""
    return reduce(and_, [F.col(c).isNotNull() for c in columns]).cast("int")


def add_absence_flags(df: DataFrame) -> DataFrame:
    """Completeness of the building block, presence of the blocks, absence of the two scores."""
    new: dict[str, Column] = {}
    if block := building_block(df):
        new["BUILDING_INFO_COUNT"] = completeness(block)
        new["HAS_BUILDING_INFO"] = (completeness(block) > 0).cast("int")
    if block := request_block(df):
        new["HAS_BUREAU_INFO"] = all_present(block)
    if block := present(df, SOCIAL):
        new["HAS_SOCIAL_INFO"] = all_present(block)
    for c in present(df, ("EXT_SOURCE_1", "EXT_SOURCE_3")):
        new[f"FLAG_{c}_NULL"] = F.col(c).isNull().cast("int")
    return df.withColumns(new) if new else df


def add_ratios(df: DataFrame) -> DataFrame:
    """Age in years, share of life employed, credit over goods price."""
    have, new = set(df.columns), {}
    if "DAYS_BIRTH" in have:
        new["AGE_YEARS"] = -F.col("DAYS_BIRTH") / P.DAYS_PER_YEAR
        if "DAYS_EMPLOYED" in have:
            new["EMPLOYED_TO_AGE_RATIO"] = ratio("DAYS_EMPLOYED", "DAYS_BIRTH")
    if {"AMT_CREDIT", "AMT_GOODS_PRICE"} <= have:
        new["LTV"] = ratio("AMT_CREDIT", "AMT_GOODS_PRICE")
    return df.withColumns(new) if new else df


def layer_one(df: DataFrame) -> DataFrame:
    """Every parameter-free feature of the main table."""
    return df.transform(add_absence_flags).transform(add_ratios)


def add_late_ratios(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Ratios whose inputs are winsorised first."""
    names = list(LATE_RATIOS) if names is None else names
    return df.withColumns({n: ratio(*LATE_RATIOS[n]) for n in names}) if names else df


def term_end_date() -> Column:
    """Planned end of term credits only; cards revolve and have none."""
    return F.when(differs("CREDIT_TYPE", CARD), F.col("DAYS_CREDIT_ENDDATE"))


def grant_ratio() -> Column:
    """Granted over requested, where both are positive."""
    asked, given = F.col("AMT_APPLICATION").cast("double"), F.col("AMT_CREDIT").cast("double")
    return F.when(holds((asked > 0) & (given > 0)), F.try_divide(given, asked))


def purpose_declared() -> Column:
    """Whether the application states a purpose."""
    c = F.col("NAME_CASH_LOAN_PURPOSE")
    return c.isNotNull() & ~holds(c.isin(*UNDECLARED_PURPOSES))


def combination_defined() -> Column:
    """Whether the application carries a product combination."""
    return F.col("PRODUCT_COMBINATION").isNotNull()


def is_recent(window: float, origin: Column | None = None) -> Column:
    """Decided less than ``window`` days before the origin (today by default); the edge is out."""
    days = F.col("DAYS_DECISION")
    return holds((days if origin is None else days - origin) > -window)


def arrears_state() -> Column:
    """With arrears, reported as zero, or unreported; NULL without history."""
    return F.when(
        holds(F.col("HAS_BUREAU_HISTORY") == 1),
        F.when(F.col("BUREAU_OVERDUE_UNION") == 1, "con_mora")
        .when(F.col("HAS_BUREAU_OVERDUE_HISTORY") == 1, "reportada_cero")
        .otherwise("sin_reportar"),
    )


def annuity_state() -> Column:
    """No annuity reported, reported as zero, or with a value."""
    return F.when(
        holds(F.col("HAS_BUREAU_HISTORY") == 1),
        F.when(F.col("HAS_BUREAU_ANNUITY") == 0, "sin_cuota")
        .when(F.col("BUREAU_CREDITS_WITH_ANNUITY_COUNT") == 0, "cuota_cero")
        .otherwise("cuota_con_valor"),
    )


def identity_ages(df: DataFrame) -> DataFrame:
    """Age at document issue and at registration, which do not depend on the application date."""
    return df.withColumns(
        {
            "EDAD_A_ID": F.col("DAYS_BIRTH") - F.col("DAYS_ID_PUBLISH"),
            "EDAD_A_REGISTRO": F.col("DAYS_BIRTH") - F.col("DAYS_REGISTRATION"),
        }
    )


def logit(p: Column) -> Column:
    """Log-odds of a probability kept away from 0 and 1."""
    eps = P.PROBABILITY_CLIP
    q = F.when(p < eps, eps).when(p > 1 - eps, 1 - eps).otherwise(p)
    return F.ln(q / (1 - q))
