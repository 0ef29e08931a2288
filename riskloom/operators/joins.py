"""Joins between clients and their aggregates.

A client without rows keeps NULL in every aggregate and gets a presence flag; nothing is filled.
Which side to broadcast is left to the optimizer, which knows the sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.nullsafe import holds

CLIENT = "SK_ID_CURR"


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """Fail (one action) when a key repeats; otherwise hand the frame back."""
    seen = [r[key] for r in repeated_keys(df, key).limit(10).collect()]
    if seen:
        raise ValueError(f"{what}: repeated {key}, for example {seen}")
    return df


def left_with_presence(clients: DataFrame, agg: DataFrame, witness: str, flag: str, key: str = CLIENT, check: bool = False) -> DataFrame:
    """Left join of a per-client aggregate with its presence flag.

    The aggregates of this library are grouped by the key, so unique by construction; ``check``
    verifies a right side of another origin first.
    """
    if check:
        require_unique(agg, key, f"right side of {flag}")
    return clients.join(agg, key, "left").withColumn(flag, F.col(witness).isNotNull().cast("int"))


def join_history(clients: DataFrame, agg: DataFrame, check: bool = False) -> DataFrame:
    """Clients with their credit-history aggregate."""
    return left_with_presence(clients, agg, "BUREAU_LOAN_COUNT", "HAS_BUREAU_HISTORY", check=check)


def join_previous(clients: DataFrame, agg: DataFrame, check: bool = False) -> DataFrame:
    """Clients with their previous-application aggregate."""
    return left_with_presence(clients, agg, "PREV_APPLICATION_COUNT", "HAS_PREV_APPLICATION", check=check)


def join_panel(clients: DataFrame, agg: DataFrame, check: bool = False) -> DataFrame:
    """Clients with their panel aggregate and the arrears seen by either source."""
    if "BUREAU_OVERDUE_UNION" not in clients.columns:
        raise ValueError("join the credit history before the panel: the arrears union reads it")
    joined = left_with_presence(clients, agg, "BB_N_CREDITS_WBAL", "HAS_BUREAU_BALANCE", check=check)
    either = holds(F.col("BUREAU_OVERDUE_UNION") > 0) | holds(F.col("BB_ANY_DPD_FLAG") > 0)
    return joined.withColumn(
        "BB_OVERDUE_UNION", F.when(F.col("BUREAU_OVERDUE_UNION").isNotNull(), either.cast("double"))
    )


def members(df: DataFrame, ids: DataFrame, key: str = CLIENT) -> DataFrame:
    """Rows whose key is in the list."""
    return df.join(ids.select(key), key, "left_semi")


def orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no parent."""
    return df.join(parents.select(key), key, "left_anti")


def reindex(keys: DataFrame, values: DataFrame, key: str = CLIENT, fill=None) -> DataFrame:
    """Values for exactly the listed keys, missing ones NULL or filled."""
    out = keys.select(key).join(values, key, "left")
    if fill is None:
        return out
    return out.fillna(fill, subset=[c for c in values.columns if c != key])


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default=None, name: str | None = None) -> DataFrame:
    """Value of a fitted table by null-safe key, with a default for unseen keys."""
    t = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    out = df.join(t, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    v = F.col("_v") if default is None else F.coalesce("_v", F.lit(default))
    return out.withColumn(name or value, v).drop("_v")


def inherit(rows: DataFrame, labelled: DataFrame, column: str = "TARGET", key: str = CLIENT) -> DataFrame:
    """History rows of labelled clients, each with its client's label."""
    return rows.join(labelled.select(key, column), key, "inner")


def same_population(left: DataFrame, right: DataFrame, key: str = CLIENT) -> DataFrame:
    """One row: keys only on the left and only on the right."""
    l = left.select(key).distinct().withColumn("_l", F.lit(1))
    r = right.select(key).distinct().withColumn("_r", F.lit(1))
    return l.join(r, key, "full").agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right")
    )


def require_same_population(left: DataFrame, right: DataFrame, what: str, key: str = CLIENT) -> None:
    """Fail when the two key sets differ."""
    row = same_population(left, right, key).first()
    if row["only_left"] or row["only_right"]:
        raise ValueError(f"{what}: {row['only_left']} keys outside, {row['only_right']} keys missing")


def join_integrity(before: DataFrame, after: DataFrame, key: str = CLIENT) -> DataFrame:
    """One row: rows before and after a left join, and how many keys repeat after it."""
    a = before.agg(F.count(F.lit(1)).alias("rows_before"))
    b = after.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum("c").alias("rows_after"), F.count_if(F.col("c") > 1).alias("repeated_keys")
    )
    n = a.select("rows_before").scalar()
    return b.withColumn("rows_before", n).withColumn(
        "intact", ((F.col("rows_before") == F.col("rows_after")) & (F.col("repeated_keys") == 0)).cast("int")
    )
