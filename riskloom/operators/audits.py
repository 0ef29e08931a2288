"""Table audits, profiles and contracts. Each report is one or two aggregates, whatever the columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import params as P
from riskloom.functions.nullsafe import holds
from riskloom.operators import cleaning
from riskloom.operators.features import building_block, identity_ages, request_block
from riskloom.operators.gram import pearson
from riskloom.operators.ranks import exact_quantiles
from riskloom.operators.signals import TARGET, two_by_two
from riskloom.operators.woe import rate_by

# Identity readings
IDENTITY = {
    "exacta": ("CODE_GENDER", "DAYS_BIRTH", "DAYS_ID_PUBLISH", "DAYS_REGISTRATION"),
    "invariante": ("CODE_GENDER", "EDAD_A_ID", "EDAD_A_REGISTRO"),
}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


def per_column(df: DataFrame, columns: Iterable[str], metrics: Mapping[str, Mapping[str, Column]], keys: Iterable[str] = ()) -> DataFrame:
    """One aggregate over the frame, turned into one row per column; ``metrics[column][name]``."""
    columns, keys = list(columns), list(keys)
    aggs, cells = [], []
    for i, c in enumerate(columns):
        parts = []
        for name, e in metrics[c].items():
            aggs.append(e.alias(f"{name}__{i}"))
            parts.append(F.col(f"{name}__{i}").alias(name))
        cells.append(F.struct(F.lit(c).alias("feature"), *parts))
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*")


# -- tables ------------------------------------------------------------------------------------


def data_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns, share of null cells, columns with nulls and type counts of each table."""
    parts = []
    for name, df in tables.items():
        kinds = [f.dataType for f in df.schema.fields]
        present = [F.count(F.col(c)).alias(f"p{i}") for i, c in enumerate(df.columns)]
        one = df.agg(F.count(F.lit(1)).alias("rows"), *present)
        gaps = [F.col("rows") - F.col(f"p{i}") for i in range(len(kinds))]
        cells = F.col("rows") * len(kinds)
        parts.append(
            one.select(
                F.lit(name).alias("table"),
                "rows",
                F.lit(len(kinds)).alias("cols"),
                F.coalesce(F.round(F.try_divide(100 * reduce(add, gaps), cells), 2), F.lit(0.0)).alias("missing_pct"),
                reduce(add, [(g > 0).cast("int") for g in gaps]).alias("cols_with_missing"),
                F.lit(sum(isinstance(k, INTEGERS) for k in kinds)).alias("int_cols"),
                F.lit(sum(isinstance(k, FLOATS) for k in kinds)).alias("float_cols"),
                F.lit(sum(isinstance(k, T.StringType) for k in kinds)).alias("text_cols"),
            )
        )
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("rows"), "table")


def narrow_types(df: DataFrame, keep_double: Iterable[str] | None = None) -> dict[str, str]:
    """Narrowest Spark type of each column, from one aggregate; edges are strict.

    Reference unsigned ranges use the next wider signed type. Columns in ``keep_double`` (all floats
    by default) stay double, because single precision moves values that sit on a cut.
    """
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGERS)]
    out = {}
    if ints:
        row = df.agg(
            *[F.min(c).alias(f"a{i}") for i, c in enumerate(ints)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(ints)]
        ).first()
        for i, c in enumerate(ints):
            out[c] = narrow_integer(row[f"a{i}"], row[f"b{i}"])
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)]
    kept = set(floats if keep_double is None else keep_double)
    return out | {c: "double" if c in kept else "float" for c in floats}


def narrow_integer(lo: int | None, hi: int | None) -> str:
    """Narrowest signed type strictly inside the edges of each width."""
    if lo is None:
        return "tinyint"
    if lo >= 0:
        for edge, name in ((255, "smallint"), (65_535, "int"), (4_294_967_295, "bigint")):
            if hi < edge:
                return "tinyint" if name == "smallint" and hi < 127 else name
        return "bigint"
    for bits, name in ((7, "tinyint"), (15, "smallint"), (31, "int")):
        if lo > -(2**bits) and hi < 2**bits - 1:
            return name
    return "bigint"


def cast_narrow(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """The frame with its columns in their narrowest type."""
    types = narrow_types(df) if types is None else types
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()}) if types else df


# Fixed values: (class, where to look, how, what). A column that hits several classes takes the one that
# stands highest in CLASSES; building descriptions are normalised columns that hold text.
CLASSES = ("ID", "Building text", "Normalized/Float", "Binary/Flag", "Days/Time", "Count", "Amount/Price", "Categorical", "Numerical")
NAMING = (
    ("ID", "name", "has", ("ID",)),
    ("ID", "description", "has", ("identifier",)),
    ("Normalized/Float", "name", "starts", ("EXT_SOURCE_",)),
    ("Normalized/Float", "name", "ends", ("_AVG", "_MODE", "_MEDI")),
    ("Normalized/Float", "note", "has", ("normalized",)),
    ("Binary/Flag", "name", "starts", ("FLAG_", "REG_", "LIVE_")),
    ("Binary/Flag", "description", "has", ("flag", "1 -")),
    ("Binary/Flag", "note", "is", ("recoded", "grouped")),
    ("Days/Time", "name", "starts", ("DAYS_",)),
    ("Days/Time", "description", "has", ("days",)),
    ("Days/Time", "note", "has", ("time only relative",)),
    ("Count", "name", "starts", ("CNT_",)),
    ("Count", "description", "has", ("number of", "count")),
    ("Amount/Price", "name", "starts", ("AMT_",)),
    ("Amount/Price", "description", "has", ("amount", "price", "annuity")),
    ("Categorical", "name", "starts", ("NAME_", "CODE_")),
    ("Categorical", "name", "is", ("ORGANIZATION_TYPE",)),
    ("Categorical", "storage", "is", ("text", "other")),
    ("Numerical", "storage", "is", ("integer", "float", "flag")),
)
BUILDING_TEXTS = ("HOUSETYPE", "WALLSMATERIAL", "FONDKAPREMONT", "EMERGENCYSTATE")
# Fixed values: (class, storage, observed fact) -> status; whatever is not listed is fine
FINDINGS = (
    ("ID", "float", "any", "ERROR"),
    ("Binary/Flag", "text", "yes or no", "IMPROVEMENT"),
    ("Binary/Flag", "text", "other text", "WARNING"),
    ("Binary/Flag", "integer", "zero or one", "IMPROVEMENT"),
    ("Binary/Flag", "float", "zero or one", "IMPROVEMENT"),
    ("Days/Time", "text", "any", "ERROR"),
    ("Days/Time", "float", "fractional", "WARNING"),
    ("Count", "text", "any", "ERROR"),
    ("Count", "float", "fractional", "WARNING"),
    ("Amount/Price", "text", "any", "ERROR"),
    ("Normalized/Float", "text", "any", "ERROR"),
    ("Categorical", "integer", "any", "WARNING"),
    ("Categorical", "float", "any", "WARNING"),
    ("Categorical", "flag", "any", "WARNING"),
    ("Categorical", "text", "few levels", "IMPROVEMENT"),
)
FEW_LEVELS = 50
#: Bits of the hash bitmap that bounds a column's distinct count from below.
HASH_BITS = 4_096
STORAGE = {"flag": (T.ByteType, T.BooleanType), "integer": INTEGERS, "float": FLOATS, "text": (T.StringType,)}


def storage_of(kind: T.DataType) -> str:
    """How a column is stored: flag, integer, float, text or other."""
    return next((name for name, kinds in STORAGE.items() if isinstance(kind, kinds)), "other")


def logical_class(column: str, description: str, note: str, storage: str) -> str:
    """Logical class of a column: the highest one that a naming rule gives it."""
    seen = {"name": column.upper(), "description": description.lower(), "note": note.lower(), "storage": storage}
    tests = {"is": str.__eq__, "has": str.__contains__, "starts": str.startswith, "ends": str.endswith}
    hits = {cls for cls, field, how, words in NAMING if any(tests[how](seen[field], w) for w in words)}
    if "Normalized/Float" in hits and any(w in seen["name"] for w in BUILDING_TEXTS):
        hits.add("Building text")
    best = min(hits, key=CLASSES.index)
    return "Categorical" if best == "Building text" else best


def few_valued_texts(df: DataFrame, columns: Iterable[str], most: int = FEW_LEVELS) -> set[str]:
    """The text columns with fewer than ``most`` distinct values, exactly.

    Hashes set bits of a small bitmap: as many set bits as ``most`` settle that a column has too many
    values. Only the others, whose values are few, are counted distinctly.
    """
    columns = list(columns)
    if not columns:
        return set()
    bit = lambda c: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(HASH_BITS)))
    bits = df.agg(*[F.bitmap_count(F.bitmap_construct_agg(bit(c))).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    open_ = [c for i, c in enumerate(columns) if bits[f"b{i}"] < most]
    if not open_:
        return set()
    levels = df.agg(*[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(open_)]).first()
    return {c for i, c in enumerate(open_) if levels[f"d{i}"] < most}


def verify_types(df: DataFrame, dictionary: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Logical class and status (OK, IMPROVEMENT, WARNING, ERROR) of every column.

    ``dictionary`` maps a column to its (description, special note). Facts observed in the data are
    matched against ``FINDINGS``. A column without values shows every fact of its storage but fractions.
    """
    dictionary = dict(dictionary or {})
    stored = {f.name: storage_of(f.dataType) for f in df.schema.fields}
    few = few_valued_texts(df, [c for c, st in stored.items() if st == "text"])
    facts = {}
    for c, st in stored.items():
        shown = [F.lit("any")]
        if st == "text":
            yes_no = F.coalesce(F.bool_and(F.col(c).isin("Y", "N", "y", "n", "1", "0")), F.lit(True))
            shown += [F.when(yes_no, "yes or no").otherwise("other text"), F.lit("few levels" if c in few else None).cast("string")]
        elif st in ("integer", "float"):
            shown.append(F.when(F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)), "zero or one"))
            shown.append(F.when(F.bool_or(F.col(c) != F.floor(c)), "fractional"))
        facts[c] = {"facts": F.array_compact(F.array(*shown))}
    spark = df.sparkSession
    declared = spark.createDataFrame(
        [(f.name, f.dataType.simpleString(), stored[f.name], logical_class(f.name, *dictionary.get(f.name, ("", "")), stored[f.name])) for f in df.schema.fields],
        "feature string, type string, storage string, logical string",
    )
    findings = spark.createDataFrame(FINDINGS, "logical string, storage string, fact string, status string")
    seen = per_column(df, df.columns, facts).join(declared, "feature").withColumn("fact", F.explode("facts"))
    return (
        seen.join(findings, ["logical", "storage", "fact"], "left")
        .groupBy("feature", "type", "logical")
        .agg(F.coalesce(F.max("status"), F.lit("OK")).alias("status"))
    )


def category_levels(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Sorted distinct values of each categorical column."""
    columns = list(columns)
    return per_column(df, columns, {c: {"levels": F.array_sort(F.collect_set(F.col(c).cast("string")))} for c in columns})


def recommend_encoding(df: DataFrame, columns: Iterable[str], fixed: Mapping[str, str] | None = None) -> DataFrame:
    """Encoding of each categorical: a fixed rule if there is one, else by cardinality."""
    columns, fixed = list(columns), dict(fixed or {})
    t = per_column(df, columns, {c: {"levels": F.count_distinct(F.col(c))} for c in columns})
    by_size = F.when(F.col("levels") == 2, "binary").when(F.col("levels") <= 10, "one-hot").otherwise("woe")
    if not fixed:
        return t.withColumn("encoding", by_size)
    rule = F.coalesce(*[F.when(F.col("feature") == c, F.lit(e)) for c, e in fixed.items()], by_size)
    return t.withColumn("encoding", rule)


# -- reports of the main table -----------------------------------------------------------------


def cleaning_report(df: DataFrame) -> DataFrame:
    """Rows marked by each rule and by their union, columns dropped and columns deferred."""
    marks = cleaning.residual_reasons(df)
    rows = {c: F.count_if(p) for c, p in marks.items()} | {"union": F.count_if(cleaning.residual_rows(df))}
    marked = per_column(df, rows, {c: {"n": e} for c, e in rows.items()}).select(
        F.lit("row").alias("kind"), F.col("feature").alias("object"), "n"
    )
    drops = [("column", c, 1) for c in cleaning.structural_drops(df.columns)]
    waits = [("deferred column", c, 1) for c in cleaning.DEFERRED_DROPS if c in df.columns]
    if not drops + waits:
        return marked
    return marked.unionByName(df.sparkSession.createDataFrame(drops + waits, "kind string, object string, n bigint"))


def layer_one_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """New features: source columns, reported rows, coverage, and marked rows or mean."""
    new = [c for c in after.columns if c not in before.columns]
    origins = {"BUILDING_INFO_COUNT": len(building_block(before)), "HAS_BUILDING_INFO": len(building_block(before))}
    origins |= {"HAS_BUREAU_INFO": len(request_block(before)), "HAS_SOCIAL_INFO": 2}
    metrics = {
        c: {
            "source_columns": F.first(F.lit(origins.get(c, 1))),
            "reported": F.count(F.col(c)),
            "coverage_pct": F.round(F.avg(F.col(c).isNotNull().cast("double")) * 100, 2),
            "marked_or_mean": F.sum(F.col(c).cast("double")) if c.startswith(("HAS_", "FLAG_")) else F.round(F.avg(F.col(c).cast("double")), 4),
        }
        for c in new
    }
    return per_column(after, new, metrics)


def before_after(raw: DataFrame, clean: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows, columns, removed rows, positives, rate and sentinel count before and after cleaning."""
    days = F.col("DAYS_EMPLOYED")

    def side(df: DataFrame, name: str, removed: Column, marked: Column) -> DataFrame:
        y = F.col(target).cast("double")
        cells = {
            "rows": F.count(F.lit(1)).cast("double"),
            "columns": F.first(F.lit(float(len(df.columns)))),
            "removed": removed.cast("double"),
            "positives": F.sum(y),
            "rate_pct": F.round(F.avg(y) * 100, 4),
            "sentinel": marked.cast("double"),
        }
        one = df.agg(*[e.alias(k) for k, e in cells.items()])
        return one.unpivot([], list(cells), "measure", name)

    mask = F.count_if(cleaning.residual_rows(raw))
    a = side(raw, "raw", mask, F.count_if(days == P.SENTINEL_DAYS))
    b = side(clean, "clean", F.first(F.lit(0)), F.sum(cleaning.ANOMALY_FLAG))
    joined = a.join(b, "measure")
    n_raw = raw.agg(F.count(F.lit(1)).cast("double")).scalar()
    n_clean = clean.agg(F.count(F.lit(1)).cast("double")).scalar()
    return joined.withColumn("clean", F.when(F.col("measure") == "removed", n_raw - n_clean).otherwise(F.col("clean")))


def reconcile(measured: DataFrame, anchors: Mapping[tuple[str, str], float]) -> DataFrame:
    """Expected against measured figures. An anchor without its measure fails."""
    spark = measured.sparkSession
    expected = spark.createDataFrame([(t, m, float(v)) for (t, m), v in anchors.items()], "source string, measure string, expected double")
    t = expected.join(measured.select("measure", F.col("value").alias("measured")), "measure", "left")
    lost = F.raise_error(F.concat(F.lit("anchor without a measure: "), F.col("measure"))).cast("double")
    t = t.withColumn("measured", F.coalesce("measured", lost))
    return t.select("source", "measure", "expected", "measured", (F.col("expected") == F.col("measured")).cast("int").alias("matches"))


def assembly_measures(base: DataFrame, assembled: DataFrame) -> DataFrame:
    """(measure, value): the figures the assembled table is reconciled on, in one pass."""
    hist, bal, prev = (holds(F.col(c) == 1) for c in ("HAS_BUREAU_HISTORY", "HAS_BUREAU_BALANCE", "HAS_PREV_APPLICATION"))
    cells = {
        "rows": F.count(F.lit(1)),
        "sentinel rows": F.sum(cleaning.ANOMALY_FLAG),
        "with history": F.count_if(hist),
        "without history": F.count_if(~hist),
        "debt ratio reported": F.count_if(hist & F.col("BUREAU_DEBT_CREDIT_RATIO").isNotNull()),
        "with panel": F.count_if(bal),
        "panel months": F.sum(F.when(bal, F.col("BB_MONTHS_TOTAL"))),
        "ever in arrears": F.sum(F.when(bal, F.col("BB_ANY_DPD_FLAG"))),
        "enough reported months": F.count_if(bal & F.col("BB_PCT_MONTHS_DPD").isNotNull()),
        "with previous": F.count_if(prev),
        "without previous": F.count_if(~prev),
        "truncated history": F.sum(F.when(prev, F.col("PREV_HISTORIAL_RECORTADO"))),
        "early settlement": F.count_if(prev & holds(F.col("PREV_EARLY_SETTLED_FLAG") == 1)),
        "refused by score": F.sum(F.when(prev, F.col("PREV_REFUSED_SCOFR_FLAG"))),
        "layer 1 columns": F.first(F.lit(len(assembled.columns))),
        "main table columns": F.first(F.lit(len(base.columns))),
    }
    one = assembled.agg(*[e.cast("double").alias(k) for k, e in cells.items()])
    return one.unpivot([], list(cells), "measure", "value")


# -- keys and coverage -------------------------------------------------------------------------


def key_profile(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """One row: rows, distinct keys, repeated keys and duplicated whole rows."""
    key = list(key)
    whole = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    rows = df.groupBy(*key, whole.alias("_row")).agg(F.count(F.lit(1)).alias("c"))
    per_key = rows.groupBy(*key).agg(F.sum("c").alias("c"), F.sum(F.col("c") - 1).alias("dup"))
    return per_key.agg(
        F.sum("c").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("c") > 1).alias("repeated_keys"),
        F.sum("dup").alias("duplicate_rows"),
    )


def bridge_coverage(history: DataFrame, panel: DataFrame, credit: str = "SK_ID_BUREAU", client: str = "SK_ID_CURR") -> DataFrame:
    """One row: credits with panel, orphans, clients covered, and covered in full or in part."""
    seen = panel.select(credit).distinct().withColumn("_p", F.lit(1))
    parents = history.select(credit, client).withColumn("_h", F.lit(1))
    linked = seen.join(parents, credit, "full")
    marks = linked.withColumns({"p": F.col("_p").isNotNull().cast("int"), "h": F.col("_h").isNotNull().cast("int")})
    per_client = marks.groupBy(F.col(client)).agg(
        F.sum("p").alias("with_panel"), F.sum("h").alias("credits"), F.sum(F.col("p") * (1 - F.col("h"))).alias("orphans")
    )
    known = F.col(client).isNotNull()
    some = known & (F.col("with_panel") > 0)
    return per_client.agg(
        F.sum("with_panel").alias("credits_with_panel"),
        F.sum("orphans").alias("orphan_credits"),
        F.count_if(known).alias("clients"),
        F.count_if(some).alias("clients_with_panel"),
        F.count_if(some & (F.col("with_panel") == F.col("credits"))).alias("full_coverage"),
        F.count_if(some & (F.col("with_panel") < F.col("credits"))).alias("partial_coverage"),
    )


def coverage_by(history: DataFrame, panel: DataFrame, group: Column, min_rows: int = 5000, credit: str = "SK_ID_BUREAU") -> DataFrame:
    """Share of credits with panel by attribute, groups of at least ``min_rows``."""
    seen = panel.select(credit).distinct().withColumn("_p", F.lit(1))
    t = history.join(seen, credit, "left").groupBy(group.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_p").isNotNull().cast("double")).alias("covered")
    )
    return t.filter(F.col("n") >= min_rows)


def orphan_profile(panel: DataFrame, history: DataFrame, credit: str = "SK_ID_BUREAU") -> DataFrame:
    """Orphan against linked credits: months (median and mean) and state shares."""
    per_credit = panel.groupBy(credit).agg(
        F.count(F.lit(1)).alias("months"),
        F.count_if(F.col("STATUS") == "C").alias("c"),
        F.count_if(F.col("STATUS") == "X").alias("x"),
        F.count_if(F.col("STATUS").isin("1", "2", "3", "4", "5")).alias("d"),
    )
    parents = history.select(credit).distinct().withColumn("_h", F.lit(1))
    t = per_credit.join(parents, credit, "left").withColumn("grp", F.when(F.col("_h").isNull(), "orphan").otherwise("linked"))
    rows = F.sum("months")
    return t.groupBy("grp").agg(
        F.count(F.lit(1)).alias("credits"),
        # at most 97 distinct months per credit, so the exact percentile keeps a small map
        F.percentile("months", F.lit(0.5)).alias("median_months"),
        F.avg("months").alias("mean_months"),
        (F.sum("c") / rows).alias("share_c"),
        (F.sum("x") / rows).alias("share_x"),
        (F.sum("d") / rows).alias("share_arrears"),
    )


def panel_integrity(panel: DataFrame, history: DataFrame, credit: str = "SK_ID_BUREAU") -> DataFrame:
    """One row: windows that do not add up, credits that reopen after closing, windows older than the credit.

    The first closed month meets the rows of its credit through a window over the credit.
    """
    closed = F.col("STATUS") == "C"
    w = Window.partitionBy(credit)
    rows = panel.withColumn("_first_c", F.min(F.when(closed, F.col("MONTHS_BALANCE"))).over(w))
    after = holds((F.col("MONTHS_BALANCE") > F.col("_first_c")) & ~closed)
    per_credit = rows.groupBy(credit).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(closed).alias("c"),
        F.count_if(F.col("STATUS") == "X").alias("x"),
        F.count_if(F.col("STATUS").isin("0", "1", "2", "3", "4", "5")).alias("reported"),
        F.count_if(after).alias("reopened"),
        F.max("MONTHS_BALANCE").alias("fin"),
    )
    lag = F.col("n") - (-F.col("DAYS_CREDIT") / 30.44 + F.col("fin"))
    t = per_credit.join(history.select(credit, "DAYS_CREDIT"), credit, "left")
    return t.agg(
        F.count(F.lit(1)).alias("credits"),
        F.count_if(F.col("c") + F.col("x") + F.col("reported") != F.col("n")).alias("unbalanced"),
        F.count_if(F.col("c") > 0).alias("ever_closed"),
        F.count_if(F.col("reopened") > 0).alias("reopened_credits"),
        F.sum("reopened").alias("reopened_rows"),
        F.count_if(holds(lag > 1)).alias("older_than_credit"),
        F.max(lag).alias("max_lag"),
    )


# -- numeric and null profiles -----------------------------------------------------------------


def numeric_profile(df: DataFrame, columns: Iterable[str], probs: Iterable[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles of each column."""
    columns, probs = list(columns), list(probs)
    q = exact_quantiles(df, columns, probs)
    base = per_column(
        df,
        columns,
        {
            c: {
                "n": F.count(F.col(c)),
                "mean": F.avg(F.col(c).cast("double")),
                "std": F.stddev_samp(F.col(c).cast("double")),
                "min": F.min(F.col(c).cast("double")),
                "max": F.max(F.col(c).cast("double")),
            }
            for c in columns
        },
    )
    names = [f"p{p * 100:g}".replace(".", "_") for p in probs]
    rows = [(c, *q.get((c,), [None] * len(probs))) for c in columns]
    schema = "feature string, " + ", ".join(f"{n} double" for n in names)
    return base.join(df.sparkSession.createDataFrame(rows, schema), "feature")


def severe_tails(df: DataFrame, columns: Iterable[str], factor: float = 3.0) -> DataFrame:
    """Maximum against the 99th percentile of each column, and whether it is beyond ``factor`` times."""
    t = numeric_profile(df, columns, [0.99]).select("feature", "max", "p99")
    return t.withColumns(
        {"times": F.try_divide("max", "p99"), "severe": (F.col("max") > F.col("p99") * factor).cast("int")}
    )


def tail_test(df: DataFrame, columns: Iterable[str], target: str = TARGET) -> DataFrame:
    """Rows above the 99th percentile (above 0 when that is not positive) against the other reported rows."""
    columns = list(columns)
    q = exact_quantiles(df, columns, [0.99])
    edges = {c: max(q[(c,)][0], 0.0) for c in columns if (c,) in q}
    t = two_by_two(df, {c: F.col(c) > e for c, e in edges.items()}, target, {c: F.col(c).isNotNull() for c in edges})
    cut = F.coalesce(*[F.when(F.col("feature") == c, F.lit(float(e))) for c, e in edges.items()])
    return t.withColumn("cut", cut).orderBy(F.desc("delta_pp"), "feature")


def null_profile(df: DataFrame, columns: Iterable[str], target: str = TARGET) -> DataFrame:
    """Nulls of each column against the target: count, share, rates, delta, test, medians by class."""
    columns = list(columns)
    t = two_by_two(df, {c: F.col(c).isNull() for c in columns}, target)
    q = exact_quantiles(df.filter(F.col(target).isNotNull()), columns, [0.5], [target])
    med: dict[str, dict] = {c: {} for c in columns}
    for (cls, c), (v,) in q.items():
        med[c][int(cls)] = v
    m = df.sparkSession.createDataFrame(
        [(c, v.get(0), v.get(1)) for c, v in med.items()], "feature string, median0 double, median1 double"
    )
    return t.withColumn("null_pct", F.col("n_hit") / (F.col("n_hit") + F.col("n_rest")) * 100).join(m, "feature")


def null_mechanism(df: DataFrame, columns: Iterable[str], category: str, controls: Mapping[str, Column], target: str = TARGET, top: int = 2) -> dict[str, DataFrame]:
    """Null share by category, the categories that hold most nulls, and the delta inside a control."""
    columns = list(columns)
    rows = df.select(category, target, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).isNull().cast("int").alias("gap"), holds(controls.get(c, F.lit(True))).alias("ctl"))
        for c in columns
    ])).alias("x")).select(category, target, "x.*")
    by_cat = rows.groupBy("feature", F.col(category).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("nulls"))
    share = F.col("nulls") / F.sum("nulls").over(Window.partitionBy("feature")) * 100
    order = Window.partitionBy("feature").orderBy(F.desc("nulls"), "level")
    ranked = by_cat.withColumns({"null_share": F.col("nulls") / F.col("n") * 100, "of_all_nulls": share, "rk": F.row_number().over(order)})
    y = F.col(target).cast("double")
    inside = rows.filter("ctl").groupBy("feature").agg(
        (F.avg(F.when(F.col("gap") == 1, y)) - F.avg(F.when(F.col("gap") == 0, y))).alias("delta")
    )
    return {
        "by_category": ranked.drop("rk", "of_all_nulls"),
        "top": ranked.filter(F.col("rk") <= top).select("feature", "level", "nulls", "of_all_nulls", "rk"),
        "inside_control": inside,
    }


def null_cooccurrence(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Absolute correlation of the null masks of each pair, with its reading band."""
    columns = list(columns)
    masks = {c: F.col(c).isNull().cast("double") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.abs(pearson(masks[a], masks[b])).alias(f"v{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{i}").alias("v")) for i, (a, b) in enumerate(pairs)])
    band = F.when(F.col("v") > 0.30, "high").when(F.col("v") < 0.10, "low").otherwise("middle")
    return one.select(F.explode(cells).alias("x")).select("x.*").withColumn("band", band)


def nulls_per_row(df: DataFrame, columns: Iterable[str], target: str = TARGET) -> dict[str, DataFrame]:
    """Rows and target rate by number of nulls, and by completeness level."""
    columns = list(columns)
    gaps = reduce(add, [F.col(c).isNull().cast("int") for c in columns])
    level = F.when(gaps == 0, "complete").when(gaps == len(columns), "all null").otherwise("partial")
    rows = df.select(gaps.alias("nulls"), level.alias("level"), target)
    return {"count": rate_by(rows, "nulls", target=target), "level": rate_by(rows, "level", target=target)}


def category_hygiene(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Distinct raw values against distinct values once trimmed and lower-cased."""
    columns = list(columns)
    t = per_column(
        df, columns, {c: {"raw": F.count_distinct(F.col(c)), "normal": F.count_distinct(F.lower(F.trim(F.col(c))))} for c in columns}
    )
    return t.withColumn("clean", (F.col("raw") == F.col("normal")).cast("int"))


def value_frequencies(df: DataFrame, column: str, head: int | None = 15) -> DataFrame:
    """Most frequent values with their share, nulls included."""
    g = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    g = g.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), F.col("value").asc_nulls_last())
    return g.limit(head) if head else g


def null_drift(df: DataFrame, group: Column, columns: Iterable[str]) -> DataFrame:
    """Null share of several columns by bin."""
    columns = list(columns)
    return df.groupBy(group.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), *[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"null_{c}") for c in columns]
    )


def absence_overlap(df: DataFrame, a: Column, b: Column, target: str = TARGET) -> DataFrame:
    """Two absences: neither, both, or one only; rows, share and target rate."""
    group = F.when(a & b, "both").when(a, "only_a").when(b, "only_b").otherwise("neither")
    t = rate_by(df, group.alias("grp"), target=target)
    total = df.agg(F.count(F.lit(1))).scalar()
    return t.withColumn("share", F.col("n") / total)


# -- identity and folds ------------------------------------------------------------------------


def identity_report(base: DataFrame, split: DataFrame, readings: Mapping[str, Iterable[str]] | None = None, id_col: str = "SK_ID_CURR") -> DataFrame:
    """Groups of identical identity tuples, and how many cross train and valid."""
    rows = identity_ages(base).join(split.select(id_col, "split"), id_col)
    parts = []
    for name, keys in (readings or IDENTITY).items():
        keys = list(keys)
        g = rows.dropna(subset=keys).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "valid").alias("v")
        )
        several, cross = F.col("n") > 1, (F.col("n") > 1) & (F.col("t") > 0) & (F.col("v") > 0)
        parts.append(
            g.agg(
                F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("clients_in_groups"),
                F.count_if(several).alias("groups"),
                F.count_if(cross).alias("crossing_groups"),
                F.coalesce(F.sum(F.when(cross, F.col("v"))), F.lit(0)).alias("valid_with_train_pair"),
                F.count_if(several & (F.col("v") == 0)).alias("train_only_groups"),
            ).select(F.lit(name).alias("reading"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def fold_report(folds: DataFrame, split: DataFrame, target: str = TARGET, id_col: str = "SK_ID_CURR") -> DataFrame:
    """Sizes and prevalence of both parts of each fold, disjointness, and clients outside train.

    ``folds`` holds one row per client and seed with the fold that evaluates it.
    """
    train = split.filter(F.col("split") == "train").select(id_col).withColumn("_t", F.lit(1))
    per_seed = Window.partitionBy("seed")
    marked = folds.join(train, id_col, "left")
    repeated = (
        folds.groupBy("seed", id_col).agg(F.count(F.lit(1)).alias("c")).groupBy("seed").agg(F.count_if(F.col("c") > 1).alias("repeated"))
    )
    g = marked.groupBy("seed", "fold").agg(
        F.count(F.lit(1)).alias("n_eval"), F.sum(F.col(target).cast("double")).alias("s"), F.count_if(F.col("_t").isNull()).alias("outside_train")
    )
    g = g.withColumns({"_n": F.sum("n_eval").over(per_seed), "_s": F.sum("s").over(per_seed)})
    n_fit = F.col("_n") - F.col("n_eval")
    return g.join(repeated, "seed").select(
        "seed",
        "fold",
        n_fit.alias("n_fit"),
        "n_eval",
        ((F.col("_s") - F.col("s")) / n_fit * 100).alias("pct_fit"),
        (F.col("s") / F.col("n_eval") * 100).alias("pct_eval"),
        (F.col("repeated") == 0).cast("int").alias("disjoint"),
        "outside_train",
    )


def column_drift(per_fold: Mapping[tuple[int, int], Iterable[str]], spark) -> DataFrame:
    """Columns each fold lacks against the union of all folds; schema metadata only."""
    union = sorted({c for cols in per_fold.values() for c in cols})
    rows = [(s, k, len(list(cols)), sorted(set(union) - set(cols))) for (s, k), cols in per_fold.items()]
    return spark.createDataFrame(rows, "seed int, fold int, n_columns int, missing array<string>")
