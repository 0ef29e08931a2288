"""Secret scans with linking of multipart credentials.

Strong findings stand alone: assignments to names of secrets, access identifiers, long hexadecimal runs. Weak candidates are
runs that look like secret keys (40 base64 characters, mixed) and endpoints (addresses with a scheme); alone they mean nothing. Parts
are linked by an interval join: identifiers (access), secrets (assign, hex, key) and endpoints complement each other. A weak key counts
if an identifier or an endpoint begins within ``SCOPE`` code points of it, an endpoint if an identifier or a secret does, in the same
document. The join meets parts in bins of that width and only asks whether a partner exists, so no pairs are made.

Only DataFrame functions are used. Positions come from splitting a text at the pattern: what lies between the matches and the matches
themselves, in turn, add up to all starts and ends; they are added up in runs of ``RUN`` matches, so that a text with very many
costs little more than its share. Patterns that cannot match a text cost one test.

Cases: null and empty texts have no findings; rows that share doc_id and text share their findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, staged

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A run of exactly 40 with lower case, upper case and digit. "=" before it ends a name, behind it pads a longer value.
KEY = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?:https?|s3|ftp)://[A-Za-z0-9.-]+(?::[0-9]+)?"
KINDS = ("assign", "access", "hex", "key", "endpoint")
SCOPE = 200
#: Matches whose positions are added up in one array.
RUN = 64


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Array of (start, kind, end) of the leftmost matches that don't overlap; ``least``: length that group 1 needs."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else whole
    zipped = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("m"), value.alias("v"))
    zipped = F.transform(zipped, lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), F.length(x["v"]).alias("v")))
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        end = start + x["m"]
        found = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        kept = F.concat(acc["out"], found) if not least else F.when(x["v"] >= least, F.concat(acc["out"], found)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    # an array that grows by one is copied each time: runs keep it short
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / RUN).cast("int")), lambda i: F.slice(zipped, i * RUN + 1, RUN))
    length = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x["b"] + x["m"])
    none = F.expr("cast(array() as array<int>)")
    offsets = F.aggregate(
        F.transform(runs, length), F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"],
    )
    placed = F.arrays_zip(runs.alias("run"), offsets.alias("at"))
    spans = F.flatten(F.transform(placed, lambda r: F.aggregate(r["run"], F.struct(r["at"].alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row hash, base findings and weak candidates of every document; texts end here."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, 0, 8), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    weak = F.concat(_spans(text, KEY, 3), _spans(text, ENDPOINT, 4))
    return docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), text).alias("rid"), F.xxhash64(F.lit(5), text).alias("tid"), base.alias("base"), weak.alias("weak"))


def linked(found: DataFrame) -> DataFrame:
    """(rid, tid, spans) of the weak candidates that have their complement within the scope."""
    bin_of = lambda c: F.floor(c / SCOPE)
    parts = found.select("rid", "tid", F.explode(F.concat("base", "weak")).alias("p")).select("rid", "tid", "p.*").distinct()
    parts = parts.repartition(partitions(found.sparkSession), "rid", "tid")
    around = F.explode(F.sequence(bin_of(F.col("start")) - 1, bin_of(F.col("start")) + 1))
    near = F.abs(F.col("start") - F.col("other")) <= SCOPE

    def with_partner(weak: DataFrame, partners: DataFrame) -> DataFrame:
        placed = partners.select("rid", "tid", F.col("start").alias("other"), around.alias("bin"))
        here = weak.withColumn("bin", bin_of(F.col("start")))
        cond = [here[c] == placed[c] for c in ("rid", "tid", "bin")] + [near]
        return here.join(placed, cond, "left_semi").drop("bin")

    keys = with_partner(parts.filter(F.col("kind") == 3), parts.filter(F.col("kind").isin(1, 4)))
    endpoints = with_partner(parts.filter(F.col("kind") == 4), parts.filter(F.col("kind") != 4))
    return keys.unionByName(endpoints).groupBy("rid", "tid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (start, kind, end; code points) of every document."""
    found = staged(scanned(docs))
    return found.drop("weak").join(linked(found), ["rid", "tid"], "left").select("doc_id", "base", F.coalesce("added", F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base findings and all spans, of every document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return findings(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "added")).alias("spans"),
    )
