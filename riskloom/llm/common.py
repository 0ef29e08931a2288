"""Helpers shared by the text operators: staging, partition counts, code-point safe columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir

#: The white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The written table cuts the lineage, survives the loss of executors and is compressed and columnar,
    which a checkpoint of rows is not.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text and its length; other columns stay."""
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(quoted(c))
    return docs.select(*out)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder -1, which no fold holds."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def tree(states: DataFrame, key: str, join: Callable[[dict, dict], dict], fan: int = 16) -> DataFrame:
    """One row for each ``key``: rows are joined ``fan`` at a time, level by level, each task holding one joined row at once.

    ``states`` has the whole-number columns ``key`` and ``part``; ``join`` gets two rows as dictionaries and returns the joined one.
    """
    states = staged(states)
    widest, schema = states.agg(F.max("part")).first()[0] or 0, states.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(len(batch)):
                own = batch.slice(k, 1).to_pylist()[0]
                own["part"] //= fan
                if held is not None and (held[key], held["part"]) == (own[key], own["part"]):
                    held = own | join(held, own)
                else:
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([held], schema=batch.schema)
                    held = own
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=batch.schema)

    while widest > 0:
        dealt = states.withColumn("bucket", F.expr(f"part div {fan}")).repartition(key, "bucket").sortWithinPartitions(key, "bucket", "part").drop("bucket")
        states, widest = staged(dealt.mapInArrow(run, schema)), widest // fan
    return states
