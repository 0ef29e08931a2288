"""From raw documents to encoded training text in five stages; each is written and read again before the next.

toxicity (documents that the classifier rejects go), line deduplication (repeated lines go), near-duplicates (one document of each
class stays), mixing (documents are repeated or left out to meet their source's share, in training order), encoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import lines, mixing, pieces, simhash, toxicity
from riskloom.llm.common import partitions, quoted, spare, staged, table

#: SQL expresses neither the classifier nor the encoder.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    score = toxicity.scorer(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    (name,) = spare(docs, "__score")
    return docs.withColumn(name, score(F.col("text").cast("string"))).filter(F.col(name) < 0.5).select(*[quoted(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has."""
    return lines.deduplicated(docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each pass of the mix, range-sorted by position.

    A document that its source's target cuts is taken whole if at least half of its words are due, else not. Rows that repeat
    doc_id, text and source all get the passes of one of them.
    """
    plan = mixing.planned(docs.select("doc_id", "text", "source"))
    doc, tie, none, named, spots, place = spare(docs, "__doc", "__tie", "__none", "__name", "__at", "__position")
    whole = F.transform(F.filter("passes", lambda p: 2 * p["words"] >= F.col("size")), lambda p: p["position"])
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    picked = plan.select(F.col("doc_id").alias(doc), F.col("__tie").alias(tie), F.col("source").isNull().alias(none), name(F.col("source")).alias(named), whole.alias(spots))
    picked = picked.filter(F.size(spots) > 0).groupBy(doc, tie, none, named).agg(F.max(spots).alias(spots))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(tie)) & (F.col("source").isNull() == F.col(none)) & (name(F.col("source")) == F.col(named))
    rows = docs.join(picked, on).select(*[quoted(c) for c in docs.columns], F.explode(spots).alias(place))
    return rows.repartitionByRange(partitions(spark), place, "doc_id").sortWithinPartitions(place, "doc_id").drop(place)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids and ids of every remaining document."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_each_class),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
