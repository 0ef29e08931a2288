"""Exact line deduplication across documents, returned as compressed bitmaps of the lines to keep.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least ``LEAST`` code points count. The keys
are hashed (128 bits), the hashes range-partitioned and sorted by hash, document and position, and the stream of each hash keeps
its first document: lines of later documents are dropped. Hashes so frequent that they would fill a task of their own are found by
a pre-aggregated count, which also tells their first document; a count bounds how many there can be, so they are broadcast and their
lines never shuffled. What leaves is, for each document that loses lines, a bitmap in words of 64 lines (words that keep all
are left out); texts are not moved for the decision.

Only DataFrame functions are used.

Cases: a null or empty text is one empty line; rows that share a doc_id are one document (their lines don't repeat each other);
rows without doc_id keep all lines and don't count as documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import BLANKS, partitions, quoted, spare, staged, with_text

LEAST = 10
WORD_BITS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """The line as it is compared. Lines of one-byte characters take the fast lower-casing, which agrees there."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text hash, position, 128-bit hash) of every line whose key is long enough."""
    keyed = F.transform(lines_of(F.col("text")), lambda line, at: F.struct(at.cast("int").alias("at"), key_of(line).alias("key")))
    long_enough = F.filter(keyed, lambda x: F.length(x["key"]) >= LEAST)
    hashed = F.transform(long_enough, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(7), x["key"]).alias("h2")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    return base.select("doc_id", F.xxhash64("text").alias("rid"), F.explode(hashed).alias("x")).select("doc_id", "rid", F.col("x.at").alias("at"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))


def dropped(found: DataFrame) -> DataFrame:
    """The occurrences whose key was seen in an earlier document."""
    spark = found.sparkSession
    parts = partitions(spark)
    rows = found.count()
    # at most 8 hashes a partition can be this frequent
    limit = max(100, rows // (8 * parts))
    frequent = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter(F.col("n") > limit).drop("n")
    marked = found.join(F.broadcast(frequent), ["h1", "h2"], "left")
    at_once = marked.filter(F.col("first_doc").isNotNull() & (F.col("doc_id") > F.col("first_doc")))
    rest = marked.filter(F.col("first_doc").isNull()).drop("first_doc")
    stream = Window.partitionBy("h1", "h2").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = rest.repartitionByRange(parts, "h1", "h2").withColumn("first_doc", F.first("doc_id").over(stream)).filter(F.col("doc_id") > F.col("first_doc"))
    return at_once.select("doc_id", "rid", "at").unionByName(streamed.select("doc_id", "rid", "at"))


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, n_dropped, keep) of every document that loses lines; ``keep`` maps a word's number to its bits."""
    lost = dropped(staged(occurrences(docs)))
    dealt = lost.distinct().repartition(partitions(docs.sparkSession), "doc_id", "rid")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % WORD_BITS)
    word = F.floor(F.col("at") / WORD_BITS).cast("int")
    by_word = dealt.groupBy("doc_id", "rid", word.alias("word")).agg(F.bit_or(bit).alias("lost"), F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "rid").agg(
        F.sum("n").alias("n_dropped"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", F.bitwise_not(F.col("lost")).alias("bits"))))).alias("keep")
    )


def _applied(text: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps, joined."""
    word = lambda at: F.coalesce(F.try_element_at(keep, F.floor(at / WORD_BITS).cast("int")), F.lit(-1).cast("long"))
    kept = F.filter(lines_of(text), lambda line, at: F.call_function("shiftright", word(at), (at % WORD_BITS).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def with_bitmaps(docs: DataFrame, n_dropped: str, keep: str) -> DataFrame:
    """``docs`` with two more columns: lines dropped and the bitmap (null: keep all)."""
    doc, rid = spare(docs, "__doc", "__rid")
    maps = keep_bitmaps(docs.select("doc_id", "text")).select(F.col("doc_id").alias(doc), F.col("rid").alias(rid), F.col("n_dropped").alias(n_dropped), F.col("keep").alias(keep))
    on = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(rid))
    return docs.join(maps, on, "left").drop(doc, rid)


def line_report(docs: DataFrame) -> DataFrame:
    """Line counts, dropped lines and the digest of what stays, of every document."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return with_bitmaps(base, "__n_dropped", "__keep").select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("__n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(_applied(F.col("text"), F.col("__keep")), 256).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the dropped lines; texts that lose nothing stay as they are, nulls included."""
    n_dropped, keep = spare(docs, "__n_dropped", "__keep")
    marked = with_bitmaps(docs, n_dropped, keep)
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(_applied(F.col("text"), F.col(keep)))
    return with_text(marked, text).select(*[quoted(c) for c in docs.columns])
