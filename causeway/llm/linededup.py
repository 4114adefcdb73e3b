"""Line dedup: lines that stand in many documents stay only in the last of them.

A line's key is the line without spaces and tabs at its ends, A-Z lower-cased; lines break at \\n alone. Keys of at
least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines but those of the largest
doc_id that holds them.

Two 64-bit hashes stand for a key. (hash, document, position) rows are range-partitioned by hash and document with a
secondary sort by position: a key of a third of all documents is spread over as many ranges as it needs. Each range is
streamed in that order and marks the first occurrence of a key in a document; counts and keepers are partial sums of first
occurrences alone. What comes back for each document is a compressed bitmap of the lines to keep: a map from word number to
64 bits, words whose lines all stay left out. Texts meet their bitmaps in one hash join whose small side is the bitmaps.

Null and empty texts have one empty line. A document is a doc_id: equal rows of one doc_id count once and lose the
same lines; rows of a null doc_id keep all lines and count for nothing. Empty tables give empty results. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, keep_only

#: What is cut from the ends of a line.
BLANK = "\t\n\x0b\x0c\r "


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, text_hash, pos of every line whose key is long enough; pos from 0."""
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", F.btrim("line", F.lit(BLANK)))
        .where(F.length("key") >= min_chars)
        .withColumn("key", ascii_lower(F.col("key")))
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")
    )


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text_hash, kept (map of word number to 64 bits, set where the line stays) of the documents that lose lines."""
    # written once: the counts and the join below both read it
    held = cut(
        line_keys(docs, min_chars)
        .repartitionByRange("h1", "h2", "doc_id")
        .sortWithinPartitions("h1", "h2", "doc_id", "pos")
        .withColumn("first", F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")) == 1)
    )
    # written too: counted in the same job, it would hold the rows of a very common key to one task of the join
    hot = cut(
        held.where("first")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    lost = held.join(hot, ["h1", "h2"]).where("doc_id <> keeper")
    words = lost.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("kept"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text joined from the lines that stay, n_lines (before) and n_dropped; own columns of those names go."""
    docs = docs.drop("n_lines", "n_dropped")
    marks = bitmaps.select(
        F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"), F.col("kept").alias("__kept")
    ).hint("shuffle_hash")
    dealt = docs.withColumn("__hash", F.xxhash64("text"))
    joined = dealt.join(marks, (F.col("doc_id") == F.col("__doc_id")) & (F.col("__hash") == F.col("__text_hash")), "left")
    lines, kept = lines_of(F.col("text")), F.col("__kept")
    n_dropped = F.aggregate(F.map_values(kept), F.lit(0), lambda total, bits: total + F.lit(64) - F.bit_count(bits).cast("int"))
    every, one = F.lit(-1).cast("long"), F.lit(1).cast("long")
    stays = F.filter(
        lines,
        lambda _, i: F.coalesce(F.element_at(kept, F.floor(i / 64).cast("int")), every).bitwiseAND(
            F.call_function("shiftleft", one, i % 64)
        )
        != 0,
    )
    text = F.when(kept.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.when(kept.isNotNull(), n_dropped), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs without the lines that go, with n_lines and n_dropped.

    Columns that differ in case alone from another are left out but for doc_id and text: the first of each name stays.
    """
    names = {c.lower(): c for c in reversed(docs.columns)} | {"doc_id": "doc_id", "text": "text"}
    types = {c: dict(docs.dtypes).get(c, "string") for c in docs.columns if names[c.lower()] == c}
    named = keep_only(docs, **types | {"doc_id": "long", "text": "string"})
    return apply_bitmaps(named, drop_bitmaps(named.select("doc_id", "text"), min_chars, min_docs))
