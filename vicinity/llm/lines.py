"""Line dedup over whole documents, in DataFrame operations only.

Lines become 128-bit hashes.  The hashes are range-partitioned together with the document id, with a secondary sort by
document and position, so that a line shared by a third of all rows still spreads over many partitions.  A window over
that order passes on the first occurrence of a line in each document as it streams by; the first occurrences become one
partial row per hash and partition, and only those partial rows are shuffled again.  The decision is a compressed keep
bitmap per document (64-bit words, words without a dropped line left out), not text.

Defined results: a null or empty text is one empty line; rows with a null id keep all their lines and count for
nothing; rows that repeat an id are one document, each row deciding for its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, hash128, strip_blanks

MIN_CHARS = 20
MIN_DOCS = 3


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, keep_words): one row per text that loses a line.

    ``keep_words`` maps word number to 64 keep bits (bit i of word w is line 64 w + i); a word that is not in the map
    keeps everything.
    """
    line = F.posexplode(line_array(F.col("text"))).alias("pos", "line")
    h1, h2 = hash128(F.col("key"))
    occurrences = cut(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
        .select("id", F.xxhash64("text").alias("text_hash"), line)
        .select("id", "text_hash", "pos", ascii_lower(strip_blanks(F.col("line"))).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(h1.alias("h1"), h2.alias("h2"), "id", "text_hash", "pos"),
        "line-occurrences",
    )
    repeated = cut(
        first_occurrences(occurrences).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("owner"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "owner"),
        "repeated-lines",
    )
    bit = F.expr("shiftleft(1L, pos % 64)")
    return (
        occurrences.join(repeated, ["h1", "h2"]).where("id <> owner")
        .groupBy("id", "text_hash", F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("dropped"))
        .groupBy("id", "text_hash")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("dropped")))).alias("keep_words"))
    )


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """The first row by position of each line (h1, h2) in each document (id): a scan of ranges of lines and documents,
    sorted by position within.  Both the ranges and the sort are what the window asks for, so neither is done twice."""
    ordered = occurrences.select("h1", "h2", "id", "pos").repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos")
    seen = F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("pos"))
    return ordered.withColumn("seen", seen).where("seen = 1").drop("seen")


def kept_text(text: Column, keep_words: Column) -> Column:
    """The text that the bitmap leaves; without a bitmap, all of it."""
    bit = lambda i: F.try_element_at(keep_words, F.floor(i / 64).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64))
    some = F.array_join(F.filter(line_array(text), lambda _, i: F.coalesce(bit(i) != 0, F.lit(True))), "\n")
    return F.when(keep_words.isNull(), F.coalesce(text, F.lit(""))).otherwise(some)


def dropped_lines(keep_words: Column) -> Column:
    each = F.transform(F.map_values(keep_words), lambda w: 64 - F.bit_count(w))
    return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0).cast("long"))


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with a column ``__vicinity_keep_words``.  The bitmaps are hashed, the texts only pass by: no sort of texts."""
    maps = keep_bitmaps(docs, id_col, text_col, **limits)
    maps = maps.select(F.col("id").alias("__vicinity_id"), F.col("text_hash").alias("__vicinity_text_hash"), F.col("keep_words").alias("__vicinity_keep_words"))
    on = (F.col(id_col) == F.col("__vicinity_id")) & (F.xxhash64(F.col(text_col)) == F.col("__vicinity_text_hash"))
    return docs.join(maps.hint("shuffle_hash"), on, "left").drop("__vicinity_id", "__vicinity_text_hash")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The columns of ``docs``, each text without the lines that later documents repeat.  A text that loses nothing
    is left as it is, null included."""
    text = F.col(text_col)
    out = with_bitmaps(docs, id_col, text_col, **limits)
    out = out.withColumn(text_col, F.when(F.col("__vicinity_keep_words").isNull(), text).otherwise(kept_text(text, F.col("__vicinity_keep_words"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Per document: lines, dropped lines and the digest of what stays."""
    out = with_bitmaps(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", **limits)
    text, keep = F.col("text"), F.col("__vicinity_keep_words")
    return out.select(
        "doc_id", F.size(line_array(text)).cast("long").alias("n_lines"), dropped_lines(keep).alias("n_dropped"),
        F.sha2(F.encode(kept_text(text, keep), "UTF-8"), 256).alias("kept_sha256"),
    )
