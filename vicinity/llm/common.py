"""What the operators share: reading tables, scratch tables, words and hashes as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.scratch import discard
from vicinity.scratch import written as cut

__all__ = ["BLANKS", "BLANK_CLASS", "ascii_lower", "cut", "discard", "hash128", "pick_rows", "strip_blanks", "table", "words"]

#: White space of the word contract, as a trim set and as a character class.
BLANKS = "\t\n\x0b\x0c\r "
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else.  ``lower`` does the same, faster, where every character is one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null or blank."""
    bare = strip_blanks(F.coalesce(c, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+", -1))


def hash128(*cs: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes from independent seeds: together wide enough to stand for the value at any corpus size."""
    return F.xxhash64(F.lit(1), *cs), F.xxhash64(F.lit(2), *cs)


#: Ids that may be broadcast to pick rows of a large table; beyond it the table is shuffled.
BROADCAST_IDS = 1_000_000


def pick_rows(docs: DataFrame, ids: DataFrame, id_col: str, ids_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids``, null ids included.  A counted, small set of ids is broadcast and
    the texts stay where they are; a larger one is hashed and the texts pass by."""
    ids = cut(ids.select(F.col(ids_col).alias("__vicinity_id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("__vicinity_id")), "left_semi")
