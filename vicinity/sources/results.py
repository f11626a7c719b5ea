"""Search results as text: a line of stars, ``n<TAB>query:<TAB>name``, then ``<TAB>rank<TAB>name<TAB>cosine`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STARS = "*" * 40


class ResultFormatError(ValueError):
    """A line that is none of the three kinds, or a neighbour before any query."""


class DuplicateQueryError(ValueError):
    """A query that has two results."""


def build(neighbours: DataFrame) -> DataFrame:
    """(query, neighbours) with an ordered array per query from (query, rank, name, label, cosine)."""
    if neighbours.groupBy("query", "rank").count().where("count > 1").limit(1).count():
        raise DuplicateQueryError("a query has two neighbours of one rank")
    return neighbours.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "label", "cosine"))).alias("neighbours"))


def text_lines(neighbours: DataFrame) -> DataFrame:
    """(query, line_no, line) of results (query, rank, name, cosine): two header lines, then one per neighbour."""
    n = neighbours.groupBy("query").agg(F.count("*").alias("n"))
    head = n.select("query", F.explode(F.array(F.struct(F.lit(-1).alias("line_no"), F.lit(STARS).alias("line")), F.struct(F.lit(0).alias("line_no"), F.concat_ws("\t", F.col("n").cast("string"), F.lit("query:"), "query").alias("line")))).alias("x")).select("query", "x.*")
    body = neighbours.select("query", F.col("rank").cast("int").alias("line_no"), F.concat_ws("\t", F.lit(""), F.col("rank").cast("string"), "name", F.col("cosine").cast("string")).alias("line"))
    return head.unionByName(body)


def to_text(neighbours: DataFrame, path: str) -> None:
    """One folder of text whose parts, in order, hold whole queries in the order of their names."""
    text_lines(neighbours).repartitionByRange("query").sortWithinPartitions("query", "line_no").select("line").write.text(path)


def parse_lines(lines: DataFrame) -> DataFrame:
    """(query, rank, name, cosine) from (place, line), where ``place`` orders the lines of one file.  Labels are not in
    the format and come back as -1."""
    t = F.split("line", "\t")
    kind = F.when(F.col("line").rlike(r"^\*+$"), "stars").when(F.col("line").rlike(r"^\d+\tquery:\t"), "query").when(F.col("line").rlike(r"^\t\d+\t.*\t[-+0-9.eENa]+$"), "hit").otherwise("bad")
    marked = lines.withColumn("kind", kind).withColumn("t", t)
    query = F.last(F.when(F.col("kind") == "query", t[2]), ignorenulls=True).over(Window.partitionBy("file").orderBy("place"))
    marked = marked.withColumn("query", query)
    if bad := marked.where("kind = 'bad' or kind = 'hit' and query is null").select("line").limit(1).collect():
        raise ResultFormatError(bad[0]["line"])
    return marked.where("kind = 'hit'").select("query", F.col("t")[1].cast("int").alias("rank"), F.col("t")[2].alias("name"), F.lit(-1).alias("label"), F.col("t")[3].cast("double").alias("cosine"))


def from_text(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``to_text`` wrote.  Parts are read whole, as a part holds whole queries."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("place", "line")).where("line <> ''")
    return parse_lines(lines)


def of_query(results: DataFrame, query: str) -> DataFrame:
    return results.where(F.col("query") == query)


def has_query(results: DataFrame, query: str) -> bool:
    return bool(of_query(results, query).limit(1).count())
