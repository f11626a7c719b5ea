"""Evaluation of search results, as joins, windows and aggregates.

Results are (query_id, rank, row_id, cosine) with ranks from 1; ``truth`` is the exact result of the same queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.operators.exact import exclude_self

MOST_CUTOFF = 100


def recall(found: DataFrame, truth: DataFrame, cutoff: int, without_self: bool = True) -> DataFrame:
    """(cutoff, recall, deviation, queries) for the cutoffs 1 .. ``cutoff``: the share of the first c true neighbours
    among the first c found.  Only queries with ``cutoff`` results in both count."""
    if not 1 <= cutoff <= MOST_CUTOFF:
        raise ValueError(f"cutoffs go from 1 to {MOST_CUTOFF}")
    if without_self:
        found, truth = exclude_self(found), exclude_self(truth)
    found, truth = (x.where(F.col("rank") <= cutoff).select("query_id", "rank", "row_id") for x in (found, truth))
    enough = lambda x: x.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= cutoff).select("query_id")
    counted = enough(found).join(enough(truth), "query_id")
    # a true neighbour is found from the later of its two ranks on
    both = truth.join(found.select("query_id", "row_id", F.col("rank").alias("found_rank")), ["query_id", "row_id"]).join(counted, "query_id", "left_semi")
    hits = both.select("query_id", F.explode(F.sequence(F.greatest("rank", "found_rank"), F.lit(cutoff))).alias("cutoff")).groupBy("query_id", "cutoff").agg(F.count("*").alias("hits"))
    grid = counted.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(cutoff))).alias("cutoff"))
    each = grid.join(hits, ["query_id", "cutoff"], "left").select("cutoff", (F.coalesce("hits", F.lit(0)) / F.col("cutoff")).alias("share"))
    return each.groupBy("cutoff").agg(F.avg("share").alias("recall"), F.stddev_samp("share").alias("deviation"), F.count("*").alias("queries"))


def list_recall(found: Column, truth: Column, cutoff: int) -> Column:
    """The same share for two arrays of ids in the order of their ranks."""
    return F.size(F.array_intersect(F.slice(found, 1, cutoff), F.slice(truth, 1, cutoff))) / float(cutoff)


def label_accuracy(found: DataFrame, labels: DataFrame, rank: int = 1, without_self: bool = True) -> DataFrame:
    """(queries, missing, accuracy, neighbours): how often the neighbour at ``rank`` has the query's label, among the
    queries that have one.  ``labels`` is (row_id, label); all of its rows count as queries."""
    results = exclude_self(found) if without_self else found
    at = results.where(F.col("rank") == rank).select("query_id", F.col("row_id").alias("neighbour"))
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    other = labels.select(F.col("row_id").alias("neighbour"), F.col("label").alias("other"))
    each = labels.select(F.col("row_id").alias("query_id"), "label").join(at, "query_id", "left").join(other, "neighbour", "left").join(n, "query_id", "left")
    return each.agg(F.count("*").alias("queries"), F.count(F.when(F.col("neighbour").isNull(), 1)).alias("missing"),
                    F.avg(F.when(F.col("neighbour").isNotNull(), (F.col("label") == F.col("other")).cast("double"))).alias("accuracy"), F.avg(F.coalesce("n", F.lit(0))).alias("neighbours"))


def vote(found: DataFrame, labels: DataFrame, k: int, without_self: bool = True) -> DataFrame:
    """(query_id, label, votes): the most frequent label among the k nearest; ties go to the smaller label."""
    results = exclude_self(found) if without_self else found
    named = results.where(F.col("rank") <= k).join(labels.select("row_id", "label"), "row_id")
    counted = named.groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return counted.withColumn("place", F.row_number().over(order)).where("place = 1").select("query_id", "label", "votes")


def mean_similarity(found: DataFrame, queries: DataFrame, ranks: int = 10) -> DataFrame:
    """(rank, similarity): mean cosine at each rank over all queries, where a missing neighbour counts as 0."""
    grid = queries.select("query_id").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(ranks))))
    return grid.join(found.select("query_id", "rank", "cosine"), ["query_id", "rank"], "left").groupBy("rank").agg(F.avg(F.coalesce("cosine", F.lit(0.0))).alias("similarity"))


def neighbour_labels(found: DataFrame, labels: DataFrame, threshold: float, k: int) -> DataFrame:
    """(query_id, rank, query_label, row_id, label, cosine): neighbours above a similarity, with both labels."""
    mine = labels.select(F.col("row_id").alias("query_id"), F.col("label").alias("query_label"))
    return (found.where((F.col("rank") <= k) & (F.col("cosine") >= threshold)).join(labels.select("row_id", "label"), "row_id").join(mine, "query_id")
            .select("query_id", "rank", "query_label", "row_id", "label", "cosine"))


def report(df: DataFrame, column: str) -> DataFrame:
    """(n, low, high, mean) of a column of per-query measures."""
    return df.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"))
