"""Streaming ingest: micro-batches of raw items become index rows and running sums.

Each batch appends unit items and their signatures and one row with its Gram sum, all keyed by batch id, so a batch
that runs again replaces itself.  Directions come from the sum of the rows at any time; a forest is built from the
items as usual.  Search against a stream of queries runs batch by batch on a stored index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinity.functions import kernels
from vicinity.operators import linear
from vicinity.operators.index import Index
from vicinity.sources import items as sources


def ingest_batch(path: str, dim: int) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = sources.split_valid(batch, dim)
        accepted = linear.with_signatures(accepted, kernels.signature_signs(dim))
        accepted.write.mode("overwrite").parquet(f"{path}/items/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
        stored = batch.sparkSession.read.parquet(f"{path}/items/batch={batch_id}")
        if stored.limit(1).count():
            gram, n = linear.gram_matrix(stored)
            row = [(gram.tobytes(), n)]
            batch.sparkSession.createDataFrame(row, "gram binary, n long").write.mode("overwrite").parquet(f"{path}/gram/batch={batch_id}")

    return run


def start_ingest(stream: DataFrame, path: str, dim: int, available_now: bool = True) -> StreamingQuery:
    """Ingest a stream of (row_id, name, label, vec)."""
    writer = stream.writeStream.foreachBatch(ingest_batch(path, dim)).option("checkpointLocation", f"{path}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stored_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/items").select("row_id", "name", "label", "vec", "sig")


def running_gram(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    """X'X and n over all batches so far: one row per batch."""
    total, n = 0.0, 0
    for r in spark.read.parquet(f"{path}/gram").select("gram", "n").toLocalIterator():
        x = np.frombuffer(r["gram"])
        total, n = total + x.reshape(int(len(x) ** 0.5), -1), n + r["n"]
    return total, n


def start_search(stream: DataFrame, index: Index, k: int, path: str, available_now: bool = True) -> StreamingQuery:
    """Answer a stream of queries (query_id, vec) against an index; results go to ``path``/results by batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        index.search(batch, k).write.mode("overwrite").parquet(f"{path}/results/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/progress-search")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
