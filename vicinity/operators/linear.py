"""Gram matrix, projection on leading directions, and running moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions import kernels, native

MOST_DIRECTIONS = 32
#: Partitions' sums are added in this many tasks before they reach the driver.
SUM_TASKS = 16


def _sums(make):
    """A stage that adds up ``make(batch matrix)`` over a partition and returns one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            x = kernels.matrix(batch.column(0))
            part = make(x)
            total = part if total is None else total + part
            n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n])], ["sums", "n"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for x, m in zip(batch.column(0), batch.column(1).to_pylist()):
            x = np.frombuffer(x.as_py())
            total = x if total is None else total + x
            n += m
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n])], ["sums", "n"])


def gram_matrix(items: DataFrame, vec_col: str = "vec") -> tuple[np.ndarray, int]:
    """X'X and the number of rows, summed in partitions, then in a few tasks, then on the driver (d x d at each step)."""
    parts = items.select(vec_col).mapInArrow(_sums(lambda x: x.T @ x), "sums binary, n long").repartition(SUM_TASKS).mapInArrow(_add, "sums binary, n long")
    total, n = 0.0, 0
    for r in parts.collect():
        x = np.frombuffer(r["sums"])
        total, n = total + x.reshape(int(len(x) ** 0.5), -1), n + r["n"]
    if n == 0:
        raise ValueError("no rows")
    return total, n


def gram_entries(items: DataFrame, vec_col: str = "vec") -> DataFrame:
    """(i, j, value) of X'X as an ordinary aggregate, j >= i."""
    pairs = items.select(F.posexplode(vec_col).alias("i", "x"), vec_col).select("i", "x", F.posexplode(vec_col).alias("j", "y")).where("j >= i")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def leading_directions(gram: np.ndarray, n: int, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, Vt) of X'X / (n - 1), largest first; each direction's largest component is positive."""
    values, vectors = np.linalg.eigh(gram / max(n - 1, 1))
    values, vt = values[::-1], vectors.T[::-1]
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
    k = len(vt) if k is None else k
    return values[:k], (vt * np.where(sign == 0, 1, sign)[:, None])[:k]


def directions_for(dim: int) -> int:
    return min(MOST_DIRECTIONS, native.largest_power_of_2(dim))


def sketched_gram(items: DataFrame, buckets: int = 1000, seed: int = 5, vec_col: str = "vec", id_col: str = "row_id") -> np.ndarray:
    """S'S of a row sketch S: every row is added with a random normal weight to one of ``buckets`` rows."""
    weight = F.sqrt(-2 * F.log((F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) + 0.5) / float(1 << 40))) * F.cos(
        2 * np.pi * F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40))
    cells = items.select(F.pmod(F.xxhash64(F.lit(seed + 2), F.col(id_col)), F.lit(buckets)).alias("bucket"), weight.alias("w"), F.posexplode(vec_col).alias("i", "x"))
    rows = cells.groupBy("bucket", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x")).groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    return gram_matrix(rows)[0]


def project(items: DataFrame, vt: np.ndarray, vec_col: str = "vec", out: str = "projected") -> DataFrame:
    """``items`` with the k inner products with the rows of Vt."""
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = kernels.matrix(batch.column(names.index(vec_col))).reshape(-1, vt.shape[1]) @ vt.T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), pa.list_(pa.float64()))], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(run, f"{fields}, {out} array<double>")


def project_native(vec: Column, vt: np.ndarray) -> Column:
    """The same as an expression."""
    return F.array(*[native.dot(vec, F.array(*[F.lit(float(x)) for x in row])) for row in vt])


def with_signatures(items: DataFrame, signs: np.ndarray, vec_col: str = "vec", out: str = "sig") -> DataFrame:
    """``items`` with an array of signature words."""
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = kernels.matrix(batch.column(names.index(vec_col))).reshape(-1, signs.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(kernels.signatures(x, signs)), pa.list_(pa.int64()))], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(run, f"{fields}, {out} array<bigint>")


def moments(items: DataFrame, vec_col: str = "vec") -> DataFrame:
    """(i, n, mean, variance) of every component, with n - 1."""
    return items.select(F.posexplode(vec_col).alias("i", "x")).groupBy("i").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))


def signed_moments(items: DataFrame, vec_col: str = "vec") -> DataFrame:
    """(i, n, mean, positive, negative): second moments of a component over its positive and its other values."""
    x = F.col("x")
    return items.select(F.posexplode(vec_col).alias("i", "x")).groupBy("i").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.sum(F.when(x > 0, x * x).otherwise(0.0)).alias("positive"), F.sum(F.when(x > 0, 0.0).otherwise(x * x)).alias("negative"))


def dump_matrix(spark: SparkSession, matrix: np.ndarray, path: str) -> None:
    """A small matrix as text: a line per row, its number first, tabs between."""
    lines = [("\t".join([str(i), *(repr(float(x)) for x in row)]),) for i, row in enumerate(matrix)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
