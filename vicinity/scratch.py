"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own clean-up of a finished execution's shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that cross to a Python worker at once.  Buffers grow by doubling on both sides, so that Spark's own 64 MB cost an
#: executor of two cores several hundred.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at or os.path.join(tempfile.gettempdir(), "vicinity-shared")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder.  What is there goes when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/vicinity/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends here, and a lost executor costs nothing that was written.
    The shuffle files of the write go with it, and Arrow batches are small meanwhile.  The table goes when ``discard`` is called or the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    wanted = {CLEANUP: "true", BATCH_BYTES: str(MOST_BYTES)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing will read again."""
    for t in tables:
        _remove(t.sparkSession, t._scratch_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before us: nothing is left to ask
        pass
