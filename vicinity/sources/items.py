"""Readers of items: (row_id, name, label, vec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions import native


class InvalidVectorError(ValueError):
    """A vector of the wrong length, with NaN or infinity, or of almost no length."""


class DuplicateNameError(ValueError):
    """A name that two items have."""


def split_valid(raw: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of rows (row_id, name, label, vec): unit vectors, and the rows that cannot be indexed with
    the reason."""
    vec = F.col("vec").cast("array<double>")
    raw = raw.select("row_id", "name", F.col("label").cast("int").alias("label"), vec.alias("vec"))
    ok = native.is_valid(F.col("vec"), dim) & F.col("name").isNotNull()
    reason = F.when(F.col("name").isNull(), "name").when(F.coalesce(F.size("vec") != dim, F.lit(True)), "length").when(~native.is_valid(F.col("vec")), "values")
    accepted = raw.where(ok).withColumn("vec", native.normalize(F.col("vec")))
    return accepted, raw.where(~ok).withColumn("reason", reason)


def ingest(raw: DataFrame, dim: int, strict: bool = True) -> DataFrame:
    """Valid unit items.  Strict: an invalid row or a name that occurs twice is an error; else invalid rows are left out."""
    accepted, rejected = split_valid(raw, dim)
    if strict:
        if bad := rejected.select("row_id", "reason").limit(1).collect():
            raise InvalidVectorError(f"row {bad[0]['row_id']}: {bad[0]['reason']}")
        if twice := accepted.groupBy("name").count().where("count > 1").limit(1).collect():
            raise DuplicateNameError(twice[0]["name"])
    return accepted


def from_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The embeddings table as raw items: ids are names."""
    e = spark.read.parquet(path)
    return e.select(F.col("vec_id").alias("row_id"), F.col("vec_id").cast("string").alias("name"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def int_cell(c: Column) -> Column:
    """An integer cell, which may end in ``.0``."""
    return F.regexp_replace(F.trim(c), r"\.0$", "").cast("int")


def double_cell(c: Column) -> Column:
    return F.trim(c).cast("double")


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, top: int | None = None) -> DataFrame:
    """Rows of strings; ``top`` keeps the first records of a file."""
    df = spark.read.csv(path, sep=sep, header=header, mode="FAILFAST")
    return df if top is None else df.limit(top)


def labelled_csv(spark: SparkSession, path: str, label_col: str, normalize: bool = False, sep: str = ",") -> DataFrame:
    """(label, vec) of a CSV file with a header: one integer label column, all others features in file order."""
    df = read_csv(spark, path, sep)
    if label_col not in df.columns:
        raise ValueError(f"no column {label_col}")
    vec = F.array(*[double_cell(F.col(f"`{c}`")) for c in df.columns if c != label_col])
    return df.select(int_cell(F.col(f"`{label_col}`")).alias("label"), (native.normalize_if_long(vec) if normalize else vec).alias("vec"))


#: Text formats: name and label from the tokens of a line, and the first token of the vector.
FORMATS = {"word": r"\s+", "label": ",", "part": r"\s+", "vector": r"\s+"}


def from_lines(lines: DataFrame, form: str) -> DataFrame:
    """(name, label, vec) from a column ``value`` of lines: ``word f1 ..``, ``label,f1,..``, ``file part label f1 ..``
    or ``f1 ..``.  A name or label that a form lacks is null or -1."""
    if form not in FORMATS:
        raise ValueError(f"unknown form {form}")
    t = F.split(F.trim("value"), FORMATS[form])
    skip = {"word": 1, "label": 1, "part": 3, "vector": 0}[form]
    name = {"word": t[0], "part": F.concat_ws("_", t[0], t[1])}.get(form, F.lit(None).cast("string"))
    label = {"label": int_cell(t[0]), "part": int_cell(t[2])}.get(form, F.lit(-1))
    vec = F.transform(F.slice(t, skip + 1, F.greatest(F.size(t) - skip, F.lit(0))), lambda x: x.cast("double"))
    return lines.select(name.alias("name"), label.alias("label"), vec.alias("vec"))
