"""Vectorised text kernels for the Arrow stages: words, shingle sets, bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Rows that a stage sees at a time.  Texts can be long, so batches are small; how many bytes cross to Python at once is
#: bounded by Spark (64 MB, or one row, by ``spark.sql.execution.arrow.maxBytesPerBatch``).
BATCH_ROWS = 256
#: Odd 64-bit constants of the splitmix64 generator.  Fixed values.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches cut to few rows: ``f`` turns few texts into Python objects at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that looks random."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 with A-Z lowered: both are what ``bytes`` methods do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words in order; with fewer words, the whole sequence as one."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix64(out * GOLDEN + h[i : len(h) - size + 1 + i])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingles(lower_words(text), size))
