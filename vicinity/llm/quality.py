"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of a whole text (proportions of character kinds, word and line shapes, repetition) are standardised over all
documents and mapped to ``FEATURES`` random cosines, whose inner products approximate a Gaussian kernel.  Every
partition sums its share of the normal equations; the sums are added on the cluster and solved on the driver (a fixed
257 x 257 system).  Ridge scores become probabilities by isotonic regression over a fixed histogram of all learning
rows.

Defined results: a null text counts as an empty one and is scored; several labels of an id count as their mean; a null
label teaches nothing; without any learning row every score is 0.5; scores are a function of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textkit import map_arrow

FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-2
BINS = 512
SEED = 2
THRESHOLD = 0.3
SUM_TASKS = 16

NAMES = ("bytes", "words", "word_length", "word_spread", "upper", "digit", "punct", "bang", "bar", "symbol", "bracket", "quote", "stop", "comma",
         "wide", "newline", "distinct", "common", "adjacent", "bare", "capital", "entropy", "line_length", "line_distinct")


def _kind(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


KINDS = np.array([
    (np.arange(256) >= 65) & (np.arange(256) <= 90), (np.arange(256) >= 48) & (np.arange(256) <= 57),
    [33 <= b < 127 and not chr(b).isalnum() for b in range(256)],
    _kind("!"), _kind("|"), _kind("$%&*#@^~+="), _kind("<>{}[]()/\\"), _kind("\"'`"), _kind(".?"), _kind(",;:"), np.arange(256) >= 128, _kind("\n"),
]).astype(float)


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``NAMES``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = KINDS @ count / len(data)
    share = count[count > 0] / len(data)
    words = data.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    bag: dict[bytes, int] = {}
    for w in words:
        bag[w] = bag.get(w, 0) + 1
    lines = data.split(b"\n")
    adjacent = sum(map(eq, words, words[1:]))
    bare = sum(1 for w in bag if not w.isalpha() and w.isascii()) / max(len(bag), 1)
    capital = sum(map(bytes.istitle, words)) / n
    stats = [np.log1p(len(data)), np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std())]
    # proportions of rare kinds on a scale that tells 0.1 % from 1 %
    stats += list(np.log1p(100 * kinds))
    stats += [len(bag) / n, max(bag.values(), default=0) / n, adjacent / n, bare, capital, float(-(share * np.log2(share)).sum()), np.log1p(len(data) / len(lines)), len(set(lines)) / len(lines)]
    return [float(s) for s in stats]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(ids, _statistics, f"id {ids.schema['id'].dataType.simpleString()}, stats array<double>")


class Fourier:
    """A fixed random map from standardised statistics to cosines."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def _stack(column) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, len(NAMES))


def _normal_sums(fourier: Fourier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            z, y = fourier(_stack(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((FEATURES + 1) * (FEATURES + 2))
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``mean`` in weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(n, m) for _, m, n in blocks]) if blocks else np.empty(0)


class Model:
    """Statistics to calibrated score."""

    def __init__(self, fourier: Fourier, weights: np.ndarray, at: np.ndarray, values: np.ndarray):
        self.fourier, self.weights, self.at, self.values = fourier, weights, at, values

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        # rounded: sums differ in the last bits with the rows that share a batch
        return np.round(np.clip(np.interp(self.raw(stats), self.at, self.values), 0, 1), 9) if len(self.at) else np.full(len(stats), 0.5)


def _raw_scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_stack(batch.column(0)))), batch.column(1)], ["raw", "y"])

    return run


def train(stats: DataFrame, labelled: DataFrame) -> Model:
    """``stats``: (id, stats) of all documents, for their scale.  ``labelled``: (stats, y) of the learning rows."""
    moments = stats.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale")).collect()
    mean, scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
    for r in moments:
        mean[r["i"]], scale[r["i"]] = r["mean"], r["scale"]
    fourier = Fourier(mean, scale)
    sums = map_arrow(labelled, _normal_sums(fourier), "sums binary").repartition(SUM_TASKS)
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in map_arrow(sums, _add_sums, "sums binary").collect():
        total += np.frombuffer(r["sums"]).reshape(total.shape)
    n = total[-1, -2]
    ridge = RIDGE * max(n, 1) / FEATURES * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-9
    model = Model(fourier, np.linalg.solve(total[:, :-1] + ridge, total[:, -1]), np.empty(0), np.empty(0))
    if n == 0:
        return model
    low, high = -0.5, 1.5
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("raw") - low) / (high - low) * BINS)))
    bins = map_arrow(labelled, _raw_scores(model), "raw double, y double").groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw"))
    bins = sorted(bins.collect(), key=lambda r: r["bin"])
    model.at = np.array([r["raw"] for r in bins])
    model.values = isotonic(np.array([float(r["n"]) for r in bins]), np.array([r["y"] for r in bins]))
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stack(batch.column(1))))], ["id", "score"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its calibrated quality score, learned from the labels outside the held-out fifth."""
    stats = cut(document_statistics(docs), "document-statistics")
    teach = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").cast("double").alias("y"))
    labelled = cut(stats.join(teach, "id").select("stats", "y"), "learning-rows")
    model = train(stats, labelled)
    kind = stats.schema["id"].dataType.simpleString()
    out = map_arrow(stats, _scores(model), f"id {kind}, score double")
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
