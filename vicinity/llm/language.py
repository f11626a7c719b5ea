"""Language identification by nearest centroid.

A text is a vector of hashed 1- to 3-byte n-grams of its lower-cased letters, weighted by log counts and inverse
document frequency over all learning rows, and scaled to length 1.  Each language has several centroids, found by
spherical k-means within a sample of its rows (``SAMPLE`` per language on average, chosen by hash; the only bound, and
it concerns fitting only).  The nearest centroid by cosine names the language; a text further from it than nearly all
of that centroid's own rows, by a wide factor, is rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; without any learning row
every text is; rows with a null id never teach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick_rows
from .textkit import map_arrow

BUCKETS = 4096
SAMPLE = 400
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected below this share of the cosine that 99 of 100 sampled rows of its centroid reach.
REJECT = 0.5
#: Languages times centroids that may be sent to every executor (16 kB each).
MOST_CENTROIDS = 4096
UNKNOWN = "und"

#: Bytes as n-grams see them: ASCII letters and all bytes of longer characters stand, everything else is a space.
SEEN = np.array([b if chr(b).isalpha() or b >= 128 else 32 for b in range(256)], np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of one text."""
    x = SEEN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    pair = x[:-1] << np.uint32(8) | x[1:]
    triple = pair[:-1] << np.uint32(8) | x[2:]
    counts = np.zeros(BUCKETS, np.int64)
    for salt, grams in enumerate((x, pair, triple)):
        hashed = (grams + np.uint32(salt << 28)) * np.uint32(2654435761)
        counts += np.bincount(hashed >> np.uint32(20), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if has_letter(text):
                seen += ngram_counts(text) > 0
                n += 1
    # bucket -1 counts the documents
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], seen]))], ["bucket", "n"])


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(ngram_counts(text)) * idf
    return (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, vector(t, idf).tobytes()) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "vec"])

    return run


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of the unit rows of x; starts are spread by farthest-first choice, so it is deterministic."""
    centers = [x.mean(0)]
    for _ in range(min(k, len(x))):
        centers.append(x[np.argmin((x @ np.array(centers).T).max(1))])
    c = np.array(centers[1:])
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _fit(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    raw = sorted(x.as_py() for x in t.column("vec"))  # rows come in any order
    x = np.array([np.frombuffer(r, np.float32) for r in raw])
    c = spherical_kmeans(x, CENTROIDS)
    cosine, near = (x @ c.T).max(1), (x @ c.T).argmax(1)
    reach = [float(np.quantile(cosine[near == i], 0.01)) if (near == i).any() else 1.0 for i in range(len(c))]
    return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "center": pa.array([r.astype(np.float32).tobytes() for r in c], pa.binary()), "reach": pa.array(reach)})


class Model:
    """What scoring needs: inverse document frequencies, centroids with their languages, rejection distances."""

    def __init__(self, idf: np.ndarray, langs: list[str], centers: np.ndarray, reach: np.ndarray):
        self.idf, self.langs, self.centers, self.reach = idf, langs, centers, reach

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        good = [i for i, t in enumerate(texts) if has_letter(t)]
        if good and len(self.langs):
            cosine = np.array([vector(texts[i], self.idf) for i in good]) @ self.centers.T
            best = cosine.argmax(1)
            top = cosine[np.arange(len(good)), best].astype(float)
            score[good] = np.clip(top, 0, 1)
            rejected[good] = top < REJECT * self.reach[best]
            for i, b in zip(good, best):
                lang[i] = self.langs[b]
        return lang, score, rejected


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on ``rows``: document frequencies over all of them, centroids on a sample of ``SAMPLE`` per language."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and id is not null")
    seen = map_arrow(rows.select("text"), _frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = {r["bucket"]: r["n"] for r in seen}
    n = counts.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([counts.get(i, 0) for i in range(BUCKETS)]))) + 0.05
    share = rows.groupBy("lang").count().select("lang", (F.lit(float(SAMPLE)) / F.col("count")).alias("share"))
    luck = (F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(1 << 30)) / float(1 << 30))
    # ids first: the texts of the sample are picked without moving any other
    ids = rows.select("id", "lang").join(share, "lang").where(luck < F.col("share"))
    sample = pick_rows(rows, ids, "id", "id").select("lang", "text")
    fitted = map_arrow(sample, _vectors(idf), "lang string, vec binary").groupBy("lang").applyInArrow(_fit, "lang string, center binary, reach double")
    fitted = sorted(fitted.limit(MOST_CENTROIDS + 1).collect())
    if len(fitted) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids to broadcast")
    centers = np.array([np.frombuffer(r["center"], np.float32) for r in fitted]).reshape(-1, BUCKETS)
    return Model(idf, [r["lang"] for r in fitted], centers, np.array([r["reach"] for r in fitted]))


def _predictions(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(ids, _predictions(model), f"id {ids.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """Per document its predicted language, learned from the rows outside the held-out part."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


def language_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with the model fitted on their non-null languages."""
    model = train(docs, id_col, text_col, lang_col)
    names = [f"`{c}`" for c in docs.columns]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~model.predict(batch.column(at).to_pylist())[2]))

    return map_arrow(docs.select(*names), run, docs.schema)
