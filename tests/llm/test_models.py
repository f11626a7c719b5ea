"""Language ID and the quality classifier: held-out accuracy, defined edge results, what they may not see."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.llm import language, quality

PARTS = {"aa": "ba be bi bo tha ver en", "bb": "ou ai eau tion que ré ê", "cc": "zz kr sch ß ü ung"}


def text(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang].split()) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(docs_of):
    rows = [(i, text(lang, i), "s", lang) for i, lang in enumerate(list(PARTS) * 80)]
    return docs_of(rows + [(1000, None, None, "aa"), (1001, "", None, None), (1002, "123 !!", None, None), (1003, text("bb", 1, 20000), None, None), (None, text("cc", 2), None, None), (1004, "12 " * 50 + text("aa", 5, 3), None, None)], extra=True)


def test_languages(corpus):
    got = {r["doc_id"]: r for r in language.language_report(corpus).collect()}
    assert len(got) == 246
    for i, lang in enumerate(list(PARTS) * 80):
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "bb", "cc", "aa"]
    assert all(got[i]["score"] == 0 and got[i]["rejected"] for i in (1000, 1001, 1002))
    assert sum(r["rejected"] for r in got.values()) <= 4


def test_held_out_languages_do_not_teach(corpus):
    swapped = corpus.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    key = lambda df: sorted(map(tuple, language.language_report(df).collect()), key=repr)
    assert key(swapped) == key(corpus)


def test_foreign_text_is_rejected(corpus, docs_of):
    model = language.train(corpus)
    lang, _, rejected = model.predict(["qqq jjj wyx qqqj xwq jqy " * 20, text("aa", 7)])
    assert list(rejected) == [True, False] and lang[1] == "aa"
    kept = language.language_filter(corpus)
    assert kept.columns == corpus.columns and kept.where("doc_id < 240").count() == 240 and kept.where("doc_id in (1000, 1001, 1002)").count() == 0
    assert language.language_report(docs_of([])).count() == 0
    alone = language.language_report(docs_of([(0, "no teacher"), (1, None)])).collect()
    assert {r["lang_pred"] for r in alone} == {"und"}


def test_kmeans_finds_clusters():
    r = np.random.default_rng(0)
    base = np.eye(3, 8)
    x = np.repeat(base, 30, 0) + r.normal(size=(90, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ((language.spherical_kmeans(x, 3) @ base.T).max(0) > 0.99).all()
    assert len(language.spherical_kmeans(x[:2], 4)) == 2


def junk(seed):
    return " ".join(w.upper() + "!!" for w in text("aa", seed, 40).split())


def labelled(spark, docs_of, n=600):
    rows = [(i, junk(i) if i % 5 == 0 else text("bb", i, 40)) for i in range(n)] + [(9000, None), (9001, ""), (9002, text("bb", 3, 20000)), (None, "no id")]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(n)] + [(0, 0, 1), (9000, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs_of(rows, extra=True), labels


def test_quality_on_held_out_rows(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    got = {r["doc_id"]: r for r in quality.quality_report(docs, labels).collect()}
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(600) if got[i]["held_out"]]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["predicted"] == (i % 5 != 0) for i in held)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values()) and got[9000]["score"] == got[9001]["score"]


def test_held_out_labels_do_not_teach(spark, docs_of):
    docs, labels = labelled(spark, docs_of, 200)
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda x: {r["doc_id"]: round(r["score"], 9) for r in quality.quality_report(docs, x).collect()}
    assert key(turned) == key(labels)


def test_quality_without_labels_or_rows(spark, docs_of):
    docs, labels = labelled(spark, docs_of, 5)
    assert {r["score"] for r in quality.quality_report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_report(docs_of([]), labels).count() == 0


def test_isotonic():
    assert quality.isotonic(np.ones(4), np.array([1.0, 0.0, 2.0, 1.0])).tolist() == [0.5, 0.5, 1.5, 1.5]
    assert quality.isotonic(np.array([3.0, 1.0]), np.array([1.0, 0.0])).tolist() == [0.75, 0.75]


def test_fourier_features_approximate_the_kernel():
    f = quality.Fourier(np.zeros(24), np.ones(24))
    x = np.random.default_rng(1).normal(size=(30, 24))
    z = f(x)[:, :-1]
    gauss = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - gauss).mean() < 0.06


def test_number_signs_are_no_letters():
    assert not any(map(language.has_letter, [None, "", "½ ² ① 12 !", "_", "٣"])) and all(map(language.has_letter, ["1a", "ß", "字", "½ x"]))
