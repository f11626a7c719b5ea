"""Registered queries against their SQL, and the pipeline stage by stage."""

import os

import pytest

import compare
import corpus_pipeline
from vicinity.llm import decontaminate, language, mixing, oracles, queries, setsketch
from vicinity.llm.common import table

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name in oracles.ORACLES:
        out = compare.connect(SMALL).execute(oracles.ORACLES[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == sorted(df.columns)
        assert compare.canonical(rows, df.columns) == compare.canonical(out.fetchall(), names)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, tmp_path):
    from test_lines import expected as kept_lines
    from test_setsketch import expected as components

    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns
        seen.append(docs.collect())
    rows = [{r["doc_id"]: r["text"] for r in s} for s in seen]
    model = language.train(table(spark, SMALL, "documents"))
    rejected = dict(zip(rows[0], model.predict(list(rows[0].values()))[2]))
    assert set(rows[1]) == {d for d in rows[0] if not rejected[d]} and len(rows[1]) > 0.95 * len(rows[0])
    import hashlib

    want = {d: h for d, _, _, h in kept_lines(list(rows[1].items()))}
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in rows[2].items()} == want
    near = components(list(rows[2].items()), 5)
    assert set(rows[3]) == {d for d, _, _, kept in near if kept}
    held = {r["doc_id"] for r in decontaminate.contamination_report(spark.read.parquet(str(tmp_path / "2")), table(spark, SMALL, "benchmark")).collect()}
    assert set(rows[4]) == set(rows[3]) - held
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_report(spark.read.parquet(str(tmp_path / "3"))).collect()}
    copies = {}
    for r in seen[5]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {d: n for d, n in plan.items() if n}
    assert setsketch.near_duplicates(docs, size=5).count() == len(seen[5])
