"""Text formats, CSV and streams."""

import pytest
from pyspark.sql import functions as F

from vicinity.sources import items as sources
from vicinity.sources import results
from vicinity.streaming import ingest


def test_result_text_round_trip(spark, tmp_path):
    rows = [("a b", 1, "x", 7, 0.5), ("a b", 2, "y", 7, 0.25), ("q", 1, "x", 7, -1.0)]
    df = spark.createDataFrame(rows, "query string, rank int, name string, label int, cosine double")
    results.to_text(df, str(tmp_path / "r"))
    back = results.from_text(spark, str(tmp_path / "r"))
    assert sorted(tuple(r) for r in back.collect()) == sorted((q, k, n, -1, c) for q, k, n, _, c in rows)
    assert results.has_query(back, "q") and not results.has_query(back, "z")
    with pytest.raises(results.DuplicateQueryError):
        results.build(df.unionByName(df))


@pytest.mark.parametrize("line", ["junk", "\t1\tname\t0.5"])
def test_result_text_errors(spark, tmp_path, line):
    (tmp_path / "bad.txt").write_text(line + "\n")
    with pytest.raises(results.ResultFormatError):
        results.from_text(spark, str(tmp_path / "bad.txt")).count()


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("label,a,b\n1.0,3,4\n2,0,0\n")
    got = sources.labelled_csv(spark, str(tmp_path / "x.csv"), "label", normalize=True)
    assert [(r["label"], r["vec"]) for r in got.collect()] == [(1, [0.6, 0.8]), (2, [0.0, 0.0])]
    with pytest.raises(ValueError):
        sources.labelled_csv(spark, str(tmp_path / "x.csv"), "nope")
    assert sources.read_csv(spark, str(tmp_path / "x.csv"), top=1).count() == 1


@pytest.mark.parametrize("form,line,want", [
    ("word", "the 1 2.5", ("the", -1, [1.0, 2.5])), ("label", "3,1,2", (None, 3, [1.0, 2.0])),
    ("part", "f p 4 1 2", ("f_p", 4, [1.0, 2.0])), ("vector", "1 2", (None, -1, [1.0, 2.0]))])
def test_line_formats(spark, form, line, want):
    assert tuple(sources.from_lines(spark.createDataFrame([(line,)], "value string"), form).head()) == want


def test_streaming_ingest_sums_and_rejects(spark, tmp_path):
    rows = [(i, f"n{i}", 0, [float((i * k) % 7 + 1) for k in range(8)]) for i in range(20)] + [(99, "bad", 0, [0.0] * 8)]
    df = spark.createDataFrame(rows, "row_id long, name string, label int, vec array<double>")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.start_ingest(stream, str(tmp_path / "out"), 8).awaitTermination()
    stored = ingest.stored_items(spark, str(tmp_path / "out"))
    assert stored.count() == 20 and stored.where(F.size("sig") == 16).count() == 20
    gram, n = ingest.running_gram(spark, str(tmp_path / "out"))
    assert n == 20 and abs(gram.trace() - 20) < 1e-9
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 1


def test_scratch_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from vicinity import scratch

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        scratch.shared_dir(Cluster)
    Cluster.sparkContext.master = "local[4]"
    assert scratch.shared_dir(Cluster)


def test_entry_without_training_operators(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "vicinity.llm", None)
    assert not any(n.startswith("op") for n in __spark_entry__.queries()) and len(__spark_entry__.queries()) > 80
