"""Queries of which more ask than the expression forms of search send to a task, against their SQL; some vectors are
equal, so that ties go by row id."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import compare
from vicinity.operators import exact, forest, index
from vicinity.plans import registry

ROWS = exact.MOST_BROADCAST + 64


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """A folder with the table embeddings, every row of which asks."""
    at = tmp_path_factory.mktemp("many")
    r = np.random.default_rng(5)
    x = r.normal(size=(ROWS, 64)).astype(np.float32)
    x[-300:] = x[:300]
    columns = {"vec_id": 20 * np.arange(ROWS), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(r.integers(0, 10, ROWS), pa.int32())}
    pq.write_table(pa.table(columns), at / "embeddings.parquet", row_group_size=1500)
    return str(at)


def oracle(many, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{many}/embeddings.parquet'")
    return con.execute(registry.ORACLES[name])


ASKED_BY_MANY = [
    "a13_recall",
    "a16_label_vote",
    "a8_measure_report",
    "s11_result_text",
    "s14_result_readers",
    "a14_recall_of_lists",
    "a17_mean_similarity_at_rank",
    "s12_result_text_roundtrip",
    "s15_dump_labels",
    "a15_label_accuracy",
    "a19_nearest_label_agreement",
    "j5_names",
    "k9_intersection",
    "s13_result_builder",
    "k2_signature_topk",
    "k1_bruteforce_topk_native",
]


@pytest.mark.parametrize("name", ASKED_BY_MANY)
def test_more_queries_than_a_broadcast_takes(spark, many, name):
    df = registry.QUERIES[name](spark, many)
    rows, out = df.collect(), oracle(many, name)
    assert rows and compare.canonical(rows, df.columns) == compare.canonical(out.fetchall(), [d[0] for d in out.description])


def test_stored_vectors_are_scored_without_a_shuffle_of_pairs(spark, many):
    df = registry.QUERIES["v24_bf16_search"](spark, many)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the join with the queries comes last: no join follows that would shuffle pairs with their vectors
    assert re.search(r"\w+Join", plan)[0] == "BroadcastNestedLoopJoin"
    assert compare.canonical(df.collect(), df.columns) == compare.canonical(oracle(many, "v24_bf16_search").fetchall(), ["query_id", "close"])


def test_largest_errors_by_hand(spark):
    r = np.random.default_rng(3)
    x, q = r.normal(size=(70, 8)), r.normal(size=(5, 8))
    y = x + 0.01 * r.normal(size=x.shape)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "row_id long, vec array<double>, stored array<double>")
    got = exact.largest_errors(df.repartition(3), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>")).collect()
    want = [max(abs(((v - a) ** 2).sum() - ((v - b) ** 2).sum()) / 2 for a, b in zip(x, y)) for v in q]
    assert {g["query_id"]: g["error"] for g in got} == pytest.approx(dict(enumerate(want)))


def test_all_items_of_many_queries_are_ranked(spark, many, tmp_path):
    registry.QUERIES["f15_rescore"](spark, many).write.parquet(str(tmp_path / "got"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{many}/embeddings.parquet'")
    con.execute(f"create table want as {registry.ORACLES['f15_rescore']}")
    con.execute(f"create view got as select * from '{tmp_path}/got/*.parquet'")
    far = con.execute("select count(*), count(g.rank), count(*) filter (w.row_id <> g.row_id or abs(w.cosine - g.cosine) > 1.5e-6) from want w full join got g using (query_id, rank)").fetchone()
    assert far == (ROWS**2, ROWS**2, 0)


def test_rank_all_is_rescore_of_all_pairs(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(90, 8))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x[80:] = x[:10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>").repartition(3)
    q = df.where("row_id % 2 = 0").select(F.col("row_id").alias("query_id"), "vec")
    key = lambda f: sorted((a["query_id"], a["rank"], a["row_id"], round(a["cosine"], 9)) for a in f.collect())
    want = key(exact.rescore(df.select("row_id").crossJoin(q.select("query_id")), df, q))
    assert len(want) == 45 * 90 and key(exact.rank_all(df, q, block=7)) == want and key(exact.rank_all(df, q, block=7, most_batches=0)) == want
    assert exact.rank_all(df, q.limit(0)).count() == 0 and exact.rank_all(df.limit(0), q).count() == 0


#: Queries over the trees of several shards.
SHARDED = [
    "f7_packed_trees",
    "s6_index_tables",
]


@pytest.mark.parametrize("name", SHARDED)
def test_several_shards(spark, many, monkeypatch, name):
    whole = index.IndexConf
    monkeypatch.setattr(index, "IndexConf", lambda *a, **conf: whole(*a, **({} if a else {"forest": forest.ForestConf(shard_rows=1000)}) | conf))
    df = registry.QUERIES[name](spark, many)
    out = oracle(many, name)
    assert compare.canonical(df.collect(), df.columns) == compare.canonical(out.fetchall(), [d[0] for d in out.description])


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """A folder with a table embeddings of which 300 points are a small share."""
    at = tmp_path_factory.mktemp("wide")
    r = np.random.default_rng(6)
    x = r.normal(size=(12_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(r.integers(0, 10, len(x)), pa.int32())}), at / "embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["f19_compare_with_bruteforce", "f19_compare_storages"])
def test_recall_holds_as_items_grow(spark, wide, name):
    df = registry.QUERIES[name](spark, wide)
    out = oracle(wide, name)
    assert compare.canonical(df.collect(), df.columns) == compare.canonical(out.fetchall(), [d[0] for d in out.description])


def close_together(groups=3, size=400, dim=32):
    r = np.random.default_rng(8)
    x = np.repeat(r.normal(size=(groups, dim)), size, axis=0) + 0.02 * r.normal(size=(groups * size, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("strategy", ["data", "hadamard"])
def test_points_that_lie_close_together_are_split(strategy):
    conf = forest.ForestConf(strategy=strategy)
    for dim in (32, 8):
        x = close_together(dim=dim)
        for seed in range(5):
            tree = forest.build_tree(x, (seed, 1), conf)
            assert sorted(tree.members.tolist()) == list(range(len(x))) and 0 < min(tree.leaf_counts) and max(tree.leaf_counts) < conf.leaf_bound
            query, leaf = forest.take_leaves(tree, x, 1)
            assert query.tolist() == list(range(len(x))) and all(i in tree.leaf(j) for i, j in zip(query, leaf))
            assert strategy == "data" or (np.diff(tree.coords, axis=1) > 0).all()
    # equal points, of which there are two kinds, end in two leaves
    two = np.repeat(x[[0, 1]], 80, axis=0)
    assert sorted(forest.build_tree(two, (1,), conf).leaf_counts.tolist()) == [80, 80]


def test_top_k_native_with_few_items(spark):
    x = np.random.default_rng(9).normal(size=(40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>")
    q = df.where("row_id < 5").select(F.col("row_id").alias("query_id"), "vec")
    key = lambda f: sorted((a["query_id"], a["rank"], a["row_id"]) for a in f.collect())
    for k in (1, 7, 100):
        for share in (1, 16):
            assert key(exact.top_k_native(df, q, k, share)) == key(exact.brute_force(df, q, k))
    assert exact.top_k_native(df.limit(0), q, 3).count() == 0 and exact.top_k_native(df, q.limit(0), 3).count() == 0


@pytest.fixture(scope="module")
def near(tmp_path_factory):
    """A folder with a table embeddings, a part of which are copies of one vector but for the last digits."""
    at = tmp_path_factory.mktemp("near")
    r = np.random.default_rng(7)
    x = r.normal(size=(2000, 64))
    x[:600] = x[0] * (1 + 1e-6 * r.normal(size=(600, 64)))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), "label": pa.array(r.integers(0, 10, len(x)), pa.int32())}), at / "embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["f1_forest_leaves", "f5_data_informed_forest", "f10_visited_leaves"])
def test_near_copies_are_split_and_find_themselves(spark, near, name):
    df = registry.QUERIES[name](spark, near)
    out = oracle(near, name)
    assert compare.canonical(df.collect(), df.columns) == compare.canonical(out.fetchall(), [d[0] for d in out.description])


def test_nearest_labels_are_compared_for_all_items(spark, wide):
    t = pq.read_table(f"{wide}/embeddings.parquet")
    x, label = np.stack(t.column("embedding").to_pylist()).astype(float), t.column("label").to_numpy()
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = x @ x.T
    np.fill_diagonal(score, -2)
    agree = int((label[score.argmax(1)] == label).sum())
    got = {r["agree"]: r["n"] for r in registry.QUERIES["a19_nearest_label_agreement"](spark, wide).collect()}
    assert got == {True: agree, False: len(x) - agree}


def test_blocks_of_queries_beyond_a_broadcast_go_in_parts(spark):
    x = np.random.default_rng(12).normal(size=(90, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>").repartition(5)
    q = df.select(F.col("row_id").alias("query_id"), "vec")
    key = lambda f: sorted((a["query_id"], a["rank"], a["row_id"]) for a in f.collect())
    got = exact.brute_force(df, q, 3, most_blocks=2)
    # no block of queries is copied to groups of items
    assert "salt" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert key(got) == key(exact.brute_force(df, q, 3)) and len(key(got)) == 270


def test_storages_rank_near_copies_as_doubles_do(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 64))
    for g in r.permutation(2000).reshape(100, 20):
        x[g] = x[g[0]] / np.linalg.norm(x[g[0]]) + 0.001 / 8 * r.normal(size=(20, 64))
    columns = {"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), "label": pa.array(r.integers(0, 10, len(x)), pa.int32())}
    pq.write_table(pa.table(columns), tmp_path / "embeddings.parquet")
    df = registry.QUERIES["f19_compare_storages"](spark, str(tmp_path))
    out = oracle(str(tmp_path), "f19_compare_storages")
    assert compare.canonical(df.collect(), df.columns) == compare.canonical(out.fetchall(), [d[0] for d in out.description])


@pytest.mark.parametrize("storage", ["float", "bf16", "byte"])
def test_storage_is_off_by_no_more_than_its_bound(storage):
    from vicinity.functions import kernels

    x = np.random.default_rng(2).normal(size=(500, 64)) * np.random.default_rng(1).choice([1, 1e-3], (500, 64))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = kernels.decode_vectors(kernels.encode_vectors(x, storage), 64, storage)
    assert (np.linalg.norm(x - y, axis=1) <= kernels.storage_errors(y, storage)).all()
    for q in x[:20]:
        assert set(np.argsort(-(x @ q), kind="stable")[:5]) <= set(kernels.may_be_best(y, q, 5, storage).tolist())
