"""Exact search, forests, index and evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.functions import kernels
from vicinity.operators import evaluate, exact, forest, index, linear
from vicinity.sources import items as sources


def clustered(groups=300, size=4, dim=64, seed=21, flip=0.1):
    r = np.random.default_rng(seed)
    base = np.abs(r.normal(size=(groups, 1, dim))) * r.choice([-1, 1], (groups, 1, dim))
    x = (base * np.where(r.random((groups, size, dim)) < flip, -1, 1)).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, size=4):
    return spark.createDataFrame([(i, f"i{i}", i // size, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, name string, label int, vec array<double>")


@pytest.fixture(scope="module")
def data(spark):
    x = clustered()
    df = frame(spark, x)
    df.cache()
    return x, df


def asked(df, every=20):
    return df.where(F.col("row_id") % every == 0).select(F.col("row_id").alias("query_id"), "vec")


def test_brute_force_matches_numpy(spark, data):
    x, df = data
    rows = exact.brute_force(df, asked(df), 5).collect()
    score = x[::20] @ x.T
    for q in range(0, len(x), 20):
        mine = sorted((r["rank"], r["row_id"]) for r in rows if r["query_id"] == q)
        order = np.lexsort((np.arange(len(x)), -score[q // 20]))[:5]
        assert [m[1] for m in mine] == order.tolist() and mine[0][1] == q
    native = exact.rank_within(exact.scored_pairs(df, asked(df)), 5)
    assert sorted((r["query_id"], r["rank"], r["row_id"]) for r in native.collect()) == sorted((r["query_id"], r["rank"], r["row_id"]) for r in rows)


def test_brute_force_with_replicated_queries_and_ties(spark):
    x = np.ones((9, 8)) / np.sqrt(8)
    df = frame(spark, x)
    q = df.limit(2).select(F.col("row_id").alias("query_id"), "vec")
    for blocks in (64, 0):
        rows = exact.brute_force(df, q, 3, most_blocks=blocks).collect()
        assert sorted((r["query_id"], r["rank"], r["row_id"]) for r in rows) == [(i, k + 1, k) for i in (0, 1) for k in range(3)]
    assert exact.brute_force(df, q, 50).count() == 18
    assert exact.brute_force(df.limit(0), q, 3).count() == 0
    assert exact.brute_force(df, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        exact.brute_force(df, q, 0)


@pytest.mark.parametrize("strategy", ["hadamard", "data"])
def test_tree_partitions_its_points(strategy):
    x = clustered(dim=32)
    conf = forest.ForestConf(strategy=strategy)
    tree = forest.build_tree(x, (1, 2, 3), conf)
    assert sorted(tree.members.tolist()) == list(range(len(x))) and max(tree.leaf_counts) < conf.leaf_bound
    again = forest.Tree.unpack(tree.pack())
    assert (again.children == tree.children).all() and np.allclose(again.projections, tree.projections) and (again.members == tree.members).all()
    # every point is at home in the first leaf that it takes; greedy takes no other
    for greedy in (False, True):
        query, leaf = forest.take_leaves(tree, x, 1, greedy)
        assert query.tolist() == list(range(len(x))) and all(i in tree.leaf(j) for i, j in zip(query, leaf))
    assert len(forest.take_leaves(tree, x, 1000, greedy=True)[0]) == len(x)


def plain_scores(tree, q):
    """Paths to every leaf that the signs of one query lead to, one node at a time."""
    out, todo = {}, [(0, 0.0, 0)]
    matrix = kernels.hadamard(np.eye(8))
    while todo:
        node, total, depth = todo.pop()
        y = q[tree.coords[node]] * tree.projections[node]
        o = matrix @ (y / np.sqrt(y @ y + 1e-4))
        for i, v in enumerate(o):
            child = int(tree.children[node][i if v > 0 else i + 8])
            if child >= 0:
                todo.append((child, total + abs(v), depth + 1))
            elif child <= -2:
                out[-2 - child] = (total + abs(v)) / (depth + 1) ** 0.5
    return out


def test_leaf_scores_match_a_walk_of_each_path():
    x = clustered(dim=32)
    tree = forest.build_tree(x, (4,), forest.ForestConf())
    q = clustered(groups=5, dim=32, seed=77)
    leaves, scores, whole = forest.ranked_leaves(tree, q, 10**6)
    plain = [plain_scores(tree, v) for v in q]
    assert whole
    for row, score, want in zip(leaves, scores, plain):
        home = {int(i) for i in row[score == np.inf]}
        got = {int(i): v for i, v in zip(row, score) if np.isfinite(v)}
        assert len(home) <= 1 and set(want) - home == set(got) and all(abs(want[i] - got[i]) < 1e-5 for i in got)
        assert (np.diff(score[score > -np.inf]) <= 0).all()
    for width in (1, 3):
        few, score, whole = forest.ranked_leaves(tree, q, width)
        assert not whole and all(len(set(r[r >= 0])) == (r >= 0).sum() and abs(v - want[int(i)]) < 1e-5 for r, s, want in zip(few, score, plain) for i, v in zip(r, s) if np.isfinite(v))
    for required in (1, 30, 200, 10**6):
        query, leaf = forest.take_leaves(tree, q, required)
        for i in range(len(q)):
            mine = leaf[query == i]
            held = tree.leaf_counts[mine].sum()
            assert held >= required and held - tree.leaf_counts[mine[-1]] < required or set(plain[i]) <= set(mine.tolist())
        at = forest.points(tree, query, leaf)
        assert sorted(zip(*map(np.ndarray.tolist, at))) == sorted((int(i), int(r)) for i, j in zip(query, leaf) for r in tree.leaf(j))


def test_tree_of_equal_points_is_one_leaf():
    tree = forest.build_tree(np.ones((80, 16)), (1,), forest.ForestConf())
    assert tree.leaf_counts.tolist() == [80] and forest.take_leaves(tree, np.ones((1, 16)), 100)[1].tolist() == [0]
    none = forest.build_tree(np.ones((0, 16)), (1,), forest.ForestConf())
    assert len(none.leaf_counts) == 0 and len(forest.take_leaves(none, np.ones((2, 16)), 5)[0]) == 0


def test_search_recall_self_hit_and_round_trip(spark, data, tmp_path):
    x, df = data
    ix = index.Index.build(df, index.IndexConf(trees=8))
    q = asked(df)
    found, truth = ix.search(q, 4), ix.brute_force(q, 4)
    assert found.where("rank = 1 and row_id = query_id").count() == q.count()
    r = {x["cutoff"]: x["recall"] for x in evaluate.recall(found, truth, 4, without_self=False).collect()}
    assert r[1] == 1.0 and r[4] > 0.95
    ix.save(str(tmp_path / "ix"))
    again = index.Index.open(spark, str(tmp_path / "ix"))
    key = lambda f: sorted((a["query_id"], a["rank"], a["row_id"]) for a in f.collect())
    assert key(again.search(q, 4)) == key(found)
    with pytest.raises(Exception):
        ix.save(str(tmp_path / "ix"))
    with pytest.raises(ValueError):
        again.save(str(tmp_path / "ix"), overwrite=True)  # it would delete what it reads
    assert key(index.Index.open(spark, str(tmp_path / "ix")).search(q, 4)) == key(found)
    at_once = ix.search(q, 4, progressive=False)
    assert at_once.where("rank = 1 and row_id = query_id").count() == q.count()


def test_sharded_forest_finds_across_shards(spark, data):
    _, df = data
    conf = index.IndexConf(trees=4, forest=forest.ForestConf(shard_rows=300, trees_per_task=2))
    ix = index.Index.build(df, conf)
    assert ix.shards == 4
    per_tree = ix.leaves().groupBy("tree").agg(F.sum(F.size("row_ids")).alias("n")).collect()
    assert {r["n"] for r in per_tree} == {1200} and len(per_tree) == 4
    assert ix.search(asked(df, 100), 1).where("row_id = query_id").count() == 12


@pytest.mark.parametrize("k", [50, 200, 1000])
@pytest.mark.parametrize("rows", [300, 10_000])
def test_as_many_as_asked_for_come_back(spark, data, k, rows):
    x, df = data
    ix = index.Index.build(df, index.IndexConf(trees=4, forest=forest.ForestConf(shard_rows=rows)))
    for options in ({}, {"keep": k}, {"keep": 1, "required": 1}, {"progressive": False}):
        n = ix.search(asked(df, 200), k, **options).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d"), F.max("rank").alias("r"))
        assert {(r["n"], r["d"], r["r"]) for r in n.collect()} == {(k, k, k)} and n.count() == 6
    found, truth = ix.search(asked(df, 200), 50), ix.brute_force(asked(df, 200), 50)
    assert evaluate.recall(found, truth, 4).where("cutoff = 4").head()["recall"] >= 0.9


@pytest.mark.parametrize("storage", sorted(kernels.STORAGES))
def test_storages_are_close_and_survive_a_round_trip(spark, data, storage, tmp_path):
    x, df = data
    ix = index.Index.build(df, index.IndexConf(trees=6, storage=storage))
    ix.save(str(tmp_path / "ix"))
    again = index.Index.open(spark, str(tmp_path / "ix"))
    assert again.conf.storage == storage and again.dimension == 64
    back = np.array([r["vec"] for r in again.stored_vectors().orderBy("row_id").collect()])
    assert np.abs(back - x).max() <= (0 if storage == "double" else 0.01)
    found, truth = again.search(asked(df), 5), again.brute_force(asked(df), 5)
    assert evaluate.recall(found, truth, 4).where("cutoff = 3").head()["recall"] >= 0.9
    both = found.join(truth.withColumnRenamed("cosine", "exact"), ["query_id", "row_id"])
    assert both.where("abs(cosine - exact) > 0.01").count() == 0
    with pytest.raises(ValueError):
        index.Index.build(df, index.IndexConf(storage="none"))


def test_the_expression_forms_refuse_many_queries(spark, data, monkeypatch):
    _, df = data
    monkeypatch.setattr(exact, "MOST_BROADCAST", 10)
    with pytest.raises(ValueError):
        exact.scored_pairs(df, asked(df))


def test_small_and_invalid_inputs(spark):
    x = clustered(groups=3)
    df = frame(spark, x)
    ix = index.Index.build(df, index.IndexConf(trees=2))
    bad = spark.createDataFrame([(1, [1.0] * 64), (2, [0.0] * 64), (3, [1.0]), (4, None)], "query_id long, vec array<double>")
    assert {r["query_id"] for r in ix.search(bad, 50).collect()} == {1}
    assert ix.search(bad, 50).count() == 12
    with pytest.raises(ValueError):
        index.Index.build(df.withColumn("vec", F.slice("vec", 1, 4)))
    assert index.Index.build(df.limit(0)).items.count() == 0


def test_directions_are_orthonormal_and_lead(spark, data):
    x, df = data
    gram, n = linear.gram_matrix(df)
    assert n == len(x) and np.allclose(gram, x.T @ x)
    values, vt = linear.leading_directions(gram, n, 32)
    assert np.allclose(vt @ vt.T, np.eye(32)) and (np.diff(values) <= 1e-12).all()
    got = linear.project(df.select("row_id", "vec"), vt).orderBy("row_id").collect()
    assert np.allclose([r["projected"] for r in got], x @ vt.T)
    one = df.orderBy("row_id").select(linear.project_native(F.col("vec"), vt[:2]).alias("p")).head()["p"]
    assert np.allclose(one, x[0] @ vt[:2].T)


def test_ingest_checks(spark):
    raw = spark.createDataFrame([(0, "a", 1, [3.0] * 8), (1, "b", 1, [0.0] * 8), (2, None, 1, [1.0] * 8), (3, "c", 1, [1.0])], "row_id long, name string, label int, vec array<double>")
    ok, bad = sources.split_valid(raw, 8)
    assert [r["row_id"] for r in ok.collect()] == [0] and {r["row_id"]: r["reason"] for r in bad.collect()} == {1: "values", 2: "name", 3: "length"}
    with pytest.raises(sources.InvalidVectorError):
        sources.ingest(raw, 8)
    with pytest.raises(sources.DuplicateNameError):
        sources.ingest(raw.where("row_id = 0").unionByName(raw.where("row_id = 0")), 8)


def test_evaluation_by_hand(spark):
    truth = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 2, 0.8), (5, 1, 6, 0.9)], "query_id long, rank int, row_id long, cosine double")
    found = spark.createDataFrame([(0, 1, 2, 0.8), (0, 2, 3, 0.7), (5, 1, 6, 0.9)], "query_id long, rank int, row_id long, cosine double")
    r = {x["cutoff"]: (x["recall"], x["queries"]) for x in evaluate.recall(found, truth, 2).collect()}
    assert r == {1: (0.0, 1), 2: (0.5, 1)}
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (5, 3), (6, 3)], "row_id long, label int")
    a = evaluate.label_accuracy(truth, labels).head()
    assert (a["queries"], a["missing"], a["accuracy"]) == (5, 3, 1.0)
    assert {(r["query_id"], r["label"]) for r in evaluate.vote(truth, labels, 2).collect()} == {(0, 1), (5, 3)}
    m = {r["rank"]: r["similarity"] for r in evaluate.mean_similarity(truth, truth.select("query_id").distinct(), 2).collect()}
    assert m == pytest.approx({1: 0.9, 2: 0.4})
