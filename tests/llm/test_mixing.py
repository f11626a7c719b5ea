"""Source mixing: targets, nearness, bounds, repetition."""

from collections import defaultdict

from vicinity.llm import mixing


def water_fill(sizes, share=1.5, most=2.0, weights=(3.0, 1.0, 2.0)):
    """Reshare the excess by weight until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    open_, left, target = set(names), share * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows(n=400):
    out = []
    for i in range(n):
        source = [None, "a", "b", "c", "é"][min(i % 9, 4)]
        out.append((i, " ".join(["w"] * (1 + i * 7 % 40)), source, None))
    return out + [(n, None, "a", None), (n + 1, " \t", "b", None), (n + 2, "w " * 20000, "c", None), (None, "x y", "a", None)]


def test_targets_sizes_and_takes(spark, docs_of):
    data = rows()
    got = mixing.mix_report(docs_of(data, extra=True)).collect()
    assert len(got) == len(data)
    size_of = {d: len((t or "").split()) for d, t, *_ in data}
    source_of = {d: s for d, _, s, _ in data}
    sizes = defaultdict(int)
    for d, n in size_of.items():
        sizes[source_of[d]] += n
    want, taken = water_fill(sizes), defaultdict(int)
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    largest = {s: max(n for d, n in size_of.items() if source_of[d] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_targets_of_many_uneven_sources(spark):
    import random

    r = random.Random(5)
    for n in (1, 2, 5, 30):
        sizes = {f"s{i:02d}": r.choice([0, 1, 7, 300, 90000]) for i in range(n)}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, source_size long")).collect()
        want = water_fill(sizes)
        assert all(abs(x["target"] - want[x["key"]]) < 1e-6 * (1 + want[x["key"]]) for x in got), n


def test_reruns_agree_whatever_the_partitions(spark, docs_of):
    a, b = docs_of(rows()), docs_of(rows()).repartition(7)
    key = lambda df: sorted(map(tuple, mixing.mix_report(df).collect()), key=repr)
    assert key(a) == key(b)


def test_mix_repeats_rows(spark, docs_of):
    df = docs_of(rows(60), extra=True)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_report(df).collect()}
    got = defaultdict(int)
    out = mixing.mix(df)
    for r in out.collect():
        got[r["doc_id"]] += 1
    assert out.columns == df.columns and dict(got) == {d: n for d, n in want.items() if n}


def test_repeated_rows_and_empty_tables(spark, docs_of):
    assert mixing.mix_report(docs_of([])).count() == 0
    same = mixing.mix_report(docs_of([(1, "a b c", "s", None)] * 4 + [(2, "d", "t", None)])).collect()
    assert len({r["taken"] for r in same if r["doc_id"] == 1}) == 1
    assert [r["taken"] for r in mixing.mix_report(docs_of([(1, None, None, None)])).collect()] == [0]


def test_random_numbers_are_even(spark):
    from pyspark.sql import functions as F

    u = [r[0] for r in spark.range(2000).select(mixing.uniform(F.col("id"), "s")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03


def test_documents_are_included_as_often_as_their_odds_say(spark, docs_of):
    """200 draws at once: as many sources that hold the same 60 sizes under different ids."""
    sizes, draws = [2 ** (i % 6) + i % 3 for i in range(60)], 200
    data = [(s * 60 + i, "w " * n, f"s{s:03d}", None) for s in range(draws) for i, n in enumerate(sizes)]
    got = mixing.plan(docs_of(data)).collect()
    seen, want = defaultdict(list), {}
    for r in got:
        times = r["target"] / r["source_size"]
        if times % 1 > 1e-9:
            key = (round(times, 9), r["size"])
            seen[key].append(r["copies"] - int(times))
            want[key] = r["inclusion"]
    p = {k[0]: k[0] % 1 for k in want}
    assert len({round(v, 9) for v in want.values()}) > len(p)  # unequal within a source
    for t in p:
        assert abs(sum(n * want[t, n] for n in sizes) / sum(sizes) - p[t]) < 1e-9
    for k, hits in seen.items():
        assert set(hits) <= {0, 1} and abs(sum(hits) / len(hits) - want[k]) < 4 * (want[k] * (1 - want[k]) / len(hits)) ** 0.5 + 0.02, (k, want[k])
    small, large = (sum(sum(h) for k, h in seen.items() if k[1] in x) / sum(len(h) for k, h in seen.items() if k[1] in x) for x in ((1, 2, 3, 4), (32, 33, 34)))
    assert large > small + 0.05
