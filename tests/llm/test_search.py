"""Decontamination and substring dedup against brute force and planted passages."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vicinity.llm import decontaminate, passages


def bag(words, size):
    size = min(size, len(words))
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def norm(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def expected(docs, items):
    out = {}
    for d, t in docs:
        w = norm(t)
        for i, it in items:
            q = norm(it)
            b = bag(q, 5)
            best = None
            for s in range(max(0, len(w) - len(q)) + 1) if q and w else ():
                a = bag(w[s:s + len(q)], 5) if len(q) >= 5 else Counter([tuple(w[s:s + len(q)])])
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both) if a else 0
                if sim >= 0.8 - 1e-12 and (best is None or sim > best[0] + 1e-12):
                    best = (sim, s)
            if best:
                out[d, i] = (best[1], round(best[0], 6))
    return out


def test_decontamination_matches_brute_force(spark, docs_of, prose):
    items = [(i, prose(500 + i, 15 + 3 * i)) for i in range(8)] + [(90, None), (91, " !! "), (92, "tiny item"), (93, "rep rep rep rep rep rep rep rep rep")]
    r = random.Random(3)
    docs = [(0, None), (1, ""), (2, "!!")]
    for k, (i, t) in enumerate(items[:8]):
        w = t.split()
        edited = list(w)
        edited[r.randrange(len(w))] = "changed"
        docs += [(100 + k, prose(k, 40) + " " + t + " " + prose(k + 50, 40)), (200 + k, ", ".join(x.upper() for x in w)), (300 + k, prose(k, 30) + "\n" + " ".join(edited)),
                 (400 + k, " ".join(w[: len(w) // 2]) + " " + prose(k, 30)), (500 + k, prose(k, 100)), (600 + k, t + " x " + t)]
    docs += [(700, "here a tiny item, there"), (701, "rep " * 30), (702, prose(1, 20000) + " " + items[3][1]), (703, " ".join(items[2][1].split()[:-1]))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as n_words")
    got = {(x["doc_id"], x["item_id"]): (x["start_word"], x["similarity"]) for x in decontaminate.contamination_report(docs_of(docs, extra=True), bench).collect()}
    assert got == expected(docs, items)
    kept = decontaminate.decontaminate(docs_of(docs + [(None, items[0][1]), (0, None)], extra=True), bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted([d for d, _ in docs if d not in {k[0] for k in got}] + [0])
    # without the broadcast
    before, decontaminate.BROADCAST_SHINGLES = decontaminate.BROADCAST_SHINGLES, 0
    try:
        again = {(x["doc_id"], x["item_id"]): (x["start_word"], x["similarity"]) for x in decontaminate.contamination_report(docs_of(docs), bench).collect()}
    finally:
        decontaminate.BROADCAST_SHINGLES = before
    assert again == got


def test_decontamination_of_nothing(spark, docs_of, prose):
    bench = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert decontaminate.contamination_report(docs_of([]), bench).count() == 0
    assert decontaminate.contamination_report(docs_of([(1, prose(1, 20))]), bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs_of([(1, prose(1, 20))]), bench.limit(0)).count() == 1
    assert decontaminate.contamination_report(docs_of([(1, prose(1, 20))] * 3), bench).count() == 1


def test_decontamination_by_items_without_an_id(spark, docs_of, prose):
    items = [(None, prose(1, 20)), (None, prose(2, 20)), (None, prose(3, 30)), (None, prose(3, 30)), (None, None), (4, prose(4, 20)), (4, prose(5, 20))]
    docs = [(k, prose(50 + k, 30) + " " + prose(k, 30 if k == 3 else 20) + " " + prose(80 + k, 30)) for k in range(1, 6)]
    docs += [(6, prose(90, 30)), (7, f"{prose(1, 20)} x {prose(2, 20)}"), (None, prose(2, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["start_word"]) for r in decontaminate.contamination_report(docs_of(docs), bench).collect()), key=repr)
    assert got == sorted([(k, None if k < 4 else 4, 30) for k in range(1, 6)] + [(7, None, 0), (7, None, 21), (None, None, 0)], key=repr)
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs_of(docs), bench).collect()] == [6]


def test_the_index_keeps_the_radius_and_joins_a_pair_once(spark):
    r, rows = np.random.default_rng(3), []
    for i in range(400):
        x = int(r.integers(0, 2**63))
        y = x
        for b in r.permutation(64)[: decontaminate.RADIUS if i % 2 else 32]:
            y ^= 1 << int(b)
        rows.append((i, x, y - 2**64 if y >= 2**63 else y))
    df = spark.createDataFrame(rows, "i1 long, x long, y long").withColumn("i2", F.lit(0).cast("long"))
    got = decontaminate.index_pairs(df.select("i1", "i2", F.col("x").alias("fingerprint")), df.select("i1", "i2", F.col("y").alias("item_fingerprint"))).collect()
    near = [x["i1"] for x in got if x["hamming"] == decontaminate.RADIUS]
    assert sorted(near) == list(range(1, 400, 2)) and len({x["i1"] for x in got}) == len(got) < 400


def test_the_radius_keeps_what_is_similar(spark, prose):
    """Of pairs of bags just above the threshold, nearly all have fingerprints within the radius."""
    import random

    r, rows = random.Random(9), []
    for i in range(400):
        a = prose(i, 60).split()
        b = list(a)
        for at in r.sample(range(56), 1 + i % 2):
            b[at] = f"changed{at}"
        rows.append((" ".join(a), " ".join(b)))
    bag = lambda c: decontaminate.shingle_array(F.transform(decontaminate.normal_words(F.col(c)), lambda w: F.xxhash64(w)), 5)
    df = spark.createDataFrame(rows, "a string, b string").select(bag("a").alias("a"), bag("b").alias("b"))
    got = df.select(decontaminate.weighted_similarity(F.col("a"), F.col("b")).alias("s"), F.bit_count(decontaminate.simhash(F.col("a")).bitwiseXOR(decontaminate.simhash(F.col("b")))).alias("d")).where("s >= 0.8").collect()
    assert len(got) > 200 and sum(x["d"] <= decontaminate.RADIUS for x in got) >= 0.99 * len(got)


def test_windows_follow_from_where_shingles_enter_and_leave(spark):
    import random

    r, rows, want = random.Random(4), [], set()
    for d in range(60):
        words, n, size, enough = r.randint(1, 40), r.randint(1, 20), r.randint(1, 5), r.randint(1, 4)
        n = max(n, size)
        spots = sorted(r.sample(range(max(1, words - size + 1)), k=min(max(1, words - size + 1), r.randint(1, 12))))
        rows += [(d, 0, words, p, size, 7, 7, n, enough) for p in spots]
        for s in range(max(0, words - n) + 1):
            if sum(s <= p <= s + n - size for p in spots) >= enough:
                want.add((d, n, size, s))
    spots = spark.createDataFrame(rows, "k1 long, k2 long, words int, pos int, size int, i1 long, i2 long, n_words int, enough long")
    got = decontaminate.windows_of(spots).collect()
    assert {(x["k1"], x["n_words"], x["size"], x["start"]) for x in got} == want and len(got) == len(want)


def spans(df):
    out = {}
    for x in passages.passages(df).collect():
        out.setdefault(x["doc_id"], []).append((x["start_word"], x["start_word"] + x["n_words"]))
    return {k: sorted(v) for k, v in out.items()}


def test_passages_are_found_and_clean_documents_are_not(spark, docs_of, prose):
    shared, near = prose(900, 80), prose(901, 120).split()
    edited = list(near)
    edited[60] = "changed"
    rows = [(i, prose(i, 200)) for i in range(10)]
    rows += [(20 + i, f"{prose(100 + i, 70)} {shared} {prose(200 + i, 90)}") for i in range(12)]
    rows += [(40, f"{prose(300, 60)} {' '.join(near)}"), (41, f"{' '.join(edited)} {prose(301, 60)}")]
    rows += [(50, prose(400, 150)), (51, prose(400, 150).upper()), (52, prose(400, 150)), (53, prose(400, 150))]
    rows += [(60, " ".join(prose(1, 200).split()[:30]) + " " + prose(500, 100)), (61, prose(600, 49)), (62, prose(600, 49)), (63, None), (64, ""), (65, None)]
    rows += [(70, prose(700, 20000) + " " + prose(701, 60)), (71, prose(701, 60) + " " + prose(702, 100)), (None, prose(703, 100)), (80, prose(703, 100) + " x")]
    got = spans(docs_of(rows, extra=True))
    assert set(got) == {*range(20, 32), 40, 41, 50, 51, 52, 53, 70, 71, None, 80}
    for i in range(20, 32):
        assert got[i] == [(70, 150)]
    (a, b), = got[40]
    assert a == 60 and b == 180
    assert got[41] == [(0, 120)] and got[50] == [(0, 150)] and got[53] == [(0, 150)]
    assert got[70] == [(20000, 20060)] and got[71] == [(0, 60)]
    assert passages.passages(docs_of([])).count() == 0


def test_blocks_find_what_the_pivot_does_not_share(spark, docs_of, prose):
    # all share ten words with the smallest document, but only pairs share passages
    line = prose(950, 10)
    rows = [(0, f"{prose(1, 60)} {line} {prose(2, 60)}")]
    for k in range(30):
        p = prose(1000 + k, 40) + " " + line + " " + prose(2000 + k, 40)
        rows += [(10 + 2 * k, prose(3000 + k, 50) + " " + p), (11 + 2 * k, p + " " + prose(4000 + k, 50))]
    got = spans(docs_of(rows))
    assert set(got) == {r[0] for r in rows[1:]}
    assert all(got[10 + 2 * k] == [(50, 140)] and got[11 + 2 * k] == [(0, 90)] for k in range(30))


def edited_passages(prose):
    """(passage, the same with one interior edit) of 50 to 90 words."""
    r = random.Random(8)
    for n in range(50, 91, 4):
        for kind in ("change", "insert", "drop"):
            for at in (n // 2, r.randrange(8, n - 8)):
                w = prose(5000 + n, n).split()
                yield w, w[:at] + ([] if kind == "drop" else ["changed"]) + w[at + (kind != "insert"):]


def brute_force(a, b, least=passages.MIN_TOKENS):
    """Positions of a in windows that start and end with a shared token and have similarity 0.8 with such a window of b."""
    same = np.pad(np.cumsum(np.cumsum(a[:, None] == b[None], 0), 1), ((1, 0), (1, 0)))
    windows = lambda x, y: [(i, j) for i in range(len(x)) for j in range(i + least, len(x) + 1) if {x[i], x[j - 1]} <= set(y.tolist())]
    other, out = np.array(windows(b, a)).reshape(-1, 2), set()
    for i, j in windows(a, b) if len(other) else ():
        both = same[j][other[:, 1]] - same[j][other[:, 0]] - same[i][other[:, 1]] + same[i][other[:, 0]]
        if (both >= 0.8 * (j - i + other[:, 1] - other[:, 0] - both)).any():
            out |= set(range(i, j))
    return out


def test_edited_passages_match_brute_force(prose):
    missed_before = 0
    for k, (w, v) in enumerate(edited_passages(prose)):
        a = passages.tokens(" ".join([prose(k, 25), *w, prose(k + 100, 25)]))
        b = passages.tokens(" ".join([prose(k + 200, 31), *v, prose(k + 300, 20)]))
        for x, y in ((a, b), (b, a)):
            found = passages.shared_stretches(x, y)
            got = {i for s, e, *_ in found for i in range(s, e)}
            want = brute_force(x, y)
            assert got >= want
            if got != want:  # the other side may be shorter than a passage
                assert got == brute_force(x, y, int(passages.MIN_TOKENS * passages.SIMILARITY)) and got
            assert all(len(set(x[s:e]) & set(y[p:q])) >= 0.8 * len(set(x[s:e]) | set(y[p:q])) for s, e, p, q, _ in found)
            hit = np.isin(x, y)
            assert all(any(s <= i < e for s, e in passages.recurring_stretches(hit)) for i in got)
            missed_before += bool(want) and all(e - s < passages.MIN_TOKENS for s, e in passages.dense_stretches(hit))
    assert missed_before > 20


def test_edited_passages_are_found_in_documents(spark, docs_of, prose):
    rows, want = [], {}
    for k, (w, v) in enumerate(edited_passages(prose)):
        x, y = " ".join([prose(6000 + k, 60), *w, prose(6100 + k, 60)]), " ".join([prose(6200 + k, 70), *v, prose(6300 + k, 50)])
        rows += [(2 * k, x), (2 * k + 1, y)]
        a, b = passages.tokens(x), passages.tokens(y)
        if brute_force(a, b):
            want[2 * k], want[2 * k + 1] = (brute_force(*p) for p in ((a, b), (b, a)))
    got = spans(docs_of(rows))
    covered = {d: {i for s, e in x for i in range(s, e - passages.SHINGLE + 1)} for d, x in got.items()}
    found = [d for d in want if covered.get(d, set()) >= want[d]]
    assert len(want) > 80 and len(found) >= 0.95 * len(want)


def test_compact_windows_cover_every_subsequence_once():
    v = np.random.default_rng(0).permutation(60)
    w = passages.compact_windows(v, 10)
    for i in range(60):
        for j in range(i + 9, 60):
            c = i + int(v[i:j + 1].argmin())
            assert [x for x in w if x[0] <= i and j <= x[2] and x[1] == c and i <= c <= j] == [x for x in w if x[0] <= i <= x[1] <= j <= x[2]]
            assert len([x for x in w if x[0] <= i <= x[1] <= j <= x[2]]) == 1


def test_windows_of_repeated_tokens_are_few_and_fast():
    import time

    for values in (np.zeros(150_000, np.uint64), np.tile(np.arange(7, dtype=np.uint64), 20_000)):
        began = time.time()
        nodes = passages.compact_windows(values)
        assert time.time() - began < 5 and len(nodes) < 4 * len(values) / passages.MIN_TOKENS
        assert all(l <= c <= r and r - l + 1 >= passages.MIN_TOKENS and values[l : r + 1].min() == values[c] for l, c, r in nodes[:: max(1, len(nodes) // 50)])


def near_copies(words, r, kind, least=0.8, most=0.85):
    """The words with edits of one kind, spread so that the similarity of shingle sets is within bounds."""
    for _ in range(2000):
        out = list(words)
        for _ in range(r.randint(1, max(1, len(words) // 30))):
            at = r.randrange(len(out))
            if kind == "drop":
                del out[at]
            elif kind == "insert":
                out.insert(at, f"new{r.random()}")
            else:
                out[at] = f"new{r.random()}"
        a, b = (set(zip(*(x[i:] for i in range(5)))) for x in (words, out))
        if least <= len(a & b) / len(a | b) < most:
            return out
    return None


def test_near_passages_are_found(spark, docs_of, prose):
    """Planted passages of 60 to 200 words at similarity 0.8 to 0.85 and 0.85 to 0.9, by all kinds of edits."""
    r, rows, planted = random.Random(77), [], []
    for n in (60, 100, 200):
        for kind in ("change", "insert", "drop"):
            for bounds in ((0.8, 0.85), (0.85, 0.9)):
                for k in range(4):
                    w = prose(r.random(), n).split()
                    v = near_copies(w, r, kind, *bounds)
                    if v is None:
                        continue
                    i = len(rows)
                    rows += [(i, " ".join([prose(r.random(), 40), *w, prose(r.random(), 40)])), (i + 1, " ".join([prose(r.random(), 25), *v, prose(r.random(), 60)]))]
                    planted.append((i, 40, 40 + n))
    got = spans(docs_of(rows))
    covered = [sum(max(0, min(e, b) - max(s, a)) for s, e in got.get(i, [])) / (b - a) for i, a, b in planted]
    assert len(planted) > 50 and sum(c >= 0.8 for c in covered) >= 0.95 * len(planted), sorted(covered)


def test_words_are_hashed_as_they_split():
    r = random.Random(3)
    texts = [None, "", "a", "A b\x0bc\x0cd e", "x" * 70_000 + " " + "y" * 200_000 + " b c d e f" + " " * 70_000 + "q w e r t", " é b c \ud800 e f", "z " * 40_000 + "w" * 65_536 + " k"]
    texts += ["".join(r.choice("ab \n\té") for _ in range(r.randint(0, 400))) for _ in range(200)]
    got, size = passages.tokens_of(texts)
    seen = {}
    for t, x in zip(texts, np.split(got, np.cumsum(size)[:-1])):
        w = passages_words(t)
        assert len(x) == max(0, len(w) - 4) and (x == passages.tokens(t)).all()
        assert all(seen.setdefault(tuple(w[i : i + 5]), y) == y for i, y in enumerate(x.tolist()))
    assert len(set(seen.values())) == len(seen) > 1000


def passages_words(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def test_passages_of_repeated_words_match_brute_force(prose):
    """Runs of one word or of a few, between other words: a token then stands at many places of either side."""
    r = random.Random(12)
    for k in range(40):
        run = " ".join(f"run{i % (1 + k % 4)}" for i in range(90))
        cut = lambda least: " ".join(run.split()[: r.randint(least, 90)])
        x = passages.tokens(" ".join([prose(k, r.randint(0, 20)), cut(50), prose(k + 100, 10)]))
        y = passages.tokens(" ".join([prose(k + 200, 9), cut(50), prose(k + 300, r.randint(0, 20)), cut(30)]))
        for a, b in ((x, y), (y, x)):
            found = passages.shared_stretches(a, b)
            grams = [{tuple(z[i : i + passages.MIN_TOKENS]) for i in range(len(z) - passages.MIN_TOKENS + 1)} for z in (a.tolist(), b.tolist())]
            for side, z in ((0, a.tolist()), (1, b.tolist())):
                same = {i + j for i in range(len(z) - passages.MIN_TOKENS + 1) if tuple(z[i : i + passages.MIN_TOKENS]) in grams[1 - side] for j in range(passages.MIN_TOKENS)}
                got = {i for f in found for i in range(f[2 * side], f[2 * side + 1])}
                assert same and same <= got
            assert all(len(set(a[s:e]) & set(b[p:q])) >= 0.8 * len(set(a[s:e]) | set(b[p:q])) for s, e, p, q, _ in found)


def test_runs_of_one_word_are_found_in_documents(spark, docs_of, prose):
    rows = [(i, f"{prose(i, 40 + i)} {'the ' * (60 + i)}{prose(100 + i, 30)}") for i in range(8)] + [(9, f"{prose(50, 60)} {'the ' * 40}{prose(51, 60)}")]
    got = spans(docs_of(rows))
    assert set(got) == set(range(8))
    assert all(any(a <= 40 + i and b >= 100 + 2 * i for a, b in got[i]) for i in range(8))


def test_no_stage_shuffles_tokens_many_times_over(spark, docs_of, prose, monkeypatch):
    """What one scratch table shuffles stays within twice the bytes of the tokens in question, as its files lie on disk together."""
    sc, shuffled, cut = spark.sparkContext, {}, passages.cut

    def watched(df, name):
        group = f"{name}-{len(shuffled)}"
        sc.setJobGroup(group, name)
        try:
            out = cut(df, name)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        shuffled[group] = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
        return out

    monkeypatch.setattr(passages, "cut", watched)
    docs = []
    for i in range(250):
        same = prose(i, 300)
        docs += [(2 * i, prose(1000 + i, 60) + " " + same), (2 * i + 1, same + " " + prose(2000 + i, 60))]
    got = {(x["doc_id"], x["start_word"], x["n_words"], x["first_id"]) for x in passages.passages(docs_of(docs)).collect()}
    assert got == {(d, 60 * (1 - d % 2), 300, d - d % 2) for d, _ in docs}
    tokens = 8 * len(docs) * 296
    assert sum(shuffled.values()) > tokens  # the jobs were seen
    assert {k: v for k, v in shuffled.items() if v > 2 * tokens} == {}


def test_rounds_part_tokens_and_keep_their_places():
    r = np.random.default_rng(4)
    parts = [r.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 5, 300, 0, 1)]
    batch = passages.pa.RecordBatch.from_pydict({"tk": list(range(5)), "s": [10 * i for i in range(5)], "tokens": passages.pa.array([x.tobytes() for x in parts], passages.pa.binary())})
    got = [tuple(x.values()) for turn in range(passages.ROUNDS) for b in passages._token_places(turn, iter([batch])) for x in b.to_pylist()]
    assert sorted(got) == sorted((i, 10 * i, p, int(x)) for i, part in enumerate(parts) for p, x in enumerate(part.view(np.int64)))


def test_values_of_two_texts_are_told_apart_in_workers(spark, monkeypatch):
    r = np.random.default_rng(5)
    hot = r.integers(0, 2**64, 3, np.uint64)
    lists = [[int(v) for v in np.concatenate([hot, r.integers(0, 2**64, 40, np.uint64)[: i % 40]])] for i in range(300)]
    lists = [x + (x[-1:] if i % 3 else lists[i // 2][-2:]) for i, x in enumerate(lists)] + [[], [2**64 - 1, 0], [0, 2**64 - 1, 7, 7]]
    rows = [(i - 150, [v - 2**64 if v >= 2**63 else v for v in x]) for i, x in enumerate(lists)]
    texts = {}
    for tk, x in rows:
        for v in x:
            texts.setdefault(v, set()).add(tk)
    want = sorted(v for v, of in texts.items() if len(of) > 1)
    df = spark.createDataFrame(rows, "tk long, key array<long>")
    for n in (0, 10**9):
        got = passages.in_two_texts(df, passages._keys, "key", n)
        assert got.columns == ["key"] and sorted(x["key"] for x in got.collect()) == want
    # a value that all rows have travels once for each batch of values
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows], pa.list_(pa.int64()))], ["tk", "key"])
    packed = pa.Table.from_batches(passages._gathered(passages._keys, 8, iter([batch])))
    assert packed.num_rows == 8 and sum(len(x) for x in packed.column("value").to_pylist()) == 8 * len(texts)
