"""Near-dedup: sketches, and components against brute force."""

import random
import re

import numpy as np

import corpus_pipeline
from vicinity.llm import setsketch, textkit

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()


def expected(rows, size=2, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        c = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def got(df, size=2):
    out = setsketch.near_duplicates(df, size=size).select("doc_id", "n_shingles", "component_id", "kept")
    return sorted(map(tuple, out.collect()), key=repr)


def variants(prose, base, n, edits, seed, words=120):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = prose(base, words).split()
        for _ in range(edits):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_match_brute_force(spark, docs_of, prose):
    texts = [None, "", " \t ", "one", "ONE", "one two", "two one", "a b c", "A\tb\x0bc", "x " * 300]
    texts += [prose(s, 60) for s in range(20)]
    # near copies on both sides of the threshold, so that some are linked through others only
    for base, edits in ((100, 2), (101, 5), (102, 7), (103, 8)):
        texts += variants(prose, base, 25, edits, base)
    texts += [prose(7, 20000), prose(7, 20000) + " tail"] + [prose(0, 60)] * 5
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    assert got(docs_of(rows, extra=True)) == expected(rows)


def test_blocks_find_what_pivots_miss(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(setsketch, "COLUMNS", 64)
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    rows = list(enumerate(variants(prose, 5, 60, 7, 11) + variants(prose, 6, 40, 3, 12)))
    assert got(docs_of(rows)) == expected(rows)


def test_five_words_repeats_and_null_ids(spark, docs_of, prose):
    rows = [(3, prose(1, 50)), (3, prose(1, 50)), (2, prose(1, 50) + " z"), (None, prose(1, 50)), (None, prose(2, 50)), (9, prose(3, 9)), (9, prose(4, 9)), (8, None)]
    assert got(docs_of(rows), 5) == expected(rows, 5)
    kept = setsketch.near_dedup(docs_of(rows, extra=True), size=5)
    # an id that two texts share stays with one row; a null id that no other document is linked to stays too
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 8, 9]
    assert kept.columns == docs_of(rows, extra=True).columns
    assert got(docs_of([])) == [] and setsketch.near_dedup(docs_of([])).count() == 0


def test_rows_are_kept_by_text_not_by_id_alone(spark, docs_of, prose):
    rows = [(None, prose(s, 40)) for s in range(20, 26)] + [(None, prose(20, 40)), (None, None), (None, "")]
    rows += [(1, prose(30, 40)), (None, prose(30, 40)), (5, prose(30, 40)), (5, prose(31, 40)), (6, prose(31, 40)), (7, prose(32, 40)), (7, prose(33, 40)), (7, None), (7, "")]
    out = sorted(map(repr, ((r["doc_id"], r["text"]) for r in setsketch.near_dedup(docs_of(rows, extra=True), single_ids=False).collect())))
    want = [(None, prose(s, 40)) for s in range(20, 26)] + [(None, None), (None, ""), (1, prose(30, 40)), (5, prose(31, 40)), (7, prose(32, 40)), (7, prose(33, 40)), (7, None), (7, "")]
    assert out == sorted(map(repr, want))
    assert corpus_pipeline.near_dedup(spark, docs_of(rows), "").count() == len(want)
    single = [(r["doc_id"], r["text"]) for r in setsketch.near_dedup(docs_of(rows)).collect()]
    assert len(single) == len(want) - 1 and (5, prose(31, 40)) in single and set(single) <= set(want)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(0)
    item = r.integers(0, 2**63, 4000).astype(np.uint64)
    for n in (1, 3, 50, 1000):
        a, b = item[:n], item[n // 2: n // 2 + n]
        ra, rb, both = setsketch.registers([a, b, np.union1d(a, b)])
        assert (setsketch.merge(ra, rb) == both).all()
    sims = []
    for i in range(200):
        part = r.integers(0, 2**63, 900).astype(np.uint64)
        a, b = part[:800], part[100:]
        ra, rb = setsketch.registers([a, b])
        sims.append(setsketch.likeliest(ra[None], rb[None], np.array([800.0]), np.array([800.0]))[0])
    assert abs(np.mean(sims) - 700 / 900) < 0.01 and np.std(sims) < 0.05
    assert setsketch.registers([]).shape == (0, 128) and (setsketch.registers([np.empty(0, np.uint64)]) == 0).all()


def test_shingle_kernel():
    a = textkit.shingle_set("A b\tC d", 2)
    assert len(a) == 3 and (a == textkit.shingle_set("a B c D", 2)).all()
    assert len(textkit.shingle_set("solo", 2)) == 1 and len(textkit.shingle_set(None, 2)) == 0
    assert textkit.shingle_set("a b", 2)[0] != textkit.shingle_set("b a", 2)[0]
