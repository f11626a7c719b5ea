"""Vector functions against numpy, and kernels against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.functions import kernels, native


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, vec array<double>")


def values(df, c):
    return [r[0] for r in df.orderBy("row_id").select(c).collect()]


@pytest.mark.parametrize("n", [1, 2, 8, 64])
def test_hadamard_is_its_matrix(spark, n):
    x = np.random.default_rng(n).normal(size=(5, n))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(n)] for i in range(n)])
    assert np.allclose(kernels.hadamard(x), x @ h)
    assert np.allclose(kernels.hadamard(kernels.hadamard(x)), n * x)
    assert np.allclose(values(vectors(spark, x), native.hadamard(F.col("vec"), n)), x @ h)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(10, 32))
    y = kernels.rotate(x, kernels.rotation_signs(32, 3))
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))


def test_powers_of_two():
    assert [native.largest_power_of_2(n) for n in (1, 2, 3, 100)] == [1, 2, 2, 64]
    assert [native.round_up_power_of_2(n) for n in (1, 2, 3, 100)] == [1, 2, 4, 128]
    with pytest.raises(ValueError):
        native.largest_power_of_2(0)


def test_validity_and_normalising(spark):
    x = [[3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0]]
    df = vectors(spark, x)
    assert values(df, native.is_valid(F.col("vec"), 2)) == [True, False, False, False, False]
    assert values(df, native.normalize(F.col("vec")))[0] == [0.6, 0.8]
    assert values(df, native.normalize_if_long(F.col("vec")))[1] == [0.0, 0.0]
    assert spark.sql("select cast(null as array<double>) v").select(native.is_valid(F.col("v"))).head()[0] is False


def test_buckets_agree_with_the_kernel(spark):
    o = np.random.default_rng(4).normal(size=(50, 8))
    o[0] = 0
    o[1] = [1, -1, 1, 0, 0, 0, 0, 0]
    df = vectors(spark, o)
    assert values(df, native.bucket(F.col("vec"), 8)) == kernels.slots(o).tolist()
    assert kernels.slots(o)[0] == 16 and kernels.slots(o)[1] == 0
    second = values(df, native.second_bucket(F.col("vec"), 8))
    for r, s in zip(o[2:], second[2:]):
        a = np.argsort(-np.abs(r))[1]
        assert s == (a if r[a] > 0 else a + 8)


def test_signatures_estimate_cosines(spark):
    r = np.random.default_rng(21)
    base = np.abs(r.normal(size=(200, 256))) * r.choice([-1, 1], (200, 256))
    other = base * np.where(r.random((200, 256)) < 0.2, -1, 1)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (base, other))
    signs = kernels.signature_signs(256)
    sa, sb = kernels.signatures(a, signs), kernels.signatures(b, signs)
    same = np.array([kernels.overlaps(x[None], y)[0] for x, y in zip(sa, sb)])
    guess = np.cos((1 - same / kernels.effective_bits(256)) * np.pi)
    assert np.abs(guess - (a * b).sum(1)).mean() < 0.04
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(sa[:20], sb[:20]))], "row_id long, x array<bigint>, y array<bigint>")
    assert values(df, native.overlap(F.col("x"), F.col("y"))) == same[:20].tolist()
    word = values(vectors(spark, a[:20]), native.signature_word(F.col("vec"), signs[0].tolist(), 256))
    assert word == sa[:20, 0].tolist()


def test_word_and_signs_are_inverse(spark):
    words = [0, 1, -1, 2**62, -(2**63)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "row_id long, w long")
    assert values(df, native.signs_to_word(native.word_to_signs(F.col("w")))) == words


def test_codecs(spark):
    x = np.random.default_rng(12).uniform(-1, 2, (40, 100))
    assert np.abs(kernels.from_bf16(kernels.to_bf16(x)) - x).max() <= 0.01
    back = np.array(values(vectors(spark, x), native.dequantize8(native.quantize8(F.col("vec")))))
    assert np.abs(back - x).max() < 0.01
    flat = values(vectors(spark, [[2.0] * 8]), native.dequantize8(native.quantize8(F.col("vec"))))
    assert flat == [[2.0] * 8]


def test_pruning_slack_is_a_binomial_bound():
    r = np.random.default_rng(8)
    for bits, p in ((128, 0.7), (512, 0.6), (1024, 0.9)):
        count = round(bits * p)
        below = (r.binomial(bits, p, 20000) < count - kernels.pruning_slack(count, bits)).mean()
        assert below < 0.012
    assert kernels.pruning_slack(0, 128) == kernels.pruning_slack(128, 128) == kernels.pruning_slack(150, 128) == 0


@pytest.mark.parametrize("keep", [50, 150, 200, 499])
def test_pruning_keeps_the_best(keep):
    r = np.random.default_rng(3)
    sig = r.integers(-(2**63), 2**63 - 1, (900, 16))
    query, rows = sig[7].copy(), np.arange(5, 505)
    votes = r.integers(1, 9, 500)
    count = votes + kernels.overlaps(sig[rows], query)
    for f in (kernels.prune, kernels.prune_at_once):
        kept = f(votes, sig, rows, query, keep)
        assert 2 in kept and keep <= len(kept) <= (500 if keep == 499 else 499)
    assert set(kept) == set(np.flatnonzero(count >= np.sort(count)[::-1][keep - 1]))
    assert len(kernels.prune(votes[:5], sig, rows[:5], query, keep)) == 5
