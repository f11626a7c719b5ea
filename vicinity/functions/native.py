"""Vector functions as Spark expressions over ``array<double>`` columns: no Python runs on the executors."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-4
ZERO_NORM = 1e-6
WORD_BITS = 64


def _zero() -> Column:
    return F.lit(0.0)


def total(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sum_of_squares(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(sum_of_squares(v))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def is_valid(v: Column, dim: int | None = None) -> Column:
    """A vector that can be indexed: right length, finite, not almost zero."""
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & finite & (sum_of_squares(v) >= ZERO_NORM)
    return F.coalesce(ok & (F.size(v) == dim) if dim is not None else ok, F.lit(False))


def normalize(v: Column) -> Column:
    """v / |v|; null where the vector is not valid."""
    return F.when(is_valid(v), scale(v, norm(v)))


def normalize_if_long(v: Column) -> Column:
    """v / |v| where the norm exceeds 1e-4, else v."""
    return F.when(norm(v) > EPS, scale(v, norm(v))).otherwise(v)


def cosine_of_unit(q: Column, v: Column) -> Column:
    """1 - |q - v|^2 / 2: the cosine of unit vectors, and the score that quantised vectors are given."""
    return 1 - F.aggregate(F.zip_with(q, v, lambda x, y: (x - y) * (x - y)), _zero(), lambda s, x: s + x) / 2


def gather_multiply(v: Column, ids: Column, values: Column) -> Column:
    """Component-wise product with a sparse vector: v[id] * value for each of its entries."""
    return F.zip_with(ids, values, lambda i, x: F.get(v, i) * x)


def columns_of(v: Column, ids: list[int]) -> Column:
    return F.array(*[F.get(v, i) for i in ids])


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def largest_power_of_2(n: int) -> int:
    """The largest power of two that is at most n."""
    if n < 1:
        raise ValueError("n must be positive")
    return 1 << n.bit_length() - 1


def pruning_slack(count: Column, bits: int) -> Column:
    """``kernels.pruning_slack`` as an expression."""
    p = F.least(F.greatest(count / bits, F.lit(0.0)), F.lit(1.0))
    return F.floor(F.lit(NormalDist().inv_cdf(0.99)) * F.sqrt(bits * p * (1 - p))).cast("long")


def is_power_of_2(n: int) -> bool:
    return n > 0 and n & n - 1 == 0


def round_up_power_of_2(n: int) -> int:
    return n if is_power_of_2(n) else largest_power_of_2(n) << 1


def hadamard(v: Column, size: int) -> Column:
    """The unnormalised Walsh-Hadamard transform of the first ``size`` (a power of two) components: log2(size) rounds of
    sums and differences at distance h."""
    if not is_power_of_2(size):
        raise ValueError("size must be a power of two")
    out = F.slice(v, 1, size)
    h = 1
    while h < size:
        out = _butterfly(out, h)
        h *= 2
    return out


def _butterfly(v: Column, h: int) -> Column:
    def run(x: Column) -> Column:
        return F.transform(x, lambda e, i: F.when(i.bitwiseAND(h) == 0, e + F.get(x, i + h)).otherwise(F.get(x, i - h) - e))

    # the array is bound once; otherwise every element would compute it again
    return F.get(F.transform(F.array(v), run), 0)


def normalized_hadamard(v: Column, size: int) -> Column:
    return F.transform(hadamard(v, size), lambda x: x / float(size) ** 0.5)


def split_normalize(v: Column) -> Column:
    """v / sqrt(|v|^2 + 1e-4), as points and queries are before a split."""
    return scale(v, F.sqrt(sum_of_squares(v) + EPS))


def bucket(output: Column, dim: int) -> Column:
    """Signed arg-max of |x|: i for a positive winner, dim + i for a negative one, 2 dim if none exceeds 1e-4; the first
    of equal values wins."""
    size = F.transform(output, lambda x: F.abs(x))
    best = F.array_max(size)
    at = F.array_position(size, best).cast("int") - 1
    return F.when(best <= EPS, F.lit(2 * dim)).when(F.get(output, at) > 0, at).otherwise(at + dim)


def constrained_bucket(output: Column, dim: int, allowed: Column) -> Column:
    """``bucket`` among the slots in ``allowed`` (an array of slot numbers)."""
    slot = lambda x, i: F.when(x > 0, i).otherwise(i + dim)
    masked = F.transform(output, lambda x, i: F.when(F.array_contains(allowed, slot(x, i)), x).otherwise(0.0))
    return bucket(masked, dim)


def bucket_value(output: Column, slot: Column, dim: int) -> Column:
    return F.coalesce(F.abs(F.get(output, slot % dim)), F.lit(0.0))


def second_bucket(output: Column, dim: int) -> Column:
    """The bucket of the runner-up."""
    first = bucket(output, dim) % dim
    return bucket(F.transform(output, lambda x, i: F.when(i == first, 0.0).otherwise(x)), dim)


def overlap(a: Column, b: Column) -> Column:
    """Equal bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(F.bitwise_not(x.bitwiseXOR(y)))), F.lit(0), lambda s, x: s + x)


def word_dot(a: Column, b: Column) -> Column:
    """The dot product of two words as sign vectors, halved: overlap - 32."""
    return F.bit_count(F.bitwise_not(a.bitwiseXOR(b))) - 32


def estimated_cosine(same_bits: Column, bits: int) -> Column:
    return F.cos((1 - same_bits / bits) * F.lit(3.141592653589793))


def word_to_signs(word: Column) -> Column:
    """64 values of +-1, the highest bit first."""
    return F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftrightunsigned", word, i).bitwiseAND(F.lit(1).cast("long")) * 2.0 - 1.0)


def signs_to_word(v: Column) -> Column:
    """The signs of at most 64 components, the first one highest; a component >= 0 gives a one."""
    return F.aggregate(F.slice(v, 1, 64), F.lit(0).cast("long"), lambda s, x: F.call_function("shiftleft", s, F.lit(1)).bitwiseOR(F.when(x >= 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def signature_word(v: Column, signs: list[float], dim: int) -> Column:
    """One word of a signature: random signs, zero padding to a power of two, Hadamard, sign bits."""
    size = round_up_power_of_2(dim)
    signed = F.zip_with(v, F.array(*[F.lit(float(s)) for s in signs]), lambda x, s: x * s)
    padded = signed if size == dim else F.concat(signed, F.array_repeat(F.lit(0.0), size - dim))
    return signs_to_word(hadamard(padded, size))


def quantize8(v: Column) -> Column:
    """Affine 8-bit form: struct(low, high, codes) with float32 bounds and codes floor(255 t + 0.5) up to 255."""
    def run(x: Column) -> Column:
        low, high = F.array_min(x).cast("float"), F.array_max(x).cast("float")
        width = (high - low).cast("double")
        code = lambda e: F.when(width > 0, F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e - low.cast("double")) / width * 255 + 0.5).cast("int")))).otherwise(0)
        return F.struct(low.alias("low"), high.alias("high"), F.transform(x, code).alias("codes"))

    return F.get(F.transform(F.array(v), run), 0)


def dequantize8(q: Column) -> Column:
    width = (q["high"] - q["low"]).cast("double")
    return F.transform(q["codes"], lambda c: q["low"].cast("double") + c * width / 255)


def is_significant(x: Column) -> Column:
    return F.abs(x) > 0.125
