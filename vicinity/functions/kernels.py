"""Numpy kernels over batches of vectors, for Arrow stages and driver models."""

from __future__ import annotations

import hashlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa

from .native import EPS, round_up_power_of_2

SIGNATURE_WORDS = 16
SIGNATURE_SEED = 11
TREE_SEED = 7
SPLIT = 8
SLOTS = 2 * SPLIT + 1


def rng(*key) -> np.random.Generator:
    """A generator that depends on its key alone, not on task order or partitioning."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big"))


def random_signs(n: int, *key) -> np.ndarray:
    """n values of +-1 / sqrt(n)."""
    return (rng(*key).integers(0, 2, n) * 2 - 1) / np.sqrt(n)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform of the rows of x, whose length is a power of two."""
    x = np.array(x, dtype=float)
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x


def signature_signs(dim: int, words: int = SIGNATURE_WORDS, seed: int = SIGNATURE_SEED) -> np.ndarray:
    return np.array([random_signs(dim, "signature", seed, w) for w in range(words)])


def signatures(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(rows, words) int64: sign bits of the first 64 Hadamard outputs of each signed copy, the first one highest."""
    size = round_up_power_of_2(x.shape[1])
    out = np.zeros((len(x), len(signs)), np.uint64)
    for w, s in enumerate(signs):
        padded = np.zeros((len(x), size))
        padded[:, : x.shape[1]] = x * s
        bits = (hadamard(padded)[:, :64] >= 0).astype(np.uint64)
        for i in range(bits.shape[1]):
            out[:, w] = out[:, w] << np.uint64(1) | bits[:, i]
    return out.view(np.int64)


def effective_bits(dim: int, words: int = SIGNATURE_WORDS) -> int:
    """Signature bits that carry information: fewer than 64 a word for short vectors, whose other bits are always 0."""
    return min(64, round_up_power_of_2(dim)) * words


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def overlaps(sig: np.ndarray, query: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
    """Equal bits of the words [start, end) of the rows of sig and of query."""
    return popcount(~(sig[:, start:end] ^ query[start:end])).sum(axis=1).astype(np.int64)


def rotation_signs(dim: int, tree: int, seed: int = TREE_SEED) -> np.ndarray:
    return random_signs(dim, "rotation", seed, tree)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sign flips and Hadamard, together orthonormal."""
    return hadamard(x * signs)


def split_outputs(x: np.ndarray, coords: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The Hadamard outputs that decide a split: of the signed coordinates, scaled to almost unit length."""
    y = x[:, coords] * signs
    return hadamard(y / np.sqrt((y * y).sum(1, keepdims=True) + EPS))


def slots(outputs: np.ndarray) -> np.ndarray:
    """Signed arg-max of |output|; the last slot where none exceeds 1e-4."""
    n = outputs.shape[1]
    size = np.abs(outputs)
    at = size.argmax(1)
    rows = np.arange(len(outputs))
    return np.where(size[rows, at] <= EPS, 2 * n, np.where(outputs[rows, at] > 0, at, at + n))


def to_bf16(x: np.ndarray) -> np.ndarray:
    """The top 16 bits of float32, truncated, as int16."""
    return (np.asarray(x, np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16).view(np.int16)


def from_bf16(codes: np.ndarray) -> np.ndarray:
    return (codes.view(np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32).astype(float)


def matrix(column: pa.Array, kind: type = float) -> np.ndarray:
    """The rows of an array column of vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


#: How vectors are stored: what one component takes, in bytes.
STORAGES = {"double": 8, "float": 4, "bf16": 2, "byte": 1}


def encode_vectors(x: np.ndarray, storage: str) -> bytes:
    """The rows of x.  "byte" keeps each row's least value and step, then codes of 0 to 255."""
    if storage == "byte":
        low, high = (f(1, keepdims=True) for f in (x.min, x.max)) if x.size else (np.zeros((0, 1)), np.zeros((0, 1)))
        step = np.where(high > low, (high - low) / 255, 1.0)
        codes = np.clip(np.floor((x - low) / step + 0.5), 0, 255).astype(np.uint8)
        return np.concatenate([low, step], axis=1).astype(np.float32).tobytes() + codes.tobytes()
    if storage == "bf16":
        return to_bf16(x).tobytes()
    return x.astype({"double": np.float64, "float": np.float32}[storage]).tobytes()


def decode_vectors(data, dim: int, storage: str) -> np.ndarray:
    """The rows that ``encode_vectors`` stored: doubles as doubles, all others as 32-bit floats."""
    if storage == "byte":
        n = len(data) // (dim + 8)
        ranges = np.frombuffer(data, np.float32, 2 * n).reshape(n, 2)
        return ranges[:, :1] + ranges[:, 1:] * np.frombuffer(data, np.uint8, n * dim, 8 * n).reshape(n, dim)
    if storage == "bf16":
        return from_bf16(np.frombuffer(data, np.int16)).astype(np.float32).reshape(-1, dim)
    return np.frombuffer(data, {"double": np.float64, "float": np.float32}[storage]).reshape(-1, dim)


def scores(x: np.ndarray, q: np.ndarray, exactly: bool = True) -> np.ndarray:
    """Cosines of the unit vector q with the rows of x: products, or 1 - |x - q|^2 / 2 for rows that storage has left
    not quite of unit length."""
    if exactly:
        return np.einsum("ij,j->i", x, q)  # in one order for every row: equal vectors score the same to the last bit
    return 1 - ((x - q) ** 2).sum(1) / 2


def storage_errors(x: np.ndarray, storage: str) -> np.ndarray:
    """How far each row of decoded vectors may lie from the vector that was stored, at most."""
    if storage == "byte":
        # half a step a component; the least and the largest code are 0 and 255.  Range and step are 32-bit floats.
        return (np.ptp(x, axis=1) / 510 + 2e-7) * x.shape[1] ** 0.5
    return {"double": 0.0, "float": 2.0**-23, "bf16": 2.0**-7}[storage] * np.sqrt((x.astype(float) ** 2).sum(1))


def may_be_best(x: np.ndarray, q: np.ndarray, k: int, storage: str) -> np.ndarray:
    """Positions of the rows of decoded vectors that may be among the k nearest of the unit vector q."""
    far, off = np.sqrt(((x - q) ** 2).sum(1)), storage_errors(x, storage)
    return np.flatnonzero(far - off <= np.partition(far + off, k - 1)[k - 1] + 1e-9) if len(x) > k else np.arange(len(x))


#: The quantile of the normal distribution that one candidate in a hundred at the cut falls short of.
SLACK_QUANTILE = NormalDist().inv_cdf(0.99)


def pruning_slack(count: float, bits: int) -> int:
    """How far below a count of equal bits the count of as good a candidate may fall by chance: its bits agree with
    probability count / bits each, so the count of ``bits`` of them is binomial."""
    p = min(max(count / bits, 0.0), 1.0)
    return int(SLACK_QUANTILE * (bits * p * (1 - p)) ** 0.5)


def threshold(counts: np.ndarray, keep: int, bits: int | None = None) -> int:
    """The ``keep``-th best count, less the slack of a count of ``bits`` bits if that is given; 1 at least, and 1 where
    there are fewer counts."""
    if len(counts) < keep:
        return 1
    kth = int(np.partition(counts, len(counts) - keep)[len(counts) - keep])
    return max(1, kth - (pruning_slack(kth, bits) if bits else 0))


def prune(votes: np.ndarray, signatures: np.ndarray, rows: np.ndarray, query: np.ndarray, keep: int, step: int = 4) -> np.ndarray:
    """Progressive pruning of one query's candidates, the ``rows`` of ``signatures``: counts are votes plus overlaps of
    ever more signature words; after each round only counts within the slack of the keep-th best stay, after the last
    one those that reach it.  Returns kept positions, ``keep`` at least."""
    sig, words = signatures[rows], signatures.shape[1]
    left, counts = np.arange(len(rows)), votes
    for start in range(0, words, step):
        if len(left) <= keep:
            break
        end = min(start + step, words)
        counts = counts + overlaps(sig[left], query, start, end)
        on = counts >= threshold(counts, keep, 64 * end if end < words else None)
        left, counts = left[on], counts[on]
    return left


def prune_at_once(votes: np.ndarray, signatures: np.ndarray, rows: np.ndarray, query: np.ndarray, keep: int) -> np.ndarray:
    """The same with all words in one round."""
    return prune(votes, signatures, rows, query, keep, signatures.shape[1])
