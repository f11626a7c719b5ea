"""Substring dedup with compact windows.

A text is its sequence of five-word shingles (tokens).  For each of ``HASHES`` hash functions, a Cartesian tree over the
tokens' hashes groups all subsequences of ``MIN_TOKENS`` tokens or more that share a minimum: a node is a compact window
(l, c, r), and every subsequence within [l, r] that contains c has its min-hash at c.  A tree is cut where windows get
shorter than a passage, so a text of n tokens has about 2 n / MIN_TOKENS windows per function.

Two passages that are equal share the windows of all functions; at Jaccard similarity 0.8 they share each with
probability 0.8.  Windows whose key occurs in two different texts are joined within their text by interval: stretches
that such windows of at least ``ENOUGH`` functions cover are segments, of which the parts dense in tokens that another
segment has are kept (every window of a passage's length with 4 of 5, the least that either side of a passage can have,
whatever the other's length), and only they are compared.  Under each key
the pivot is the segment of the smallest document.  A segment first meets the pivot that most of its seeds name, then
those of the seeds that no confirmed passage covers.  Seeds that are open even then meet all others of their key, in
blocks of 512 by 512 and by the tokens around them, so that no key is held in one task and none is capped; each block
returns one partner of an open seed.  Confirming looks at maximal stretches of 50 words or more in which 8 of 9 tokens
recur, and takes those whose sets of tokens have an exact Jaccard similarity of 0.8.

Texts that are equal are one text until the end, so thousands of copies count once.

Defined results: texts of fewer than 50 words, null and empty ones have no passage; equal texts of 50 words or more
are one passage each; rows with a null id take part and are returned; repeated rows are copies.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut, discard, pick_rows
from .textkit import GOLDEN, map_arrow, mix64

SHINGLE = 5
MIN_WORDS = 50
MIN_TOKENS = MIN_WORDS - SHINGLE + 1
HASHES = 4
ENOUGH = 2
SIMILARITY = 0.8
BLOCK = 512
#: Parts in which the spans of one text are joined before they meet.
SALTS = 32
#: Rounds in which tokens meet, by their hash, and segments meet what was found, by their text: shuffle files go after each.
ROUNDS = 3
#: Values that are gathered in a worker before they are told apart, and how many meet in one group.
GATHERED, MEETING = 1 << 18, 1 << 19
#: A stretch goes on while unmatched tokens are at most one to MATCHES matched ones: two stretches of equal length with
#: 8 of 9 tokens in common have similarity 0.8.
MATCHES = 8
#: The same for stretches of any two lengths: similarity 0.8 takes 4 of 5 tokens of the longer one.
LEAST_MATCHES = 4
#: Hits in the shortest such stretch.
LEAST_HITS = -(-LEAST_MATCHES * MIN_TOKENS // (LEAST_MATCHES + 1))
#: Runs of matches up to which all pairs of them are looked at before tokens are compared.
MOST_RUNS = 64
#: More different tokens than any window around a seed has.
NEVER = 2000
#: Candidates up to which each is compared without a bound on what it can share.
FEW = 2
#: Texts whose trees are built together.
TOGETHER = 64
#: An odd multiplier of places that spreads neighbours, and its inverse modulo 2^32.
PLACE = np.uint64(0x9E3779B1)
PLACE_BACK = np.uint64(pow(0x9E3779B1, -1, 1 << 32))
#: The inverse of GOLDEN modulo 2^64.
GOLDEN_BACK = np.uint64(pow(int(GOLDEN), -1, 1 << 64))
#: Pairs of a block that are counted at a time, and common tokens of them.
MOST_PAIRS, MOST_COMMON = 1 << 20, 1 << 22


def _powers(odd: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, odd)]))


#: Bytes that are hashed at a time.
PIECE = 1 << 16
#: Bytes of a word up to which its hash is a sum of its bytes' values times powers of GOLDEN, modulo 2^64.
LONG_WORD = 64
BLANK = re.compile(rb"[\x20\x09-\x0D]")
IS_BLANK = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
POWERS, POWERS_BACK = _powers(GOLDEN, PIECE), _powers(GOLDEN_BACK, PIECE)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased UTF-8 start, and a hash of each."""
    starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = max(data.rfind(x, at, end) for x in (b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r")) + 1
            if not end:  # nothing but one word
                blank = BLANK.search(data, at + PIECE)
                end = blank.start() if blank else len(data)
                starts.append(np.array([at]))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], np.uint64))
                at = end
                continue
        x = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], IS_BLANK[x], [True]])))
        s, e = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[x] * POWERS[: len(x)])])
        h = mix64((total[e] - total[s]) * POWERS_BACK[s])
        for i in np.flatnonzero(e - s > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(data[at + int(s[i]) : at + int(e[i])])
        starts.append(s + at)
        hashes.append(h)
        at += len(x)
    return np.concatenate(starts), np.concatenate(hashes)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts, one after the other, and how many each has."""
    parts = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]
    starts, h = _words(b"\n".join(parts))
    ends = np.cumsum([len(x) + 1 for x in parts])
    n = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    out = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        out = out * GOLDEN + h[i : i + len(out)]
    size = np.maximum(0, n - SHINGLE + 1)
    begin = np.cumsum(n) - n
    own = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    return mix64(out[own]), size


def tokens(text: str | None) -> np.ndarray:
    return tokens_of([text])[0]


def text_key(text: str | None) -> int:
    """A signed 64-bit key of a text."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - 2**63


def compact_windows(values: np.ndarray, least: int = MIN_TOKENS) -> list[tuple[int, int, int]]:
    """The nodes (l, c, r) of the Cartesian tree over ``values`` that span at least ``least`` positions.  Equal values may
    stand in any order; a hash of their places decides, so that repeated tokens make no chain."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.uint64) << np.uint64(32)
    left, c, right = compact_windows_of(rank, np.array([0, len(values)]), least)
    return list(zip(left.tolist(), c.tolist(), right.tolist()))


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(2 * len(a), np.int64)
    out[::2], out[1::2] = a, b
    return out


def compact_windows_of(values: np.ndarray, bounds: np.ndarray, least: int = MIN_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``compact_windows`` of the sequences between ``bounds`` of 64-bit hashes ``values``, level by level for all of them: the minima
    of one level are one pass, in which a word holds half a value and its place, multiplied by an odd number."""
    low_half, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    place = (np.arange(len(values)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
    packed = np.append(values >> half << half | (place * PLACE) & low_half, np.uint64(0))
    start, left, end = bounds[:-1], bounds[:-1], bounds[1:]
    levels = [(left[:0],) * 3]
    while True:
        wide = end - left >= least
        start, left, end = start[wide], left[wide], end[wide]
        if not len(left):
            break
        low = np.minimum.reduceat(packed, _in_turn(left, end))[::2]
        c = (((low & low_half) * PLACE_BACK) & low_half).astype(np.int64) + start
        levels.append((left, c, end - 1))
        start, left, end = np.repeat(start, 2), _in_turn(left, c + 1), _in_turn(c, end)
    return tuple(np.concatenate(x) for x in zip(*levels))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        for at in range(0, batch.num_rows, TOGETHER):
            texts = batch.column(1).slice(at, TOGETHER).to_pylist()
            t, size = tokens_of(texts)
            bounds = np.concatenate([[0], np.cumsum(size)])
            found = []
            with np.errstate(over="ignore"):
                for f in range(HASHES):
                    left, c, right = compact_windows_of(mix64(t + np.uint64(f + 1) * GOLDEN), bounds)
                    found.append((left, c, right, mix64(t[c] ^ mix64(np.uint64(f + 1) * GOLDEN)).view(np.int64), np.full(len(c), f)))
            left, c, right, key, f = (np.concatenate(x) for x in zip(*found))
            owner = np.searchsorted(bounds, c, side="right") - 1
            order, start = np.argsort(owner, kind="stable"), bounds[owner]
            # two positions a long: function and c, l and r
            cuts = np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]
            listed = [np.split(x[order], cuts) for x in (key, f << 32 | c - start, left - start << 32 | right - start)]
            for column, x in zip(columns, ([text_key(x) for x in texts], np.where(size > 0, size + SHINGLE - 1, 0).tolist(), *listed)):
                column.extend(x)
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "tk", "n_words", "key", "fc", "lr"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text that shared windows of enough functions cover, once for each seed inside."""
    for batch in batches:
        out = [[np.empty(0, np.int64)] * 5]
        for tk, keys, fc, lr in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
            key, fc, lr = (x.values.to_numpy() for x in (keys, fc, lr))
            f, c, left, right = fc >> 32, fc & 0xFFFFFFFF, lr >> 32, lr & 0xFFFFFFFF
            width = int(right.max()) + 2
            own = np.bincount(f * width + left, minlength=HASHES * width) - np.bincount(f * width + right + 1, minlength=HASHES * width)
            enough = (np.cumsum(own.reshape(HASHES, width), axis=1) > 0).sum(0) >= ENOUGH
            edge = np.flatnonzero(np.diff(np.concatenate([[0], enough, [0]])))
            edge = edge.reshape(-1, 2)[np.diff(edge)[::2] >= MIN_TOKENS]
            if len(edge):
                of = np.searchsorted(edge[:, 0], c, side="right") - 1
                inside = (of >= 0) & (c < edge[of, 1])
                key, c, of = (x[inside] for x in (key, c, of))
                order = np.lexsort((key, c))
                new = np.concatenate([[True], (np.diff(c[order]) != 0) | (key[order[1:]] != key[order[:-1]])])[: len(order)]
                key, c, of = (x[order][new] for x in (key, c, of))
                out.append([np.full(len(c), tk), edge[of, 0], edge[of, 1] - 1, key, c])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["tk", "s", "e", "key", "c"])


def _of_round(turn: int, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows (tk, tokens) to the tokens of a round and the text of each."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
    token = np.concatenate([np.empty(0, np.uint64), *parts])
    mine = token % np.uint64(ROUNDS) == turn
    return token[mine], np.repeat(batch.column(0).to_numpy(), [len(x) for x in parts])[mine]


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows (tk, array of keys) to the keys and the text of each."""
    listed = batch.column(1)
    return listed.flatten().to_numpy().view(np.uint64), np.repeat(batch.column(0).to_numpy(), listed.value_lengths().to_numpy())


def _sorted_out(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value once, in order, with the least of its ``low`` and the greatest of its ``high``."""
    order = np.argsort(value)
    value = value[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    return value[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _gathered(values_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many values as one row for each range of them, a value once with the smallest and the largest text that has it: so
    one that all texts have travels once for each GATHERED values."""
    edges = np.array([(g << 32) // groups for g in range(groups + 1)], np.uint64)

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        value, tk = (np.concatenate(x) for x in zip(*held))
        columns = _sorted_out(value, tk, tk)
        # by the upper half of a value: ranges of equal size, in the values' order
        bounds = np.searchsorted(columns[0] >> np.uint64(32), edges)
        full = np.flatnonzero(np.diff(bounds))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array([x[bounds[g] : bounds[g + 1]].tobytes() for g in full], pa.binary()) for x in columns]], ["range", "value", "low", "high"])

    held, n = [], 0
    for batch in batches:
        held.append(values_of(batch))
        n += len(held[-1][0])
        if n >= GATHERED:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _in_two_texts(_: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """The values of a range that more than one text has."""
    value, low, high = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("value", np.uint64), ("low", np.int64), ("high", np.int64)))
    value, low, high = _sorted_out(value, low, high)
    return pa.table({"value": pa.array(value[low != high].view(np.int64))})


def in_two_texts(df: DataFrame, values_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], name: str, n: int) -> DataFrame:
    """The values (uniform 64-bit hashes, about ``n``, of which ``values_of`` gets those of a batch) that more than one
    text has.  Workers tell them apart by sorting, so that only those that are shared become rows."""
    groups = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // MEETING))
    packed = map_arrow(df, partial(_gathered, values_of, groups), "range int, value binary, low binary, high binary")
    return packed.groupBy("range").applyInArrow(_in_two_texts, "value long").withColumnRenamed("value", name)


def _token_places(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of a round, with their places in their segments."""
    for batch in batches:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens")]
        n = np.array([len(x) for x in parts], np.int64)
        token = np.concatenate([np.empty(0, np.uint64), *parts])
        mine = np.flatnonzero(token % np.uint64(ROUNDS) == turn)
        owner = np.repeat(np.arange(len(n)), n)[mine]
        place = (mine - (np.cumsum(n) - n)[owner]).astype(np.int32)
        owner = pa.array(owner)
        yield pa.RecordBatch.from_arrays([batch.column("tk").take(owner), batch.column("s").take(owner), pa.array(place), pa.array(token[mine].view(np.int64))], ["tk", "s", "place", "token"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tk, s, tokens, places) to the parts of the segment that are dense in the places of shared tokens."""
    for batch in batches:
        out = []
        for tk, s, x, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            part = np.frombuffer(x.as_buffer(), np.uint64)
            mask = np.zeros(len(part), bool)
            mask[places.values.to_numpy()] = True
            out += [(tk, s + a, s + b - 1, part[a:b].tobytes()) for a, b in recurring_stretches(mask)]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns[:3]], pa.array(columns[3], pa.binary())], ["tk", "s", "e", "tokens"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in batch.column(0).to_pylist()], pa.int64()), batch.column(0)], ["tk", "text"])


def dense_stretches(hit: np.ndarray) -> list[tuple[int, int]]:
    """The maximal scoring stretches of a mask, where a hit scores 1 and a miss -MATCHES: disjoint, and every start and
    end of one has a positive score.  One pass over the runs of hits."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(int)))
    starts, ends = edge[::2].tolist(), edge[1::2].tolist()
    out: list[list[int]] = []  # start, end, score before, score after
    score, last = 0, 0
    for s, e in zip(starts, ends):
        score -= MATCHES * (s - last)
        now, score, last = [s, e, score, score + e - s], score + e - s, e
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= now[2]:
                j -= 1
            if j < 0 or out[j][3] >= now[3]:
                break
            now = [out[j][0], e, out[j][2], now[3]]
            del out[j:]
        out.append(now)
    return [(s, e) for s, e, _, _ in out]


def recurring_stretches(hit: np.ndarray) -> list[tuple[int, int]]:
    """What the windows of MIN_TOKENS or more with LEAST_MATCHES hits to a miss cover, joined: each window reaches to the
    last place where the score is what it was at its start."""
    score = np.concatenate([[0], np.cumsum(np.where(hit, 1, -LEAST_MATCHES))])
    after = np.maximum.accumulate(score[::-1])[::-1]
    reach = np.searchsorted(-after, -score, side="right") - 1
    start = np.flatnonzero(reach - np.arange(len(score)) >= MIN_TOKENS)
    if not len(start):
        return []
    reach = np.maximum.accumulate(reach[start])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return list(zip(start[first].tolist(), reach[np.append(first[1:] - 1, len(start) - 1)].tolist()))


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _previous(x: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same value, or -1."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), -1)
    same = x[order[1:]] == x[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _fewest(x: np.ndarray, size: int = MIN_TOKENS) -> int:
    """The least number of different values in a window of that size of x."""
    before = np.lib.stride_tricks.sliding_window_view(_previous(x), size)
    return int((before < np.arange(len(before))[:, None]).sum(1).min())


def _between_runs(a: np.ndarray, b: np.ndarray, place: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The longest passages from the start of one run of matched tokens to the end of another, for each start.  Tokens
    ``place`` of a are ``other`` in b.

    For each start, the distinct tokens up to every end are counted at once, on both sides and of those that match: with
    them no similarity can be higher, so only ends that allow it are compared."""
    jump = np.diff(other)
    # a token that follows itself changes no set: the run goes on
    edge = np.flatnonzero((np.diff(place) != 1) | (jump != 1) & (jump != 0)) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(place)]]) - 1
    before_a, before_b = _previous(a[: place[-1] + 1]), _previous(b[: int(other.max()) + 1])
    matched = np.zeros(place[-1] + 1, bool)
    matched[place] = True
    out, reached = [], 0
    for i in first:
        start, low = int(place[i]), int(other[i])
        ends = last[(place[last] + 1 - start >= MIN_TOKENS) & (other[last] + 1 - low >= MIN_TOKENS * SIMILARITY) & (place[last] >= reached)]
        if not len(ends):
            continue
        new = before_a[start:] < start
        n, hits = np.cumsum(new)[place[ends] - start], np.cumsum(new & matched[start:])[place[ends] - start]
        m = np.cumsum(before_b[low:] < low)[other[ends] - low]
        for j in ends[hits >= SIMILARITY * (n + m - hits)][::-1]:
            s, e, low, high = int(place[i]), int(place[j]) + 1, int(other[i]), int(other[j]) + 1
            similarity = _similarity(a[s:e], b[low:high])
            if similarity >= SIMILARITY:
                out.append((s, e, low, high, similarity))
                reached = e
                break
    return out


def _possible(a: np.ndarray, b: np.ndarray, place: np.ndarray, at: np.ndarray, order: np.ndarray) -> bool:
    """Whether ``shared_stretches`` can find a passage at all.  It has LEAST_HITS common tokens; and if no token repeats,
    those of a come in the same order in b and none is far off the others' diagonal, every passage spans the matches from
    one place to another on both sides.  Its similarity is then a matter of counts, and highest where it starts and ends
    with whole runs of matches, so that all pairs of runs tell."""
    if len(place) < LEAST_HITS:
        return False
    other = at[place]
    step, jump = np.diff(place), np.diff(other)
    in_order = b[order]
    off = other - place
    if (jump < 1).any() or off.max() - off.min() > MIN_TOKENS or (in_order[1:] == in_order[:-1]).any() or len(np.unique(a)) < len(a):
        return True
    edge = np.flatnonzero((step != 1) | (jump != 1)) + 1
    if len(edge) > MOST_RUNS:
        return True  # the comparison itself takes no longer than all pairs of so many runs
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(place)]]) - 1
    hits = last[None] + 1 - first[:, None]
    n, m = (x[last][None] - x[first][:, None] + 1 for x in (place, other))
    return bool(((n >= MIN_TOKENS) & (hits >= SIMILARITY * (n + m - hits) - 1e-9)).any())


def _hopeful(a: np.ndarray, at: np.ndarray, plain: np.ndarray, fewest: np.ndarray) -> np.ndarray:
    """For many sequences at once, whether ``shared_stretches`` of a and each can find a passage at all.  ``at`` has the
    places of a's tokens in each, or -1; ``plain`` are those without repeated tokens, ``fewest`` the least number of
    different tokens in any LEAST_HITS places of each, which a passage has on its other side.

    Without repeats, in order and near one diagonal, a passage spans the matches from one place to another on both sides,
    so 18 hits >= 8 (n + m), a difference of two sums that each hang on one end.  Otherwise the different tokens of every
    window of a, and those of them that match, are counted."""
    hit, place = at >= 0, np.arange(at.shape[1])
    before, far = _previous(a), 1 << 40
    out, simple = np.ones(len(at), bool), np.zeros(len(at), bool)
    if (before < 0).all():
        reach, off = np.maximum.accumulate(at, axis=1), at - place
        simple = plain & ~(hit[:, 1:] & (at[:, 1:] <= reach[:, :-1])).any(1)
        simple &= np.where(hit, off, -far).max(1) - np.where(hit, off, far).min(1) <= MIN_TOKENS
        score = 18 * np.cumsum(hit, axis=1) - 8 * (place + at)
        last = np.maximum.accumulate(np.where(hit, score, -far)[:, ::-1], axis=1)[:, ::-1]
        best = (last[:, MIN_TOKENS - 1 :] - np.where(hit, score - 18, far)[:, : 1 - MIN_TOKENS]).max(1)
        out[simple] = best[simple] >= 16
    start = np.arange(len(a) - MIN_TOKENS + 1)[:, None]
    new = (before < start) & (place >= start)
    n, long = np.cumsum(new, axis=1, dtype=np.int16), place >= start + MIN_TOKENS - 1
    rest = np.flatnonzero(~simple)
    for some in np.split(rest, range(64, len(rest), 64)):
        hits = np.cumsum(new & hit[some, None], axis=2, dtype=np.int16)
        least = 4 * fewest[some].astype(np.int16)[:, None, None]
        out[some] = (long & (5 * hits >= 4 * n) & (9 * hits - 4 * n >= least)).any((1, 2))
    return out


def _grams(x: np.ndarray) -> np.ndarray:
    """A hash of every window of MIN_TOKENS tokens: sums of tokens times powers of an odd number, modulo 2^64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(GOLDEN, len(x) - 1))])
    return (total[MIN_TOKENS:] - total[:-MIN_TOKENS]) * _powers(GOLDEN_BACK, len(x) - MIN_TOKENS)


def _copied(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The passages of a that consist of windows of MIN_TOKENS tokens that stand in b as they are.  Windows that follow each
    other in a and overlap in b make one passage, which has the same tokens on both sides."""
    if min(len(a), len(b)) < MIN_TOKENS:
        return []
    x, y = _grams(a), _grams(b)
    order = np.argsort(y, kind="stable")
    at = order[np.minimum(np.searchsorted(y, x, sorter=order), len(y) - 1)]
    start = np.flatnonzero(y[at] == x)
    if not len(start):
        return []
    at = at[start]
    edge = np.concatenate([[0], np.flatnonzero((np.diff(start) > 1) | (np.abs(np.diff(at)) > MIN_TOKENS)) + 1])
    ends = np.append(edge[1:], len(start)) - 1
    found = zip(start[edge].tolist(), (start[ends] + MIN_TOKENS).tolist(), np.minimum.reduceat(at, edge).tolist(), (np.maximum.reduceat(at, edge) + MIN_TOKENS).tolist())
    return [(*f, 1.0) for f in found if _similarity(a[f[0] : f[1]], b[f[2] : f[3]]) == 1]


def shared_stretches(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(start in a, end, start in b, end, similarity) of the passages that two token sequences share.

    Where tokens repeat in b, one place cannot stand for a token, so equal passages are looked for by their windows, from
    either side, and only what they leave is compared further.

    Stretches of tokens of a that b has, of MIN_TOKENS or more, with the part of b around their main diagonal.  In one
    that falls short of the similarity, all pairs of a first and a last run of matches are tried, and its dense stretches,
    which are parted where their diagonal jumps most, or else at the widest gap.
    """
    order = np.argsort(b, kind="stable")
    at = order[np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)] if len(b) else np.zeros(len(a), int)
    hit = b[at] == a if len(b) else np.zeros(len(a), bool)
    if not _possible(a, b, np.flatnonzero(hit), at, order):
        return []
    in_order, out = b[order], []
    if (in_order[1:] == in_order[:-1]).any():
        out = _copied(a, b) + [(s, e, low, high, x) for low, high, s, e, x in _copied(b, a)]
    whole = [(s, e) for s, e, *_ in out]
    todo = [(*x, True) for x in recurring_stretches(hit) if not any(s <= x[0] and x[1] <= e for s, e in whole)]
    while todo:
        s, e, outer = todo.pop()
        place = s + np.flatnonzero(hit[s:e])
        if not len(place):
            continue
        s, e = int(place[0]), int(place[-1]) + 1
        if e - s < MIN_TOKENS:
            continue
        diagonal = at[place] - place
        shift = np.sort(diagonal)[len(diagonal) // 2]
        near = at[place][np.abs(diagonal - shift) <= max(MIN_TOKENS, (e - s) // 4)]
        low, high = int(near.min()), int(near.max()) + 1
        similarity = _similarity(a[s:e], b[low:high])
        if similarity >= SIMILARITY:
            if high - low >= MIN_TOKENS * SIMILARITY:
                out.append((s, e, low, high, float(similarity)))
            continue
        if outer:
            out += _between_runs(a, b, place, at[place])
            todo += [(s + x, s + y, False) for x, y in dense_stretches(hit[s:e]) if y - x >= MIN_TOKENS]
            continue
        jump, gap = np.abs(np.diff(diagonal)), np.diff(place)
        if len(gap) and (jump.any() or (gap > 1).any()):
            cut_at = int(place[int((jump if jump.any() else gap).argmax())]) + 1
            todo += [(s, cut_at, False), (cut_at, e, False)]
    return out


def _segment_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tk, text, starts, ends) to the segments of each text with their tokens."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(at, TOGETHER)
            t, size = tokens_of(some.column(1).to_pylist())
            parts = np.split(t, np.cumsum(size)[:-1])
            out = [(tk, s, e, x[s : e + 1].tobytes()) for tk, x, *ends in zip(some.column(0).to_pylist(), parts, some.column(2).to_pylist(), some.column(3).to_pylist()) for s, e in zip(*ends)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns[:3]], pa.array(columns[3], pa.binary())], ["tk", "s", "e", "tokens"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tk, s, tk2, s2, tokens, tokens2) to the passages both segments share."""
    for batch in batches:
        rows = []
        tk, s, tk2, s2 = (batch.column(i).to_pylist() for i in range(4))
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            rows += [(tk[i], s[i] + p, s[i] + q, tk2[i], s2[i] + p2, s2[i] + q2) for p, q, p2, q2, _ in shared_stretches(a, b)]
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tk", "a", "b", "tk2", "a2", "b2"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of the segment around each seed that the shortest passage through it can hold, and the seed's place."""
    names = ["key", "i", "j", "open_side", "tk", "s", "e"]
    for batch in batches:
        at = [c - s for c, s in zip(batch.column("c").to_pylist(), batch.column("s").to_pylist())]
        near = [np.frombuffer(x.as_buffer(), np.uint64)[max(0, i - MIN_TOKENS + 1) : i + MIN_TOKENS].tobytes() for x, i in zip(batch.column("tokens"), at)]
        place = [min(i, MIN_TOKENS - 1) for i in at]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(place, pa.int64()), pa.array(near, pa.binary())], [*names, "place", "near"])


def _block_groups(_: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """For each open seed of one block pair of each key in a bucket of keys, a partner around whose seed the open one's
    tokens recur: 4 of 5 in a stretch of MIN_TOKENS or more with the seed."""
    t = t.sort_by([("key", "ascending"), ("tk", "ascending"), ("s", "ascending")])  # rows come in any order, and the first partner counts
    near = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("near").combine_chunks()]
    size = np.array([len(x) for x in near])
    code = np.unique(np.concatenate(near), return_inverse=True)[1]
    codes = np.split(code, np.cumsum(size)[:-1])
    key = np.unique(t.column("key").to_numpy(), return_inverse=True)[1]
    open_side, tk, place = t.column("open_side").to_numpy(zero_copy_only=False), t.column("tk").to_numpy(), t.column("place").to_numpy()
    left, queries = np.flatnonzero(~open_side), np.flatnonzero(open_side & (size >= MIN_TOKENS))
    width = int(code.max()) + 1
    # the different tokens of each row: a place where each stands, and how often it does
    held, first, times = np.unique(np.repeat(np.arange(len(near)), size) * width + code, return_index=True, return_counts=True)
    owner, spot = held // width, first - (np.cumsum(size) - size)[held // width]
    within = key[owner] * width + held % width
    of_left = np.flatnonzero(~open_side[owner])
    of_left = of_left[np.argsort(within[of_left], kind="stable")]
    bounds = np.searchsorted(owner, np.arange(len(near) + 1))
    begin, end = (np.searchsorted(within[of_left], within, side=x) for x in ("left", "right"))
    unrepeated = np.diff(bounds) == size
    same: dict[bytes, int] = {}
    content = [same.setdefault(x.tobytes(), i) for i, x in enumerate(near)]
    tested: dict[tuple[int, int], bool] = {}
    fewest_of: dict[int, int] = {}

    def share(q: int, p: int) -> bool:
        pair = content[q], content[p]
        if pair not in tested:
            tested[pair] = bool(shared_stretches(near[q], near[p]))
        return tested[pair]

    def fewest(p: int) -> int:
        if content[p] not in fewest_of:
            fewest_of[content[p]] = NEVER if size[p] < LEAST_HITS else LEAST_HITS if unrepeated[p] else _fewest(near[p], LEAST_HITS)
        return fewest_of[content[p]]

    def partner(q: int, some: np.ndarray) -> int | None:
        """The first of the rows ``some`` that shares a passage with the open seed q."""
        own, back = np.unique(codes[q], return_inverse=True)
        wanted = some[:, None] * width + own
        entry = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        at = np.where(held[entry] == wanted, spot[entry], -1)
        hit = at >= 0
        score = np.concatenate([np.zeros((len(some), 1), int), np.cumsum(np.where(hit[:, back], 1, -LEAST_MATCHES), axis=1)], axis=1)
        after = np.maximum.accumulate(score[:, ::-1], axis=1)[:, ::-1]
        start = np.arange(min(place[q], size[q] - MIN_TOKENS) + 1)
        best = (after[:, np.maximum(start + MIN_TOKENS, place[q] + 1)] - score[:, start]).max(1)
        # the common tokens, each once, are 4 of 5 of those of the window with the fewest at least
        enough = np.flatnonzero((best >= 0) & (hit.sum(1) >= SIMILARITY * _fewest(codes[q]) - 1e-9))
        if len(enough) > FEW:
            enough = enough[_hopeful(codes[q], at[enough][:, back], unrepeated[some[enough]], np.array([fewest(p) for p in some[enough]]))]
        enough = enough[np.argsort(-best[enough], kind="stable")]
        return next((p for p in some[enough] if share(q, p)), None)

    rows: list[tuple[int, int]] = []
    number = np.empty(len(near), np.int64)
    number[left] = np.arange(len(left))
    # the hits of all pairs at once: most fall short of those that a passage takes
    entries = np.concatenate([[0], np.cumsum(end - begin)])
    common = entries[bounds[queries + 1]] - entries[bounds[queries]]
    turn = np.maximum(np.cumsum(common) // MOST_COMMON, np.arange(len(queries)) // max(1, MOST_PAIRS // max(1, len(left))))
    for some in np.split(queries, np.flatnonzero(np.diff(turn)) + 1):
        mine = np.concatenate([np.arange(bounds[q], bounds[q + 1]) for q in some] or [queries])
        n = (end - begin)[mine]
        entry = of_left[np.repeat(begin[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        asked = np.repeat(np.searchsorted(some, owner[mine]), n)
        hits = np.bincount(asked * len(left) + number[owner[entry]], np.repeat(times[mine], n), len(some) * len(left)).reshape(len(some), len(left))
        for i, q in enumerate(some):
            others = left[hits[i] >= LEAST_HITS]
            others = others[tk[others] != tk[q]]
            p = partner(q, others) if len(others) else None
            if p is not None:
                rows.append((q, p))
    q, p = (np.array([r[k] for r in rows], int) for k in (0, 1))
    get = lambda n, k: t.column(n).to_numpy()[k]
    return pa.table({"tk": get("tk", q), "s": get("s", q), "e": get("e", q), "tk2": get("tk", p), "s2": get("s", p), "e2": get("e", p)})


def _joined(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching spans (a, b, first_id) of the same keys as one, with the smallest first_id."""
    order = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)).over(order)
    marked = spans.withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("first_id").alias("first_id")).drop("island")


def joined_spans(spans: DataFrame) -> DataFrame:
    """(tk, a, b, first_id) without overlaps.  A pivot has as many spans as its group has members, so they are joined in
    parts first."""
    parts = _joined(spans.groupBy("tk", "a", "b").agg(F.min("first_id").alias("first_id")).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS))), "tk", "salt")
    return _joined(parts.drop("salt"), "tk")


def one_of_each(index: DataFrame, texts: DataFrame) -> DataFrame:
    """``index`` without the copies of a text but the one with the smallest id.  Only texts that have copies are joined:
    broadcast while they are few (counted), else hashed."""
    copied = cut(texts.where("copies > 1").select("tk", F.lit(True).alias("copied"), "first_id"), "copied-texts")
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_IDS else copied.hint("shuffle_hash")
    kept = F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))
    return index.join(copied, "tk", "left").where(kept).drop("copied", "first_id")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, first_id): the stretches of each document that recur in another one, joined where
    they overlap, with the smallest id of a document known to hold part of the stretch."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = cut(map_arrow(docs, _windows, f"doc_id {kind}, tk long, n_words long, key array<long>, fc array<long>, lr array<long>"), "compact-windows")
    brief = cut(index.select("doc_id", "tk", "n_words"), "documents")
    texts = cut(brief.where(F.col("n_words") >= MIN_WORDS).groupBy("tk").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_words").alias("n_words")), "texts")
    stored, index = index, one_of_each(index, texts)
    n_words = brief.agg(F.sum("n_words")).first()[0] or 0
    shared = cut(in_two_texts(index.select("tk", "key"), _keys, "key", 2 * HASHES * n_words // MIN_TOKENS), "shared-keys")
    each = index.select("tk", F.explode(F.arrays_zip("key", "fc", "lr")).alias("w")).select("w.key", "tk", "w.fc", "w.lr")
    # no distinct on top: it would take over the join's partitioning, and a hot key could not be split
    hits = cut(each.join(shared.hint("shuffle_hash"), "key", "left_semi"), "shared-windows")
    discard(stored, shared)
    listed = hits.groupBy("tk").agg(*[F.collect_list(c).alias(c) for c in ("key", "fc", "lr")])
    seeds = cut(map_arrow(listed, _segments, "tk long, s long, e long, key long, c long"), "seeds")
    discard(hits)

    segments = cut(seeds.select("tk", "s", "e").distinct(), "segments")
    wanted = segments.select("tk").distinct().join(texts, "tk").select("tk", "first_id")
    # texts travel, once: their tokens are larger and do not compress
    picked = map_arrow(pick_rows(docs, wanted, "doc_id", "first_id").select("text"), _keyed, "tk long, text string").groupBy("tk").agg(F.first("text").alias("text"))
    parts = segments.groupBy("tk").agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends"))
    wide = cut(map_arrow(picked.join(parts, "tk").select("tk", "text", "starts", "ends"), _segment_tokens, "tk long, s long, e long, tokens binary"), "segment-tokens")

    # A passage consists of tokens that another text has, 8 of 9: a line that many share does not make one.
    def shared_places(turn: int) -> DataFrame:
        places = map_arrow(wide.select("tk", "s", "tokens"), partial(_token_places, turn), "tk long, s long, place int, token long")
        known = cut(in_two_texts(wide.select("tk", "tokens"), partial(_of_round, turn), "token", n_words // ROUNDS), "shared-tokens")
        found = cut(places.join(known.hint("shuffle_hash"), "token", "left_semi").groupBy("tk", "s").agg(F.collect_list("place").alias("places")), "shared-places")
        discard(known)
        return found

    hits = [shared_places(turn) for turn in range(ROUNDS)]

    def refined(turn: int) -> DataFrame:
        mine = F.pmod("tk", F.lit(ROUNDS)) == turn
        dense = reduce(DataFrame.unionByName, hits).where(mine).groupBy("tk", "s").agg(F.flatten(F.collect_list("places")).alias("places"))
        both = wide.where(mine).join(dense, ["tk", "s"]).select("tk", "s", "tokens", "places")
        return cut(map_arrow(both, _refined, "tk long, s long, e long, tokens binary"), "dense-tokens")

    tokens_of = reduce(DataFrame.unionByName, [refined(turn) for turn in range(ROUNDS)])
    # a text that repeats itself has a key many times: once is enough
    inside = seeds.drop("s", "e").join(tokens_of.select("tk", "s", "e"), "tk").where("c between s and e").groupBy("tk", "s", "e", "key").agg(F.min("c").alias("c"))
    discard(wide, *hits)
    seeds = cut(inside, "dense-seeds")

    named = seeds.join(texts.select("tk", "first_id"), "tk")
    pivots = named.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("first_id", "tk", "s", "e")).alias("p")).where("n > 1")
    pivots = cut(pivots.select("key", "n", F.col("p.tk").alias("tk2"), F.col("p.s").alias("s2"), F.col("p.e").alias("e2")), "pivots")
    segment, other = ["tk", "s", "e"], ["tk2", "s2", "e2"]

    def confirm(pairs: DataFrame) -> DataFrame:
        side = tokens_of.select(F.col("tk").alias("tk2"), F.col("s").alias("s2"), F.col("tokens").alias("tokens2"))
        both = pairs.join(tokens_of.drop("e"), ["tk", "s"]).join(side, ["tk2", "s2"]).select("tk", "s", "tk2", "s2", "tokens", "tokens2")
        return cut(map_arrow(both, _confirm, "tk long, a long, b long, tk2 long, a2 long, b2 long"), "passages")

    def spans(found: DataFrame) -> DataFrame:
        both = found.select("tk", "a", "b", F.col("tk2").alias("other")).unionByName(found.select(F.col("tk2").alias("tk"), F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("tk").alias("other")))
        return both.join(texts.select(F.col("tk").alias("other"), "first_id"), "other").select("tk", "a", "b", "first_id")

    def open_seeds(found: DataFrame) -> DataFrame:
        """Seeds outside all confirmed passages of their text."""
        covered = seeds.join(found.select("tk", "a", "b"), "tk").where("c >= a and c < b").select("tk", "key", "c").distinct()
        return cut(seeds.join(covered, ["tk", "key", "c"], "left_anti"), "open-seeds")

    votes = seeds.join(pivots, "key").where("tk <> tk2").groupBy(*segment, *other).agg(F.count("*").alias("n"))
    best = cut(votes.groupBy(*segment).agg(F.max(F.struct("n", *other)).alias("p")).select(*segment, *[F.col(f"p.{c}").alias(c) for c in other]), "best-pivots")
    found = cut(joined_spans(spans(confirm(best))), "spans")
    rest = open_seeds(found)
    others = rest.join(pivots, "key").where("tk <> tk2").select(*segment, *other).distinct().join(best, [*segment, *other], "left_anti")
    found = cut(joined_spans(found.unionByName(spans(confirm(cut(others, "other-pivots"))))), "spans")

    # Open seeds of keys with more members than the pivot and one other meet all of them.
    rest = open_seeds(found).join(pivots.where("n > 2").select("key", "n", "tk2", "s2"), "key")
    open_keys = cut(rest.groupBy("key").agg(F.first("n").alias("n"), F.first("tk2").alias("tk2"), F.first("s2").alias("s2"), F.count("*").alias("open")), "open-keys")
    if open_keys.limit(1).count():
        blocks, open_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "open"))
        place = lambda n: F.pmod(F.xxhash64("tk", "c"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        # the pivot's segment has been compared as a whole with all of them
        all_ = seeds.join(open_keys, "key").where("not (tk = tk2 and s = s2)").drop("tk2", "s2").select("*", place(blocks).alias("i"), every(open_blocks).alias("j"), F.lit(False).alias("open_side"))
        mine = rest.drop("n", "tk2", "s2").join(open_keys.drop("tk2", "s2"), "key").select("*", every(blocks).alias("i"), place(open_blocks).alias("j"), F.lit(True).alias("open_side"))
        rows = cut(all_.unionByName(mine).select("key", "i", "j", "open_side", *segment, "c"), "block-seeds")
        near = map_arrow(rows.join(tokens_of.drop("e"), ["tk", "s"]), _around, "key long, i int, j int, open_side boolean, tk long, s long, e long, place long, near binary")
        # many keys have few members: some hundreds of rows at a time spare a call for each key
        near = near.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(max(1, rows.count() // BLOCK))))
        more = cut(near.groupBy("bucket", "i", "j").applyInArrow(_block_groups,"tk long, s long, e long, tk2 long, s2 long, e2 long").distinct(), "block-pairs")
        found = cut(joined_spans(found.unionByName(spans(confirm(more)))), "spans")

    # Equal texts are passages as a whole.
    whole = texts.where("copies > 1").select("tk", F.lit(0).cast("long").alias("a"), (F.col("n_words") - SHINGLE + 1).alias("b"), "first_id")
    found = cut(_joined(found.unionByName(whole), "tk"), "spans")
    return brief.select("doc_id", "tk").join(found, "tk").select(
        "doc_id", F.col("a").alias("start_word"), (F.col("b") - F.col("a") + SHINGLE - 1).alias("n_words"), F.least("first_id", "doc_id").alias("first_id"))
