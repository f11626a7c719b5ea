"""FLAC: exact round trips, foreign streams, checksums."""

import hashlib
import sys
import zlib

import numpy as np
import pytest

from vicinity.llm import flac, media

R = np.random.default_rng(7)
PAYLOADS = [b"\0" * 64, b"abc" * 1000, R.integers(0, 256, 9000, dtype=np.uint8).tobytes(), b"\0" * 63 + b"\xff", b"\0" * 5000 + b"\x7f\x80" * 40,
            bytes(range(256)) * 70, np.cumsum(R.integers(-3, 4, 8192)).astype(np.int8).tobytes(), b"x", b"xy", b"\x80\x7f\x80", R.integers(0, 2, 4096 * 130, dtype=np.uint8).tobytes()]


def test_round_trip_together_and_alone():
    streams = flac.encode(PAYLOADS)
    assert [s.pcm for s in flac.decode(streams)] == PAYLOADS
    assert all(flac.encode([p])[0] == s and flac.decode([s])[0].pcm == p for p, s in zip(PAYLOADS, streams))
    blocks = flac.decode(streams)[2].blocks
    assert [b[:2] for b in blocks] == [(0, 4096), (4096, 4096), (8192, 808)]


def test_predictable_signals_shrink():
    n = [len(s) for s in flac.encode(PAYLOADS)]
    assert n[6] < len(PAYLOADS[6]) * 0.6 and n[4] < 1000


def test_without_a_seek_table_frames_are_read_in_turn():
    s = flac.encode([PAYLOADS[2]])[0]
    at = 4 + 4 + 34
    size = int.from_bytes(s[at + 1: at + 4], "big")
    bare = s[:4] + b"\x80" + s[5:at] + s[at + 4 + size:]
    assert flac.decode([bare])[0].pcm == PAYLOADS[2]


def subframes(stream):
    """(subframe type, partition order or None) of each frame."""
    out = []
    for b in flac.decode([stream])[0].blocks:
        head = len(flac._frame_header(b[0] // flac.BLOCK, b[1])) + 1
        data = stream[b[2]:]
        kind = data[head] >> 1
        order = kind - 31 if kind >= 32 else kind - 8
        bits = flac._Bits(np.frombuffer(data, np.uint8))
        at = np.array([(head + 1 + order) * 8 + (flac.LPC_HEAD if kind >= 32 else 0) + 2])
        out.append((kind, int(bits.read(at, 4)[0]) if kind >= 8 else None))
    return out


def test_the_encoder_writes_every_form_it_names():
    t = np.arange(flac.BLOCK * 2)
    tone = np.round(90 * np.sin(t / 5) + R.integers(-1, 2, len(t))).astype(np.int8).tobytes()
    steps = np.concatenate([R.integers(-(2 ** (i % 6)), 2 ** (i % 6) + 1, 512) for i in range(8)]).astype(np.int8).tobytes()
    silence = np.concatenate([R.integers(-9, 9, 2048), np.zeros(2048, int)]).astype(np.int8).tobytes()
    noise = R.integers(0, 256, 4096, dtype=np.uint8).tobytes()
    made = [subframes(s) for s in flac.encode([tone, steps, silence, noise, b"\0" * 4096])]
    assert {k for k, _ in made[0]} == {31 + flac.LPC_ORDER}
    assert all(8 <= k <= 35 and p == 3 for k, p in made[1] + made[2]) and made[3] == [(1, None)] and made[4] == [(0, None)]
    assert len(flac.encode([silence])[0]) < 2048 * 5 / 8 + 200  # the silent half is escaped to no bits
    assert [s.pcm for s in flac.decode(flac.encode([tone, steps, silence, noise]))] == [tone, steps, silence, noise]


def test_a_sparse_seek_table_leaves_gaps_that_are_read_in_turn():
    s = flac.encode([PAYLOADS[10]])[0]
    at = 4 + 4 + 34
    size = int.from_bytes(s[at + 1: at + 4], "big")
    points = [s[at + 4 + i: at + 22 + i] for i in range(0, size, 18)]
    body = b"".join(points[3::50])
    sparse = s[:at] + s[at:at + 1] + len(body).to_bytes(3, "big") + body + s[at + 4 + size:]
    assert flac.decode([sparse, s])[0].pcm == PAYLOADS[10]


def test_long_streams_take_little_more_than_their_bytes():
    import tracemalloc

    data = R.integers(97, 123, 12 << 20, dtype=np.uint8).tobytes()
    tracemalloc.start()
    try:
        stream = flac.encode([data])[0]
        encoded = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        h = hashlib.sha256()
        for b in flac.blocks([stream]):
            h.update(b.pcm)
        decoded = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert h.hexdigest() == hashlib.sha256(data).hexdigest()
    # payload, frames, stream, and a run; runs are of 1 and 3 MB
    assert encoded < 3 * len(data) + (120 << 20) and decoded < 2 * len(data) + (160 << 20)


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        self.s += format(value & (1 << n) - 1, f"0{n}b") if n else ""

    def rice(self, r, k):
        u = r * 2 if r >= 0 else -r * 2 - 1
        self.s += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        s = self.s + "0" * (-len(self.s) % 8)
        return bytes(int(s[i: i + 8], 2) for i in range(0, len(s), 8))


def crc(data, poly, n):
    c = 0
    for b in data:
        c ^= b << (n - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (n - 1) & 1 else c << 1) & ((1 << n) - 1)
    return c


def foreign(samples, subframe):
    """A stream of one frame from a plain writer, with the given subframe bits."""
    n = len(samples)
    head = bytes([0xFF, 0xF8, 0x74, 0x02, 0]) + (n - 1).to_bytes(2, "big")
    frame = head + bytes([crc(head, 7, 8)]) + subframe.bytes()
    frame += crc(frame, 0x8005, 16).to_bytes(2, "big")
    pcm = np.array(samples, np.int8).tobytes()
    info = (n).to_bytes(2, "big") * 2 + len(frame).to_bytes(3, "big") * 2 + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC\x80\0\0\x22" + info + frame, pcm


def signal(n=192):
    t = np.arange(n)
    return np.clip(np.round(60 * np.sin(t / 9) + R.integers(-4, 5, n)), -128, 127).astype(int).tolist()


@pytest.mark.parametrize("partitions,method,escape", [(0, 0, False), (3, 0, False), (2, 1, False), (2, 0, True), (2, 1, True)])
def test_lpc_partitions_and_escapes(partitions, method, escape):
    x, coefficients, shift, precision = signal(), [60, -29], 5, 8
    order = len(coefficients)
    b = Bits()
    b.put((32 + order - 1) << 1, 8)
    for v in x[:order]:
        b.put(v, 8)
    b.put(precision - 1, 4)
    b.put(shift, 5)
    for c in coefficients:
        b.put(c, precision)
    b.put(method, 2)
    b.put(partitions, 4)
    size = len(x) >> partitions
    for p in range(1 << partitions):
        r = [x[t] - (sum(c * x[t - 1 - i] for i, c in enumerate(coefficients)) >> shift) for t in range(max(order, p * size), (p + 1) * size)]
        width = 5 if method else 4
        if escape and p % 2:
            b.put((1 << width) - 1, width)
            b.put(10, 5)
            for v in r:
                b.put(v, 10)
        else:
            b.put(3 + p % 2, width)
            for v in r:
                b.rice(v, 3 + p % 2)
    stream, pcm = foreign(x, b)
    assert flac.decode([stream])[0].pcm == pcm
    assert [s.pcm for s in flac.decode([stream, flac.encode([b"text" * 16])[0], stream])] == [pcm, b"text" * 16, pcm]


@pytest.mark.parametrize("order", range(5))
def test_fixed_orders(order):
    x = signal(193)
    r = x
    for _ in range(order):
        r = np.diff(r).tolist()
    b = Bits()
    b.put((8 + order) << 1, 8)
    for v in x[:order]:
        b.put(v, 8)
    b.put(0, 6)
    b.put(2, 4)
    for v in r:
        b.rice(int(v), 2)
    stream, pcm = foreign(x, b)
    assert flac.decode([stream])[0].pcm == pcm


@pytest.mark.parametrize("parameter,raw", [(0, None), (1, None), (13, None), (17, None), (30, None), (None, 0), (None, 16), (None, 17), (None, 31)])
def test_codes_of_any_length(parameter, raw):
    x = [0] * 64 if raw == 0 else [-128, 127, -128, 0, 0, 1, -1, 100] * 8
    b = Bits()
    b.put(8 << 1, 8)
    b.put(1, 2)
    b.put(0, 4)
    b.put(31 if parameter is None else parameter, 5)
    if parameter is None:
        b.put(raw, 5)
    for v in x:
        b.put(v, raw) if parameter is None else b.rice(v, parameter)
    stream, pcm = foreign(x, b)
    assert [s.pcm for s in flac.decode([stream, flac.encode([b"text" * 16])[0], stream])] == [pcm, b"text" * 16, pcm]


def lines(f):
    """The lines of the module that a call runs: the interpreter's work, whatever the machine."""
    count = 0

    def trace(frame, event, _):
        nonlocal count
        if frame.f_code.co_filename != flac.__file__:
            return None
        count += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        f()
    finally:
        sys.settrace(before)
    return count


def test_a_sample_costs_the_interpreter_little():
    # encoding has no step for each byte, decoding one of few lines, those of the prediction included
    data = R.integers(97, 123, flac.BLOCK, dtype=np.uint8).tobytes()
    stream = flac.encode([data])[0]
    flac.decode([stream])
    assert lines(lambda: flac.encode([data])) < flac.BLOCK / 4
    assert lines(lambda: flac.decode([stream])) < flac.BLOCK * 20


GOLDEN = ["854be29056f57d32", "c46404c91a43952b", "9d2956822bfebec3", "10ae617a04c47e0e", "1b60e5181ba3d534", "e2ef2ded2bfd7349"]


def test_streams_keep_their_bytes():
    """What the encoder chose before it was made cheaper (commit a274333)."""
    t = np.arange(3 * flac.BLOCK + 192)
    saw, steps = (t * 7 % 97 - 48).astype(np.int8), (t * t // 512 % (t // 700 % 9 + 1) * 3).astype(np.int8)
    text = b"".join(b"line %d of a text, %d words\n" % (i, i * i % 1000) for i in range(900))
    payloads = [saw.tobytes(), steps.tobytes(), text, text[:64], b"\0" * 5000, bytes(range(256)) * 20]
    streams = flac.encode(payloads)
    assert [s.pcm for s in flac.decode(streams)] == payloads
    assert [hashlib.sha256(s).hexdigest()[:16] for s in streams] == GOLDEN


def test_damage_is_noticed():
    s = flac.encode([PAYLOADS[1]])[0]
    for at in (0, 30, len(s) - 1, len(s) - 40, len(s) // 2, 4 + 38 + 4 + 18 + 3):
        bad = bytearray(s)
        bad[at] ^= 0x10
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])
    with pytest.raises(flac.FlacError):
        flac.decode([s[:-20]])
    with pytest.raises(flac.FlacError):
        flac.encode([b""])
    assert flac.decode([]) == [] and flac.encode([]) == []


TEXTS = [None, "", "a", "x" * 63, "x" * 64, "é😀 text".encode("utf-16", "surrogatepass").decode("utf-16"), "same", "same", "long " * 30000]


def test_report(spark, docs_of):
    got = {r["doc_id"]: r for r in media.media_report(docs_of(list(enumerate(TEXTS)), extra=True)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[6]["feature"] == got[7]["feature"] and got[6]["media_sha256"] == got[7]["media_sha256"]
    assert media.media_report(docs_of([])).count() == 0


def test_blocks_are_seekable(spark, docs_of):
    stored = media.store(docs_of([(1, "long " * 3000), (2, None)]))
    rows = media.pcm_blocks(stored).orderBy("doc_id", "block").collect()
    stream = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    assert b"".join(bytes(r["pcm"]) for r in rows if r["doc_id"] == 1).rstrip(b"\0").decode() == "long " * 3000
    for r in rows:
        if r["doc_id"] == 1:
            assert r["sample_offset"] == r["block"] * 4096 and stream[1][r["byte_offset"]:][:2] == b"\xff\xf8"
