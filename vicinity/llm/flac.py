"""FLAC for media columns: an encoder and a decoder that work on many frames at once.

Streams are mono 8-bit at 8 kHz with fixed blocks of 4096 samples: STREAMINFO with the MD5 of the samples, a SEEKTABLE
with every frame, then frames.  The encoder picks per frame a constant, verbatim samples, a fixed linear predictor of
order 0 to 2 or one of order 4 fitted to the frame (LPC), with residuals in one partition or eight, each Rice-coded or
escaped, whichever is shortest.  The decoder reads constant, verbatim, fixed (order 0 to 4) and LPC subframes with any
Rice partition order, parameters of 4 or 5 bits and escaped partitions; it verifies the CRC-8 of each header, the CRC-16
of each frame and the MD5 of the stream.

Rice codes can only be read one after another, but frames are independent: step t reads sample t of every frame of a
run, so the interpreter's cost is shared by hundreds of frames, of many streams or of one.  Codes of up to 16 bits come
from tables, longer ones are read one by one.  The encoder has no such steps: it places all codes of a run at once.  Both
directions work in runs of a few megabytes, so a long stream takes no more memory than its bytes and a run.  Samples are a text's bytes
as signed numbers.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 4096
SAMPLE_RATE = 8000
MAGIC = b"fLaC"
FIXED_ORDERS = 3
#: The fixed predictors by order, the latest sample's factor first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
RICE_MOST = 14
#: Bytes that are coded together, and decoded together: more there, as each step costs the same for any number of frames.
RUN = 1 << 20
READ_RUN = 3 << 20
LPC_ORDER = 4
LPC_BITS = 10
#: Bits of precision, shift and coefficients.
LPC_HEAD = 9 + LPC_ORDER * LPC_BITS
PARTS = 8
#: Among the kinds of code that are read from tables, raw numbers of no bits; Rice parameters and one kind that is in no table
#: stand before.  LONG: the number of bits that stands for a code of more than 16.
RAW = 16
LONG = 255
U8, U16, U64 = np.uint8, np.uint16, np.uint64


class FlacError(ValueError):
    """The bytes are not a FLAC stream that this module reads, or a checksum fails."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table, top = [], 1 << (bits - 1)
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & ((1 << bits) - 1)
        table.append(c)
    return np.array(table, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Bytes that a CRC-16 takes in step before such pieces are put together.
CRC_PIECE = 64


def _crc16_after(crc: np.ndarray, zeros: int) -> np.ndarray:
    for _ in range(zeros):
        crc = (crc << np.uint32(8)) & np.uint32(0xFFFF) ^ CRC16[crc >> np.uint32(8)]
    return crc


#: A CRC-16 after two bytes of 0, and after a piece of them.
CRC16_WORD, CRC16_PIECE = (_crc16_after(np.arange(1 << 16, dtype=np.uint32), n).astype(U16) for n in (2, CRC_PIECE))


def _crc8s(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-8 of the short byte ranges of ``data``, all ranges in step."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    crc = np.zeros(len(at), np.uint32)
    live = len(at) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")
    for t, n in enumerate(live):
        crc[:n] = CRC8[crc[:n] ^ data[at[:n] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _crc16s(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-16 of the byte ranges of ``data``: pieces of all ranges in step, then the pieces of each range in turn."""
    pieces = np.maximum(-(-size // CRC_PIECE), 1)
    ends = np.cumsum(pieces)
    # bytes of 0 ahead of a range leave its checksum as it is
    padded = np.zeros(int(ends[-1]) * CRC_PIECE if len(ends) else 0, U8)
    for a, n, e in zip(start.tolist(), size.tolist(), (ends * CRC_PIECE).tolist()):
        padded[e - n : e] = data[a : a + n]
    words = np.ascontiguousarray(padded.view(">u2").reshape(-1, CRC_PIECE // 2).T).astype(U16)
    part = np.zeros(words.shape[1], U16)
    for row in words:
        part = CRC16_WORD[part ^ row]
    order = np.argsort(-pieces, kind="stable")
    at, left = (ends - pieces)[order], pieces[order]
    crc = np.zeros(len(at), U16)
    live = len(at) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")
    for t, n in enumerate(live):
        crc[:n] = CRC16_PIECE[crc[:n]] ^ part[at[:n] + t]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# --- encoding ---------------------------------------------------------------------------------------------------------


def _frame_number(i: int) -> bytes:
    """The extended UTF-8 form of a frame number."""
    if i < 0x80:
        return bytes([i])
    tail = []
    n = 2
    while i >= 1 << (5 * n + 1):
        n += 1
    for _ in range(n - 1):
        tail.append(0x80 | i & 0x3F)
        i >>= 6
    return bytes([(0xFF00 >> n) & 0xFF | i, *reversed(tail)])


def _frame_header(number: int, size: int) -> bytes:
    whole = size == BLOCK
    head = bytes([0xFF, 0xF8, (0xC0 if whole else 0x70) | 0x04, 0x02]) + _frame_number(number)
    return head if whole else head + (size - 1).to_bytes(2, "big")


def _streaminfo(total: int, md5: bytes, frame_sizes: list[int]) -> bytes:
    packed = SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | total
    body = BLOCK.to_bytes(2, "big") * 2 + min(frame_sizes).to_bytes(3, "big") + max(frame_sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    return bytes([0, 0, 0, len(body)]) + body


def _seektable(sizes: list[int], frame_sizes: list[int]) -> bytes:
    at = np.concatenate([[0], np.cumsum(frame_sizes)[:-1]])
    body = b"".join((i * BLOCK).to_bytes(8, "big") + int(o).to_bytes(8, "big") + n.to_bytes(2, "big") for i, (o, n) in enumerate(zip(at, sizes)))
    return bytes([0x83]) + len(body).to_bytes(3, "big") + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (at least one byte each).  Frames are coded in runs of about RUN bytes, so that the
    memory taken besides payloads and streams does not grow with them."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[int]] = [[] for _ in payloads]
    run: list[tuple[int, int, memoryview]] = []
    held = 0

    def flush() -> None:
        size = np.array([len(x) for _, _, x in run])
        samples = np.frombuffer(b"".join(x for _, _, x in run), np.int8)
        for (i, _, _), frame, n in zip(run, _encode_frames(samples, size, [number for _, number, _ in run]), size.tolist()):
            frames[i].append(frame)
            sizes[i].append(n)

    for i, data in enumerate(payloads):
        if not data:
            raise FlacError("a stream has at least one sample")
        view = memoryview(data)
        for at in range(0, len(data), BLOCK):
            run.append((i, at // BLOCK, view[at : at + BLOCK]))
            held += len(run[-1][2])
            if held >= RUN:
                flush()
                run, held = [], 0
    if run:
        flush()
    out = []
    for i, data in enumerate(payloads):
        lengths = [len(f) for f in frames[i]]
        out.append(b"".join([MAGIC, _streaminfo(len(data), hashlib.md5(data).digest(), lengths), _seektable(sizes[i], lengths), *frames[i]]))
        frames[i] = []
    return out


def _sums(v: np.ndarray, start: np.ndarray) -> np.ndarray:
    # a block of 16-bit numbers stays below 2^28
    return np.add.reduceat(v, start, dtype=np.int32 if v.itemsize <= 2 else np.int64).astype(np.int64)


def _leading(start: np.ndarray, size: np.ndarray, n) -> np.ndarray:
    """Where the first ``n`` samples of each frame are, as far as it has them."""
    n = np.minimum(n, size)
    return np.concatenate([(start + i)[n > i] for i in range(int(n.max(initial=0)))] or [start[:0]])


def _fixed(samples: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zigzag residuals, order) of the best fixed predictor of each frame, 0 in the warm-up."""
    residual = samples.astype(np.int16)
    best, best_cost, order = None, None, np.zeros(len(size), int)
    for p in range(FIXED_ORDERS):
        zigzag = residual << 1 ^ residual >> 15
        zigzag[_leading(start, size, p)] = 0
        cost = _sums(zigzag, start)
        if best is None:
            best, best_cost = zigzag, cost
        else:
            better = (cost < best_cost) & (size > p)
            order[better] = p
            best_cost = np.where(better, cost, best_cost)
            np.copyto(best, zigzag, where=np.repeat(better, size))
        residual = np.concatenate([residual[:1], np.diff(residual)])
    return best, order


def _linear(samples: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag residuals, coefficients by order and frame, shifts) of a predictor of LPC_ORDER for each frame: Levinson's
    recursion on the autocorrelation, rounded to LPC_BITS."""
    x = samples.astype(np.int16)
    lags = []
    for lag in range(LPC_ORDER + 1):
        # a product of two samples is 2^14 at most
        product = x * np.concatenate([np.zeros(lag, np.int16), x])[: len(x)]
        product[_leading(start, size, lag)] = 0
        lags.append(_sums(product, start))
    r = np.array(lags, np.float64)
    error = r[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((LPC_ORDER, len(start)))
    for m in range(LPC_ORDER):
        reflection = (r[m + 1] - (a[:m] * r[m:0:-1]).sum(0)) / error
        a[:m] = a[:m] - reflection * a[:m][::-1]
        a[m] = reflection
        error = np.maximum(error * (1 - reflection**2), 1e-9)
    most = (1 << LPC_BITS - 1) - 1
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(np.maximum(np.abs(a).max(0), 1e-3))), 0, 15).astype(np.int64)
    q = np.clip(np.round(a * (1 << shift)), -most, most).astype(np.int32)
    predicted = np.zeros(len(samples), np.int32)
    whole = samples.astype(np.int32)
    for m in range(LPC_ORDER):
        predicted[m + 1 :] += np.repeat(q[m], size)[m + 1 :] * whole[: max(0, len(whole) - m - 1)]
    predicted >>= np.repeat(shift.astype(np.int32), size)
    residual = whole - predicted
    zigzag = residual << 1 ^ residual >> 31
    zigzag[_leading(start, size, LPC_ORDER)] = 0
    # half the width is half the work, and nearly always enough
    return zigzag.astype(np.int16) if zigzag.max() < 1 << 15 else zigzag, q, shift


def _rice(zigzag: np.ndarray, start: np.ndarray, size: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) for runs of ``size`` values that begin at ``start`` and hold ``coded`` residuals."""
    mean = _sums(zigzag, start) / np.maximum(coded, 1)
    guess = np.clip(np.log2(np.maximum(mean, 1)).astype(int), 0, RICE_MOST)
    least = np.maximum(guess - 1, 0)
    high = zigzag >> np.repeat(least.astype(zigzag.dtype), size)
    rice, bits = least, _sums(high, start) + coded * (1 + least)
    for k in (least + 1, least + 2):
        high >>= 1
        now = _sums(high, start) + coded * (1 + k)
        better = (now < bits) & (k <= np.minimum(guess + 1, RICE_MOST))
        rice, bits = np.where(better, k, rice), np.where(better, now, bits)
    return rice, bits


def _encode_frames(samples: np.ndarray, size: np.ndarray, number: list[int]) -> list[bytes]:
    count = len(size)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    best, order = _fixed(samples, size, start)
    rice, bits = _rice(best, start, size, size - order)
    bits = bits + order * 8 + 6 + 4
    # a linear predictor, where it is shorter with its coefficients
    zigzag, coefficients, shift = _linear(samples, size, start)
    rice_l, bits_l = _rice(zigzag, start, size, np.maximum(size - LPC_ORDER, 0))
    bits_l = bits_l + LPC_ORDER * 8 + LPC_HEAD + 6 + 4
    lpc = (size > LPC_ORDER) & (bits_l < bits)
    best = best.astype(zigzag.dtype, copy=False)
    np.copyto(best, zigzag, where=np.repeat(lpc, size))
    order, rice, bits = np.where(lpc, LPC_ORDER, order), np.where(lpc, rice_l, rice), np.where(lpc, bits_l, bits)
    del zigzag
    # whole blocks in PARTS partitions with a parameter each, where that is shorter
    pieces = np.where(size == BLOCK, PARTS, 1)
    first_piece = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    piece_frame = np.repeat(np.arange(count), pieces)
    inner = np.arange(len(piece_frame)) - first_piece[piece_frame]
    piece_start = start[piece_frame] + inner * (BLOCK // PARTS)
    piece_whole = np.where(pieces == 1, size, BLOCK // PARTS)[piece_frame]
    piece_size = piece_whole - np.where(inner == 0, order[piece_frame], 0)
    rice_p, bits_p = _rice(best, piece_start, piece_whole, piece_size)
    # raw numbers where those are shorter than Rice codes: none at all for residuals that are all 0
    top = np.maximum.reduceat(best, piece_start)
    raw_bits = np.ceil(np.log2(top + 1.0)).astype(int)
    raw = raw_bits * piece_size + 5 < bits_p
    bits_p = np.where(raw, raw_bits * piece_size + 5, bits_p) + 4
    split_bits = np.add.reduceat(bits_p, first_piece) + order * 8 + 6 + np.where(lpc, LPC_HEAD, 0)
    split = split_bits < bits
    bits = np.minimum(bits, split_bits)
    on = split[piece_frame]
    raw &= on
    low_bits = np.where(raw, raw_bits, np.where(on, rice_p, rice[piece_frame]))
    # bits of the parameters that stand before the residuals of a piece, all earlier ones of its frame included
    own = np.where(on | (inner == 0), np.where(raw, 9, 4), 0)
    upto = np.cumsum(own)
    ahead = upto - (upto - own)[first_piece][piece_frame]

    first = samples[start]
    constant = ~np.logical_or.reduceat(samples != np.repeat(first, size), start)
    verbatim = ~constant & (bits >= size * 8)
    body_bits = 8 + np.where(constant, 8, np.where(verbatim, size * 8, bits))
    heads = [_frame_header(i, int(n)) for i, n in zip(number, size)]
    head_size = np.array([len(h) + 1 for h in heads])
    total = head_size + (body_bits + 7) // 8 + 2
    at = np.concatenate([[0], np.cumsum(total)[:-1]])
    out = np.zeros(int(total.sum()), U8)
    heads_all = np.frombuffer(b"".join(h + b"\0" for h in heads), U8)
    where = np.repeat(at - np.concatenate([[0], np.cumsum(head_size)[:-1]]), head_size) + np.arange(len(heads_all))
    out[where] = heads_all
    out[at + head_size - 1] = _crc8s(out, at, head_size - 1)
    body = at + head_size
    out[body] = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 31 + LPC_ORDER, 8 + order))) << 1
    unsigned = samples.view(U8)
    out[body[constant] + 1] = first.view(U8)[constant]
    plain = np.concatenate([np.flatnonzero(np.repeat(verbatim, size)), _leading(start, size, np.where(constant | verbatim, 0, order))])
    owner = np.searchsorted(start, plain, side="right") - 1
    out[body[owner] + 1 + plain - start[owner]] = unsigned[plain]
    riced = ~(constant | verbatim)
    if riced.any():
        # bits are put together in big-endian words of 32; what is put has 32 bits at most, so it lies in two of them
        word = np.zeros(len(out) // 4 + 3, np.uint32)

        def placed(pos: np.ndarray, value: np.ndarray, n) -> np.ndarray:
            return (value & (1 << n) - 1).astype(U64) << (64 - n - (pos & 31)).astype(U64)

        def put(pos: np.ndarray, value: np.ndarray, n: int) -> None:
            two = placed(pos, value, n)
            np.bitwise_or.at(word, pos >> 5, (two >> U64(32)).astype(np.uint32))
            np.bitwise_or.at(word, (pos >> 5) + 1, two.astype(np.uint32))

        # after the warm-up: the predictor's head, 2 bits of method, 4 of partition order, then pieces
        section = (body + 1 + order) * 8
        l = np.flatnonzero(riced & lpc)
        put(section[l], np.full(len(l), LPC_BITS - 1), 4)
        put(section[l] + 4, shift[l], 5)
        for m in range(LPC_ORDER):
            put(section[l] + 9 + m * LPC_BITS, coefficients[m][l], LPC_BITS)
        section = section + np.where(lpc, LPC_HEAD, 0)
        parted = riced & split & (pieces > 1)
        put(section[parted] + 2, np.full(int(parted.sum()), PARTS.bit_length() - 1), 4)
        # a residual is a number of zeros, a one, and low bits; raw numbers are low bits alone
        value = best.astype(np.int32)
        low, bare = np.repeat(low_bits.astype(np.int32), piece_whole), np.repeat(raw, piece_whole)
        if raw.any():
            np.copyto(value, value >> 1 ^ -(value & 1), where=bare)
        tail = low + ~bare
        length = tail + np.where(bare, 0, value >> low)
        none = np.concatenate([np.flatnonzero(np.repeat(~riced, size)), _leading(start, size, order)])
        tail[none] = length[none] = 0
        ends = np.cumsum(length, dtype=np.int64)
        # where the residuals of each frame, and of each piece, begin among all of them
        before = np.concatenate([[0], ends])
        lead = before[start]
        head_at = section[piece_frame] + 6 + ahead - own + before[piece_start] - lead[piece_frame]
        head = np.flatnonzero(riced[piece_frame] & (own > 0))
        put(head_at[head], np.where(raw, 15, low_bits)[head], 4)
        put(head_at[raw & riced[piece_frame]] + 4, low_bits[raw & riced[piece_frame]], 5)
        # residuals lie in order, those without bits too, so the ones that begin in a word are neighbours
        origin = np.where(riced[piece_frame], section[piece_frame] + 6 + ahead, at[piece_frame] * 8) - lead[piece_frame]
        pos = ends + np.repeat(origin, piece_whole) - tail
        two = placed(pos, np.where(bare, value, value | 1 << low), tail)
        pos >>= 5
        begins = np.concatenate([[0], np.flatnonzero(pos[1:] != pos[:-1]) + 1])
        two, pos = np.bitwise_or.reduceat(two, begins), pos[begins]
        word[pos] |= (two >> U64(32)).astype(np.uint32)
        word[pos + 1] |= two.astype(np.uint32)
        out |= word.astype(">u4").view(U8)[: len(out)]
    crc = _crc16s(out, at, total - 2)
    out[at + total - 2], out[at + total - 1] = crc >> 8, crc & 0xFF
    data = out.tobytes()
    return [data[a : a + n] for a, n in zip(at.tolist(), total.tolist())]


# --- decoding ---------------------------------------------------------------------------------------------------------


@dataclass
class Stream:
    """A stream read back: its samples as bytes and its blocks as (first sample, samples, byte offset in the stream)."""

    pcm: bytes
    blocks: list[tuple[int, int, int]]
    sample_rate: int


@dataclass
class _Info:
    total: int
    md5: bytes
    rate: int
    seek: list[tuple[int, int]]
    frames_at: int
    block: int
    most: int


def _metadata(data: bytes) -> _Info:
    if data[:4] != MAGIC:
        raise FlacError("no fLaC marker")
    at, last, info, seek = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata ends early")
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise FlacError("only mono streams of 8-bit samples are read")
            info = (packed & (1 << 36) - 1, body[18:34], packed >> 44)
            block, most = int.from_bytes(body[2:4], "big"), int.from_bytes(body[7:10], "big")
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, n, 18)]
            seek = [x for x in points if x[0] != 2**64 - 1]
        at += 4 + n
    if info is None:
        raise FlacError("no STREAMINFO")
    return _Info(*info, seek, at, block, most)


class _Bits:
    """Big-endian bit reads at many positions of one buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, U8)])
        self.word = np.ndarray(len(data) + 8, ">u8", padded, strides=(1,)).astype(U64)

    def from_(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 valid bits from each position, at the top of a word."""
        return self.word[np.minimum(pos >> 3, len(self.word) - 1)] << (pos & 7).astype(U64)

    def read(self, pos: np.ndarray, n) -> np.ndarray:
        """``n`` (1 to 57) bits at each position."""
        return (self.from_(pos) >> (64 - np.asarray(n)).astype(U64)).astype(np.int64)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        v = self.read(pos, n)
        return v - ((v >> (np.asarray(n) - 1) & 1) << np.asarray(n))

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """Zero bits before the next one bit."""
        # the exponent of the top 32 bits, exact in a double, gives the leading zeros
        top = (self.from_(pos) >> U64(32)).astype(np.float64)
        n = 32 - np.frexp(top)[1].astype(np.int64)
        more = np.flatnonzero(top == 0)
        while len(more):
            top = (self.from_(pos[more] + n[more]) >> U64(32)).astype(np.float64)
            n[more] += 32 - np.frexp(top)[1]
            more = more[(top == 0) & (pos[more] + n[more] < len(self.word) * 8)]
        return n


def _decode_frames(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frames that start at the offsets ``at``: (samples by frame and time, block sizes, frame numbers, end offsets)."""
    bits = _Bits(data)
    byte = lambda x: data[np.minimum(x, len(data) - 1)].astype(np.int64)
    if ((byte(at) != 0xFF) | (byte(at + 1) & 0xFE != 0xF8)).any() or (at >= len(data) - 8).any():
        raise FlacError("no frame where one is expected")
    code, form = byte(at + 2), byte(at + 3)
    if (form >> 4).any() or (~np.isin(form >> 1 & 7, (0, 1))).any():
        raise FlacError("only mono frames of 8-bit samples are read")
    lead = byte(at + 4)
    extra = np.zeros(len(at), np.int64)
    for n in range(2, 8):
        extra[lead >> (7 - n) == (1 << (n + 1)) - 2 if n < 7 else lead == 0xFE] = n - 1
    number = np.where(extra > 0, lead & ((1 << np.maximum(6 - extra, 0)) - 1), lead)
    for i in range(int(extra.max(initial=0))):
        number = np.where(extra > i, number << 6 | byte(at + 5 + i) & 0x3F, number)
    cursor = at + 5 + extra
    kind = code >> 4
    size = np.select(
        [kind == 1, (kind >= 2) & (kind <= 5), kind == 6, kind == 7, kind >= 8],
        [np.full(len(at), 192), 576 << np.maximum(kind - 2, 0), byte(cursor) + 1, (byte(cursor) << 8 | byte(cursor + 1)) + 1, 256 << np.maximum(kind - 8, 0)], 0)
    if (size == 0).any():
        raise FlacError("a reserved block size")
    cursor = cursor + np.select([kind == 6, kind == 7], [1, 2], 0)
    rate = code & 15
    cursor = cursor + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (_crc8s(data, at, cursor - at) != byte(cursor)).any():
        raise FlacError("a frame header fails its CRC-8")
    cursor = cursor + 1
    head = byte(cursor)
    if (head & 0x81).any():
        raise FlacError("a subframe with wasted bits or padding")
    kind = head >> 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if (~(fixed | lpc | (kind < 2))).any():
        raise FlacError("a reserved subframe")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    out = np.zeros((len(at), int(size.max())), np.int8)
    first = cursor + 1
    end = np.zeros(len(at), np.int64)
    for f in np.flatnonzero(kind == 1):
        out[f, : size[f]] = data[first[f] : first[f] + size[f]].view(np.int8)
        end[f] = first[f] + size[f]
    for f in np.flatnonzero(kind == 0):
        out[f, : size[f]] = data[first[f]].view(np.int8)
        end[f] = first[f] + 1
    if (rows := np.flatnonzero(fixed | lpc)).size:
        # longest blocks first: the frames that still have a sample t are then always a prefix
        rows = rows[np.argsort(-size[rows], kind="stable")]
        values, stop = _decode_predicted(bits, first[rows] * 8, size[rows], order[rows], lpc[rows])
        out[rows, : len(values)] = values.astype(np.int8).T
        end[rows] = (stop + 7) // 8
    if (end + 2 > len(data)).any() or (_crc16s(data, at, end - at) != (byte(end) << 8 | byte(end + 1))).any():
        raise FlacError("a frame fails its CRC-16")
    return out, size, number, end + 2


@functools.cache
def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(bits, value) of the residual that 16 bits begin with, by kind of code, those 16 bits: Rice codes by parameter, codes
    that none of the bits tells, raw numbers by width.  LONG bits: the code goes on."""
    x = np.arange(1 << 16)
    lead = 16 - np.frexp(x.astype(np.float64))[1]
    bits, value = np.full((RAW + 17, 1 << 16), LONG, U8), np.zeros((RAW + 17, 1 << 16), np.int32)
    for k in range(RAW - 1):
        n = lead + 1 + k
        v = lead << k | x >> np.maximum(16 - n, 0) & (1 << k) - 1
        bits[k] = np.where(n <= 16, n, LONG)
        value[k] = np.where(n <= 16, v >> 1 ^ -(v & 1), 0)
    for n in range(17):
        v = x >> 16 - n
        bits[RAW + n], value[RAW + n] = n, v - (v >> max(n - 1, 0) << n)
    return bits.reshape(-1), value.reshape(-1)


def _decode_predicted(bits: _Bits, pos: np.ndarray, size: np.ndarray, order: np.ndarray, lpc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames with linear prediction, by descending block size: their samples and the bit positions of their ends."""
    steps, count, deep = int(size[0]), len(size), int(order.max())
    x = np.zeros((deep + steps, count), np.int32)
    out = x[deep:]
    warm = []
    for t in range(deep):
        w = np.flatnonzero(order > t)
        warm.append((w, bits.signed(pos[w], 8)))
        pos[w] += 8
    coefficient, shift = np.zeros((32, count), np.int64), np.zeros(count, np.int64)
    if lpc.any():
        w = np.flatnonzero(lpc)
        precision = bits.read(pos[w], 4) + 1
        shift[w] = bits.signed(pos[w] + 4, 5)
        pos[w] += 9
        for i in range(int(order[w].max())):
            has = order[w] > i
            coefficient[i, w[has]] = bits.signed(pos[w[has]], precision[has])
            pos[w[has]] += precision[has]
    wide = np.where(bits.read(pos, 2) == 1, 5, 4)
    parts = size >> bits.read(pos + 2, 4)
    pos += 6
    rice, raw = np.zeros(count, np.int64), np.zeros(count, bool)
    next_part = order.copy()
    passed = np.zeros(count, np.int64)
    turns = np.zeros(steps + 1, bool)  # times at which some frame starts a partition, or has ended
    turns[order[order < steps]] = True
    turns[size] = True
    for p in np.unique(parts[parts > 0]):
        turns[p :: p] = True
    turns = [*np.flatnonzero(turns).tolist(), steps]
    lengths, values = _code_tables()
    # frames in their warm-up read raw numbers of no bits
    code = np.full(count, RAW << 16)
    place, seen, length = np.empty(count, np.int64), np.empty(count, U64), np.empty(count, U8)
    offset, seven, top = np.empty(count, U64), U64(7), U64(48)
    for begin, end in zip(turns, turns[1:]):
        n = int(np.searchsorted(-size, -begin, side="left"))
        w = np.flatnonzero(next_part[:n] == begin)
        if len(w):
            rice[w] = bits.read(pos[w], wide[w])
            pos[w] += wide[w]
            raw[w] = rice[w] == (1 << wide[w]) - 1
            if raw[w].any():
                e = w[raw[w]]
                rice[e] = bits.read(pos[e], 5)
                pos[e] += 5
            passed[w] += 1
            next_part[w] = passed[w] * parts[w]
            code[w] = np.where(raw[w], np.where(rice[w] <= 16, RAW + rice[w], RAW - 1), np.minimum(rice[w], RAW - 1)) << 16
        p, c, i, s, l, o = pos[:n], code[:n], place[:n], seen[:n], length[:n], offset[:n]
        unsigned, key = p.view(U64), s.view(np.int64)
        for t in range(begin, end):
            np.right_shift(p, 3, out=i)
            bits.word.take(i, out=s, mode="clip")
            np.bitwise_and(unsigned, seven, out=o)
            np.left_shift(s, o, out=s)
            np.right_shift(s, top, out=s)
            np.add(key, c, out=key)
            lengths.take(key, out=l, mode="clip")
            values.take(key, out=out[t, :n], mode="clip")
            if LONG in l.tobytes():
                for f in (w := np.flatnonzero(l == LONG)).tolist():
                    r, p[f] = _read_long(bits, int(p[f]), int(rice[f]), bool(raw[f]))
                    out[t, f] = (r + (1 << 31) & (1 << 32) - 1) - (1 << 31)
                l[w] = 0
            np.add(p, l, out=p)
    for t, (w, samples) in enumerate(warm):
        out[t, w] = samples
    if deep:
        for p, fixed in enumerate(FIXED):
            coefficient[: len(fixed), ~lpc & (order == p)] = np.array(fixed, np.int64)[:, None]
        _predict(x, size, order, coefficient[:deep][::-1], shift)
    return out, pos


def _read_long(bits: _Bits, at: int, rice: int, raw: bool) -> tuple[int, int]:
    """A residual of any length and the bit position behind it."""
    word = lambda: int(bits.word[min(at >> 3, len(bits.word) - 1)]) << (at & 7) & (1 << 64) - 1
    if raw:
        value = word() >> 64 - rice
        return value - (value >> rice - 1 << rice), at + rice
    zeros = 0
    while not (first := word() >> 32) and at < len(bits.word) * 8:
        zeros, at = zeros + 32, at + 32
    lead = 32 - first.bit_length()
    zeros, at = zeros + lead, at + lead + 1
    value = zeros << rice | word() >> 64 - rice
    return value >> 1 ^ -(value & 1), at + rice


def _predict(x: np.ndarray, size: np.ndarray, order: np.ndarray, coefficient: np.ndarray, shift: np.ndarray) -> None:
    """Turns residuals behind warm-up samples into samples, by time and frame, frames by descending block size.  Above them
    stand as many rows of zeros as there are coefficients; those of the oldest sample come first."""
    deep, lowest = len(coefficient), int(order.min())
    wide_sums = int(np.abs(coefficient).sum(0).max()) >= 1 << 24
    c, down = coefficient.astype(np.int64 if wide_sums else np.int32), np.maximum(shift, 0).astype(np.int32)
    ends = [t for t in np.unique(size).tolist() if t > lowest]
    for begin, end in zip([lowest, *ends], ends):
        n = int(np.searchsorted(-size, -begin, side="left"))
        factor, by, starts = np.ascontiguousarray(c[:, :n]), down[:n], order[:n]
        product, predicted = np.empty_like(factor), np.empty(n, c.dtype)
        for t in range(begin, end):
            np.multiply(factor, x[t : t + deep, :n], out=product)
            np.add.reduce(product, 0, out=predicted)
            np.right_shift(predicted, by, out=predicted)
            if t < deep:
                predicted[t < starts] = 0
            row = x[t + deep, :n]
            np.add(row, predicted, out=row, casting="unsafe")


@dataclass
class Block:
    """A block of a stream: which stream, its place there in blocks, samples and bytes, and its samples."""

    stream: int
    number: int
    sample_offset: int
    n_samples: int
    byte_offset: int
    pcm: bytes
    sample_rate: int
    last: bool


def blocks(streams: list[bytes]) -> Iterator[Block]:
    """The blocks of the streams, in order.  Frames that seek tables name are decoded in runs of about READ_RUN samples, over
    streams; others frame after frame.  A stream's MD5 is verified before its last block is given out."""
    infos = [_metadata(s) for s in streams]
    known = [sorted({x.frames_at + o for _, o in x.seek}) or [x.frames_at] for x in infos]
    # each stream's frames up to the next known one, at most as long as the stream says
    spans: list[tuple[int, int, int]] = []
    for i, (s, x) in enumerate(zip(streams, infos)):
        ends = [*known[i][1:], len(s)]
        spans += [(i, a, min(e, a + x.most) if x.most else e) for a, e in zip(known[i], ends) if x.total]
    md5 = [hashlib.md5() for _ in streams]
    have, cursor = [0] * len(streams), [x.frames_at for x in infos]
    number = [0] * len(streams)

    def give(i: int, a: int, pcm: bytes, end: int) -> Block:
        md5[i].update(pcm)
        at, have[i], cursor[i] = have[i], have[i] + len(pcm), end
        last = have[i] >= infos[i].total
        if have[i] > infos[i].total or (last and any(infos[i].md5) and md5[i].digest() != infos[i].md5):
            raise FlacError("the samples do not match STREAMINFO")
        number[i] += 1
        return Block(i, number[i] - 1, at, len(pcm), a, pcm, infos[i].rate, last)

    def gap(i: int, until: int) -> Iterator[Block]:
        """Frames that no seek table names."""
        while cursor[i] < until and have[i] < infos[i].total:
            a = cursor[i]
            pcm, n = _run(streams, [(i, a, min(len(streams[i]), a + infos[i].most) if infos[i].most else len(streams[i]))])[0]
            yield give(i, a, pcm, a + n)

    at = 0
    while at < len(spans):
        end, held = at, 0
        while end < len(spans) and held < READ_RUN:
            held += max(infos[spans[end][0]].block, spans[end][2] - spans[end][1])
            end += 1
        for (i, a, _), (pcm, n) in zip(spans[at:end], _run(streams, spans[at:end])):
            yield from gap(i, a)
            if cursor[i] != a:
                raise FlacError("a seek point is no frame")
            yield give(i, a, pcm, a + n)
            if a == known[i][-1]:
                yield from gap(i, len(streams[i]))
                if have[i] != infos[i].total:
                    raise FlacError("the samples do not match STREAMINFO")
        at = end


def _run(streams: list[bytes], spans: list[tuple[int, int, int]]) -> list[tuple[bytes, int]]:
    """(samples, bytes taken) of the frames that begin the given spans of streams."""
    parts = [memoryview(streams[i])[a:e] for i, a, e in spans]
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]).astype(np.int64)
    out, size, _, end = _decode_frames(np.frombuffer(b"".join(parts), U8), at)
    return [(out[f, :n].tobytes(), int(e - a)) for f, (n, e, a) in enumerate(zip(size.tolist(), end.tolist(), at.tolist()))]


def decode(streams: list[bytes]) -> list[Stream]:
    """Read streams back as a whole."""
    pcm: list[list[bytes]] = [[] for _ in streams]
    found: list[list[tuple[int, int, int]]] = [[] for _ in streams]
    for b in blocks(streams):
        pcm[b.stream].append(b.pcm)
        found[b.stream].append((b.sample_offset, b.n_samples, b.byte_offset))
    return [Stream(b"".join(p), f, _metadata(s).rate) for p, f, s in zip(pcm, found, streams)]
