"""Media columns: payloads stored as FLAC and read back as PCM blocks with seekable sample offsets.

Both directions hold the streams of a small batch and one run of frames, so a worker's memory grows with its longest
text alone, by a few bytes for each of its bytes.

Defined results: a null text is an empty payload; every payload is padded with zero bytes to a positive multiple of 64;
equal texts give equal streams and features; a stream that fails a checksum fails its task with ``flac.FlacError``; a
text of any length is one stream of blocks of 4096 samples; an empty table has no streams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .textkit import map_arrow

PAD = 64
#: Bytes of payloads, streams or samples that are held together in a worker, or one text if that is longer.
CHUNK = 3 << 20


def payload(text: str | None) -> tuple[int, bytes]:
    """A text's number of bytes, and the bytes with their padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (-len(data) % PAD if data else PAD)


def _slices(column: pa.Array) -> Iterator[slice]:
    """Runs of rows of a string or binary column of about CHUNK bytes each."""
    start, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
        size += n or 0
        if size >= CHUNK:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(column):
        yield slice(start, len(column))


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of batches, put together or cut to about CHUNK bytes of a column, with the values of that column."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> tuple[pa.RecordBatch, list]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return t, t.column(column).to_pylist()

    for batch in batches:
        for part in _slices(batch.column(column)):
            piece = batch.slice(part.start, part.stop - part.start)
            n = pa.compute.sum(pa.compute.binary_length(piece.column(column))).as_py() or 0
            if held and size + n > CHUNK:
                yield whole()
                held, size = [], 0
            held.append(piece)
            size += n
    if held:
        yield whole()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _gathered(batches, 1):
        sizes, payloads = zip(*map(payload, texts))
        del texts
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(flac.encode(list(payloads)), pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded payload as a FLAC stream."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(docs, _store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["block", "sample_offset", "n_samples", "byte_offset", "pcm"]
    for batch, media in _gathered(batches, 2):
        held: list[flac.Block] = []
        size = 0

        def rows() -> pa.RecordBatch:
            rest = batch.select([0, 1]).take(pa.array([b.stream for b in held], pa.int64()))
            columns = [pa.array(x, pa.int64()) for x in zip(*((b.number, b.sample_offset, b.n_samples, b.byte_offset) for b in held))]
            return pa.RecordBatch.from_arrays([*rest.columns, *columns, pa.array([b.pcm for b in held], pa.binary())], [*rest.schema.names, *names])

        for b in flac.blocks(media):
            held.append(b)
            size += b.n_samples
            if size >= CHUNK:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Each stream of ``media`` (doc_id, n_bytes, media) as its PCM blocks: where a block starts in samples, and in bytes
    of the stream."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return map_arrow(media, _read_blocks, f"doc_id {kind}, n_bytes long, block long, sample_offset long, n_samples long, byte_offset long, pcm binary")


@dataclass
class Digest:
    """What is computed of a stream from its PCM blocks as they come: digest, tail, level, spread, peak, crossings."""

    sha: object = field(default_factory=hashlib.sha256)
    tail: bytes = b""
    samples: int = 0
    total: int = 0
    power: int = 0
    peak: int = 0
    crossings: int = 0
    blocks: int = 0
    below: bool = False

    def add(self, b: flac.Block) -> None:
        if b.sample_offset != self.samples:
            raise flac.FlacError("a block is not where the one before it ends")
        x = np.frombuffer(b.pcm, np.int8).astype(np.int32)
        below = x < 0
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + int(self.blocks > 0 and below[0] != self.below)
        self.below = below[-1]
        self.total += int(x.sum())
        self.power += int((x * x).sum(dtype=np.int64))
        self.peak = max(self.peak, int(np.abs(x).max()))
        self.samples += b.n_samples
        self.blocks += 1
        self.sha.update(b.pcm)
        self.tail = b.pcm[-PAD:] if b.n_samples >= PAD else (self.tail + b.pcm)[-PAD:]

    def feature(self, rate: int) -> str:
        mean, power = self.total / self.samples, self.power / self.samples
        return f"rate={rate};blocks={self.blocks};samples={self.samples};peak={self.peak};mean={mean:.4f};rms={power**0.5:.4f};crossings={self.crossings}"


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch, media in _gathered(batches, 2):
        rows, digest = [], Digest()
        for b in flac.blocks(media):
            digest.add(b)
            if b.last:
                m = media[b.stream]
                rows.append((digest.samples, digest.sha.hexdigest(), zlib.crc32(digest.tail), len(m), hashlib.sha256(m).hexdigest(), digest.feature(b.sample_rate)))
                digest = Digest()
        yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).columns, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", "n_bytes", *names])


def media_report(docs: DataFrame) -> DataFrame:
    """Per document the digests of the PCM blocks that are read back from its stored stream."""
    media = store(docs)
    kind = media.schema["doc_id"].dataType.simpleString()
    return map_arrow(media, _read_digests, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
