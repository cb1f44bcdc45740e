"""Media columns: ISO media containers.

``encode`` stores bytes losslessly as 8-bit PCM samples in an ISO base media file (ftyp, mdat, moov). ``probe``
walks the nested boxes of stored bytes, decodes the sample tables (stsd, stts, stsz, stsc, stco or co64, stss) and
returns codec, duration and the byte range of every sample and keyframe; it never touches the payload. ``payload``
then reads samples by those ranges.

Null text is the empty text. The empty text is padded like any other, to 64 zero bytes. Equal texts give equal
containers. Damaged containers raise ``ValueError``. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts_of

UNIT = 64
RATE = 8000
#: Samples (units) in a chunk, and from one sync sample to the next.
CHUNK, SYNC = 16, 32
CODEC = b"raw "  # unsigned 8-bit PCM
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"))
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``UNIT``."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode(payload: bytes) -> bytes:
    """An ISO media file whose samples are the payload's units of 64 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    n = len(payload) // UNIT
    ticks = len(payload)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp42")
    large = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(ftyp) + len(head)
    chunks = first + np.arange(0, n, CHUNK, dtype=np.int64) * UNIT
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, CHUNK)] if n % CHUNK == 0 or n > CHUNK else []
    if n % CHUNK:
        runs.append((len(chunks), n % CHUNK))
    sync = np.arange(1, n + 1, SYNC, dtype=np.int64)
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, UNIT)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", chunk, size, 1) for chunk, size in runs)),
        full(b"stsz", struct.pack(">II", UNIT, n)),
        full(b"co64", struct.pack(">I", len(chunks)), chunks.astype(">u8").tobytes()) if large else full(b"stco", struct.pack(">I", len(chunks)), chunks.astype(">u4").tobytes()),
        full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
    mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks, 0x55C4, 0))
    hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0")
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), flags=3)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, ticks, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, head, payload, box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))))


def boxes(data: memoryview, begin: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box as (path, begin and end of its content); goes into containers, never into payloads."""
    end = len(data) if end is None else end
    while begin < end:
        if end - begin < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if end - begin < 16:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} runs past its parent")
        here = (*path, kind)
        yield here, begin + head, begin + size
        if kind in CONTAINERS:
            yield from boxes(data, begin + head, begin + size, here)
        begin += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray  # of each sample in the file
    sizes: np.ndarray
    keyframes: np.ndarray  # sample numbers from 0

    def keyframe_ranges(self) -> np.ndarray:
        """First byte and end of each keyframe."""
        return np.column_stack((self.offsets[self.keyframes], self.offsets[self.keyframes] + self.sizes[self.keyframes]))


def _numbers(data: memoryview, begin: int, end: int, count: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize * count
    if begin + size > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data[begin : begin + size], kind).astype(np.int64)


def probe(stored: bytes) -> list[Track]:
    """The tracks of a container, from its boxes and sample tables alone."""
    data = memoryview(stored)
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, begin, end in boxes(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and path[:2] == (b"moov", b"trak"):
            tracks[-1][path[-1]] = begin, end
    out = []
    for t in tracks:
        if missing := [k.decode() for k in (b"mdhd", b"stsd", b"stts", b"stsz", b"stsc") if k not in t]:
            raise ValueError(f"a track lacks {', '.join(missing)}")
        long = data[t[b"mdhd"][0]] == 1
        scale, duration = struct.unpack_from(">IQ" if long else ">II", data, t[b"mdhd"][0] + (20 if long else 12))
        codec = bytes(data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16]).decode("latin-1")
        begin, end = t[b"stsz"]
        same, n = struct.unpack_from(">II", data, begin + 4)
        sizes = np.full(n, same, np.int64) if same else _numbers(data, begin + 12, end, n, ">u4")
        begin, end = t.get(b"stco") or t.get(b"co64") or (0, 0)
        if not end:
            raise ValueError("a track lacks chunk offsets")
        n_chunks = struct.unpack_from(">I", data, begin + 4)[0]
        chunks = _numbers(data, begin + 8, end, n_chunks, ">u4" if b"stco" in t else ">u8")
        begin, end = t[b"stsc"]
        n_runs = struct.unpack_from(">I", data, begin + 4)[0]
        runs = _numbers(data, begin + 8, end, 3 * n_runs, ">u4").reshape(-1, 3)
        span = np.diff(np.append(runs[:, 0], n_chunks + 1))
        per_chunk = np.repeat(runs[:, 1], span)
        if per_chunk.sum() != n or len(per_chunk) != n_chunks:
            raise ValueError("sample tables disagree on the number of samples")
        chunk = np.repeat(np.arange(n_chunks), per_chunk)
        before = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else np.zeros(0, np.int64)
        first = np.concatenate(([0], np.cumsum(per_chunk)[:-1])) if n_chunks else np.zeros(0, np.int64)
        offsets = chunks[chunk] + before - before[first[chunk]] if n else before
        if n and (offsets + sizes).max() > len(data):
            raise ValueError("a sample lies outside the file")
        if b"stss" in t:
            begin, end = t[b"stss"]
            keys = _numbers(data, begin + 8, end, struct.unpack_from(">I", data, begin + 4)[0], ">u4") - 1
        else:  # without the table every sample is a sync sample
            keys = np.arange(n)
        out.append(Track(codec, scale, duration, offsets, sizes, keys))
    return out


def payload(stored: bytes, track: Track) -> bytes:
    """The track's samples, read by their byte ranges; neighbours are read at once."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts, stops = track.offsets[np.concatenate(([0], cut))], ends[np.concatenate((cut - 1, [len(ends) - 1]))]
    return b"".join(stored[a:b] for a, b in zip(starts.tolist(), stops.tolist()))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container as a binary column ``media``."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


INDEX = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<begin: long, end: long>>"
_RANGE = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for stored in batch.column(batch.schema.get_field_index("media")).to_pylist():
            t = probe(stored)[0]
            rows.append((t.codec, t.timescale, t.duration, len(t.sizes), [{"begin": a, "end": b} for a, b in t.keyframe_ranges().tolist()]))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), _RANGE]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), types)] if rows else [pa.array([], k) for k in types]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "codec", "timescale", "duration", "n_samples", "keyframes"])


def indexed(media: DataFrame) -> DataFrame:
    """Adds codec, timescale, duration, number of samples and keyframe byte ranges to a table with a ``media`` column."""
    prepare(media.sparkSession)
    return media.mapInArrow(_index, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.schema) + ", " + INDEX)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, n, stored in zip(*(batch.column(c).to_pylist() for c in range(3))):
            t = probe(stored)[0]
            ranges = t.keyframe_ranges()
            read = payload(stored, t)
            feature = f"{t.codec.strip()}/{t.timescale}/{t.duration}/{len(t.sizes)}/{len(ranges)}/{zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
            rows.append((doc_id, n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        types = [pa.string() if " string" in x else pa.int64() for x in DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)] if rows else [pa.array([], k) for k in types], names)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container's payload digest, size and index; ``feature`` is codec/timescale/duration/samples/keyframes/crc32 of their byte ranges."""
    return media_column(table(spark, sf_dir, "documents")).mapInArrow(_digest, DIGEST)
