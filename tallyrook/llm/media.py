"""Media columns: 8-bit PNG images written to and read from binary columns, and cosine-transform hashes of them.

An image is written as signature, IHDR, IDAT chunks of one zlib stream, IEND, each with its checksum. A picture's rows
are filtered by that of the filters None, Sub and Up that leaves the least sum of absolute values. Reading tests the signature, every
chunk's checksum and the stream's own, and takes all five filter types off with numpy. A picture with a fault raises
ValueError, naming it.

Nulls and empty texts give one block of zero bytes. Equal texts give equal bytes and features; repeated rows are stored each. A text
of any length is one picture, whose memory is a few times the text's. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of an IDAT chunk at most, side of the picture before the transform, side of the block of low frequencies.
CHUNK, SIDE, LOW = 1 << 20, 32, 8


def payload(text: str | None) -> bytes:
    """The text's UTF-8 bytes and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw)) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(pixels: np.ndarray, level: int = 3) -> bytes:
    """A grey picture of 8 bits, given as rows of samples."""
    height, width = pixels.shape
    tried = np.empty((3, height, width + 1), np.uint8)
    tried[:, :, 0] = np.arange(3)[:, None]
    tried[:, :, 1:] = pixels
    tried[1, :, 2:] -= pixels[:, :-1]
    tried[2, 1:, 1:] -= pixels[:-1]
    samples = tried[:, :, 1:]
    rows = tried[np.minimum(samples, -samples).sum(axis=(1, 2), dtype=np.int64).argmin()]  # bytes read as signed
    stream = zlib.compress(rows.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", stream[i : i + CHUNK]) for i in range(0, len(stream), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples of a grey picture of 8 bits without interlacing."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"the checksum of {kind!r} is wrong")
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height = head[:2]
    if head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only grey pictures of 8 bits without interlacing are read")
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as fault:
        raise ValueError(f"the zlib stream is broken: {fault}") from fault
    if rows.size != height * (width + 1):
        raise ValueError("the stream's length does not fit the header")
    return unfilter(rows.reshape(height, width + 1))


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples from filtered rows (the filter type first). Runs of one type are undone together where that can be."""
    kinds, x = rows[:, 0], rows[:, 1:]
    out = np.empty_like(x)
    edges = np.flatnonzero(np.diff(kinds.astype(np.int16))) + 1
    above = np.zeros(x.shape[1], np.uint8)
    for a, b in zip([0, *edges], [*edges, len(rows)], strict=True):
        kind = kinds[a] if a < len(rows) else 0
        if kind == 0:
            out[a:b] = x[a:b]
        elif kind == 1:
            np.cumsum(x[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(x[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (3, 4):
            for i in range(a, b):
                _by_sample(kind, x[i], out[i - 1] if i else above, out[i])
        else:
            raise ValueError(f"there is no filter type {kind}")
        above = out[b - 1] if b else above
    return out


def _by_sample(kind: int, x: np.ndarray, above: np.ndarray, out: np.ndarray) -> None:
    """Average and Paeth: each sample needs the one before."""
    left = corner = 0
    for j, (value, top) in enumerate(zip(x.tolist(), above.tolist(), strict=True)):
        if kind == 3:
            guess = (left + top) // 2
        else:
            p = left + top - corner
            guess = min((abs(p - left), 0, left), (abs(p - top), 1, top), (abs(p - corner), 2, corner))[2]
        left, corner = (value + guess) & 255, top
        out[j] = left


def _means(samples: np.ndarray) -> np.ndarray:
    """Rows of samples averaged to SIDE; where there are fewer than SIDE, rows are repeated."""
    edge = np.arange(SIDE + 1) * len(samples) // SIDE
    return np.add.reduceat(samples, edge[:-1], axis=0, dtype=np.float64) / np.maximum(np.diff(edge), 1)[:, None]


@lru_cache(maxsize=1)
def _frequencies() -> np.ndarray:
    """LOW x SIDE: the lowest frequencies of the cosine transform."""
    k, i = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * SIDE))


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies lie above the median of all but the constant one."""
    small = _means(_means(pixels).T).T
    flat = np.round(_frequencies() @ small @ _frequencies().T, 6).ravel()
    return np.packbits(flat > np.median(flat[1:])).tobytes()


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the PNG that holds the text's payload, 64 samples a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                held = [(len((x or "").encode("utf-8", "surrogatepass")), payload(x)) for x in part.column("text").to_pylist()]
                media = [write_png(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for _, p in held]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in held], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Adds payload (as read back from media) and feature (the picture's cosine hash), both binary."""
    stored = stored.select("doc_id", "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                pictures = [read_png(x) for x in part.column("media").to_pylist()]
                part = part.append_column("payload", pa.array([p.tobytes() for p in pictures], pa.binary()))
                yield part.append_column("feature", pa.array([cosine_hash(p) for p in pictures], pa.binary()))

    return stored.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """The digests of what store_texts() wrote and read_media() read back."""
    back = read_media(store_texts(docs))
    tail = F.when(F.length("payload") > WIDTH, F.expr(f"substring(payload, length(payload) - {WIDTH - 1}, {WIDTH})")).otherwise(F.col("payload"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )
