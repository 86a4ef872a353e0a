"""Media columns: texts' bytes as PNG images in a binary column, and their hashes.

A payload is stored as 8-bit grey samples, 64 to a row: IHDR, one IDAT chunk of
zlib data and IEND, each with its CRC. The reader tests the signature, every chunk's
CRC and zlib's own checksum, undoes the row filters in numpy, and the low
frequencies of a cosine transform of the image give a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
#: Fixed values of the PNG format: the signature and the filter numbers.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class CorruptImage(ValueError):
    """A chunk, a checksum or a filter isn't as the format wants it."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predicted(left: np.ndarray, up: np.ndarray, corner: np.ndarray, kind: int) -> np.ndarray:
    """What a filter predicts from the neighbours; arguments as int16."""
    if kind == AVERAGE:
        return (left + up) >> 1
    base = left + up - corner
    to_left, to_up, to_corner = abs(base - left), abs(base - up), abs(base - corner)
    return np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))


def filtered(image: np.ndarray, kind: int | None = None) -> np.ndarray:
    """Rows with their filter byte. kind None: of none, sub and up, for each row the
    one with the least sum of absolute differences, the format's usual rule."""
    rows = image.astype(np.uint8)
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    if kind in (AVERAGE, PAETH):
        corner = np.zeros_like(rows)
        corner[1:, 1:] = rows[:-1, :-1]
        wide = [x.astype(np.int16) for x in (left, up, corner)]
        out[:, 0], out[:, 1:] = kind, rows - _predicted(*wide, kind).astype(np.uint8)
        return out
    forms = {NONE: rows, SUB: rows - left, UP: rows - up}
    if kind is not None:
        out[:, 0], out[:, 1:] = kind, forms[kind]
        return out
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in forms.values()])
    best = cost.argmin(axis=0)
    out[:, 0] = best
    out[:, 1:] = np.stack(list(forms.values()))[best, np.arange(len(rows))]
    return out


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Undo the filters of all rows. Runs of up rows are one cumulative sum; average
    and Paeth rows, which this writer doesn't use, go byte by byte."""
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise CorruptImage("unknown filter")
    sub = kinds == SUB
    data[sub] = np.cumsum(data[sub], axis=1, dtype=np.uint8)
    slow = np.flatnonzero(kinds >= AVERAGE)
    first = 0
    for stop in [*slow, len(data)]:
        if stop > first:
            _climb(data, kinds, first, stop)
        if stop < len(data):
            _by_byte(data, int(stop), int(kinds[stop]))
        first = stop + 1
    return data


def _climb(data: np.ndarray, kinds: np.ndarray, first: int, stop: int) -> None:
    """Rows first to stop, of which none is average or Paeth, in place."""
    part, up = data[first:stop], kinds[first:stop] == UP
    if not up.any():
        return
    if first and up[0]:
        part[0] += data[first - 1]
    up[0] = False
    total = np.cumsum(part, axis=0, dtype=np.uint8)
    anchor = np.maximum.accumulate(np.where(up, 0, np.arange(len(part))))
    before = np.zeros_like(total)
    before[anchor > 0] = total[anchor[anchor > 0] - 1]
    part[:] = total - before


def _by_byte(data: np.ndarray, at: int, kind: int) -> None:
    above = data[at - 1].astype(np.int16) if at else np.zeros(data.shape[1], np.int16)
    left = corner = np.int16(0)
    for x in range(data.shape[1]):
        left = np.int16((int(data[at, x]) + int(_predicted(left, above[x], corner, kind))) & 255)
        corner, data[at, x] = above[x], left


def png(payload: bytes, kind: int | None = None, level: int = 6) -> bytes:
    """A grey image of the payload, whose length is a positive multiple of WIDTH."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(image, kind).tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(stored: bytes) -> np.ndarray:
    """The samples of a grey 8-bit image; CorruptImage if any test fails."""
    if stored[:8] != SIGNATURE:
        raise CorruptImage("signature")
    at, head, body, ended = 8, None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise CorruptImage("cut off")
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4:at + 8]
        data = stored[at + 8:at + 8 + n]
        if at + 12 + n > len(stored) or zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise CorruptImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise CorruptImage("header or end")
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise CorruptImage(str(e)) from e
    if len(rows) != head[1] * (head[0] + 1):
        raise CorruptImage("size")
    return unfiltered(rows.reshape(head[1], head[0] + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(low)[:, None])


@lru_cache(maxsize=64)
def _from_rows(height: int, side: int, low: int) -> np.ndarray:
    """Area means over height rows in side cells, then the low cosines: one matrix."""
    edges = np.linspace(0, height, side + 1)
    cover = np.minimum(edges[1:, None], np.arange(1, height + 1)[None, :]) - np.maximum(edges[:-1, None], np.arange(height)[None, :])
    return _cosines(side, low) @ (cover.clip(0) / (height / side))


def cosine_hash(image: np.ndarray, side: int = 32, low: int = 8) -> str:
    """64 bits as hex digits: whether each of the low x low cosine coefficients of the
    image, shrunk to side x side means, is above the median of all but the constant."""
    c = _from_rows(image.shape[0], side, low) @ image.astype(np.float64) @ _from_rows(image.shape[1], side, low).T
    c = np.round(c.ravel(), 6)
    bits = c > np.median(c[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


FORM = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def with_media(texts: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each row's id, the unpadded length n_bytes, and its text's image in the binary
    column media. A null text counts as empty and gives one row of zeros; repeated
    rows each give theirs; an empty table gives none. Other columns aren't read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for text in batch.column(1):
                n, payload = payload_of(text.as_py())
                rows.append((n, png(payload)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the images of the column media again: checks, digests and the hash."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, stored in zip(batch.column(1).to_pylist(), batch.column(2)):
                stored = stored.as_py()
                image = read_png(stored)
                payload = image.tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(image)))
            columns = list(zip(*rows)) or [[]] * len(FORM)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, FORM))], schema=pa.schema([("doc_id", pa.int64()), *FORM]))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import table

    return media_features(with_media(table(spark, sf_dir, "documents")))
