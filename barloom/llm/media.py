"""Lossless media columns: bytes as PNG images, read back with checksum tests, and cosine-transform hashes of the samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Texts are filled up to whole tiles of 24 x 24 samples.
WIDTH = 24
UNIT = WIDTH * WIDTH
FILL = 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the grid that samples are averaged to, and of the low-frequency block that is hashed.
GRID, LOW = 32, 8
#: No byte of a deflated stream stands for more bytes than this: images whose header says more are refused before they are inflated.
MOST_TIMES = 1032
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class MediaError(ValueError):
    """A stored image that isn't whole."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 6, row_filters: np.ndarray | None = None) -> bytes:
    """An 8-bit grey (h, w) or RGB (h, w, 3) image as PNG.

    Each row gets the filter of ``row_filters`` (0 to 4), or of none, sub and up the one whose bytes, as signed numbers, have the least sum of sizes: these three are undone
    for all rows at once.
    """
    height, width = samples.shape[:2]
    depth = 1 if samples.ndim == 2 else samples.shape[2]
    rows = np.ascontiguousarray(samples).reshape(height, width * depth)
    filtered = _filtered(rows, depth, UP if row_filters is None else PAETH)
    kinds = np.abs(filtered.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0) if row_filters is None else row_filters
    lines = np.empty((height, width * depth + 1), dtype=np.uint8)
    lines[:, 0], lines[:, 1:] = kinds, filtered[kinds, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if depth == 1 else 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _filtered(rows: np.ndarray, depth: int, upto: int) -> np.ndarray:
    """(filters, height, n): all rows under each row filter up to ``upto``."""
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, depth:], above[1:] = rows[:, :-depth], rows[:-1]
    plain = [rows, rows - left, rows - above]
    if upto > UP:
        corner = np.zeros_like(rows)
        corner[1:, depth:] = rows[:-1, :-depth]
        a, b, c = (x.astype(np.int16) for x in (left, above, corner))
        plain += [rows - ((a + b) >> 1).astype(np.uint8), rows - _paeth(a, b, c)]
    return np.stack(plain)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and corner the one next to left + above - corner; ties in this order."""
    da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey or RGB PNG without interlace; MediaError where a checksum, length or filter is wrong."""
    if data[:8] != SIGNATURE:
        raise MediaError("signature")
    at, parts, head, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise MediaError(f"checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
    if not ended or head is None or head[2] != 8 or head[3] not in (0, 2) or head[4:] != (0, 0, 0):
        raise MediaError("header or end")
    width, height, depth = head[0], head[1], 1 if head[3] == 0 else 3
    size = height * (width * depth + 1)
    if not width or not height or size > MOST_TIMES * sum(map(len, parts)):
        raise MediaError("size")
    try:
        inflater = zlib.decompressobj()
        raw = inflater.decompress(b"".join(parts), size + 1)  # never more than the header lets expect
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != size or not inflater.eof:
        raise MediaError("length")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, width * depth + 1)
    out = _unfilter(lines[:, 0], lines[:, 1:], depth)
    return out.reshape(height, width) if depth == 1 else out.reshape(height, width, depth)


def _unfilter(filters: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Undo the row filters: runs of rows under none, sub and up at once, runs under average and Paeth along their diagonals."""
    height, n = rows.shape
    if height and filters.max() > PAETH:
        raise MediaError("filter")
    out = np.empty((height, n), dtype=np.uint8)
    above = np.zeros(n, dtype=np.uint8)
    sums = filters <= UP
    edges = [0, *(np.flatnonzero(sums[1:] != sums[:-1]) + 1).tolist(), height]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        undo = _undo_sums if sums[start] else _undo_diagonals
        out[start:end] = undo(filters[start:end], rows[start:end], above, depth)
        above = out[end - 1]
    return out


def _undo_sums(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    """Rows under none, sub and up: sums along rows, then sums down from the last row that isn't under up."""
    height, n = rows.shape
    along = np.cumsum(rows.reshape(height, -1, depth), axis=1, dtype=np.uint8).reshape(height, n)
    lines = np.vstack([above, np.where(kinds[:, None] == SUB, along, rows)])
    down = np.cumsum(lines, axis=0, dtype=np.uint8)
    first = np.maximum.accumulate(np.where(kinds != UP, np.arange(1, height + 1), 0))
    return down[1:] - down[first] + lines[first]


def _undo_diagonals(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    """Rows under average and Paeth, a diagonal at once: pixel x of row y is on diagonal x + y, after its left, upper and corner neighbours."""
    height, n = rows.shape
    width = n // depth
    done = np.zeros((height + 1, width + 1, depth), dtype=np.int16)
    done[0, 1:] = above.reshape(width, depth)
    source = rows.reshape(height, width, depth)
    average = kinds == AVERAGE
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        a, b, c = done[y + 1, x], done[y, x + 1], done[y, x]
        guess = np.where(average[y, None], (a + b) >> 1, _paeth(a, b, c))
        done[y + 1, x + 1] = (source[y, x] + guess) & 255
    return done[1:, 1:].reshape(height, n).astype(np.uint8)


def _averages(samples: np.ndarray, cells: int) -> np.ndarray:
    """Means of equal stretches along the first axis, with parts of the samples that an edge cuts."""
    edge = np.linspace(0, len(samples), cells + 1)
    whole = np.minimum(edge.astype(np.int64), len(samples) - 1)
    sums = np.vstack([np.zeros(samples.shape[1]), np.cumsum(samples, axis=0, dtype=np.float64)])
    upto = sums[whole] + (edge - whole)[:, None] * samples[whole]
    return np.diff(upto, axis=0) * (cells / len(samples))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest frequencies of the samples' 32 x 32 averages lie above their median (the constant term is left out of it)."""
    grey = samples if samples.ndim == 2 else samples.mean(axis=2)
    small = _averages(_averages(grey, GRID).T, GRID).T
    low = _cosines() @ small @ _cosines().T
    flat = np.round(low.ravel(), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes().hex()


def payload_of(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """A text's UTF-8 with bytes 255 up to a positive multiple of ``unit``, and its length without them."""
    raw = (text or "").encode()
    return raw + bytes([FILL]) * (-len(raw) % unit if raw else unit), len(raw)


def store_texts(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes and media: each text of ``docs`` (doc_id, text) as a grey PNG with rows of 24 samples. Null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                stored = [(encode_png(np.frombuffer(p, dtype=np.uint8).reshape(-1, WIDTH)), n) for p, n in map(payload_of, part["text"])]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_bytes": [n for _, n in stored], "media": [m for m, _ in stored]})

    ids = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    stored = ids.mapInPandas(run, "doc_id string, n_bytes long, media binary")
    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "media")


def read_media(stored: DataFrame) -> DataFrame:
    """Read the binary column ``media`` of ``stored`` back and describe it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes,
    media_sha256, feature (the cosine hash of the samples as decoded) and error; other columns are left out. An empty table gives no rows. A row whose image isn't whole, or is null, keeps its id and
    media columns and says why in ``error``; it never stops the job.
    """

    def describe(media: bytes | None) -> tuple:
        if media is None:
            return (None, None, None, None, None, None, "null")
        media = bytes(media)
        own = (len(media), hashlib.sha256(media).hexdigest())
        try:
            samples = decode_png(media)
        except (MediaError, struct.error) as e:
            return (None, None, None, *own, None, str(e))
        payload = samples.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, cosine_hash(samples), None)

    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([describe(m) for m in pdf["media"]], columns=columns)
            for c in ("payload_bytes", "tail_crc32", "media_bytes"):
                found[c] = found[c].astype("Int64")
            yield pd.concat([pdf[["doc_id", "n_bytes"]].reset_index(drop=True), found], axis=1)

    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    read = stored.select(F.col("doc_id").cast("string").alias("doc_id"), "n_bytes", "media").mapInPandas(run, schema)
    return read.withColumn("doc_id", F.col("doc_id").cast("long"))


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text) as PNG and read it back, very long ones whole. Other columns are left out. Repeated rows and null doc_ids are rows like any other; an empty table gives no rows."""
    return read_media(store_texts(docs))
