"""Media columns: binary columns of PNG images, written and read with zlib and numpy, and cosine-transform hashes of them."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow_limits, map_batches

#: Payloads are padded to a positive multiple of this, which is also the width of their images.
UNIT = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(pixels: np.ndarray, level: int = 3) -> bytes:
    """8-bit grey PNG of a 2-D array; each row has the one of the filters none, sub and up with the smaller sum of absolute residues."""
    h, w = pixels.shape
    left = np.zeros_like(pixels)
    left[:, 1:] = pixels[:, :-1]
    above = np.zeros_like(pixels)
    above[1:] = pixels[:-1]
    tries = np.stack([pixels, pixels - left, pixels - above])
    cost = np.minimum(tries, 0 - tries).sum(axis=2, dtype=np.int64)
    cost[0] //= 4  # text hardly gains from differences, which hide its repeats from deflate
    pick = cost.argmin(axis=0)
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = pick
    rows[:, 1:] = tries[pick, np.arange(h)]
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Pixels of filtered rows; runs of rows with the filters none, sub and up go by whole arrays, average and Paeth by pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    h, w = out.shape
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        out[sub] = np.cumsum(out[sub].reshape(len(sub), -1, bpp), axis=1, dtype=np.uint8).reshape(len(sub), w)
    for y in np.flatnonzero(kinds >= 2):
        up = out[y - 1] if y else np.zeros(w, np.uint8)
        if kinds[y] == 2:
            out[y] += up
            continue
        row, above = out[y].astype(int).tolist(), up.tolist()
        for x in range(w):
            a, b, c = (row[x - bpp] if x >= bpp else 0), above[x], (above[x - bpp] if x >= bpp else 0)
            if kinds[y] == 3:
                guess = (a + b) // 2
            else:
                da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                guess = a if da <= db and da <= dc else b if db <= dc else c
            row[x] = (row[x] + guess) & 255
        out[y] = row
    return out


def read_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit PNG without interlacing, (rows, columns * channels). Bad signatures, checksums, sizes and filters raise ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, head = 8, [], None
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("PNG checksum")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("PNG kind")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != head[1] * (head[0] * channels + 1):
        raise ValueError("PNG size")
    return _unfilter(raw.reshape(head[1], head[0] * channels + 1), channels)


_K = np.arange(32)
_COSINE = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:9, None] / 64)


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest frequencies (DC apart, rows and columns 1 to 8) of the image's 32 x 32 block means lie above their median."""
    h, w = pixels.shape
    ys, xs = np.arange(33) * h // 32, np.arange(33) * w // 32
    small = np.zeros((32, 32))
    sums = np.add.reduceat(np.add.reduceat(pixels, np.minimum(ys[:-1], h - 1), axis=0, dtype=np.int64), np.minimum(xs[:-1], w - 1), axis=1)
    small[:] = sums / (np.maximum(np.diff(ys), 1)[:, None] * np.maximum(np.diff(xs), 1)[None, :])
    low = (_COSINE @ small @ _COSINE.T)[1:, 1:].ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return len(data), data + b"\xff" * (size - len(data))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty), padded with bytes 255 to a positive multiple of UNIT, as a grey PNG of width UNIT."""
    arrow_limits(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [payload(t) for t in b.column("text").to_pylist()]
        media = [write_png(np.frombuffer(p, np.uint8).reshape(-1, UNIT)) for _, p in made]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": pa.array([n for n, _ in made], pa.int64()), "media": pa.array(media, pa.binary())})

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and the cosine hash of each stored image, from its bytes; images that can't be read raise, as silent loss is worse."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for m in b.column("media").to_pylist():
            pixels = read_png(m)
            data = pixels.tobytes()
            for k, v in zip(out, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(pixels))):
                out[k].append(v)
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes")} | {k: pa.array(v, pa.int64() if isinstance(v[0], int) else pa.string()) if v else pa.array([], pa.string() if "sha" in k or k == "feature" else pa.int64()) for k, v in out.items()})

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Stored as a table of media in the shared folder, then read back from there."""
    stored = Tables(spark, "media").write(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return media_features(stored)
