"""Page images: gray levels from colour, PNG without an image library, and ingest into a store."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """Gray levels of a gray, BGR or BGRA image (the usual weights of the eye)."""
    if pixels.ndim == 2:
        return pixels
    b, g, r = (pixels[..., i].astype(np.float64) for i in range(3))
    return np.clip(np.rint(0.114 * b + 0.587 * g + 0.299 * r), 0, 255).astype(np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(gray: np.ndarray) -> bytes:
    """A gray PNG."""
    h, w = gray.shape
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), gray.astype(np.uint8)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def from_png(raw: bytes) -> np.ndarray:
    """Pixels of an 8-bit PNG without interlacing: gray, or colour as BGR or BGRA."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, b"", None
    while at < len(raw):
        (size,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    w, h, depth, colour, _, _, interlace = head
    n = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or interlace or n is None:
        raise ValueError("only 8-bit gray, RGB and RGBA without interlacing")
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), dtype=np.uint8)
    above = np.zeros(w * n, dtype=np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above & 255
        elif kind:
            for x in range(w * n):
                left, up, corner = (line[x - n] if x >= n else 0), above[x], (above[x - n] if x >= n else 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = line[x] + guess & 255
        out[y], above = line, line
    if n == 1:
        return out
    pixels = out.reshape(h, w, n)
    return pixels[..., [2, 1, 0, *range(3, n)]]


def doc_id(source: bytes) -> str:
    """The short name of a source: twelve digits of its digest."""
    return hashlib.sha256(source).hexdigest()[:12]


def ingest(store, images: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Put page images into a store: blobs of the images and gray forms, one document version each; the pages.

    ``images`` has source_path, source_sha256, page_no, bytes (PNG), placed_points
    (width on the page, 1/72 inch; null: unknown) and native.
    """
    rows = images if max_pages is None else images.where(F.col("page_no") < max_pages)

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for path, sha, page, raw, points, native in zip(b.source_path, b.source_sha256, b.page_no, b.bytes, b.placed_points, b.native, strict=True):
                gray = to_gray(from_png(bytes(raw)))
                png = to_png(gray)
                dpi = gray.shape[1] / (points / 72) if points and points == points else None
                out.append((sha[:12], path, sha, page, gray.shape[1], gray.shape[0], dpi, bool(native), float((gray < 200).mean()), bytes(raw), png))
            yield pd.DataFrame(out, columns=["doc_id", "source_path", "source_sha256", "page_no", "width_px", "height_px", "dpi", "native", "ink", "raw", "gray"])

    kinds = "doc_id string, source_path string, source_sha256 string, page_no int, width_px int, height_px int, dpi double, native boolean, ink double, raw binary, gray binary"
    pages = rows.select("source_path", "source_sha256", F.col("page_no").cast("int").alias("page_no"), "bytes", F.col("placed_points").cast("double").alias("placed_points"), "native").mapInPandas(run, kinds)
    store.put_blobs(pages.select(F.explode(F.array("raw", "gray")).alias("bytes")))
    views = F.create_map(F.lit("raw"), F.sha2("raw", 256), F.lit("gray"), F.sha2("gray", 256))
    out = pages.select("doc_id", "source_path", "source_sha256", "page_no", "width_px", "height_px", "dpi", "native", "ink", F.sha2("raw", 256).alias("raw_sha256"), F.sha2("gray", 256).alias("gray_sha256"), views.alias("views"))
    store.save(out.drop("views", "source_path", "source_sha256"), out.select("doc_id", "source_path", "source_sha256").distinct())
    return out
