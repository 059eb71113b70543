"""Pages as grey PNG images.

The glyphs are plain stand-ins (a code point's bits in its cell), since no font belongs to this library;
sizes, rows and the file format are those of the geometry.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .geometry import PAD, Grid, cell_width, grid, laid_out, page_sizes


def encode_grey(pixels: np.ndarray) -> bytes:
    """8-bit grey PNG of (height, width) bytes: no filter, zlib level 6."""
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def draw(rows: list[str], size: tuple[int, int], g: Grid) -> np.ndarray:
    w, h = size
    page = np.zeros((h, w), np.uint8)
    for y, row in enumerate(rows):
        x = PAD
        for c in row:
            if not c.isspace():
                bits = np.unpackbits(np.frombuffer(struct.pack(">I", ord(c) * 2654435761 % (1 << 32)), np.uint8))
                cell = np.resize(bits, (g.ch - 2, g.cw - 1)) * 255
                page[PAD + y * g.ch + 1 : PAD + (y + 1) * g.ch - 1, x : x + g.cw - 1] = cell[:, : max(0, min(g.cw - 1, w - x))]
            x += cell_width(c) * g.cw
    return 255 - page


def rendered(docs: DataFrame, font: str = "normal", pack: bool = True) -> DataFrame:
    """doc_id, page_no (from 0), width, height, png of each page of each text."""
    g = grid(font)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                pages = laid_out(text or "", g, True, pack)
                sizes = page_sizes(pages, g, pack)
                n = len(pages)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([i] * n)), pa.array(range(n), pa.int64()), pa.array([w for w, _ in sizes], pa.int64()), pa.array([h for _, h in sizes], pa.int64()),
                        pa.array([encode_grey(draw(p, s, g)) for p, s in zip(pages, sizes, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "page_no", "width", "height", "png"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, page_no bigint, width bigint, height bigint, png binary")
