"""Words of Arrow text columns as flat numpy arrays: one pass over the UTF-8 bytes, no Python loop per text.

A word is a maximal run of digits, ASCII letters (A-Z lowered) and bytes from 0x80 up,
which is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over the lowered text. Words become
64-bit hashes. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: What separates the pieces of ``pieces``: space, tab, line feed, carriage return.
PIECE = np.ones(256, dtype=bool)
PIECE[[9, 10, 13, 32]] = False
BLOCK = 4 << 20  # bytes of text held as arrays at a time, unless one text is longer


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TABLE_LOWER = TABLE[LOWER]
BASE = np.uint64(0xD6E8FEB86659FD93)
ROLL = np.uint64(0xA0761D6478BD642F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of n texts; null as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def runs(data: np.ndarray, offs: np.ndarray, member: np.ndarray, table: np.ndarray, cut: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``member`` bytes inside each text: hash, text number, first byte, byte length.

    ``cut`` gets the bytes, first and last bytes of the runs and returns places at which runs are cut in two.
    """
    inside = member[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offs[:-1][offs[:-1] < len(data)]
    begin[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    end[edge] = inside[edge]
    start, last = np.flatnonzero(begin), np.flatnonzero(end)
    if cut is not None and len(start):
        more = cut(data, start, last)
        start, last = np.sort(np.r_[start, more]), np.sort(np.r_[last, more - 1])
    size = last + 1 - start
    doc = np.searchsorted(offs, start, "right") - 1
    if not len(start):
        return np.zeros(0, np.uint64), doc, start, size
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    value = np.add.reduceat(table[data[inside]] * powers(BASE, int(size.max()))[place], first)
    return mix(value + size.astype(np.uint64)), doc, start, size


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in text order and the text each belongs to."""
    hashed, doc, _, _ = runs(data, offs, WORD, TABLE_LOWER)
    return hashed, doc


def word_list(text: str | None) -> np.ndarray:
    """Word hashes of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[0]


def shingles(hashed: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words, and their texts; a text of fewer words is one shingle."""
    n, p = len(hashed), powers(ROLL, k)
    m = max(0, n - k + 1)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += hashed[j : m + j] * p[j]
    full = doc[:m] == doc[k - 1 : k - 1 + m]
    ids, at = mix(out[full]), doc[:m][full]
    count = np.bincount(doc, minlength=n_docs)
    few = (count > 0) & (count < k)
    if few.any():
        own = few[doc]
        d = doc[own]
        head = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        place = np.arange(len(d)) - np.repeat(head, np.diff(np.r_[head, len(d)]))
        ids = np.r_[ids, mix(np.add.reduceat(hashed[own] * p[place], head) + count[d[head]].astype(np.uint64))]
        at = np.r_[at, d[head]]
        order = np.argsort(at, kind="stable")
        ids, at = ids[order], at[order]
    return ids, at


def counted(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, id), sorted, with how often each occurs: id, text, count."""
    order = np.lexsort((ids, at))
    ids, at = ids[order], at[order]
    head = np.flatnonzero(np.r_[len(ids) > 0, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])]) if len(ids) else np.zeros(0, np.int64)
    return ids[head], at[head], np.diff(np.r_[head, len(ids)])
