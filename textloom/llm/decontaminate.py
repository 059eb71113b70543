"""Benchmark decontamination over a stored positional inverted index.

The index is partitioned by documents: each row is a segment of some MB of text with, for
every term (64-bit word hash), the sorted list of its positions. ``build_index`` stores
it in the shared folder, ``search`` looks phrases up in it: for each phrase the positions of its rarest
term, shifted to the phrase's start, are intersected with the shifted lists of its other
terms, rarest first, until only exact places are left. Proximity matches are places of a phrase's first
term with every other term of it within ``near`` positions; they too are sought around the places of its rarest term. Phrases are taken in
parts whose rarest lists hold at most ``PLACES`` positions, or one phrase.

Positions of consecutive documents in a segment lie one apart, so no phrase
crosses from one into the next. The items pass through the driver in blocks of about
``BLOCK_PHRASES`` terms, one at a time: each is one narrow pass over the stored index, whose matches
(a bit for each position, and pairs of document and item, of segments that have any) are kept; then they are put together by segment.

``clean`` marks rows where they are read, by the same segments, which live only as long as their rows pass: a stored
index would have to be joined with the rows again, which moves all texts.

Defined results: null, empty and wordless texts have no words and no hits; items without a
word never occur; repeated items and rows are all honoured; an item of fewer words
than ``width`` is one window; a very long text is a segment of its own. Other columns are ignored by ``contamination`` and carried by ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import words as W
from .shared import stash

WIDTH, NEAR = 10, 20
#: Terms of phrases sent to the executors at a time (8 bytes each), and positions looked at together.
BLOCK_PHRASES, PLACES = 4_000_000, 8_000_000


def index_schema(kind: str) -> str:
    """segment: its number; starts: first position of each document (one more at the end); terms, ends and places: sorted term hashes, the end of each one's list, all lists."""
    return f"segment bigint, doc_ids array<{kind}>, starts binary, terms binary, ends binary, places binary"


def index_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    for batch in batches:
        for part in W.slices(batch):
            hashed, doc = W.words(*W.raw(part.column("text")))
            n = part.num_rows
            starts = np.r_[0, np.cumsum(np.bincount(doc, minlength=n) + 1)].astype(np.uint32)
            place = (np.arange(len(hashed)) + doc).astype(np.uint32)
            order = np.argsort(hashed, kind="stable")
            hashed, place = hashed[order], place[order]
            last = np.flatnonzero(np.r_[hashed[1:] != hashed[:-1], len(hashed) > 0])
            cells = [starts, hashed[last], (last + 1).astype(np.uint32), place]
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["segment", "doc_ids", "starts", "terms", "ends", "places"])
            number += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The stored positional inverted index of ``docs`` (doc_id, text), in segments."""
    return stash(docs.select("doc_id", "text").mapInArrow(index_segments, index_schema(docs.schema["doc_id"].dataType.simpleString())))


class Phrases:
    """Windows of ``width`` words (grouped by length) and the items they come from, by their numbers in ``names``."""

    def __init__(self, texts: list[tuple[object, str | None]], width: int) -> None:
        by: dict[int, tuple[list, list]] = {}
        self.names = ["" if x is None else str(x) for x, _ in texts]
        for item, (_, text) in enumerate(texts):
            w = W.word_list(text)
            if len(w):
                k = min(width, len(w))
                windows = np.lib.stride_tricks.sliding_window_view(w, k)
                held = by.setdefault(k, ([], []))
                held[0].append(windows)
                held[1].append(np.full(len(windows), item, np.uint32))
        self.groups = []
        for k, (a, b) in sorted(by.items()):
            both = np.unique(np.c_[np.concatenate(a), np.concatenate(b).astype(np.uint64)], axis=0)
            self.groups.append((k, both[:, :k], both[:, k].astype(np.uint32)))


def lookup(terms: np.ndarray, ends: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each phrase's terms: index in ``terms``, start and length of their lists (0: absent)."""
    if not len(terms):
        zero = np.zeros(phrases.shape, np.int64)
        return zero, zero, zero
    at = np.minimum(np.searchsorted(terms, phrases), len(terms) - 1)
    begin = np.r_[0, ends[:-1]].astype(np.int64)[at]
    return at, begin, np.where(terms[at] == phrases, ends[at].astype(np.int64) - begin, 0)


def intersect(terms: np.ndarray, ends: np.ndarray, places: np.ndarray, phrases: np.ndarray, near: int | None = None, starts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase number, first position) of every exact match, or with ``near`` of every proximity match; part by part of the phrases."""
    at, begin, size = lookup(terms, ends, phrases)
    some = np.flatnonzero(size.min(1) > 0)
    if not len(some):
        return
    keys = np.repeat(np.arange(len(terms)), np.diff(np.r_[0, ends.astype(np.int64)])) * (1 << 32) + places  # sorted
    part = np.cumsum(size[some].min(1)) // PLACES

    def around(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the places of a term near ``place``, in the same document, begin and end in ``keys``."""
        doc = np.searchsorted(starts, place, "right")
        first, last = np.maximum(place - near, starts[doc - 1].astype(np.int64)), np.minimum(place + near, starts[doc].astype(np.int64) - 1)
        return np.searchsorted(keys, key + first), np.searchsorted(keys, key + last, "right")

    for live in np.split(some, np.flatnonzero(np.diff(part)) + 1):
        rank = np.argsort(size[live], axis=1, kind="stable")
        row = np.arange(len(live))
        n = size[live][row, rank[:, 0]]
        who = np.repeat(row, n)
        place = places[np.repeat(begin[live][row, rank[:, 0]] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
        if near is None:
            place = place - rank[who, 0]
            who, place = who[place >= 0], place[place >= 0]
        else:
            # Places of the first term near those of the rarest.
            low, high = around(at[live][who, 0] * (1 << 32), place)
            n = high - low
            both = np.c_[np.repeat(who, n), keys[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())] & 0xFFFFFFFF]
            who, place = np.unique(both, axis=0).T if len(both) else both.T
        for r in range(1, phrases.shape[1]):
            nth = rank[who, r]
            key = at[live][who, nth] * (1 << 32)
            if near is None:
                want = key + place + nth
                found = np.minimum(np.searchsorted(keys, want), len(keys) - 1) if len(want) else np.zeros(0, np.int64)
                ok = keys[found] == want if len(want) else np.zeros(0, bool)
            else:
                low, high = around(key, place)
                ok = low < high
            who, place = who[ok], place[ok]
        yield live[who], place


def segment(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    """starts, terms, ends and places of a row of the index."""
    return [np.frombuffer(batch.column(c)[i].as_py(), np.uint64 if c == "terms" else np.uint32) for c in ("starts", "terms", "ends", "places")]


PAIRS = pa.list_(pa.struct([("doc", pa.int64()), ("item", pa.string())]))
MATCHES = "segment bigint, hits binary, items array<struct<doc: bigint, item: string>>, near array<struct<doc: bigint, item: string>>"


def search_segments(batches: Iterator[pa.RecordBatch], phrases: Phrases, near: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            starts, terms, ends, places = segment(batch, i)
            bits = np.zeros(int(starts[-1]), np.uint8)
            items, close = ([np.zeros((0, 2), np.int64)] for _ in range(2))
            for k, windows, owner in phrases.groups:
                for limit, out in ((None, items), (near, close)):
                    for which, place in intersect(terms, ends, places, windows, limit, starts):
                        doc = np.searchsorted(starts, place, "right") - 1
                        if limit is None:
                            for j in range(k):
                                bits[place + j] = 1
                        out.append(np.unique(np.c_[doc, owner[which].astype(np.int64)], axis=0))
            items, close = (np.unique(np.concatenate(x), axis=0).tolist() for x in (items, close))
            if items or close:
                pairs = [pa.array([[{"doc": d, "item": phrases.names[x]} for d, x in some]], PAIRS) for some in (items, close)]
                yield pa.RecordBatch.from_arrays([batch.column("segment").slice(i, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), *pairs], names=["segment", "hits", "items", "near"])


def phrase_blocks(items: DataFrame, width: int, block: int = BLOCK_PHRASES) -> Iterator[Phrases]:
    """Phrases of ``items`` (item_id, text) in blocks of about ``block`` terms; the driver holds one at a time."""
    held, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        held.append((row.item_id, row.text))
        size += width * (len(row.text or "") // 2 + 1)
        if size > block:
            yield Phrases(held, width)
            held, size = [], 0
    if held:
        yield Phrases(held, width)


def search(index: DataFrame, items: DataFrame, width: int = WIDTH, near: int = NEAR, block: int = BLOCK_PHRASES) -> DataFrame:
    """Matches of all windows of ``items`` by segment (MATCHES), stored block by block."""
    out = index.sparkSession.createDataFrame([], MATCHES)
    for phrases in phrase_blocks(items, width, block):
        if phrases.groups:
            out = out.unionByName(stash(index.mapInArrow(lambda it, p=phrases: search_segments(it, p, near), MATCHES)))
    return out


REPORT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near_items bigint, items array<string>, near_items array<string>"


def reported(own: pa.Table, matches: pa.Table) -> pa.Table:
    """The documents of a segment with its matches of all blocks."""
    own, matches = own.combine_chunks(), matches.combine_chunks()
    starts = np.frombuffer(own.column("starts")[0].as_py(), np.uint32).astype(np.int64)
    n = len(starts) - 1
    bits = np.zeros(-(-int(starts[-1]) // 8), np.uint8)
    found, close = ([set() for _ in range(n)] for _ in range(2))
    for row in matches.to_pylist():
        bits |= np.frombuffer(row["hits"], np.uint8)
        for sets, pairs in ((found, row["items"]), (close, row["near"])):
            for x in pairs:
                sets[x["doc"]].add(x["item"])
    total = np.r_[0, np.cumsum(np.unpackbits(bits, bitorder="little"), dtype=np.int64)]
    hit = total[starts[1:] - 1] - total[starts[:-1]]
    lists, near = [sorted(x) for x in found], [sorted(x) for x in close]
    counts = [pa.array([len(x) for x in some], pa.int64()) for some in (lists, near)]
    return pa.table(
        {
            "doc_id": own.column("doc_ids").combine_chunks().flatten(), "n_words": pa.array(starts[1:] - starts[:-1] - 1, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": counts[0],
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), "contaminated": pa.array(hit > 0), "n_near_items": counts[1],
            "items": pa.array(lists, pa.list_(pa.string())), "near_items": pa.array(near, pa.list_(pa.string())),
        }
    )


def report(index: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each document of the index."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    return index.select("segment", "doc_ids", "starts").groupBy("segment").cogroup(matches.groupBy("segment")).applyInArrow(reported, f"doc_id {kind}, {REPORT}")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, near: int = NEAR, block: int = BLOCK_PHRASES) -> DataFrame:
    """One row per row of ``docs``: words, words inside exact matches, matching items and items with a proximity match (as strings, and counted)."""
    index = build_index(docs)
    return report(index, search(index, items, width, near, block))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, block: int = BLOCK_PHRASES) -> DataFrame:
    """``docs`` without the contaminated ones, a narrow pass for each block of items: rows are marked where they are read."""
    mark = "_hit"
    while mark in docs.columns:
        mark += "_"
    schema = StructType([*docs.schema.fields, StructField(mark, BooleanType())])
    ahead = phrase_blocks(items, width, block)
    phrases = next(ahead, None)
    while phrases is not None:
        after = next(ahead, None)
        if phrases.groups:
            docs = docs.mapInArrow(lambda it, p=phrases: marked(it, p, mark), schema).where(~F.col(mark)).drop(mark)
            # The driver lets go of a block before it takes another.
            docs = stash(docs) if after else docs
        phrases = after
    return docs


def marked(batches: Iterator[pa.RecordBatch], phrases: Phrases, mark: str) -> Iterator[pa.RecordBatch]:
    """Rows with whether they hold a phrase: a segment's index lives only as long as its rows pass."""
    for batch in batches:
        for part in W.slices(batch):
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column("text")], names=["doc_id", "text"])
            hit = np.zeros(part.num_rows, bool)
            for found in index_segments([own]):
                starts, terms, ends, places = segment(found, 0)
                for _, windows, _ in phrases.groups:
                    for _, place in intersect(terms, ends, places, windows):
                        hit[np.searchsorted(starts, place, "right") - 1] = True
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hit)], names=[*part.schema.names, mark])
