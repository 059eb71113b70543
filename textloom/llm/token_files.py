"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

``write`` encodes every text with a tokenizer, appends the end id, and replaces ids by their
rank in order of frequency (ties by id), so that the common ones take one byte. Ranks are
coded in 1 to 4 little-endian bytes; the lengths lie apart from the data, four to a control
byte (two bits each, the first in the lowest bits), each document starting on a control byte
of its own. A file is a Parquet table of blocks

    file, block, doc_ids, counts (ids of each document), control, data

with documents in ascending order of doc_id (null first; rows that repeat a doc_id by their texts' hash)
over all files and blocks, beside ``ranks``, the ids by rank. Files hold about ``FILE_IDS`` ids, however many that makes; which
document goes to which comes from a sample of (doc_id, hash, row), so not even rows that repeat an id must meet in one file. ``read`` decodes blocks with a table of
the lengths that each control byte stands for.

Texts are cut at white space, which this kind of tokenizer drops before it splits words, and before punctuation
that ends a piece, where it splits: every distinct piece
is encoded by the library once per Python worker (or again when more than ``REMEMBERED`` are held) and looked up by its 64-bit hash after that. That holds
for a tokenizer whose normaliser and splitter never look across these places, such as
word_bpe_49k.json; ``by_pieces=False`` encodes whole texts instead.

Defined results: null and empty texts hold the end id alone; repeated rows are written each; other
columns are ignored; an empty table gives files without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import fresh, stash

END = 2
#: Distinct pieces that a worker remembers, ids in a block, ids in a file.
REMEMBERED, BLOCK_IDS, FILE_IDS = 2_000_000, 1 << 20, 8 << 20
#: Rows sampled for the bounds of files: for each file, and at most.
SAMPLED, SAMPLE = 200, 1_000_000
#: Files in a group, by which positions are summed.
GROUP = 1024
#: Byte lengths of the four numbers under each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
BLOCKS = "file int, block int, doc_ids array<bigint>, counts array<bigint>, control binary, data binary"


@lru_cache(maxsize=2)
def tokenizer(path: str):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: ASCII punctuation that may end a piece, and what a text's end of a piece is cut behind. < > and | may belong to special tokens.
ENDING, PLAIN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
ENDING[33:48] = ENDING[58:65] = ENDING[91:97] = ENDING[123:127] = True
ENDING[[60, 62, 124]] = False
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = True


def endings(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where punctuation after a letter or digit of ASCII ends a piece: a splitter cuts there anyway."""
    body = np.maximum.accumulate(np.where(ENDING[data], 0, np.arange(len(data))))[last]
    return (body + 1)[(body >= first) & (body < last) & PLAIN[data[body]]]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for ids in lists for x in ids), np.uint32, int(count.sum())), count


def encoded(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of ``texts`` and how many each has: many at a time between special tokens, which part texts for the library as calls of its own would."""
    own = tokenizer(path)
    mark = next(((i, t.content) for i, t in sorted(own.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
    if mark is None or any(mark[1] in x for x in texts):
        return flat([e.ids for e in own.encode_batch(texts, add_special_tokens=False)])
    ids = [np.array(own.encode(mark[1].join(texts[i : i + 512]) + mark[1], add_special_tokens=False).ids, np.uint32) for i in range(0, len(texts), 512)]
    ids = np.concatenate([np.zeros(0, np.uint32), *ids])
    ends = np.flatnonzero(ids == mark[0])
    return ids[ids != mark[0]], np.diff(np.r_[-1, ends]) - 1


class Pieces:
    """Ids of texts by way of their pieces."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.known, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        data, offs = W.raw(text)
        hashed, doc, start, size = W.runs(data, offs, W.PIECE, W.TABLE, endings)
        distinct, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            if len(self.known) > REMEMBERED:
                self.forget()
                new = np.ones(len(distinct), bool)
            whole = data.tobytes()
            texts = [whole[start[i] : start[i] + size[i]].decode() for i in first[new]]
            ids, count = encoded(self.path, texts)
            known = np.r_[self.known, distinct[new]]
            order = np.argsort(known)
            self.begin = np.r_[self.begin, len(self.pool) + np.cumsum(count) - count][order]
            self.count = np.r_[self.count, count][order]
            self.known, self.pool = known[order], np.r_[self.pool, ids]
        at = np.searchsorted(self.known, distinct)
        begin, count = self.begin[at][which], self.count[at][which]
        n = int(count.sum())
        return self.pool[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(n)], np.bincount(doc, weights=count, minlength=len(text)).astype(np.int64)


class Texts:
    """Ids of whole texts."""

    def __init__(self, path: str) -> None:
        self.path = path

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in tokenizer(self.path).encode_batch([x or "" for x in text.to_pylist()], add_special_tokens=False)])


def with_end(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(count), END), count + 1


_SOURCES: dict[tuple[str, bool], Pieces | Texts] = {}


def source(path: str, by_pieces: bool) -> Pieces | Texts:
    """One for each Python worker, which runs many tasks: what a task has encoded serves the next."""
    key = path, by_pieces
    if key not in _SOURCES:
        _SOURCES.clear()
        _SOURCES[key] = (Pieces if by_pieces else Texts)(path)
    return _SOURCES[key]


def binaries(whole: np.ndarray, at: np.ndarray) -> pa.Array:
    """Slices of ``whole`` between the byte offsets ``at``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(whole.tobytes())])


def tokenise(batches: Iterator[pa.RecordBatch], path: str, by_pieces: bool, width: str) -> Iterator[pa.RecordBatch]:
    encode_ids = source(path, by_pieces).ids
    for batch in batches:
        for part in W.slices(batch):
            ids, count = with_end(*encode_ids(part.column("text")))
            own = ids.astype(width)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("xx"), pa.array(count, pa.int64()), binaries(own, np.r_[0, np.cumsum(count)] * own.itemsize)], names=["doc_id", "xx", "n", "ids"])


def flat_ids(column: pa.Array, width: str) -> np.ndarray:
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]].view(width) if len(column) else np.zeros(0, width)


def parts_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of about ``most`` ids at a time."""
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def count_ids(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0, np.int64)
    for part in parts_of(batches, BLOCK_IDS):
        now = np.bincount(flat_ids(part.column("ids"), width), minlength=len(seen))
        now[: len(seen)] += seen
        seen = now
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some], pa.int64())], names=["id", "n"])


def code(ranks: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data of all documents, and where each one's begin (with the ends)."""
    v = ranks.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    ends = np.r_[0, np.cumsum(size)]
    data = np.zeros(ends[-1], np.uint8)
    for b in range(4):
        has = size > b
        data[ends[:-1][has] + b] = (v[has] >> np.uint32(8 * b)).astype(np.uint8)
    first = np.cumsum(count) - count
    control = np.r_[0, np.cumsum((count + 3) // 4)]
    lengths = np.zeros(4 * control[-1], np.uint8)
    lengths[np.repeat(4 * control[:-1] - first, count) + np.arange(len(v))] = size - 1
    return (lengths.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8), control, data, ends[np.r_[first, len(v)]]


def decode(control: np.ndarray, data: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranks of all documents of a block."""
    lengths = LENGTHS[control].reshape(-1)
    first = np.cumsum(count) - count
    begin = np.cumsum((count + 3) // 4) - (count + 3) // 4
    lengths = lengths[np.repeat(4 * begin - first, count) + np.arange(int(count.sum()))].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    out = data[at].astype(np.uint32)
    for b in range(1, 4):
        has = lengths > b
        out[has] |= data[at[has] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def order_of(doc_id: np.ndarray, xx: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of rows that sort in the order of files."""
    out = np.empty(len(doc_id), "i8,i8,i8")
    out["f0"], out["f1"], out["f2"] = doc_id, xx, at
    return out


def encode(batches: Iterator[pa.RecordBatch], width: str, rank: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in parts_of(batches, BLOCK_IDS):
        count = part.column("n").to_numpy(zero_copy_only=False)
        control, c, data, d = code(rank[flat_ids(part.column("ids"), width)], count)
        doc_id = part.column("doc_id")
        key = order_of(doc_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), part.column("xx").to_numpy(), part.column("at").to_numpy())
        # The number of bounds at or below each row's key.
        both = np.argsort(np.concatenate([bounds, key]), kind="stable")
        file = np.empty(len(both), np.int32)
        file[both] = np.cumsum(both < len(bounds))
        yield pa.RecordBatch.from_arrays([pa.array(file[len(bounds) :]), doc_id, part.column("xx"), part.column("n"), binaries(control, c), binaries(data, d)], names=["file", "doc_id", "xx", "n", "control", "data"])


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (file, doc_id) to blocks of ``most`` ids, or one document if it has more."""
    file, block, held, size = None, 0, [], 0

    def done() -> pa.RecordBatch:
        ids, n, control, data = zip(*held, strict=True)
        row = [[file], [block], [list(ids)], [list(n)], [b"".join(control)], [b"".join(data)]]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["file", "block", "doc_ids", "counts", "control", "data"])

    for batch in batches:
        for f, *row in zip(*(batch.column(c).to_pylist() for c in ("file", "doc_id", "n", "control", "data")), strict=True):
            if held and (f != file or size + row[1] > most):
                yield done()
                block = block + 1 if f == file else 0
                held, size = [], 0
            file = f
            held.append(row)
            size += row[1]
    if held:
        yield done()


def write(docs: DataFrame, tokenizer_path: str, out: str, by_pieces: bool = True) -> None:
    """Token-ID files of ``docs`` (doc_id integer, text) under the path ``out``."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("xx"))
    width = "<u2" if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    ids = stash(own.mapInArrow(lambda it: tokenise(it, tokenizer_path, by_pieces, width), "doc_id bigint, xx bigint, n bigint, ids binary"))
    # One row for each id of the vocabulary at most.
    seen = ids.select("n", "ids").mapInArrow(lambda it: count_ids(it, width), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = [r.id for r in sorted(seen, key=lambda r: (-r.n, r.id))]
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    spark.createDataFrame([(order,)], "ids array<bigint>").coalesce(1).write.parquet(f"{out}/ranks")
    tokens, n = ids.agg(F.sum("n"), F.count("*")).first()
    parts = max(1, (tokens or 0) // FILE_IDS)
    keys = ids.withColumn("at", F.monotonically_increasing_id())
    wanted = min(SAMPLE, SAMPLED * parts)
    # At most about SAMPLE rows of three numbers.
    some = keys.select(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min).cast("long")).alias("doc_id"), "xx", "at").where(F.rand(5) < wanted / max(n, 1)).toArrow() if parts > 1 else None
    bounds = order_of(*(some.column(c).to_numpy() for c in ("doc_id", "xx", "at"))) if some is not None else order_of(*np.zeros((3, 0), np.int64))
    bounds = np.unique(np.sort(bounds)[(np.arange(1, parts) * len(bounds)) // parts]) if len(bounds) else bounds
    coded = keys.mapInArrow(lambda it: encode(it, width, rank, bounds), "file int, doc_id bigint, xx bigint, n bigint, control binary, data binary")
    ordered = coded.repartitionById(len(bounds) + 1, "file").sortWithinPartitions("doc_id", "xx")
    ordered.mapInArrow(lambda it: blocks(it, BLOCK_IDS), BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")


def read_blocks(batches: Iterator[pa.RecordBatch], ids: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            doc_id = batch.column("doc_ids").slice(i, 1).flatten()
            count = batch.column("counts").slice(i, 1).flatten().to_numpy()
            control, data = (np.frombuffer(batch.column(c)[i].as_py(), np.uint8) for c in ("control", "data"))
            found = ids[decode(control, data, count)]
            at = np.r_[0, np.cumsum(count)]
            raw = memoryview(found.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = len(count)
            columns = [pa.array(np.full(n, batch.column(c)[i].as_py(), np.int32)) for c in ("file", "block")] + [doc_id, pa.array(at[:-1], pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())]
            names = ["file", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files under ``path``."""
    ranked = spark.read.schema("ids array<bigint>").parquet(f"{path}/ranks").first()
    ids = np.array(ranked.ids if ranked else [], np.uint32)
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    schema = "file int, block int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    found = stored.mapInArrow(lambda it: read_blocks(it, ids, with_ids), schema)
    # Ids before a block: in its file, in the files of its group, in the groups before; one row for each, no task sees more than a file's, group's or all groups' rows.
    sizes = stash(stored.select("file", "block", (F.col("file") / GROUP).cast("int").alias("group"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")))
    up_to = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = sizes.groupBy("group", "file").agg(F.sum("n").alias("n"))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n"))
    in_file = sizes.select("group", "file", "block", up_to("group", "file", "block").alias("a"))
    in_group = files.select("group", "file", up_to("group", "file").alias("b"))
    before = in_file.join(in_group, ["group", "file"]).join(groups.select("group", up_to("group").alias("c")), "group")
    before = before.select("file", "block", (F.col("a") + F.col("b") + F.col("c")).alias("before"))
    return found.join(before, ["file", "block"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    spark = docs.sparkSession
    out = fresh(spark)
    write(docs, tokenizer_path, out)
    return read(spark, out)
