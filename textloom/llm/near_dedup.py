"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Each text is a weighted set of shingles of five words (lower-cased A-Z); a shingle
found c times weighs 1 + ln c. A signature register holds the shingle with the
earliest arrival among exponential arrivals of rate = weight (a Poisson process per
shingle, each arrival in one random register); a shingle stops once its next arrival is
later than every register's. Two registers agree with the probability Jaccard similarity

    J_P(x, y) = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i).

Texts that share a band of registers are candidates, and candidates are linked when
their exact J_P reaches the threshold; classes are the components of the links.

How candidates are compared without emitting all pairs of a bucket: texts with equal
shingles are one node; every bucket's nodes are compared with one centre; then, in
buckets that still hold several components of the links found, with the member that has the most
links, for some rounds; last, in the few buckets still open, members outside the largest
component with all others, in blocks of bounded size. A block emits no more links than
join its members (pairs already in one component are passed over).

Defined results: a null text is a class of its own; equal texts (also empty ones or those
without a word) are one class; a text of fewer than five words is one shingle; class_id is
the least doc_id of the class (null if the class has none); rows that repeat are all
returned. Other columns are ignored, so extra ones don't clash. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import components, stash

SHINGLE, THRESHOLD = 5, 0.8
#: 20 bands of 4 registers: a pair at 0.8 is missed with probability (1 - 0.8 ** 4) ** 20 < 3e-5.
BANDS, ROWS = 20, 4
#: Rounds with other centres; nodes and shingles in one block of a bucket that is compared fully; columns of a matrix at a time.
HUBS, UNIT, UNIT_SHINGLES, COLUMNS = 1, 256, 1_000_000, 2048
INF = np.inf


def signatures(ids: np.ndarray, at: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) shingle ids; rows of texts without shingles are 0."""
    best = np.full(n_docs * m, INF)
    held = np.zeros(n_docs * m, np.uint64)
    time = np.zeros(len(ids))
    step = np.zeros(1, np.uint64)
    while len(ids):
        step += np.uint64(0x9E3779B97F4A7C15)
        r = W.mix(ids + step)
        time = time - np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight
        slot = at * m + (W.mix(r) % np.uint64(m)).astype(np.int64)
        win = time < best[slot]
        s, t, x = slot[win], time[win], ids[win]
        np.minimum.at(best, s, t)
        own = t == best[s]
        held[s[own]] = x[own]
        limit = best.reshape(n_docs, m).max(1)
        go = time < limit[at]
        ids, at, weight, time = ids[go], at[go], weight[go], time[go]
    return held.reshape(n_docs, m)


def weigh(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def described(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offs = W.raw(column)
    ids, at = W.shingles(*W.words(data, offs), len(column), k)
    ids, at, count = W.counted(ids, at)
    return ids, at, weigh(count)


def sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, xx, text) to (doc_id, xx, node, size in shingles, bands). node: 16 bytes, equal for equal shingle counts; null for null texts."""
    for batch in batches:
        for part in W.slices(batch):
            text = part.column("text")
            n = len(text)
            ids, at, weight = described(text, k)
            sig = signatures(ids, at, weight, n, bands * rows)
            keys = np.zeros((n, bands), np.uint64)
            for b in range(bands):
                x = np.full(n, b + 1, np.uint64)
                for r in range(rows):
                    x = W.mix(x * W.ROLL + sig[:, b * rows + r])
                keys[:, b] = x
            some = np.bincount(at, minlength=n) > 0
            w = weight.view(np.uint64) | np.uint64(1)
            pair = np.zeros((n, 2), np.uint64)
            head = np.flatnonzero(np.r_[len(at) > 0, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            for c in range(2):
                if len(head):
                    pair[at[head], c] = np.add.reduceat(W.mix(W.mix(ids + np.uint64(c * 77 + 1)) * w), head)
            flat = pair.tobytes()
            node = [None if not v.is_valid else flat[i * 16 : i * 16 + 16] if some[i] else hashlib.md5(b"no word\0" + v.as_py().encode()).digest() for i, v in enumerate(text)]
            held = keys[some].view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("xx"), pa.array(node, pa.binary()), pa.array(np.bincount(at, minlength=n), pa.int64()), pa.ListArray.from_arrays(np.r_[0, np.cumsum(some * bands)].astype(np.int32), pa.array(held, pa.int64()))], names=["doc_id", "xx", "node", "size", "bands"]
            )


def similarities(pair: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """J_P of n pairs from rows (pair, id, weight in the first or 0, weight in the second or 0)."""
    out = np.zeros(n)
    if not len(pair):
        return out
    order = np.lexsort((ids, pair))
    pair, ids, x, y = pair[order], ids[order], x[order], y[order]
    head = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (ids[1:] != ids[:-1])])
    pair, x, y = pair[head], np.add.reduceat(x, head), np.add.reduceat(y, head)
    with np.errstate(divide="ignore"):
        order = np.lexsort((x / y, pair))
    pair, x, y = pair[order], x[order], y[order]
    head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    seg = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(pair)]))
    cx, cy = np.cumsum(x) - x, np.cumsum(y) - y
    rest = np.add.reduceat(x, head)[seg] - (cx - cx[head][seg])
    before = cy - cy[head][seg]
    both = (x > 0) & (y > 0)
    term = np.zeros(len(pair))
    term[both] = 1.0 / (rest[both] / x[both] + before[both] / y[both])
    out[pair[head]] = np.add.reduceat(term, head)
    return out


def verify(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, centre, text, other) to the pairs (node, centre) whose J_P reaches the threshold."""
    for batch in batches:
        for part in W.slices(batch, limit=W.BLOCK // 2):
            a, b = described(part.column("text"), k), described(part.column("other"), k)
            zero = np.zeros(len(a[0])), np.zeros(len(b[0]))
            sim = similarities(np.r_[a[1], b[1]], np.r_[a[0], b[0]], np.r_[a[2], zero[1]], np.r_[zero[0], b[2]], part.num_rows)
            yield part.select(["node", "centre"]).filter(pa.array(sim >= threshold - 1e-9))


def shared_weights(ids: np.ndarray, at: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of a left and a right text, the weight that the left one has in shared shingles, and the right one."""
    n = int(max(left.max(initial=-1), right.max(initial=-1))) + 1
    _, local, count = np.unique(ids, return_inverse=True, return_counts=True)
    some = count[local] > 1  # a shingle of one text alone is shared with none
    order = np.argsort(local[some], kind="stable")
    local, at, weight = np.unique(local[some], return_inverse=True)[1][order], at[some][order], weight[some][order]
    ours, theirs = np.zeros((2, len(left), len(right)), np.float32)
    cuts = np.searchsorted(local, np.arange(0, (local[-1] if len(local) else -1) + 1 + COLUMNS, COLUMNS))
    for c, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        held = np.zeros((n, COLUMNS), np.float32)
        held[at[i:j], local[i:j] - c * COLUMNS] = weight[i:j]
        some = (held > 0).astype(np.float32)
        ours += held[left] @ some[right].T
        theirs += some[left] @ held[right].T
    return ours, theirs


def within(group: pa.Table, k: int, threshold: float) -> pa.Table:
    """Links that join members of block 0 to those of block 1, none between members that are joined already.

    Shared weights of all pairs come from matrix products. They give J_P itself where all weights are 1, else a bound
    (no pair exceeds the part of either text's weight that is shared), and pairs that reach it are computed one by one.
    """
    group = group.combine_chunks()
    names, label, block = (group.column(c).to_pylist() for c in ("node", "label", "block"))
    ids, at, weight = described(group.column("text").combine_chunks(), k)
    n = group.num_rows
    offs = np.searchsorted(at, np.arange(n + 1))
    total = np.bincount(at, weights=weight, minlength=n)
    plain = np.bincount(at, weights=weight != 1, minlength=n) == 0
    side = np.array(block)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    ours, theirs = shared_weights(ids, at, weight, left, right)
    x, y = total[left][:, None], total[right][None, :]
    exact = plain[left][:, None] & plain[right][None, :]
    number = np.unique(np.array([x.hex() for x in label]), return_inverse=True)[1]
    apart = number[left][:, None] != number[right][None, :]
    low = threshold - 1e-6
    sure = apart & exact & (ours / np.maximum(x + y - ours, 1e-9) >= low)
    maybe = apart & ~exact & (np.minimum(ours / np.maximum(x, 1e-9), theirs / np.maximum(y, 1e-9)) >= low)
    root = list(range(int(number.max(initial=-1)) + 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []

    def link(i: int, j: int) -> None:
        a, b = find(number[i]), find(number[j])
        if a != b:
            root[a] = b
            links.append((names[i], names[j]))

    for i, j in zip(*np.nonzero(sure), strict=True):
        link(left[i], right[j])
    open_pairs = [(left[i], right[j]) for i, j in zip(*np.nonzero(maybe), strict=True)]
    for c in range(0, len(open_pairs), 64):
        few = [(i, j) for i, j in open_pairs[c : c + 64] if find(number[i]) != find(number[j])]
        if not few:
            continue
        a, b = [slice(offs[i], offs[i + 1]) for i, _ in few], [slice(offs[j], offs[j + 1]) for _, j in few]
        n_a, n_b = [s.stop - s.start for s in a], [s.stop - s.start for s in b]
        pair = np.r_[np.repeat(np.arange(len(few)), n_a), np.repeat(np.arange(len(few)), n_b)]
        own = np.concatenate([ids[s] for s in (*a, *b)])
        w_a, w_b = np.concatenate([weight[s] for s in a]), np.concatenate([weight[s] for s in b])
        sim = similarities(pair, own, np.r_[w_a, np.zeros(len(w_b))], np.r_[np.zeros(len(w_a)), w_b], len(few))
        for (i, j), s in zip(few, sim, strict=True):
            if s >= threshold - 1e-9:
                link(i, j)
    return pa.table({"node": pa.array([a for a, _ in links], pa.binary()), "centre": pa.array([b for _, b in links], pa.binary())})


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, unit: int = UNIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, xx (xxhash64 of the text), label (16 bytes, the class), class_id."""
    own = docs.select("doc_id", F.xxhash64("text").alias("xx"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stash(own.mapInArrow(lambda it: sign(it, k, bands, rows), f"doc_id {kind}, xx bigint, node binary, size bigint, bands array<bigint>"))
    nodes = signed.where("node is not null and size(bands) > 0").groupBy("node").agg(F.min_by(F.struct("doc_id", "xx", "size", "bands"), F.struct("doc_id", "xx")).alias("r")).select("node", "r.*")
    nodes = stash(nodes)
    placed = nodes.select("node", "size", F.explode("bands").alias("band"))
    centres = placed.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n"), F.sum("size").alias("sizes")).where("n > 1")
    shared = stash(placed.join(centres, "band"))
    pairs = shared.where("node != centre").select("node", "centre").distinct()

    wanted = shared.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("id"), F.col("xx").alias("x")), "node")
    texts = stash(own.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("xx") == F.col("x"))).dropDuplicates(["node"]).select("node", "text"))
    faced = pairs.join(texts, "node").join(texts.select(F.col("node").alias("centre"), F.col("text").alias("other")), "centre").select("node", "centre", "text", "other")
    links = stash(faced.mapInArrow(lambda it: verify(it, k, threshold), "node binary, centre binary"))
    comps = components(links, "node", "centre")

    def open_buckets() -> DataFrame:
        """Members of the buckets that hold several components, one bucket of those with the same members: band, node, n, label."""
        tagged = shared.where("n > 2").join(comps, "node", "left").select("band", "node", "n", "size", "sizes", F.coalesce("label", "node").alias("label"))
        split = tagged.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("set"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).where("lo != hi")
        return stash(tagged.join(split.groupBy("set", "sum").agg(F.min("band").alias("band")).select("band"), "band"))

    def joined(comps: DataFrame, more: DataFrame) -> DataFrame:
        """Components with more links: only their labels are contracted."""
        ends = [more.select(F.col(c).alias("node")) for c in ("node", "centre")]
        known = stash(comps.unionByName(ends[0].unionByName(ends[1]).distinct().join(comps, "node", "left_anti").select("node", F.col("node").alias("label"))))
        a, b = known.select("node", F.col("label").alias("a")), known.select(F.col("node").alias("centre"), F.col("label").alias("b"))
        met = components(more.join(a, "node").join(b, "centre"), "a", "b").select(F.col("node").alias("label"), F.col("label").alias("to"))
        return stash(known.join(met, "label", "left").select("node", F.coalesce("to", "label").alias("label")))

    for _ in range(HUBS):
        # Centres with the most links so far: what many are near copies of comes first.
        held = open_buckets()
        degree = links.select("node").unionByName(links.select(F.col("centre").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
        hub = held.join(degree, "node", "left").groupBy("band").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "node", F.col("label").alias("own"))).alias("hub"))
        more = held.join(hub, "band").where("label != hub.own").select("node", F.col("hub.node").alias("centre")).distinct().join(links, ["node", "centre"], "left_anti")
        more = more.join(texts, "node").join(texts.select(F.col("node").alias("centre"), F.col("text").alias("other")), "centre").select("node", "centre", "text", "other")
        more = stash(more.mapInArrow(lambda it: verify(it, k, threshold), "node binary, centre binary"))
        if more.isEmpty():
            break
        links, comps = links.unionByName(more), joined(comps, more)

    # What is left: members outside a bucket's largest component are compared with all of other components, block by block.
    held = open_buckets()
    largest = held.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("size").alias("s")).groupBy("band").agg(F.max(F.struct("c", "label", "s")).alias("top"))
    blocks = lambda n, size: F.ceil(F.greatest(n / F.lit(unit), size / F.lit(UNIT_SHINGLES))).cast("int")
    sized = held.join(largest, "band").withColumns({"minor": F.col("label") != F.col("top.label"), "rows": blocks(F.col("n") - F.col("top.c"), F.col("sizes") - F.col("top.s")), "columns": blocks(F.col("n"), F.col("sizes"))})
    at = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    sides = sized.where("minor").select("band", "node", "label", F.lit(0).alias("block"), at("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j")).unionByName(
        sized.select("band", "node", "label", F.lit(1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), at("columns").alias("j"))
    )
    more = stash(sides.join(texts, "node").groupBy("band", "i", "j").applyInArrow(lambda t: within(t, k, threshold), "node binary, centre binary").distinct())
    if not more.isEmpty():
        comps = joined(comps, more)

    classed = signed.select("doc_id", "xx", "node").join(comps, "node", "left").select("doc_id", "xx", F.coalesce("label", "node").alias("label"))
    least = classed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return classed.join(least, "label", "left").select("doc_id", "xx", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, **knobs) -> DataFrame:
    """``docs`` with one row left of each class: the one of the least doc_id (of rows that repeat it, any one); null texts all stay."""
    found = near_duplicates(docs, **knobs)
    first = found.where("label is not null").where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", F.col("doc_id").alias("doc")).agg(F.min("xx").alias("xx"))
    # Whole rows travel as one column, so their names clash with nothing.
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_xx"), F.col("text").isNull().alias("none"))
    kept = own.where("not none").join(first, F.col("doc").eqNullSafe(F.col("_id")) & (F.col("xx") == F.col("_xx"))).dropDuplicates(["label"])
    return kept.select("row.*").unionByName(docs.where("text is null"))
