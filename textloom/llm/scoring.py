"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

Each word is predicted from the ``REACH`` words before it and after it; its own place is masked. The network,
in numpy, sums an embedding of each neighbour through a matrix for its offset, applies
tanh and gives a distribution over word classes; p(word) = p(class | neighbours) * p(word | class), with the
second factor from the corpus count of every word. Classes hold about equal shares of all tokens: the commonest words have one
of their own, other known words share some in order of frequency, and the words of the tail share classes of like
counts, so that for these the count says the class and p(word | class). A document's score is the sum of its
words' conditional log-probabilities; per word it compares documents of any length.

What is learned comes from the whole corpus. Words are counted over all documents (summed in
each task before the shuffle). Known words, which have an embedding each, are the commonest ones, about
``GROWTH`` times the root of the number of tokens, and the tail is hashed to a quarter as many. Texts are then encoded once,
by slices: a slice asks for the counts of its tail words block by block of their hashes, as no task holds all counts.
Then each task trains on its own slices, starting from the same weights, and the weights are averaged, embeddings by how often a
task met them and the others by its numbers of tokens. ``ROUNDS`` such rounds are made, each over every ``ROUNDS``-th
position from another start, so that each word is a target once. Weights travel as pieces summed in two levels, so that
no task and not the driver receives every task's weights.

Defined results: null, empty and wordless texts have 0 tokens, score 0 and mean null; repeated rows
are scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import stash

VOCABULARY, CLASSES, OTHER = 4096, 96, 64  # the first and last at least
GROWTH = 8
REACH, WIDTH, HIDDEN = 2, 16, 32
ROUNDS, BATCH, RATE, CLIP = 2, 2048, 2.0, 5.0
PIECE = 1 << 14
BLOCKS, ASKED = 32, 4_000_000  # blocks of word hashes at least, and rows of counts a block


class Vocabulary:
    """Known words (sorted hashes) with each one's class and log p(word | class); the same for the counts (``level``) of all other words, which share ``other`` inputs.

    ``tail`` has (count, number of words with it) of the words not in ``counts``; without it they count alike.
    """

    def __init__(self, counts: list[tuple[int, int]], all_tokens: int, all_words: int, tail: list[tuple[int, int]] | None = None, other: int = OTHER) -> None:
        counts = sorted(counts, key=lambda c: (-c[1], c[0]))
        n = np.array([c[1] for c in counts], np.float64)
        if tail is None:
            tail = [((all_tokens - n.sum()) / (all_words - len(counts)), all_words - len(counts))] if all_words > len(counts) else []
        tail = np.array(sorted(tail), np.float64).reshape(-1, 2)
        self.level, of_level = tail[:, 0], tail[:, 0] * tail[:, 1]
        # Frequent words take a class each; then known words and counts of the tail fill classes of equal mass.
        single = min(len(counts), CLASSES // 2)
        rest, others = n[single:].sum(), of_level.sum()
        last = int(np.clip(round((CLASSES - single) * others / max(rest + others, 1)), 1, CLASSES - 1 - single))

        def equal(mass: np.ndarray, first: int, many: int) -> np.ndarray:
            return first + np.minimum((np.cumsum(mass) - mass) / max(mass.sum(), 1) * many, many - 1).astype(np.int64)

        cls = np.r_[np.arange(single), equal(n[single:], single, CLASSES - single - last)].astype(np.int64)
        self.level_cls = equal(of_level[::-1], CLASSES - last, last)[::-1]
        mass = np.bincount(cls, weights=n, minlength=CLASSES) + np.bincount(self.level_cls, weights=of_level, minlength=CLASSES)
        inside = np.log(n / mass[cls]) if len(n) else n
        self.level_inside = np.log(self.level / mass[self.level_cls]).astype(np.float32)
        hashed = np.array([c[0] % (1 << 64) for c in counts], np.uint64)
        order = np.argsort(hashed)
        self.hashed, self.cls, self.inside = hashed[order], cls[order], inside[order].astype(np.float32)
        self.prior = np.log((mass + 1) / (all_tokens + CLASSES)).astype(np.float32)
        self.size, self.other = len(counts), other
        self.inputs = 1 + other + self.size

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input number of each word (0 is outside the text), and whether it is known."""
        hashed = 1 + (words % np.uint64(self.other)).astype(np.int32)
        if not self.size:
            return hashed, np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.hashed, words), self.size - 1)
        known = self.hashed[at] == words
        return np.where(known, 1 + self.other + at, hashed).astype(np.int32), known

    def classed(self, number: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and log p(word | class) of words by their inputs, with ``level`` of those not known."""
        known = number > self.other
        cls, inside = np.zeros(len(number), np.int64), np.zeros(len(number), np.float32)
        at = number[known] - 1 - self.other
        cls[known], inside[known] = self.cls[at], self.inside[at]
        cls[~known], inside[~known] = self.level_cls[level], self.level_inside[level]
        return cls, inside


class Network:
    def __init__(self, inputs: int, prior: np.ndarray, flat: np.ndarray | None = None) -> None:
        shapes = [(inputs, WIDTH), (2 * REACH * WIDTH, HIDDEN), (HIDDEN, CLASSES), (1, CLASSES)]
        if flat is None:
            rng = np.random.default_rng(17)
            flat = np.concatenate([rng.normal(0, 0.3, shapes[0]).ravel(), rng.normal(0, 0.15, shapes[1]).ravel(), rng.normal(0, 0.05, shapes[2]).ravel(), prior.ravel()]).astype(np.float32)
        self.flat = flat.copy()
        at = np.r_[0, np.cumsum([a * b for a, b in shapes])]
        self.embed, self.mixed, self.out, self.bias = (self.flat[i:j].reshape(s) for i, j, s in zip(at[:-1], at[1:], shapes, strict=True))
        self.met = np.zeros(inputs, np.int64)

    def forward(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.take(self.embed, near.ravel(), axis=0).reshape(len(near), -1)
        h = np.tanh(x @ self.mixed)
        z = h @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return x, h, z

    def log_p(self, near: np.ndarray, cls: np.ndarray) -> np.ndarray:
        _, _, z = self.forward(near)
        own = z[np.arange(len(z)), cls]
        return own - np.log(np.exp(z).sum(1))

    def learn(self, near: np.ndarray, cls: np.ndarray, rate: float) -> None:
        x, h, z = self.forward(near)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), cls] -= 1
        dh = (p @ self.out.T) * (1 - h * h)
        dx = (dh @ self.mixed.T).reshape(-1, WIDTH)
        n = len(near)
        for w, g in ((self.out, h.T @ p), (self.mixed, x.T @ dh), (self.bias, p.sum(0, keepdims=True))):
            g /= n
            w -= rate * g / max(1.0, float(np.linalg.norm(g)) / CLIP)
        # Input and place in one number sort faster than a stable argsort.
        both = np.sort((near.ravel().astype(np.int64) << 32) + np.arange(near.size))
        flat, dx = both >> 32, np.take(dx, both & 0xFFFFFFFF, axis=0)
        head = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        count = np.diff(np.r_[head, len(flat)])[:, None]
        self.met[flat[head]] += count[:, 0]
        # A word's step is its mean gradient times the root of its count, so that rare words move too.
        self.embed[flat[head]] -= rate * np.add.reduceat(dx, head, axis=0) / np.sqrt(count) / np.sqrt(n)


def contexts(number: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Input numbers of the neighbours of the words ``at``; 0 beyond the text."""
    n = len(number)
    out = np.zeros((len(at), 2 * REACH), np.int32)
    for j, o in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        to = np.clip(at + o, 0, n - 1)
        out[:, j] = np.where((at + o >= 0) & (at + o < n) & (doc[to] == doc[at]), number[to], 0)
    return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and counts, summed over some tens of MB at a time."""
    held: list[np.ndarray] = []
    sums: list[np.ndarray] = []

    def merged() -> pa.RecordBatch:
        word, which = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate(sums)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for part in W.slices(batch):
            word, n = np.unique(W.words(*W.raw(part.column("text")))[0], return_counts=True)
            held.append(word)
            sums.append(n)
            if sum(map(len, held)) > 2_000_000:
                yield merged()
                held, sums = [], []
    if held:
        yield merged()


def sliced(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Slices of texts: ids, words a text, inputs of all words, distinct words of the tail, and for each word of the tail its place among these."""
    task = TaskContext.get()
    at = (task.partitionId() if task else 0) << 32
    for batch in batches:
        for part in W.slices(batch):
            hashed, doc = W.words(*W.raw(part.column("text")))
            number, known = vocabulary.look_up(hashed)
            tail, place = np.unique(hashed[~known], return_inverse=True)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
            n = np.bincount(doc, minlength=part.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in (n, number, tail, place.astype(np.int32)))], names=["slice", "ids", "n", "number", "tail", "place"])
            at += 1


def by_block(words: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts words by their blocks, each block's in their own order, and where blocks begin and end in it."""
    block = (W.mix(words) % np.uint64(blocks)).astype(np.int64)
    return np.argsort(block, kind="stable"), np.r_[0, np.cumsum(np.bincount(block, minlength=blocks))]


BLOCK_SCHEMA = "block int, slice bigint, words binary, n binary"


def asked(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """The words of the tail that slices ask for, or (without slices) counts of words, by block."""
    for batch in batches:
        counts = "word" in batch.schema.names
        rows = [(None, batch.column("word").to_numpy().view(np.uint64), batch.column("n").to_numpy())] if counts else [(k, np.frombuffer(t, np.uint64), None) for k, t in zip(batch.column("slice").to_pylist(), batch.column("tail").to_pylist(), strict=True)]
        for k, words, n in rows:
            order, ends = by_block(words, blocks)
            some = [j for j in range(blocks) if ends[j] < ends[j + 1]]
            at = [order[ends[j] : ends[j + 1]] for j in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([k] * len(some), pa.int64()), pa.array([words[i].tobytes() for i in at], pa.binary()), pa.array([None if n is None else n[i].tobytes() for i in at], pa.binary())], names=["block", "slice", "words", "n"])


def answered(table: pa.Table, level: np.ndarray) -> pa.Table:
    """For each slice that asks, the levels of its words of this block."""
    rows = table.to_pylist()
    word = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["words"], np.uint64) for r in rows if r["slice"] is None)])
    n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["n"], np.int64) for r in rows if r["slice"] is None)])
    order = np.argsort(word)
    word, found = word[order], np.searchsorted(level, n[order]).astype(np.int32)
    asking = [r for r in rows if r["slice"] is not None]
    return pa.table({"slice": pa.array([r["slice"] for r in asking], pa.int64()), "block": pa.array([r["block"] for r in asking], pa.int32()), "level": pa.array([found[np.searchsorted(word, np.frombuffer(r["words"], np.uint64))].tobytes() for r in asking], pa.binary())})


def levelled(own: pa.Table, answers: pa.Table, blocks: int) -> pa.Table:
    """A slice with the levels of its words of the tail in text order."""
    row = own.select(["tail", "place"]).to_pylist()[0]
    order, _ = by_block(np.frombuffer(row["tail"], np.uint64), blocks)
    level = np.zeros(len(order), np.int32)
    level[order] = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x.as_py(), np.int32) for x in answers.sort_by("block").column("level"))])
    return own.select(["ids", "n", "number"]).append_column("level", pa.array([level[np.frombuffer(row["place"], np.int32)].tobytes()], pa.binary()))


def read(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of encoded slices: ids, words a text; input, text, class and log p(word | class) of each word."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, number, level = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in (("n", np.int64), ("number", np.int32), ("level", np.int32)))
            yield batch.column("ids").slice(i, 1).flatten() if "ids" in batch.schema.names else None, n, number, np.repeat(np.arange(len(n)), n), *vocabulary.classed(number, level)


WEIGHTS = "piece int, part int, at binary, met binary, weights binary"


def train(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, flat: np.ndarray | None, turn: int, rounds: int, rate: float) -> Iterator[pa.RecordBatch]:
    net = Network(vocabulary.inputs, vocabulary.prior, flat)
    seen = 0
    for _, _, number, doc, cls, _ in read(batches, vocabulary):
        at = np.arange(turn, len(number), rounds)
        at = at[np.argsort(W.mix(number[at].astype(np.uint64) * W.ROLL + at.astype(np.uint64)), kind="stable")]  # not text by text
        for i in range(0, len(at), BATCH):
            some = at[i : i + BATCH]
            net.learn(contexts(number, doc, some), cls[some], rate * np.sqrt(len(some) / BATCH))
        seen += len(at)
    if not seen:
        return
    task = TaskContext.get()
    me = task.partitionId() if task else 0
    # Piece -1 has all but the embeddings; the others have those that were met.
    pieces = [(-1, np.zeros(1, np.int64), np.array([seen]), net.flat[None, net.embed.size :])]
    met = np.flatnonzero(net.met)
    for at in np.split(met, np.searchsorted(met, np.arange(PIECE, vocabulary.inputs, PIECE))):
        if len(at):
            pieces.append((int(at[0]) // PIECE, at, net.met[at], net.embed[at]))
    for piece, at, n, w in pieces:
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([me], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at, n, (w * n[:, None].astype(np.float64)).astype(np.float32)))], names=["piece", "part", "at", "met", "weights"])


def added(table: pa.Table) -> pa.Table:
    rows = table.sort_by("part").to_pylist()
    ats = [np.frombuffer(r["at"], np.int64) for r in rows]
    at = np.unique(np.concatenate(ats))
    met, total = np.zeros(len(at), np.int64), np.zeros((len(at), len(rows[0]["weights"]) // 4 // len(ats[0])))
    for r, own in zip(rows, ats, strict=True):
        to = np.searchsorted(at, own)
        met[to] += np.frombuffer(r["met"], np.int64)
        total[to] += np.frombuffer(r["weights"], np.float32).reshape(len(own), -1)
    return pa.table({"piece": pa.array([rows[0]["piece"]], pa.int32()), "part": pa.array([rows[0]["part"]], pa.int32()), "at": pa.array([at.tobytes()], pa.binary()), "met": pa.array([met.tobytes()], pa.binary()), "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def score(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, flat: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    net = Network(vocabulary.inputs, vocabulary.prior, flat)
    for ids, n, number, doc, cls, inside in read(batches, vocabulary):
        log_p = inside.astype(np.float64)
        for i in range(0, len(number), 4 * BATCH):
            at = np.arange(i, min(i + 4 * BATCH, len(number)))
            log_p[at] += net.log_p(contexts(number, doc, at), cls[at])
        total = np.bincount(doc, weights=log_p, minlength=len(n))
        mean = total / np.maximum(n, 1)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(total), pa.array(mean, mask=n == 0)], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])


def counted(docs: DataFrame) -> tuple[DataFrame, Vocabulary, int]:
    """Counts of all words, the vocabulary, and the least count of a known word."""
    counts = stash(docs.select("text").mapInArrow(count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    # Distinct counts are at most about the root of twice the number of tokens.
    levels = sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    tokens, words = sum(n * w for n, w in levels), sum(w for _, w in levels)
    most = max(VOCABULARY, int(GROWTH * tokens**0.5))
    known = int(np.searchsorted(np.cumsum([w for _, w in levels]), most, "right"))
    least = levels[known - 1][0] if known else tokens + 1
    top = counts.where(F.col("n") >= least).toArrow() if known else None
    pairs = list(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True)) if known else []
    return counts, Vocabulary(pairs, tokens, words, levels[known:], max(OTHER, most // 4) if most > VOCABULARY else OTHER), least


def encoded(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, least: int) -> DataFrame:
    """Slices of ``docs`` as ids, words a text, inputs of words, and levels of those of the tail."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = f"ids array<{kind}>, n binary, number binary"
    slices = stash(docs.select("doc_id", "text").mapInArrow(lambda it: sliced(it, vocabulary), f"slice bigint, {own}, tail binary, place binary"))
    blocks = max(BLOCKS, -(-int((vocabulary.level.sum() and slices.agg(F.coalesce(F.sum(F.octet_length("tail")), F.lit(0))).first()[0]) // 8) // ASKED))
    wanted = slices.select("slice", "tail").mapInArrow(lambda it: asked(it, blocks), BLOCK_SCHEMA)
    stored = counts.where(F.col("n") < least).mapInArrow(lambda it: asked(it, blocks), BLOCK_SCHEMA)
    level = vocabulary.level
    answers = wanted.unionByName(stored).groupBy("block").applyInArrow(lambda t: answered(t, level), "slice bigint, block int, level binary")
    return stash(slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda a, b: levelled(a, b, blocks), f"{own}, level binary"))


def fit(slices: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, salts: int = 64) -> np.ndarray | None:
    """Weights of the network after training on encoded slices; none without a word. ``salts``: groups that pieces are summed in first."""
    text, flat = slices.select("n", "number", "level"), None
    for turn in range(rounds):
        start = flat
        learned = text.mapInArrow(lambda it, s=start, t=turn: train(it, vocabulary, s, t, rounds, RATE / (1 + t)), WEIGHTS)
        first = learned.groupBy("piece", F.pmod("part", F.lit(salts)).alias("salt")).applyInArrow(added, WEIGHTS)
        rows = first.groupBy("piece").applyInArrow(added, WEIGHTS).collect()
        net = Network(vocabulary.inputs, vocabulary.prior, start)
        for r in rows:
            at, met = np.frombuffer(r.at, np.int64), np.frombuffer(r.met, np.int64)
            w = np.frombuffer(r.weights, np.float32).reshape(len(at), -1) / met[:, None].astype(np.float32)
            if r.piece < 0:
                net.flat[net.embed.size :] = w[0]
            else:
                net.embed[at] = w
        flat = net.flat if rows else flat
    return flat


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum) and mean_log_prob of every row of ``docs`` (doc_id, text)."""
    counts, vocabulary, least = counted(docs)
    slices = encoded(docs, counts, vocabulary, least)
    # Two levels of about as many rows each.
    flat = fit(slices, vocabulary, salts=max(1, int(slices.rdd.getNumPartitions() ** 0.5)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slices.mapInArrow(lambda it: score(it, vocabulary, flat), f"doc_id {kind}, n_tokens bigint, log_prob double, mean_log_prob double")
