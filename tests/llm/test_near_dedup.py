import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import near_dedup as N
from textloom.llm import words as W

from .plain import classes, jaccard_p, shingles

SCHEMA = "doc_id long, text string, source string, lang string, size long"


def weighted(text):
    return {s: 1 + math.log(c) for s, c in shingles(text).items()}


def make(seed, n_bases=6, copies=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 60, 120)))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(t) + rng.choice(("", "!", " \n")))
    line = " ".join(rng.choice(vocabulary) for _ in range(9))
    return [*texts, "\n".join([line] * 20), "\n".join([line] * 25), "\n".join([line] * 20 + ["one more"])]


def test_words_match_the_pattern():
    from .plain import words

    for t in ["Hello, WORLD_1 déjà", "", "...", "a", "ÀB\x00c9-", "x" * 5000]:
        assert len(W.word_list(t)) == len(words(t))
    a, b = W.word_list("One two ONE"), W.word_list("one")
    assert a[0] == a[2] == b[0] != a[1]


def test_similarity_is_probability_jaccard():
    rng = random.Random(1)
    for _ in range(30):
        a = {rng.randrange(12): rng.choice((1.0, 2.0, 3.5)) for _ in range(8)}
        b = {rng.randrange(12): rng.choice((1.0, 2.0)) for _ in range(8)}
        pair = np.zeros(len(a) + len(b), np.int64)
        ids = np.array([*a, *b], np.uint64)
        x = np.array([*a.values(), *[0] * len(b)], float)
        y = np.array([*[0] * len(a), *b.values()], float)
        assert N.similarities(pair, ids, x, y, 1)[0] == pytest.approx(jaccard_p(a, b))


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(3)
    ids = W.mix(np.arange(1, 101, dtype=np.uint64))
    wa, wb = rng.choice([1.0, 2.0], 80), rng.choice([1.0, 2.0], 80)
    m = 4096
    sig = N.signatures(np.r_[ids[:80], ids[20:]], np.r_[np.zeros(80, int), np.ones(80, int)], np.r_[wa, wb], 2, m)
    want = jaccard_p(dict(zip(ids[:80].tolist(), wa)), dict(zip(ids[20:].tolist(), wb)))
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)
    assert (N.signatures(ids[:1], np.zeros(1, int), np.ones(1), 1, 64) == ids[0]).all()


@pytest.mark.parametrize("seed", [0, 1])
def test_classes_match_all_pairs(spark, seed):
    texts = make(seed)
    rows = [(i, t, "s", "en", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA), unit=8).collect()}
    sets = [weighted(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard_p(sets[i], sets[j]) >= 0.8]
    assert got == classes(links, range(len(texts)))


def test_block_links_join_what_all_pairs_join():
    texts = make(5)
    sets = [weighted(t) for t in texts]
    n = len(texts)
    names = [f"{i:016d}".encode() for i in range(n)]
    table = pa.table({"node": names * 2, "label": names * 2, "block": [0] * n + [1] * n, "text": texts * 2})
    links = N.within(table, 5, 0.8)
    assert links.num_rows < n
    got = classes([(int(a), int(b)) for a, b in zip(links["node"].to_pylist(), links["centre"].to_pylist())], range(n))
    assert got == classes([(i, j) for i in range(n) for j in range(i) if jaccard_p(sets[i], sets[j]) >= 0.8], range(n))


def test_odd_rows(spark):
    rows = [(1, None, "a", None, None), (2, None, "a", None, None), (3, "", "a", None, None), (4, "", None, None, None), (5, "!!", "b", "x", 1), (6, "!!", "b", "x", 1), (7, "one two", "b", "x", 1), (7, "one two", "b", "x", 1), (None, "one two", "b", "x", 1), (None, "a b c d e f", "b", "x", 1)]
    got = [(r.doc_id, r.class_id) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (7, 7), (None, 7), (None, None)], key=str)
    kept = N.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "source", "lang", "size"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 5, 7, None], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert N.near_duplicates(docs).count() == 0
    assert N.keep_one(docs).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_recall_on_the_documents(spark):
    """Pairs of different texts at 0.8 or more, found by brute force over an index of all shingles: at least 0.9 must share a class, and no class joins texts that no chain of such pairs joins."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.text is not None}
    sets = {i: weighted(t) for i, t in text.items()}
    holders, shared = {}, {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for held in holders.values():
        for n, a in enumerate(held):
            for b in held[:n]:
                shared[b, a] = shared.get((b, a), 0) + 1
    # No pair reaches 0.8 that shares less than half of the shingles of either text.
    pairs = [(a, b) for (a, b), n in shared.items() if 2 * n >= max(len(sets[a]), len(sets[b]))]
    links = [(a, b) for a, b in pairs if sets[a] == sets[b] or jaccard_p(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    apart = [(a, b) for a, b in links if sets[a] != sets[b]]
    assert len(apart) >= 10 and sum(got[a] == got[b] for a, b in apart) >= 0.9 * len(apart)
    want = classes(links, sets)
    assert all(want[i] == want[got[i]] for i in sets if sets[i])
