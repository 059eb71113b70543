import hashlib
import random

from textloom.llm import decontaminate as D

from .plain import words


def plain(text, items, width=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        k = min(width, len(v))
        for i in range(len(v) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def fixture():
    rng = random.Random(2)
    v = ["the", "of", "a"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice((1, 3, 10, 25))))) for i in range(10)] + [(7, "The of A"), (11, "..."), (12, ""), (13, None)]
    docs = []
    for i in range(60):
        t = [rng.choice(v) for _ in range(rng.choice((0, 5, 40)))]
        for _ in range(rng.randrange(3)):
            x = words(rng.choice(items)[1])
            a = rng.randrange(len(x) + 1)
            t[len(t) // 2 : len(t) // 2] = x[a : a + 15]
        docs.append((i, " ".join(t).upper() if i % 3 else ", ".join(t)))
    return [*docs, (100, None), (101, ""), (102, "?!"), (5, docs[5][1])], items


def test_hits_match_a_plain_search(spark):
    docs, items = fixture()
    rows = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows)
    assert got == sorted((i, *plain(t, items)) for i, t in docs)
    assert all(r.contaminated == (r.n_hit > 0) for r in rows)


def test_blocks_of_items_give_the_same(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = D.contamination(d, b, block=60).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows) == sorted((i, *plain(t, items)) for i, t in docs)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x gamma x beta"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert {r.doc_id: (r.n_near_items, r.n_hit) for r in D.contamination(d, b, near=8).collect()} == {1: (1, 0), 2: (0, 0), 3: (0, 0)}


def test_clean_keeps_rows_and_columns(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_hit long")
    kept = D.clean(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in docs if not plain(t, items)[1])


def plain_near(text, items, near):
    """Items of which some window has a place of its first word with all its other words near."""
    w, out = words(text), set()
    for item, t in items:
        v = words(t)
        k = min(10, len(v))
        for i in range(len(v) - k + 1 if k else 0):
            if any(w[p] == v[i] and set(v[i : i + k]) <= set(w[max(0, p - near) : p + near + 1]) for p in range(len(w))):
                out.add(str(item))
    return sorted(out)


def test_proximity_matches_a_plain_search(spark):
    rng = random.Random(6)
    v = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice((1, 2, 4, 7, 12))))) for i in range(12)]
    docs = [(j, " ".join(rng.choice(v) for _ in range(rng.choice((5, 60, 200))))) for j in range(25)]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), near=6).collect()
    want = {i: plain_near(t, items, 6) for i, t in docs}
    assert {r.doc_id: r.near_items for r in got} == want and len({len(x) for x in want.values()}) > 3
    assert all(r.n_near_items == len(r.near_items) for r in got)


def test_common_words_are_taken_in_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "PLACES", 50)
    docs, items = fixture()
    docs = [*docs, (900, "the of a " * 300), (901, "w1 " * 4000)]
    items = [*items, (50, "the of a the of a the of a the of a"), (51, "w1 w1")]
    rows = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows) == sorted((i, *plain(t, items)) for i, t in docs)


def test_clean_in_blocks_with_clashing_names(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, True, 1, "x", 2) for i, t in docs], "doc_id long, text string, _hit boolean, segment int, hits string, starts int")
    kept = D.clean(d, spark.createDataFrame(items, "item_id long, text string"), block=60)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in docs if not plain(t, items)[1])
    assert D.contamination(d, spark.createDataFrame(items, "item_id long, text string")).count() == len(docs)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert D.contamination(none, items).count() == 0
    assert [r.n_hit for r in D.contamination(one, items).collect()] == [0]
    assert D.clean(one, items).count() == 1
