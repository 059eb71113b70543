"""The pipeline against a plain version of its stages, on a small fixture."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from textloom.llm import language, mixing

from .plain import classes, jaccard_p, pieces, words
from .test_language_licenses import texts
from .test_near_dedup import weighted


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    own = [(i, t) for i, t, _ in texts(240, 5)]
    lang = {i: x for i, _, x in texts(240, 5)}
    for i in range(40):
        w = rng.choice(own)[1].split()
        w[rng.randrange(len(w))] = f"edit{i}"
        own.append((1000 + i, " ".join(w)))
    items = [(i, " ".join(f"bench{rng.randrange(40)}" for _ in range(14))) for i in range(5)]
    for i in range(12):
        w = own[i * 7][1].split()
        x = rng.choice(items)[1].split()
        w[3:3] = x[2:13] if i % 2 else x[:9]
        own.append((2000 + i, " ".join(w)))
    odd = [(3000, None), (3001, ""), (3002, "!!"), (3003, "жщюфы ъэхзц " * 20)]
    rows = [(i, t, lang.get(i), f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in [*own, *odd]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def test_run_matches_plain_stages(spark, folder):
    path, rows, items = folder
    text = {r[0]: r[1] for r in rows}
    # What isn't one of the languages, or has no letter, goes: none of the texts, but of those with a passage some that are mostly passage.
    mostly = {i for i in text if 2 * sum(x.startswith("bench") for x in words(text[i])) > len(words(text[i]))}
    far = {r.doc_id for r in language.languages(spark.read.parquet(f"{path}/documents.parquet")).where("rejected").collect()}
    assert far - mostly == {3000, 3001, 3002, 3003}
    kept = [i for i in text if i not in far]
    sets = {i: weighted(text[i]) for i in kept}
    first = classes([(a, b) for n, a in enumerate(kept) for b in kept[:n] if jaccard_p(sets[a], sets[b]) >= 0.8], kept)
    kept = [i for i in kept if first[i] == i]
    windows = {tuple(words(t)[k : k + 10]) for _, t in items for k in range(5)}
    kept = [i for i in kept if not any(tuple(words(text[i])[k : k + 10]) in windows for k in range(len(words(text[i]))))]
    got = C.run(spark, path)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    out = got.collect()
    count = Counter(r.doc_id for r in out)
    assert set(count) <= set(kept) and max(count.values()) <= 2
    source = {r[0]: r[3] for r in rows}
    size, taken = defaultdict(int), defaultdict(int)
    for i in kept:
        size[source[i]] += len(pieces(text[i]))
        taken[source[i]] += count[i] * len(pieces(text[i]))
    left = spark.createDataFrame([r for r in rows if r[0] in set(kept)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.doc_id: r.copies for r in mixing.copies(left).collect()}
    assert count == Counter({i: n for i, n in want.items() if n})
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    by = defaultdict(list)
    for r in out:
        assert r.text == text[r.doc_id]
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    assert [k for k, _ in C.STAGES] == ["language", "near_dedup", "decontaminate", "mixing", "sharding"]
