import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing as M
from textloom.llm import sharding as S

from .plain import pieces

SCHEMA = "doc_id long, text string, source string, shard string, copies int"


def docs(n=600):
    rows = [(i, f"text {i % 97} " * (1 + i * 7919 % 50), f"s{i % 5}" if i % 11 else None, "z", 1) for i in range(n)]
    return [*rows, *[(10_000 + i, "the same hot text", "s0", "z", 1) for i in range(n // 2)], (1, None, "s1", None, None), (2, "", "s1", None, None), (None, None, None, None, None), (3, "word " * 4000, "s9", "z", 2)]


def test_shards_are_even_and_gapless(spark):
    rows = docs()
    got = S.assign(spark.createDataFrame(rows, SCHEMA), 24).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    size = {s: sum(r["size"] for r in g) for s, g in by.items()}
    longest = max(len((t or "").encode()) + 8 for _, t, *_ in rows)
    assert max(size.values()) - min(size.values()) <= longest + max(size.values()) * 0.1
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in got) == want


def test_equal_texts_stay_together_unless_hot(spark):
    rows = [(i, f"text {i // 2}", "s", "z", 1) for i in range(4000)]
    got = S.assign(spark.createDataFrame(rows, SCHEMA), 4).collect()
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[i] == shard[i + 1] for i in range(0, 4000, 2))


def test_packing_takes_the_highest_dot_product():
    plan = S.pack([("a", 60, 1, 1), ("b", 1, 60, 1), ("c", 30, 1, 1), ("d", 1, 30, 1)], 2)
    assert {u: s for u, s, _ in plan}["a"] != {u: s for u, s, _ in plan}["c"]
    assert S.pack([], 3) == []


def test_shard_keeps_columns_and_empty(spark):
    out = S.shard(spark.createDataFrame(docs(50), SCHEMA), 3)
    assert out.columns == ["doc_id", "text", "source", "copies", "size", "text_crc32", "shard", "slot"]
    assert S.assign(spark.createDataFrame([], SCHEMA), 3).count() == 0


def plain_targets(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)


def test_targets_and_taken(spark):
    rows = docs(3000)
    d = spark.createDataFrame(rows, SCHEMA)
    got = M.mixture(d).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s, *_ in rows:
        size[s] += len(pieces(t))
    want = plain_targets(size)
    source = {}
    for i, t, s, *_ in rows:
        source.setdefault((i, len(pieces(t))), s)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 4000
    assert sorted(map(tuple, M.mixture(d).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_each_boundary_emits_once(spark):
    d = spark.createDataFrame([(i, "a b", "s", "z", 1) for i in range(1000)] + [(5000 + i, "c", "t", "z", 1) for i in range(1000)], SCHEMA)
    got = M.copies(d).groupBy("source").agg(F.sum("copies").alias("n"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    for r in got:
        assert abs(r.n - 1000 * r.t / r.s) < 1
    assert M.mix(d).count() == sum(r.n for r in got)
    assert M.mix(d).columns == d.columns


def test_empty_mix(spark):
    assert M.mixture(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("n", "copies"), [(300, 2), (2400, 5), (24_000, 200)])
def test_groups_that_fit_into_a_shard_stay_whole(spark, n, copies):
    rows = [(i, f"text {i // copies}", "s", "z", 1) for i in range(n)]
    got = S.assign(spark.createDataFrame(rows, SCHEMA), 24).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.doc_id // copies].add(r.shard)
    assert len(got) == n and all(len(s) == 1 for s in shards.values())
    count = [sum(r.shard == k for r in got) for k in range(24)]
    assert max(count) - min(count) <= max(2 * copies, n // 24 // 4)


def plain_pack(units, shards):
    """Largest first, into the shard of the highest dot product with what is left, of those it fits."""
    total = [sum(u[k] for u in units) or 1 for k in (1, 2, 3)]
    vector = {u[0]: [shards * u[k + 1] / total[k] for k in range(3)] for u in units}
    left, out = [[1.0] * 3 for _ in range(shards)], {}
    for u in sorted(units, key=lambda u: (-max(vector[u[0]]), u[0])):
        v = vector[u[0]]
        fits = [s for s in range(shards) if all(a >= b - 1e-12 for a, b in zip(left[s], v, strict=True))] or range(shards)
        best = max(fits, key=lambda s: (sum(a * b for a, b in zip(left[s], v, strict=True)), -s))
        left[best] = [a - b for a, b in zip(left[best], v, strict=True)]
        out[u[0]] = best
    return out


def test_packing_matches_a_plain_packer():
    rng = random.Random(3)
    for shards in (1, 3, 24):
        units = [(f"u{i:03}", rng.randrange(1, 10_000), rng.randrange(1, 900), rng.randrange(1, 40)) for i in range(200)]
        plan = S.pack(units, shards)
        assert {u: s for u, s, _ in plan} == plain_pack(units, shards)
        rows = defaultdict(int)
        for u, s, before in plan:
            assert before == rows[s]
            rows[s] += next(x[3] for x in units if x[0] == u)


@pytest.mark.parametrize("rows_a_cell", [1, 200_000])
def test_slots_by_ranges_of_units(spark, monkeypatch, rows_a_cell):
    monkeypatch.setattr(S, "ROWS", rows_a_cell)
    monkeypatch.setattr(S, "BUNDLES", 8)
    got = S.assign(spark.createDataFrame(docs(900), SCHEMA), 4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 1354 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_cells_change_no_result(spark, monkeypatch):
    d = spark.createDataFrame(docs(2000), SCHEMA)
    want = sorted(map(tuple, M.mixture(d).collect()), key=str)
    monkeypatch.setattr(M, "ROWS", 100)
    assert sorted(map(tuple, M.mixture(d).collect()), key=str) == want
