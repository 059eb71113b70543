import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import quality as Q

from .plain import pieces

SCHEMA = "doc_id long, text string, quality string, votes int"


def plain(text):
    t = text or ""
    w = pieces(t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j + k for places in at.values() if len(places) > 1 for j in places for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if pieces(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def texts():
    rng = random.Random(6)
    v = [f"{a}{b}" for a in ("lo", "rem", "ips", "um", "dé") for b in ("ta", "ne", "ri")]
    good = [(i, "\n".join(" ".join(rng.choice(v) for _ in range(12)) + "." for _ in range(8))) for i in range(150)]
    junk = [(1000 + i, " ".join(rng.choice(v).upper() + rng.choice(("!!", "###", " |", "$$$")) for _ in range(60))) for i in range(12)]
    rep = [(2000 + i, "\n".join([" ".join(rng.choice(v) for _ in range(9))] * 7)) for i in range(8)]
    odd = [(3000, None), (3001, ""), (3002, " \t\x0b"), (3003, "a b c d e f g h a b c d e f g h"), (3004, "x " * 30), (3005, "one line\none line\n\n\none line"), (3, good[3][1]), (3006, "tail  \n lead"), (3007, "🦀 crab nbsp")]
    return [(i, t, "q", 1) for i, t in [*good, *junk, *rep, *odd]]


def test_counts_match_plain_ones_and_junk_goes(spark):
    rows = texts()
    got = Q.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        want = plain(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1
    assert all(r.kept for r in got if r.doc_id < 1000)
    assert not any(r.kept for r in got if 1000 <= r.doc_id < 3000)


def plain_em(patterns, rounds):
    n = Q.N_RULES
    prior, good, bad = Q.PRIOR, [list(Q.START_GOOD) for _ in range(n)], [list(Q.START_BAD) for _ in range(n)]
    every = sum(patterns.values())
    lean = every * Q.LEAN
    for _ in range(rounds):
        g = {}
        for v, c in patterns.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[j][s] / bad[j][s]) for j, s in enumerate(v))
            g[v] = c / (1 + math.exp(-odds))
        likely = sum(g.values())
        prior = (likely + lean * Q.PRIOR) / (every + lean)
        for j in range(n):
            good[j] = [(sum(x for v, x in g.items() if v[j] == s) + Q.START_GOOD[s] * lean) / (likely + lean) for s in range(3)]
            bad[j] = [(sum(patterns[v] - x for v, x in g.items() if v[j] == s) + Q.START_BAD[s] * lean) / (every - likely + lean) for s in range(3)]
            over = max(good[j][0] - Q.MISFIRE, 0)
            good[j][0] -= over
            good[j][1] += over
    return prior, [x for t in good for x in t], [x for t in bad for x in t]


def test_em_matches_a_plain_one(spark):
    rng = random.Random(8)
    patterns = Counter(tuple(rng.choice((0, 1, 2, 2, 2)) for _ in range(Q.N_RULES)) for _ in range(60))
    rows = [(list(v), float(c)) for v, c in sorted(patterns.items())]
    one = spark.createDataFrame([(rows,)], "all array<struct<votes: array<int>, n: double>>")
    p = one.select(Q.estimated(F.col("all"), Q.N_RULES, 6).alias("p")).first().p
    prior, good, bad = plain_em(patterns, 6)
    assert p.prior == pytest.approx(prior) and p.good == pytest.approx(good) and p.bad == pytest.approx(bad)


def test_empty(spark):
    assert Q.judged(spark.createDataFrame([], SCHEMA)).count() == 0
