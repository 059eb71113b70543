from collections import Counter

import numpy as np
import pytest

from textloom.llm import scoring as S
from textloom.llm import words as W


def test_every_word_keeps_its_count(spark, monkeypatch):
    monkeypatch.setattr(S, "VOCABULARY", 10)
    monkeypatch.setattr(S, "GROWTH", 0)
    texts = [" ".join(f"w{j}" for j in range(120) if i % (1 + j) == 0) for i in range(240)] + [None, "", "only once here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts, vocabulary, least = S.counted(docs)
    want = Counter(w for t in texts if t for w in t.split())
    tail = {int(W.word_list(w)[0]): n for w, n in want.items() if n < least}
    assert 0 < vocabulary.size <= 10 and len(tail) > 100
    seen = Counter()
    for r in S.encoded(docs, counts, vocabulary, least).collect():
        number, level = np.frombuffer(r.number, np.int32), np.frombuffer(r.level, np.int32)
        assert len(level) == (number <= vocabulary.other).sum()
        first, known = vocabulary.look_up(np.concatenate([W.word_list(texts[i]) for i in r.ids]))
        hashed = np.concatenate([W.word_list(texts[i]) for i in r.ids])[~known]
        assert (first == number).all()
        assert [vocabulary.level[k] for k in level] == [tail[int(h)] for h in hashed]
        seen.update(hashed.tolist())
    assert seen == tail
    # p(word | class) of known words and of the tail adds up to 1 in each class.
    p = np.bincount(vocabulary.cls, np.exp(vocabulary.inside), S.CLASSES)
    words = Counter(tail.values())
    p += np.bincount(vocabulary.level_cls, np.exp(vocabulary.level_inside) * [words[int(n)] for n in vocabulary.level], S.CLASSES)
    assert p[p > 0] == pytest.approx(1, abs=1e-4)


def test_common_words_of_the_tail_score_above_rare_ones(spark, monkeypatch):
    monkeypatch.setattr(S, "VOCABULARY", 4)
    monkeypatch.setattr(S, "GROWTH", 0)
    rows = [(i, " ".join(["the of and a"] * 5 + [f"common{i % 5}", f"rare{i}"])) for i in range(100)] + [(1000, "common1"), (1001, "rare1")]
    got = {r.doc_id: r.log_prob for r in S.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] > got[1001] + 1


def test_every_position_is_a_target_once(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(1 + i % 23))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, vocabulary, least = S.counted(docs)
    seen, turns, plain = [], [], S.train
    monkeypatch.setattr(S.Network, "learn", lambda self, near, cls, rate: seen.extend(cls.tolist()))
    monkeypatch.setattr(S, "train", lambda *a: turns.append(a[3:]) or plain(*a))
    batches = S.encoded(docs, counts, vocabulary, least).select("n", "number", "level").toArrow().to_batches()

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            list(f(iter(batches)))
            return spark.createDataFrame([], S.WEIGHTS)

    S.fit(Frame(), vocabulary)
    want = Counter()
    for w, n in Counter(w for _, t in rows for w in t.split()).items():
        want[int(vocabulary.cls[np.searchsorted(vocabulary.hashed, W.word_list(w)[0])])] += n
    assert Counter(seen) == want and len(turns) == S.ROUNDS
