import random
import zlib

import numpy as np
import pytest

from textloom.llm import language as L
from textloom.llm import licenses as X
from textloom.llm import words as W

from .plain import words

PARTS = {"en": "the and ing tion er wh th ou", "de": "sch ung ein ich keit ßch äu ver", "fr": "eau que oui ère ç ment tion les", "es": "ción ado que os ñ ará los mente"}


def texts(n=400, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        word = lambda: "".join(rng.choice(PARTS[lang].split()) for _ in range(rng.choice((1, 2, 3))))  # noqa: B023, E731
        out.append((i, " ".join(word() for _ in range(rng.choice((4, 30, 90)))), lang))
    return out


def test_held_out_accuracy_and_contract(spark):
    rows = texts()
    extra = [(1000, None, "en"), (1001, "123 ...", "de"), (1002, "", None), (1003, "Ω", "fr"), (5, rows[5][1], rows[5][2])]
    got = L.languages(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred in PARTS
    held = [(i, lang) for i, _, lang in rows if by[i].held_out]
    assert sum(by[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert not any(by[i].rejected for i, _, _ in rows)


def test_far_texts_are_rejected_and_columns_stay(spark):
    rows = [(i, t, lang, "s", 0.5) for i, t, lang in texts()] + [(2000, "жщюфы ъэхзц " * 20, None, "s", None), (2001, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, rejected double")
    kept = L.accepted(d)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids) == 400 and 2000 not in ids and 2001 not in ids


UNLEARNED = [
    "La ragione per cui questo paese ha bisogno di una nuova legge sulla scuola è molto semplice: i ragazzi non leggono più, e gli insegnanti sono stanchi di combattere contro un sistema che non li ascolta",
    "Türkiye'nin en büyük şehri olan İstanbul, iki kıtayı birbirine bağlayan boğazın kıyısında kurulmuştur ve her yıl milyonlarca turist tarafından ziyaret edilmektedir",
    "Suomen pääkaupunki on Helsinki, joka sijaitsee maan etelärannikolla. Kaupungissa asuu yli kuusisataatuhatta ihmistä ja se on maan suurin kaupunki",
    "Warszawa jest stolicą Polski i największym miastem kraju. Leży nad Wisłą w centralnej części Niziny Środkowomazowieckiej",
    "xkcd qwrt zzxv bnmp lkjh gfds qqpw trwq xzcv bnml kjhg fdsq plmk jnhb vgfc xdrz sewq plok mijn uhbv",
]


def test_languages_never_learned_are_rejected_in_latin_script_too(spark):
    rows = texts(1600, 3) + [(5000 + i, t, None) for i, t in enumerate(UNLEARNED)]
    got = {r.doc_id: r.rejected for r in L.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[5000 + i] for i in range(len(UNLEARNED)))
    assert sum(got[i] for i, _, _ in rows[:1600]) <= 2


def test_sample_is_bounded_when_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "stash", lambda df: seen.append(df.count()) or df)
    rows = texts(300, 8)
    L.fit(spark.createDataFrame(rows + [(1, f"the and of ing {i}", "en") for i in range(900)], "doc_id long, text string, lang string"), sample=20)
    assert seen and all(n <= 20 * len(PARTS) for n in seen)


def test_reach_grows_with_length():
    at, median, low = L.reach(np.repeat([0.3, 0.6, 0.9], 20), np.repeat([50, 150, 600], 20))
    assert list(median) == [0.3, 0.6, 0.9] and low == pytest.approx(L.SLACK) and list(at.round(1)) == [5.6, 7.2, 9.2]


def test_very_long_and_repeated_texts_and_other_columns(spark):
    rows = [(*r, "x", 1.5) for r in texts(200, 4)]
    rows += [(900, rows[0][1] * 3000, None, "x", 1.5), (901, "", None, "x", 1.5), rows[3], rows[3]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = L.languages(d).collect()
    assert len(got) == len(rows) and len({r.lang_pred for r in got if r.doc_id == rows[3][0]}) == 1
    assert next(r.lang_pred for r in got if r.doc_id == 900) == rows[0][2]
    assert L.accepted(d).columns == d.columns


def test_nothing_learned_and_empty(spark):
    d = spark.createDataFrame([(1, "hello there", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.languages(d).collect()] == [("und", 0.0)]
    assert L.languages(d.where("false")).count() == 0


def plain_base(text):
    w = words(text)
    found = [(i, label) for p, label in X.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def plain_labels(text):
    w, out = words(text), set()
    for label, t in X.TEMPLATES:
        t, span = words(t), X.span_of(len(words(t)))
        assert span >= max(64, 2 * len(t)) and span < max(65, 4 * len(t))
        if any(len(set(t) & set(w[b : b + span])) >= X.THRESHOLD * len(set(t)) - 1e-9 for b in range(0, len(w), span // 2)):
            out.add(label)
    return out


def license_texts():
    rng = random.Random(4)
    v = ["the", "all", "rights", "reserved", "cc", "by", "general", "public", "license", "mit", "under", "version", *(f"w{i}" for i in range(20))]
    rows = []
    for i in range(120):
        w = [rng.choice(v) for _ in range(rng.choice((0, 3, 40, 200)))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice([*X.PHRASES, *(t for _, t in X.TEMPLATES)]).split()
            for _ in range(rng.choice((0, 0, 1, len(notice) // 8, len(notice) // 3))):
                notice.pop(rng.randrange(len(notice)))
            at = rng.randrange(len(w) + 1)
            w[at:at] = notice
        rows.append((i, ", ".join(w).title() if i % 2 else "\n".join(w)))
    return [*rows, (500, None), (501, ""), (502, "-"), (3, rows[3][1]), (503, "cc by " * 300)]


def test_scans_match_a_plain_search(spark):
    rows = license_texts()
    got = X.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    base = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert base == sorted(((i, *plain_base(t)) for i, t in rows), key=str)
    text = dict(rows)
    for r in got:
        want = plain_labels(text[r.doc_id]) | set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == want
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(want)


def test_own_templates_and_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (2, "a b x y z")], "doc_id long, text string")
    got = X.licenses(d, phrases={}, templates=(("t", "a b c d"),), threshold=0.75)
    assert {r.doc_id: (r.labels, r.n_base) for r in got.collect()} == {1: ("t", 0), 2: ("", 0)}
    assert X.licenses(d.where("false")).count() == 0
    long = " ".join(f"w{i}" for i in range(3000))
    e = spark.createDataFrame([(1, f"a b {long} c d", "x"), (2, long[: len(long) // 2], "x")], "doc_id long, text string, labels string")
    assert {r.doc_id: r.labels for r in X.licenses(e, templates=(("t", long),)).collect()} == {1: "t", 2: ""}
    assert len(W.word_list("a b")) == 2
