import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import html_text as H
from textloom.llm import scoring as S
from textloom.llm import token_files as T

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">Accept all</div>
<main><h1>Head &amp; line</h1><p>One <b>bold</b>
 word&nbsp;here<p>Two &lt;x&gt; &#233;<br>more<div class="ad">Buy</div><section class="comments"><p>First!</p></section></main>
<aside>Side</aside><form><p>Mail</p></form><footer>&copy; us</footer></body></html>"""


def structured(page):
    return H.assembled(H.blocks(page or ""), {})


def test_structure():
    assert structured(PAGE) == "Head & line\nOne bold word here\nTwo <x> é more"
    assert structured(None) == ""
    assert structured("plain <text") == "plain <text"
    assert structured("<article><p>a<script>x") == "a"
    assert structured("<article><p>a<!-- b </p> --><p>c") == "a\nc"
    assert structured('<article class="post ad-free"><p>a</article><article class="comment"><p>b') == "a"


def open_pages():
    rng = random.Random(9)
    v = [f"word{i}" for i in range(500)]
    notice = " ".join(f"boiler{i}" for i in range(14))
    rows = []
    for i in range(30):
        body = [" ".join(rng.choice(v) for _ in range(20)) for _ in range(3)]
        rows.append((i, f"http://h{i % 2}.org/{i}", f"<html><body><div>{notice} h{i % 2}</div>" + "".join(f"<p>{b}</p>" for b in body) + f"<div>short tail {i}</div></body>", body))
    return rows


def test_repeated_runs_go_and_unique_ones_stay(spark):
    rows = open_pages()
    d = spark.createDataFrame([r[:3] for r in rows] + [(100, "http://h0.org/0", rows[0][2]), (101, "http://x.org", rows[0][2]), (102, None, None), (103, None, "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in H.main_text(d).collect()}
    assert len(got) == 34
    for i, _, _, body in rows:
        assert got[i].text == "\n".join([*body, f"short tail {i}"]) and got[i].n_chars == len(got[i].text)
    assert got[100].text == got[0].text  # a mirrored page isn't boilerplate of itself
    assert got[101].text.startswith("boiler0")  # the only page of its host
    assert got[102].text == got[103].text == ""


def test_suffixes_are_sorted_to_depth():
    pages = [H.blocks(f"<p>{t}</p>") for t in ("a b c d e f g h i", "a b c d e f g h x", "z a b c d e f g h")]
    stream = H.Stream(pages, np.zeros(3))
    order, rank = stream.suffixes()
    keys = [tuple(stream.tokens[i : i + H.RUN].tolist()) for i in stream.whole[order]]
    assert len(order) == 6 and len(set(keys)) == 4
    assert [keys.index(k) for k in keys] == sorted(keys.index(k) for k in keys)  # equal runs lie together
    assert len(set(rank.tolist())) == 4 and len(set(stream.runs.tolist())) == 4


def test_empty_pages(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    net = S.Network(20, np.zeros(S.CLASSES, np.float32))
    near, cls = rng.integers(0, 20, (50, 2 * S.REACH)).astype(np.int32), rng.integers(0, S.CLASSES, 50)
    before = net.log_p(near, cls).mean()
    for _ in range(60):
        net.learn(near, cls, 0.5)
    assert net.log_p(near, cls).mean() > before + 0.5


def test_probabilities_sum_to_one():
    vocabulary = S.Vocabulary([(i, 1000 // (i + 1)) for i in range(300)], 20_000, 900)
    net = S.Network(1 + S.OTHER + 300, vocabulary.prior)
    near = np.zeros((1, 2 * S.REACH), np.int32)
    p = np.exp([net.log_p(near, np.array([c]))[0] for c in range(S.CLASSES)])
    assert p.sum() == pytest.approx(1, abs=1e-4)
    for c in set(vocabulary.cls.tolist()):
        assert np.exp(vocabulary.inside[vocabulary.cls == c]).sum() == pytest.approx(1, abs=1e-4)


def test_context_predicts(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(w for _ in range(60) for w in rng.choice((("red", "apple", "tree"), ("blue", "ocean", "wave"))))) for i in range(60)]
    shuffled = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in docs[:20]]
    rows = [*docs, *shuffled, (2000, None), (2001, ""), (2002, "..."), (3, docs[3][1])]
    got = S.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    mean = lambda lo, hi: np.mean([r.mean_log_prob for r in got if lo <= r.doc_id < hi])
    assert mean(0, 1000) > mean(1000, 2000) + 0.2
    assert all((r.n_tokens, r.log_prob, r.mean_log_prob) == (0, 0.0, None) for r in got if r.doc_id >= 2000)
    assert S.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(2)
    count = rng.integers(0, 9, 50)
    ranks = rng.choice([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], count.sum()).astype(np.uint32)
    control, c, data, d = T.code(ranks, count)
    assert (T.decode(control, data, count) == ranks).all()
    one = slice(c[7], c[8]), slice(d[7], d[8])
    first = count[:7].sum()
    assert (T.decode(control[one[0]], data[one[1]], count[7:8]) == ranks[first : first + count[7]]).all()


TEXTS = ["Hello, World!", "", None, "it's we'll I'd ’s", "a\tb\r\nc  d", "é é Ünï ﬁ", "###word$$$ 123 4x", "<|endoftext|> x<|startoftext|>y", " nb sp", "日本語 テキスト 🦀🦀", "x" * 3000, "THE the The", "a'b 'c d'"]


def test_files_hold_what_the_tokenizer_gives(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    rows = [(i * 37 % 101, TEXTS[i % len(TEXTS)]) for i in range(100)] + [(5, "again"), (5, "again")]
    got = sorted(T.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    at, text = 0, dict(rows[:100])
    for r in got:
        if r.doc_id != 5:
            ids = T.tokenizer(path).encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text[r.doc_id]
        assert r.start == at
        at += r.n_tokens
    pieces, whole = T.Pieces(path), T.Texts(path)
    rng = random.Random(0)
    parts = ["a", "B", "é", "ß", "'", "’", "s", "t", "re", ".", ",", "#", "!", "1", "23", " ", "\n", "-", "|", ">", "<", "…", "\u0301", "ll", "日", "🦀", "\xa0", "\x85", "\x0b", "\x1c"]
    fuzz = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(2000)]
    for texts in (TEXTS, fuzz, fuzz + TEXTS):
        a, b = pieces.ids(pa.array(texts)), whole.ids(pa.array(texts))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_ids_come_back_and_empty(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    d = spark.createDataFrame([(2, "b c"), (1, "a"), (None, "z")], "doc_id long, text string")
    T.write(d, path, f"file://{tmp_path}/x")
    got = sorted(T.read(spark, f"file://{tmp_path}/x", with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2]
    assert [list(r.ids) for r in got] == [T.tokenizer(path).encode(t, add_special_tokens=False).ids + [2] for t in ("z", "a", "b c")]
    assert T.round_trip(d.where("false"), path).count() == 0


def test_files_are_parted_by_ids_and_rows_of_one_id_are_split(spark, tmp_path, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(T, "FILE_IDS", 40)
    monkeypatch.setattr(T, "BLOCK_IDS", 15)
    monkeypatch.setattr(T, "GROUP", 3)
    rows = [(i % 50 if i % 3 else 7, f"text number {i} of some" if i % 2 else "the same text in each of these rows", 1, "x") for i in range(300)] + [(None, "none", 0, "")] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, file int, block string").repartition(6)
    T.write(d, path, f"file://{tmp_path}/x")
    stored = spark.read.schema(T.BLOCKS).parquet(f"file://{tmp_path}/x/blocks").collect()
    assert len({r.file for r in stored}) > 20 and sum(7 in r.doc_ids for r in stored) > 5
    got = sorted(T.read(spark, f"file://{tmp_path}/x", with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])][:-1].tolist()
    encode = lambda t: T.tokenizer(path).encode(t, add_special_tokens=False).ids + [2]
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(r[0]), encode(r[1])) for r in rows)
