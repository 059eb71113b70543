import random
import time

import numpy as np
import pytest

from textloom.llm import html_text as H


def test_only_runs_on_a_share_of_the_pages_go(spark):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    foot = " ".join(f"foot{j}" for j in range(12))
    passage = " ".join(f"quote{j}" for j in range(60))
    near = [own("near", 60) + f" day{i}" for i in range(2)]
    body = [own(i, 30) + (f" {passage}" if i < 2 else "") for i in range(10)]
    rows = [(i, f"http://a.org/{i}", f"<p>{b}</p><div>{foot}; unique{i}, é end{i}.</div>") for i, b in enumerate(body)]
    rows += [(20 + i, f"http://b.org/{i}", f"<p>{t}</p>") for i, t in enumerate(near)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(10)] == [f"{b}\nunique{i}, é end{i}." for i, b in enumerate(body)]
    assert [got[20], got[21]] == near


def structured(page):
    return H.assembled(H.blocks(page), {})


def test_classes_inside_an_article_need_a_box():
    assert structured('<article><p>Start.</p><p class="form">One</p><h2 class="banner">Two</h2><figure class="social">Three</figure><div class="ad">Four</div></article>') == "Start.\nOne\nTwo\nThree"


def test_pages_in_forms_and_marked_boxes():
    assert structured('<body><form id="all"><nav>Menu</nav><p>The whole page is here</p></form>') == "The whole page is here"
    assert structured("<body><p>A page with a longer body of text</p><form><p>Mail</p></form>") == "A page with a longer body of text"
    assert structured("<form><main><p>Kept</p></main><p>Send</p></form>") == "Kept"
    assert structured('<div class="with sidebar"><p>All there is</p></div>') == "All there is"
    assert structured('<div class="sidebar"><p>Not this</p></div><p>This</p>') == "This"
    body = "the body stands outside of it and is far longer than the teaser " * 4
    assert structured(f"<article>Teaser</article><p>{body}</p>") == f"Teaser\n{body.strip()}"


def test_broken_markup_is_read_in_linear_time():
    assert structured('<article><p>a</p><p title="x>hello</p><p>b</article>') == "a\nhello\nb"
    assert structured("<article><p>a < b</p><svg><p>c") == "a < b\nc"
    for bad in ("<script ", "<a '", '<a "', "<", "<!", "<!--", "</x>", "<div></x>", "<div>", "<div a='>", "<svg>", "<p class=", "<a ='\">", "&#", "<title>"):
        page = "<article><p>text</p>" + bad * (1_000_000 // len(bad))
        began = time.process_time()
        H.blocks(page + "</article>")
        H.blocks(page + ">")
        assert time.process_time() - began < 6, bad


def plain_boilerplate(pages):
    """Runs that are boilerplate by host, counted one by one."""
    counts, all_keys = {}, {}
    for host, page in pages:
        stream = H.Stream([H.blocks(page)], np.array([host]))
        key = stream.keys()[0]
        all_keys.setdefault(host, set()).add(key)
        for r in [*stream.runs.tolist(), *stream.short_runs.tolist()]:
            counts.setdefault((host, r), set()).add(key)
    rule = lambda least, share: {(h, r) for (h, r), k in counts.items() if len(k) >= least and len(k) >= share * len(all_keys[h])}
    return rule(H.LEAST, H.SHARE), rule(H.LEAST_KEPT, H.SHARE_KEPT)


def some_pages():
    rng = random.Random(5)
    v = [f"w{i}" for i in range(300)]
    own = lambda n: " ".join(rng.choice(v) for _ in range(n))
    pages = []
    for host in range(6):
        notes = [own(12) for _ in range(5)]
        last = ""
        for i in range((3, 8, 20, 60, 90, 1)[host]):
            body = last if i % 5 == 4 else own(rng.randint(5, 60))
            last = body if i % 7 else body.replace(" w1", " x1", 1)
            some = [n for j, n in enumerate(notes) if rng.random() < (0.1, 0.24, 0.3, 0.55, 0.9)[j]]
            box = "article" if rng.random() < 0.6 else "div"
            inside = rng.random() < 0.5
            pages.append((host, f"<{box}><p>{body}</p>{some[-1] if some and inside else ''}</{box}>" + "".join(f"<div>{n}</div>" for n in some) + "<p>Read on</p>"))
    return pages


@pytest.mark.parametrize("piece", [H.PIECE, 3000, 500])
def test_host_suffix_array_finds_what_counting_finds(spark, piece):
    pages = some_pages()
    runs, strict = plain_boilerplate(pages)
    assert runs and strict and len(runs) > len(strict)
    found = H.boilerplate(spark.createDataFrame(pages, "host long, html string").repartition(5), piece).collect()
    signed = lambda xs: {(h, int(np.array([r], np.uint64).view(np.int64)[0])) for h, r in xs}
    assert {(r.host, x) for r in found for x in r.runs} == signed(runs)
    assert {(r.host, x) for r in found for x in r.strict} == signed(strict)


def test_boilerplate_inside_articles_goes_and_copies_stay(spark):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    join = "Join our readers and get every story first by mail each week"
    rows = [(i, f"http://a.org/{i}", f"<article><p>{own(i, 30)}</p><p>{join}</p><p>{own(100 + i, 9)}</p></article>") for i in range(12)]
    rows += [(50 + i, "http://c.org/", f"<article><p>{own('c', 200)} end{i}</p></article>") for i in range(12)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == [f"{own(i, 30)}\n{own(100 + i, 9)}" for i in range(12)]
    assert [got[50 + i] for i in range(12)] == [f"{own('c', 200)} end{i}" for i in range(12)]


def test_clashing_columns_and_lists_back_by_host(spark, monkeypatch):
    monkeypatch.setattr(H, "SENT", -1)
    rows = [(i, "http://a.org/", f"<p>w{i} and more of its own {i}</p><p>the foot of every page of it here</p>", i) for i in range(6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host int").selectExpr("*", "host AS runs", "host AS text", "host AS unit", "host AS n_chars")
    got = {r.page_id: r.text for r in H.main_text(d).collect()}
    assert got == {i: f"w{i} and more of its own {i}" for i in range(6)}
