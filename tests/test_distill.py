import random
import re

import pytest

from textloom.operators import distill as D

IMPORTANT = re.compile(r"\b([0-9A-Za-z_]*(error|exception)s?|err|warn(ing)?s?|fail(s|ed|ure|ures)?)\b", re.I | re.A)


def mask(x):
    return re.sub(r"\b[0-9]+\b", "<n>", re.sub(r"\b[0-9a-f]{7,64}\b", "<hex>", x, flags=re.A), flags=re.A)


def template(x):
    return " ".join(t if re.fullmatch("[A-Za-z]+", t) else "<v>" for t in re.split(r"\s+", x))


def plain(text, query=None):
    """The three passes, one line after another."""
    own = text.split("\n")
    masked, imp = [mask(x) for x in own], [bool(IMPORTANT.search(x)) for x in own]
    out, i, n = [], 0, len(own)
    while i < n:
        best = (0, 0, 0)
        for k in range(1, 9):
            if any(imp[i : i + k]) or i + k > n:
                break
            r = 1
            while i + (r + 1) * k <= n and masked[i + r * k : i + (r + 1) * k] == masked[i : i + k] and not any(imp[i + r * k : i + (r + 1) * k]):
                r += 1
            if r >= 3 and k * (r - 1) > best[0]:
                best = (k * (r - 1), k, r)
        _, k, r = best
        if k:
            out += [(own[j], masked[j], False) for j in range(i, i + k)]
            out.append((f"   [×{r} similar]" if k == 1 else f"   [×{r} similar {k}-line blocks]", None, False))
            i += k * r
        else:
            out.append((own[i], masked[i], imp[i]))
            i += 1
    seen, shapes, kept, exact, alike = {}, {}, [], 0, 0
    for line, m, important in out:
        if important or m is None or line.strip().startswith("[×") or len(line.strip()) < 4:
            kept.append((line, important))
        elif m in seen:
            seen[m][0] += 1
            if seen[m][0] <= 2:
                kept.append((line, False))
            else:
                exact += 1
        else:
            seen[m] = [1, line]
            c = shapes.setdefault(template(m), [0, line])
            c[0] += 1
            if c[0] <= 3:
                kept.append((line, False))
            else:
                alike += 1
    top = [(c, "", x) for c, x in seen.values() if c > 2] + [(c, " (template)", x) for c, x in shapes.values() if c > 3]
    top = sorted(top, key=lambda t: -t[0])[:40]
    if exact + alike:
        kept.append((f"── {exact + alike} repeated lines suppressed ({exact} exact ×N, {alike} same-template; first occurrences kept above) ──", False))
        kept += [(f"  ×{c}{tag}  {x.strip()[:160]}", bool(IMPORTANT.search(x))) for c, tag, x in top]
    if query is not None:
        hit = [i for i, (x, important) in enumerate(kept) if important or re.search(query, x, re.I)]
        keep = {j for i in hit for j in range(i - 2, i + 3)}
        rows, gone = [], 0
        for i, (x, _) in enumerate(kept):
            if i in keep:
                rows += [f"… {gone} lines omitted"] * (gone > 0) + [x]
                gone = 0
            else:
                gone += 1
        return "\n".join(rows + [f"… {gone} lines omitted"] * (gone > 0))
    return "\n".join(x for x, _ in kept)


def logs(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        rows = []
        while len(rows) < 60:
            block = [rng.choice(("get item {}", "put {} ok", "beat", "zz", "  pad {}", "scan dir{} now", "an error {}", "poll {} of {}")) for _ in range(rng.choice((1, 1, 2, 3, 5)))]
            for _ in range(rng.choice((1, 1, 2, 3, 6))):
                rows += [b.format(rng.randrange(9), rng.randrange(9)) for b in block]
        out.append("\n".join(rows))
    return [*out, "", "one", "a\na\na\na", "x\n\n\n\ny", "[× fake]\n[× fake]\n[× fake]\nabcd"]


@pytest.mark.parametrize("query", [None, "put 3", "nothing matches", "(", "(?P<x>a)"])
def test_matches_line_by_line(spark, query):
    texts = logs(1)
    got = D.distill(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), query).collect()
    assert {r.doc_id: r.distilled for r in got} == {i: plain(t, {"(": r"\(", "(?P<x>a)": re.escape("(?P<x>a)")}.get(query, query)) for i, t in enumerate(texts)}
    for r in got:
        assert r.orig_lines == texts[r.doc_id].count("\n") + 1 and r.out_lines == r.distilled.count("\n") + 1


def test_important_lines_always_stay(spark):
    text = "\n".join(["fatal error 1"] * 50 + ["ok line"] * 50)
    r = D.distill(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.distilled.count("fatal error 1") == 50 and r.important_kept == 50 and r.collapsed_runs == 1


def test_carriage_returns_and_colours(spark):
    r = D.distill(spark.createDataFrame([(1, "10%\r50%\rdone\nline\r\n\x1b[31mred\x1b[0m")], "doc_id long, text string")).first()
    assert r.distilled == "done\nline\nred"
