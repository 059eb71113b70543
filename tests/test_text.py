import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import ladder, lines, needles, secrets


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_lengths_and_trim(spark):
    assert one(spark, T.chars, "a🦀b", "") == [3, 0]
    assert one(spark, T.octets, "a🦀b", "") == [6, 0]
    assert one(spark, T.trim_space, "\u3000 a b\x85\n", "\ufeffx") == ["a b", "\ufeffx"]
    assert one(spark, T.content_id, "abc") == ["ba7816bf8f01"]


def plain_tokens(s):
    import re

    word = sum(len(r) for r in re.findall("[A-Za-z]+", s) if len(r) <= 14 and re.search("[aeiouyAEIOUY]", r))
    letters = len(re.findall("[A-Za-z]", s))
    digits, space = len(re.findall("[0-9]", s)), len(re.findall("[ \t\n\r]", s))
    return (word * 161 + (letters - word) * 1501 + digits * 807 + space * 428 + (len(s) - letters - digits - space) * 690 + 500) // 1000


def test_tokens(spark):
    texts = ["", "hello world", "xkcd 123 éa", "a" * 15, "a" * 14, "{\"k\": 1}\n\t", "🦀 crab"]
    assert one(spark, T.text_tokens, *texts) == [plain_tokens(t) for t in texts]


def test_tokens_of_long_texts(spark):
    n, rates = 3_200_000, {"1": 807, "q": 1501, "-": 690}
    texts = spark.range(len(rates)).select("id", F.repeat(F.get(F.array(*map(F.lit, rates)), F.col("id").cast("int")), n).alias("x"))
    assert [r[0] for r in texts.select("id", T.text_tokens(F.col("x")).alias("n")).orderBy("id").select("n").collect()] == [(n * w + 500) // 1000 for w in rates.values()]


def test_masks(spark):
    got = one(spark, T.mask, "2024-01-02T03:04:05.6Z up 12:13:14", "id 123e4567-e89b-12d3-a456-426614174000 deadbeef1", "took 12ms 3.5 GiB 7µs x7 50%", "zzz", "é7 7é")
    assert got == ["<ts> up <time>", "id <uuid> <hex>", "took <n> <n> <n> x7 <n>%", "zzz", "é<n><n>é"]


def test_templates_and_important_lines(spark):
    assert one(spark, T.template, "a b2 C", " a", "a ", "x-y") == ["a <v> C", "<v> a", "a <v>", "<v>"]
    got = one(spark, T.is_important, "an Error", "x_error_y", "IOException: x", "warned", "timed out", "failure", "nofail", "assertions")
    assert got == [True, False, True, False, True, True, False, True]


def test_frames_and_ansi(spark):
    assert one(spark, T.last_frame, "a\rb\rc", "a\r", "a\rb\r", "x") == ["c", "a", "b", "x"]
    assert one(spark, T.strip_ansi, "\x1b[1;31mred\x1b[0m") == ["red"]


def test_percent(spark):
    rows = spark.createDataFrame([(0, 5), (200, 199), (200, 201), (3, 1), (8, 7)], "a long, b long").select(T.percent_saved(F.col("a"), F.col("b")))
    assert [r[0] for r in rows.collect()] == [0, 1, -1, 67, 13]


def test_split_and_join(spark):
    d = spark.createDataFrame([(1, "a\nb\n"), (2, "")], "doc_id long, text string")
    rows = lines.split_lines(d)
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (2, 0, "")]
    assert sorted(map(tuple, lines.join_lines(rows, "pos").collect())) == [(1, "a\nb\n"), (2, "")]


def test_paths(spark):
    assert one(spark, T.is_sensitive_path, ".env", "a/.ENV.prod", "x/.aws/y", "aws/y", "id_rsa.pub", "secretary.txt", "a.pem.txt", "C:\\k\\.ssh\\z") == [True, True, True, False, True, True, False, True]


@pytest.mark.parametrize(
    ("level", "text", "want"),
    [
        (1, "a  \n\n\n\nb\t", "a\n\nb"),
        (2, "in order to  go , please note that it works", "To go, it works"),
        (2, "needless to say, you must ensure that this is done", "Ensure this is done"),
        (2, "I'd recommend using X", "Use X"),
        (3, "the cat saw a very big an dog", "Cat saw big dog"),
        (4, "this is in the house of cards", "House cards"),
        (2, "    code  stays   here", "    code  stays   here"),
        (4, "{{a}}==(b);;[[c]]", "{{a}}==(b);;[[c]]"),
        (3, "éthe a thé", "éthe thé"),
        (0, "a  ", "a  "),
        (9, "it is the end", "End"),
    ],
)
def test_ladder(spark, level, text, want):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert ladder.compress(d, level).first().compressed == want


@pytest.mark.parametrize("level", [2, 3, 4])
def test_ladder_evaluates_a_line_once(spark, level):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = ladder.compress(d, level)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"{{{ladder.LONG_TOKEN}}}") == 2  # what protects a line: its first look and the look that decides


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Please Note That it works", "It works"),
        ("x,plea\u017fe note that it works", "X, it works"),
        ("go ın order to w\u0130n", "Go to w\u0130n"),
        ("keep it. Eeep \u212aeep in mind that all", "Keep it. Eeep all"),
        ("\u3000two\u00a0 words\u2003.\u3000", "Two\u00a0 words."),
        ("a\u3000" + "b" * 23 + "\tc please note that", "A\u3000" + "b" * 23 + "\tc"),
        ("a\u3000" + "b" * 24 + " please note that", "a\u3000" + "b" * 24 + " please note that"),
    ],
)
def test_ladder_beyond_ascii(spark, text, want):
    assert ladder.compress(spark.createDataFrame([(1, text)], "doc_id long, text string"), 2).first().compressed == want


@pytest.mark.parametrize("level", [3, 4])
def test_ladder_drops_words_in_one_pass(spark, level):
    d = spark.createDataFrame([(1, "\U0001d400the end, a very\u3000the \u0130s-of the\u2003the1 that")], "doc_id long, text string")
    passes = lambda n: ladder.compress(d, n)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    assert passes(level) == passes(2) + 1
    assert ladder.compress(d, level).first().compressed == {3: "\U0001d400the end, \u0130s-of the1 that", 4: "\U0001d400the end, -the1"}[level]


def test_plain_lines(spark):
    """Only these skip what protects a line, phrases and white space before punctuation."""
    plain = ["", "It was the best.", "a caf\u00e9, (the \"end\") isn't 1", "x" * 23 + " y", "fact sheet", "word " * 200_000 + "end"]
    others = ["x" * 24, "  a", "a  b", "a .", "...", "a_b", "\u00e9\u00e9 a", "a\tb", "a\u00a0b", "\u2014 a", "to Note that a", "the \u017fame", "a\u3000b", "it wa\u0131ts"]
    assert one(spark, ladder.is_plain, *plain, *others) == [True] * len(plain) + [False] * len(others)


def _spelled(pattern):
    m = re.search(r"\(\?:([^()]*)\)(\??)|(.)\?", pattern)
    ways = [""] if not m else [*m[1].split("|"), *([""] if m[2] else [])] if m[1] is not None else [m[3], ""]
    return [x for w in ways for x in _spelled(pattern[: m.start()] + w + pattern[m.end() :])] if m else [pattern]


def test_every_phrase_has_a_part(spark):
    phrases = [x for p, _ in ladder.HEDGES + ladder.FILLER for x in _spelled(p)]
    assert len(phrases) > 50
    assert [x for x in phrases if not any(f" {part}" in x for part in ladder.PARTS)] == []
    assert min(map(len, ladder.PARTS)) >= 6
    assert not any(one(spark, ladder.is_plain, *[f"So {x.upper()} all" for x in phrases]))


@pytest.mark.parametrize("level", [3, 4])
def test_ladder_plain_lines_lose_the_same_words(spark, level):
    line = "The AN a (the end) \u00e9the th\u00e9 -the a\u00b7the _the that's \u00aban ox\u00bb really, Just rather the is-of to be. it has a"
    # The second line is the same but for its last word, which isn't plain.
    d = spark.createDataFrame([(1, f"{line} x\n{line} \u2014")], "doc_id long, text string")
    x, y = ladder.compress(d, level).first().compressed.split("\n")
    assert x[:-1] == y[:-1]
    assert x == {
        3: "(end) \u00e9the th\u00e9 -a\u00b7_the that's \u00abox\u00bb really, is-of to be. it has x",
        4: "(end) \u00e9the th\u00e9 -a\u00b7_the 's \u00abox\u00bb really, -. x",
    }[level]


def test_protected_lines_are_counted(spark):
    d = spark.createDataFrame([(1, "plain words here\n  indented\n" + "x" * 24 + "\n#### ####")], "doc_id long, text string")
    assert ladder.compress(d, 2).first().protected_lines == 3
    assert ladder.compress(d, -1).first().level == 0


SECRETS = {
    "aws-key": "AKIA" + "A1" * 8,
    "github-token": "ghp_" + "a" * 36,
    "slack-token": "xoxb-1234567890ab",
    "stripe-key": "sk_live_" + "a1" * 8,
    "api-key": "sk-ant-" + "a" * 20,
    "jwt": "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12,
    "private-key": "-----BEGIN RSA PRIVATE KEY-----",
}


def test_credentials(spark):
    texts = list(SECRETS.values())
    assert one(spark, lambda x: F.array_join(secrets.credential_kinds(x), ","), *texts) == list(SECRETS)
    named = ['DB_PASSWORD = "hunter2hunter2"', "password=password1", "imageTokens: rev.tokens1", "ask-password-console.path: Deactivated", "token: short"]
    assert one(spark, lambda x: F.array_join(secrets.credential_kinds(x), ","), *named) == ["named-secret", "named-secret", "", "", ""]
    assert one(spark, lambda x: secrets.redacted(x)[0], *named[:2]) == ['DB_PASSWORD = "[redacted:named-secret]"', "password=[redacted:named-secret]"]
    assert one(spark, lambda x: secrets.redacted(x)[1], f"{texts[0]} {texts[1]}", named[0], "x") == [2, 1, 0]


RISK = ["abc", "12345678", "123456789", "deadbe", "12ms", "1h30m0s", "2024-01-02T03", "v1.2.3", "00:1a:2b:3c:4d:5e", "8086:1f3a", "aGVsbG8gd29ybGQxMjM0", "pod-7f9c8d6b5-x2k4q", "xkcdqwrt", "understanding", "ee70833..0c331b6", "a1b2c3d4e5", "beautiful", "sixty-four"]


def test_risk_in_spark_and_python(spark):
    got = one(spark, needles.at_risk, *RISK)
    assert got == [needles.token_at_risk(v) for v in RISK]
    want = {"123456789", "deadbe", "00:1a:2b:3c:4d:5e", "8086:1f3a", "aGVsbG8gd29ybGQxMjM0", "pod-7f9c8d6b5-x2k4q", "xkcdqwrt", "ee70833..0c331b6", "a1b2c3d4e5"}
    assert {v for v, g in zip(RISK, got, strict=True) if g} == want


def test_sidecar_budget_and_order():
    kept, more, text = needles.sidecar("id=deadbeef01 at src/a.ts:10:5 10.0.0.1\nid=deadbeef01", 1000)
    assert kept == [(1, "deadbeef01"), (1, "src/a.ts:10:5"), (1, "10.0.0.1")] and more == 0 and text.startswith("·verbatim· 3 exact strings")
    many = "\n".join(f"id={i:04d}deadbeef" for i in range(400))
    kept, more, text = needles.sidecar(many, len(many))
    assert len(kept) + more == 400 and more and text.endswith(f"… +{more} more (needle-dense; keep the source as text)")
    assert needles.sidecar("deadbeef" * 40, 10) == ([], 0, "")


def test_sidecars_of_rows(spark):
    d = spark.createDataFrame([(1, "sha deadbeefcafe"), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (len(r.needles), r.more, r.dense) for r in needles.sidecars(d).collect()}
    assert got == {1: (1, 0, False), 2: (0, 0, False), 3: (0, 0, False)}
