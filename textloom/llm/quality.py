"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote bad, abstain or good on each text. Texts with the same votes form a pattern; there
are at most 3 ** len(RULES) patterns, and expectation-maximisation over the pattern counts, one
higher-order expression on a single row, estimates for each class how often each rule casts each vote
(its accuracy, where a vote misleads and where it abstains). A text's
posterior probability of being good replaces the test that it pass every rule. The estimates lean on the
starting table with the weight of ``LEAN`` of all texts, and no rule may vote bad on more than ``MISFIRE``
of good texts, so that the classes keep their meaning.

Defined results: null texts count as empty; a text without a word fails; repeated rows are judged each;
other columns are ignored (or carried by ``keep``); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROUNDS, LEAN, PRIOR = 25, 0.02, 0.8
#: Bound on bad votes for good texts. Starting table: how often a rule votes bad, abstains, votes good, in good and in bad texts.
MISFIRE = 0.01
START_GOOD, START_BAD = (0.004, 0.10, 0.896), (0.24, 0.10, 0.66)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """How many words lie in windows of ``k`` words that occur twice or more in the array."""

    def covered(sorted_windows: Column) -> Column:
        near = lambda e, i: (e["h"] == F.get(sorted_windows, i - 1)["h"]) | (e["h"] == F.get(sorted_windows, i + 1)["h"])
        again = F.filter(sorted_windows, lambda e, i: F.coalesce(near(e, i), F.lit(False)))
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(k), x - a["last"])).alias("n"))
        return F.aggregate(F.array_sort(F.transform(again, lambda e: e["i"])), start, step, lambda a: a["n"])

    def of_windows(h: Column) -> Column:
        # Most texts repeat no window; only the others are sorted.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    return F.when(F.size(words) < k, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: let(windows(w), of_windows)))


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id and the counts that the rules use."""
    plain = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t")).withColumn("words", F.filter(F.split("t", SPACE), lambda x: x != "")).withColumn("lines", lines)
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("t", " \t\n\x0b\x0c\r", "")),
        "n_symbols": plain(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_lines": F.size("lines"),
        "n_upper": plain("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_shouts": plain("!"),
        "n_stops": plain(".?!"),
        "n_digits": plain("0123456789"),
    }
    return rows.select("doc_id", *[c.cast("long").alias(k) for k, c in counts.items()])


def _rules() -> list[Column]:
    """Votes 0 bad, 1 abstain, 2 good. Each kind of junk is seen by two rules or more, since a rule that no other ever agrees with looks unreliable."""
    n, chars = F.col("n_words"), F.col("word_chars")
    vote = lambda bad, good: F.when(bad, 0).when(good, 2).otherwise(1)
    return [
        vote(n < 20, n >= 50),
        vote((chars < 2 * n) | (chars > 14 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        vote(10 * F.col("n_symbols") > 3 * n, 50 * F.col("n_symbols") <= n),
        vote(100 * F.col("n_repeat_words") > 30 * n, 100 * F.col("n_repeat_words") <= 10 * n),
        vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), F.col("n_dup_lines") == 0),
        vote(2 * F.col("n_upper") > chars, 5 * F.col("n_upper") <= chars),
        vote(5 * F.col("n_shouts") > n, 50 * F.col("n_shouts") <= n),
        vote(100 * F.col("n_stops") < n, (20 * F.col("n_stops") >= n) & (2 * F.col("n_stops") <= n)),
        vote(10 * F.col("n_digits") > 3 * chars, 20 * F.col("n_digits") <= chars),
        vote(25 * F.col("n_symbols") > chars, 200 * F.col("n_symbols") <= chars),
    ]


N_RULES = 10


def estimated(patterns: Column, n: int, rounds: int = ROUNDS) -> Column:
    """EM: array<struct<votes array<int>, n double>> to struct<prior, good array<double>, bad array<double>> (vote s of rule j at 3 j + s)."""
    start = lambda t: F.array(*[F.lit(x) for _ in range(n) for x in t])
    good0, bad0 = start(START_GOOD), start(START_BAD)

    def odds(p: Column, ratio: Column, votes: Column) -> Column:
        summed = F.aggregate(F.transform(votes, lambda s, j: F.element_at(ratio, j * 3 + s + 1)), F.lit(0.0), lambda a, x: a + x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.log(p / (1 - p)) + summed)))

    def step(p: Column, _: Column) -> Column:
        ratio = F.zip_with(p["good"], p["bad"], lambda g, b: F.log(g / b))

        def anew(q: Column) -> Column:
            every = F.aggregate(q, F.lit(0.0), lambda a, x: a + x["n"])
            likely = F.aggregate(q, F.lit(0.0), lambda a, x: a + x["g"])

            def table(weight: Callable[[Column], Column], mass: Column, first: Column) -> Column:
                count = lambda k: F.aggregate(q, F.lit(0.0), lambda a, x: a + F.when(F.element_at(x["votes"], F.floor(k / 3).cast("int") + 1) == k % 3, weight(x)).otherwise(0.0))
                return F.transform(first, lambda f, k: (count(k) + f * every * LEAN) / (mass + every * LEAN))

            # A rule's bad vote misfires on at most MISFIRE of good texts; the excess counts as abstaining.
            bounded = lambda t: F.transform(t, lambda x, k: F.when(k % 3 == 0, F.least(x, F.lit(MISFIRE))).when(k % 3 == 1, x + F.greatest(F.element_at(t, k) - MISFIRE, F.lit(0.0))).otherwise(x))
            return F.struct(
                ((likely + every * LEAN * PRIOR) / (every * (1 + LEAN))).alias("prior"),
                let(table(lambda x: x["g"], likely, good0), bounded).alias("good"),
                table(lambda x: x["n"] - x["g"], every - likely, bad0).alias("bad"),
            )

        return let(ratio, lambda r: let(F.transform(patterns, lambda t: F.struct(t["votes"].alias("votes"), t["n"].alias("n"), (t["n"] * odds(p["prior"], r, t["votes"])).alias("g"))), anew))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(PRIOR).alias("prior"), good0.alias("good"), bad0.alias("bad")), step)


def posteriors(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``voted`` (votes array<int>) to votes and quality, one row a pattern (3 ** N_RULES at most)."""
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("all")).where("size(all) > 0")
    fitted = one.withColumn("p", estimated(F.col("all"), N_RULES, rounds))
    ratio = F.zip_with(F.col("p.good"), F.col("p.bad"), lambda g, b: F.log(g / b))
    each = fitted.withColumn("r", ratio).select("p", "r", F.explode("all").alias("x")).select("x.votes", "p", "r")
    summed = F.aggregate(F.transform("votes", lambda s, j: F.element_at("r", j * 3 + s + 1)), F.lit(0.0), lambda a, x: a + x)
    return each.select("votes", (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.log(F.col("p.prior") / (1 - F.col("p.prior"))) + summed)))).alias("quality"))


def judged(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the counts, base_failed, quality (posterior) and kept."""
    rows = stash(counted(docs).withColumn("votes", F.array(*_rules())))
    table = F.broadcast(posteriors(rows, rounds))  # at most 3 ** N_RULES rows of a few dozen bytes
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.join(table, "votes").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
