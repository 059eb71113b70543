"""Graded prose compression: 0 none, 1 whitespace (lossless), 2 prose (light), 3 dense (medium), 4 caveman (heavy)."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.json import let

LEVELS = ((0, "none", "lossless"), (1, "whitespace", "lossless"), (2, "prose", "light"), (3, "dense", "medium"), (4, "caveman", "heavy"))

# Fixed values of the results to match.
#: Word characters of Unicode, for boundaries.
W = "[\\p{IsAlphabetic}\\p{M}\\p{Nd}\\p{Pc}\\u200C\\u200D]"
#: Those of ASCII, all named, as a class of single characters is the quickest to look up.
ASCII_W = string.ascii_letters + string.digits + "_"
LONG_TOKEN = 24
#: Letters beyond ASCII that patterns without case take for one of ASCII.
ODD_LETTERS = "\u017f\u212a\u0130\u0131"
PLAIN = "a-zA-Z0-9.,;:'\"!?()\\-"
#: Those of PLAIN and white space that are quick to drop, all named.
SOME_PLAIN = " .,;:'\"!?()\\-" + string.ascii_letters + string.digits
#: Those of Latin-1 that aren't white space, all named.
LATIN = "".join(map(chr, range(0xA1, 0x100)))
HEDGES = (
    ("it (?:might|may|could) (?:potentially )?be worth (?:considering|noting|mentioning) that", ""),
    ("it is worth (?:noting|mentioning) that", ""),
    ("(?:please )?keep in mind that", ""),
    ("it goes without saying that", ""),
    ("needless to say,?", ""),
    ("in my (?:personal )?opinion,?", ""),
    ("as far as i (?:can tell|know),?", ""),
    ("at the end of the day,?", ""),
    ("make sure to", ""),
    ("you (?:should|need to|must) (?:make sure|ensure) that", "ensure"),
    ("i(?:'d| would) recommend (?:using|trying)", "use"),
    ("i(?:'d| would) recommend", ""),
    ("to be honest,?", ""),
    ("it turns out(?: that)?", ""),
)
FILLER = (
    ("in order to", "to"),
    ("due to the fact that", "because"),
    ("at this point in time", "now"),
    ("in the event that", "if"),
    ("for the purpose of", "for"),
    ("with regard to", "about"),
    ("a large number of", "many"),
    ("it is important to note that", ""),
    ("please note that", ""),
    ("as a matter of fact", ""),
    ("in terms of", "for"),
    ("the fact that", "that"),
)
#: A part of each phrase that follows a space in it, of six characters at least.
PARTS = (
    "worth ", "mind that", "goes without", "to say", "opinion", "far as i", "end of", "sure t", "ensure that", "recommend", "honest", "turns out", "order to", "fact that", "matter of", "point in", "event that",
    "purpose of", "regard to", "number of", "note that", "terms of",
)
ARTICLES = "the|an|a"
INTENSIFIERS = "very|really|just|actually|basically|simply|quite|rather|essentially|literally"
FUNCTION_WORDS = (
    "is|are|was|were|am|be|been|being|do|does|did|have|has|had|will|would|shall|should|can|could|may|might|of|to|in|on|at|for|with|that|this|these|those|it|its|there|here"
)


def is_plain(line: Column) -> Column:
    """True only for lines that aren't protected, no phrase matches and no white space is to be dropped from: short words of PLAIN and Latin-1, a space apart, that neither begin with what closes a sentence nor with a part of a phrase."""
    inner = SOME_PLAIN[1:] + LATIN
    word = f"(?!{_ahead(PARTS, 6)}{_forked(PARTS, CASED)})[{inner.translate(str.maketrans('', '', '.,;:!?'))}][{inner}]{{0,{LONG_TOKEN - 2}}}+"
    # What is beyond ASCII counts as a symbol; each such character has a byte more at least.
    return (10 * (F.octet_length(line) - F.length(line)) <= 3 * F.length(line)) & line.rlike(f"^(?:{word} )*+(?:{word})?\\z")


def is_protected(line: Column) -> Column:
    """Indented, rich in symbols (over 30 %), or with a token of 24 code points or more."""
    rich = lambda x: 10 * F.length(x) > 3 * F.length(line)
    symbols = let(F.regexp_replace(line, f"[{SOME_PLAIN}]+", ""), lambda x: rich(x) & rich(F.regexp_replace(x, f"[{PLAIN}{T.SPACE}]+", "")))
    # The class of all white space is slow to try, so that only lines that go so far without a plain space are tried.
    long = line.rlike(f"^ *(?:[^ ]{{1,{LONG_TOKEN - 1}}} +)*+[^ ]{{{LONG_TOKEN}}}") & line.rlike(f"(?:^|{T.NOT_PRINTABLE}[{T.SPACE}])[^{T.SPACE}]{{{LONG_TOKEN}}}")
    return (line != "") & (line.startswith(" ") | line.startswith("\t") | symbols | long)


def _starts(pattern: str) -> set[str]:
    optional = "(?:please )?"
    return {"p", pattern[len(optional)]} if pattern.startswith(optional) else {pattern[0]} if "(" in pattern else {w[0] for w in pattern.split("|")}


def _words(pattern: str, tail: str) -> str:
    """Words after a boundary. A look at the first letter spares the lookbehind at most places."""
    starts = _starts(pattern)
    first = "".join(sorted(starts)) + ("\\u017f" if "s" in starts else "")
    return f"(?iu)(?=[{first}])(?<!{W})(?:{pattern}){tail}"


def _phrase(pattern: str) -> str:
    return _words(pattern, f"(?!{W})")


#: Letters without case, and with those of ODD_LETTERS that are taken for them.
CASED = {c: f"[{c}{c.upper()}]" for c in string.ascii_lowercase}
ODD_CASED = CASED | {c: f"[{c}{c.upper()}{odd}]" for c, odd in (("s", ODD_LETTERS[0]), ("k", ODD_LETTERS[1]), ("i", ODD_LETTERS[2:]))}


def _ahead(words: Sequence[str], n: int) -> str:
    """A first look at ``n`` characters, spaces after shorter words, that rules out most words."""
    return f"(?={''.join('[' + ''.join(sorted({CASED.get(c, '[' + c + ']')[1:-1] for w in words for c in w[i : i + 1] or ' '})) + ']' for i in range(n))})"


def _forked(words: Sequence[str], cased: dict[str, str] | None = None) -> str:
    """Patterns as one that tries letters they begin with alike once, as classes of ``cased``; what follows letters and spaces in a pattern is left as it is."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1] if w[:1].islower() or w[:1] == " " else "", []).append(w)
    whole = by.pop("", [])
    ways = [(cased or {}).get(c, c) + _forked([w[1:] for w in rest], cased) for c, rest in by.items()] + whole
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"  # a group costs as much as two characters


def _may_hold(line: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    """False only where no phrase matches: where the line in lower case has none that follows no letter of ASCII, nor a letter beyond ASCII that equals one of ASCII without case."""
    optional = "(?:please )?"
    found = _forked([w for p, _ in phrases for w in ([optional[3:-2] + p[len(optional) :], p[len(optional) :]] if p.startswith(optional) else [p])])
    letters = string.ascii_lowercase
    found = F.lower(line).rlike(f"^[^{letters}]*(?:(?!{found})[{letters}]+[^{letters}]*)*+{found}")
    return reduce(lambda a, b: a | b, [line.contains(c) for c in ODD_LETTERS], found)


def _without(line: Column, *steps: tuple[str, str]) -> Column:
    """Whole words of any case that what is named with them follows are dropped, with the white space behind them.

    Neither what precedes a word nor what follows it changes for others by its going, so one pass does for all steps. Each
    match holds the words that stay, up to the next to go or the end, so that only where a word begins is one looked for.
    """
    gone = _forked([f"{w}(?![{ASCII_W}]){after}" for words, after in steps for w in words.split("|")], ODD_CASED)
    beyond = "(?=[^\\x00-\\x7F])"
    between = "".join(f"\\x{i:02x}" for i in range(128) if chr(i) not in ASCII_W)
    # A word of ASCII and what is between it and the next; those beyond ASCII are slow to look up.
    kept = f"(?!{gone})[{ASCII_W}]*[{between}]+|[{between}]+|{beyond}[^{W[1:-1]}]|(?!{gone})(?:[{ASCII_W}]+|{beyond}{W})++"
    return F.array_join(F.regexp_extract_all(line, F.lit(f"((?:{kept})*+)(?:{gone} *(?:{T.NOT_PRINTABLE}[{T.SPACE}]+)?|\\z)"), F.lit(1)), "")


def _plain_without(line: Column, *steps: tuple[str, str]) -> Column:
    """``_without`` for plain lines: what is named with words is dropped with them, and only classes of Latin-1 are looked up."""
    latin = "".join(c for c in LATIN if c.isalpha())
    between = "".join(f"\\x{ord(c):02x}" for c in map(chr, range(256)) if c not in ASCII_W + latin)
    words = [w for words, _ in steps for w in words.split("|")]
    gone = _ahead(words, 2) + _forked([w + after.format(W=ASCII_W + latin) for words, after in steps for w in words.split("|")], CASED)
    return F.substring(F.regexp_replace(F.concat(F.lit(" "), line), f"([{between}])(?:{gone})++", "$1"), 2, 1 << 30)


def _replaced(line: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda s, step: F.regexp_replace(s, *step), steps, line)


def tightened(line: Column, level: int, plain: Column) -> Column:
    """A line of prose at level 2, 3 or 4, before its first letter is raised; ``plain`` is its ``is_plain``."""
    phrases = (HEDGES if level >= 2 else ()) + FILLER
    # A line that no phrase matches stays as it is through all of these steps.
    single = lambda s: F.when(s.contains("  "), _replaced(s, [(" {2,}", " ")])).otherwise(s)
    whole = F.when(plain, line).otherwise(let(single(line), lambda s: F.when(_may_hold(s, phrases), _replaced(s, [(_phrase(p), r) for p, r in phrases])).otherwise(s)))
    if level >= 3:
        spaced = f"(?=[{T.SPACE}])"
        words = [(ARTICLES, spaced, " "), (INTENSIFIERS, spaced, " "), *([(FUNCTION_WORDS, f"(?!{W})", "(?![{W}]) ?")] if level >= 4 else [])]
        whole = let(whole, lambda s: F.when(plain, _plain_without(s, *[(w, after) for w, _, after in words])).otherwise(_without(s, *[(w, after) for w, after, _ in words])))
    # As white space is slow to look for, only lines where some may be found go through what follows.
    closed = lambda s: F.when(s.rlike(f"[.,;:!?](?<={T.NOT_PRINTABLE}[{T.SPACE}].)"), _replaced(s, [(f"{T.NOT_PRINTABLE}[{T.SPACE}]+([.,;:!?])", "$1")])).otherwise(s)
    bare = lambda s: F.when(F.concat(F.substring(s, 1, 1), F.substring(s, -1, 1)).rlike("[^!-~]"), T.trim_space(s)).otherwise(s)
    ended = lambda s: let(let(single(s), closed), bare)
    # Up to level 3 the last word of a plain line stays, as does every word before what closes a sentence.
    return let(whole, lambda s: F.when(plain, s).otherwise(ended(s)) if level <= 3 else ended(s))


def capitalised(line: Column) -> Column:
    return F.when(F.substring(line, 1, 1).rlike("^[a-z]"), F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, 2, 1 << 30))).otherwise(line)


def clamp(level: float) -> int:
    return max(0, min(4, int(level)))


def compress(docs: DataFrame, level: float) -> DataFrame:
    """doc_id, compressed, protected_lines, level of each text of ``docs`` (doc_id, text)."""
    n = clamp(level)
    t = F.col("text")
    if n == 0:
        return docs.select("doc_id", t.alias("compressed"), F.lit(0).cast("long").alias("protected_lines"), F.lit(0).alias("level"))
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.when(x.endswith(" ") | x.endswith("\t"), F.regexp_replace(x, "[ \\t]+\\z", "")).otherwise(x))
    if n == 1:
        return docs.select("doc_id", T.squeezed_blank_lines(F.array_join(lines, "\n")).alias("compressed"), F.lit(0).cast("long").alias("protected_lines"), F.lit(n).alias("level"))
    # In steps, so that what protects a line and the chain of replacements are evaluated once a line.
    shown = lambda x, plain, kept: F.struct(kept.alias("kept"), F.when(kept, x).otherwise(let(tightened(x, n, plain), capitalised)).alias("line"))
    done = F.transform(lines, lambda x: let(is_plain(x), lambda plain: let(~plain & is_protected(x), lambda kept: shown(x, plain, kept))))
    out, kept = F.transform("done", lambda d: d["line"]), F.size(F.filter("done", lambda d: d["kept"]))
    return docs.select("doc_id", done.alias("done")).select("doc_id", T.squeezed_blank_lines(F.array_join(out, "\n")).alias("compressed"), kept.cast("long").alias("protected_lines"), F.lit(n).alias("level"))
