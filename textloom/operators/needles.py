"""Exact strings that a misread would silently corrupt: which tokens are at risk, and the list to carry beside pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import EDGE

# Fixed values of the results to match.
SHARE, LEAST = 2, 256
#: In order of priority; names are ours.
PATTERNS = (
    ("uuid", "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("digest", f"{EDGE}(?:sha1|sha256|sha384|sha512|md5|blake2b|blake2s|blake3):[0-9a-fA-F]{{8,128}}"),
    ("address", f"{EDGE}0x[0-9a-fA-F]{{8,64}}{EDGE}"),
    ("frame", "[A-Za-z0-9_./-]*[/.][A-Za-z0-9_.-]*:[0-9]+:[0-9]+"),
    ("hex", f"{EDGE}[0-9a-fA-F]{{12,64}}{EDGE}"),
    ("ipv4", f"{EDGE}(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}(?::[0-9]{{1,5}})?{EDGE}"),
    ("version", f"{EDGE}[0-9]+\\.[0-9]+\\.[0-9]+(?:-[0-9A-Za-z][0-9A-Za-z.-]*)?{EDGE}"),
)
#: Shapes that sequence or format restores: measures, durations, dates, clocks, versions.
RECOVERABLE = (
    "^[0-9]+(?:\\.[0-9]+)?(?:ns|us|ms|s|m|h|d|B|KB|MB|GB|TB|KiB|MiB|GiB|TiB|%)\\z",
    "^(?:[0-9]+h)?(?:[0-9]+m)?[0-9]+(?:\\.[0-9]+)?s\\z",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9A-Za-z:.+-]*\\z",
    "^[0-9]{2}:[0-9]{2}:[0-9]{2}[0-9.,]*\\z",
    "^[vV]?[0-9]+(?:[._][0-9]+)+\\z",
)
GROUPED = "^(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\\z|^(?:[0-9a-fA-F]{4,}[:-])+[0-9a-fA-F]{4,}\\z"
BASE64 = "^[A-Za-z0-9+/]{16,}={0,2}\\z"
CONSONANTS = "[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{5}"
VOWELS = "aeiouyAEIOUY"


def named(text: Column, name: str) -> Column:
    """All matches of one named pattern."""
    return F.regexp_extract_all(text, F.lit(dict(PATTERNS)[name]), F.lit(0))


def at_risk(v: Column) -> Column:
    """Whether losing one character of a token would be silent and past repair."""
    # In UTF-16 units; all but characters beyond the basic plane count one.
    n = F.when(F.octet_length(v) == F.length(v), F.length(v)).otherwise((F.octet_length(F.encode(v, "UTF-16BE")) / 2).cast("int"))
    digit, upper, lower = v.rlike("[0-9]"), v.rlike("[A-Z]"), v.rlike("[a-z]")

    def segment(s: Column) -> Column:
        size, has_digit, has_letter = F.length(s), s.rlike("[0-9]"), s.rlike("[A-Za-z]")
        vowels = size - F.length(F.translate(s, VOWELS, ""))
        return (
            ((size >= 6) & s.rlike("^[0-9a-fA-F]+\\z") & has_letter) | ((size >= 9) & ~has_letter) | ((size >= 8) & has_digit & has_letter)
            | ((size >= 8) & ~has_digit & (s.rlike(CONSONANTS) | (vowels * 100 < size * 15)))
        )

    runs = F.size(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)))
    flips = 2 * runs - v.rlike("^[0-9]").cast("int") - v.rlike("[0-9]\\z").cast("int")
    mixed = (n >= 10) & digit & (upper | lower) & (flips >= 3)
    shape = v.rlike(GROUPED) | (digit & upper & lower & v.rlike(BASE64)) | F.exists(F.regexp_extract_all(v, F.lit("[0-9A-Za-z]+"), F.lit(0)), segment) | mixed
    known = v.rlike("|".join(RECOVERABLE))
    return F.when(n < 6, False).when(v.rlike("^[0-9]+\\z"), n >= 9).when(v.rlike("^[0-9a-fA-F]+\\z"), True).when(known, False).otherwise(shape)


def bare_tokens(line: Column) -> Column:
    """Tokens between spaces and tabs: the value of a key=value of six characters or more, without wrapping punctuation."""
    value = lambda t: F.when(t.rlike("(?s)^.+=[^=]{6,}\\z"), F.regexp_replace(t, "(?s)^.*=", "")).otherwise(t)
    trim = lambda t: F.regexp_replace(F.regexp_replace(value(t), "^[^0-9A-Za-z]+", ""), "[^0-9A-Za-z=+/]+\\z", "")
    return F.filter(F.transform(F.split(line, "[ \\t]+", -1), trim), lambda t: t != "")


def risky_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), nth, token: tokens at risk."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    tokens = lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.posexplode(bare_tokens(F.col("line"))).alias("nth", "token"))
    return tokens.where(at_risk(F.col("token")))


def budget(raw_chars: Column) -> Column:
    """Characters that the list may take beside a text of so many."""
    return F.greatest(F.lit(LEAST), F.floor(raw_chars / SHARE)).cast("long")


_RECOVERABLE = [re.compile(p.replace("\\z", "\\Z")) for p in RECOVERABLE]
_GROUPED, _BASE64, _CONSONANTS = (re.compile(p.replace("\\z", "\\Z")) for p in (GROUPED, BASE64, CONSONANTS))
_PATTERNS = [re.compile(p) for _, p in PATTERNS]
_ALNUM = re.compile("[0-9A-Za-z]")


def token_at_risk(v: str) -> bool:
    """``at_risk`` of one string."""
    n = len(v.encode("utf-16-le")) // 2
    if n < 6:
        return False
    if re.fullmatch("[0-9]+", v):
        return n >= 9
    if re.fullmatch("[0-9a-fA-F]+", v):
        return True
    if any(p.search(v) for p in _RECOVERABLE):
        return False
    digit, upper, lower = (bool(re.search(c, v)) for c in ("[0-9]", "[A-Z]", "[a-z]"))
    if _GROUPED.search(v) or (digit and upper and lower and _BASE64.search(v)):
        return True
    for s in re.findall("[0-9A-Za-z]+", v):
        d, a = bool(re.search("[0-9]", s)), bool(re.search("[A-Za-z]", s))
        if (len(s) >= 6 and a and re.fullmatch("[0-9a-fA-F]+", s)) or (len(s) >= 9 and not a) or (len(s) >= 8 and d and a):
            return True
        if len(s) >= 8 and not d and (_CONSONANTS.search(s) or sum(c in VOWELS for c in s) * 100 < len(s) * 15):
            return True
    flips = 2 * len(re.findall("[0-9]+", v)) - bool(re.match("[0-9]", v)) - bool(re.search("[0-9]\\Z", v))
    return n >= 10 and digit and (upper or lower) and flips >= 3


def line_needles(line: str) -> Iterator[str]:
    """Exact strings of a line: tokens at risk from left to right, then matches of the patterns that overlap nothing taken."""
    taken: list[tuple[int, int]] = []
    for m in re.finditer("[^ \\t]+", line):
        s, e = m.span()
        eq = line.rfind("=", s, e)
        if eq > s and e - (eq + 1) >= 6:
            s = eq + 1
        while s < e and not _ALNUM.match(line[s]):
            s += 1
        while e > s and not re.match("[0-9A-Za-z=+/]", line[e - 1]):
            e -= 1
        if e > s and token_at_risk(line[s:e]):
            taken.append((s, e))
            yield line[s:e]
    for pattern in _PATTERNS:
        for m in pattern.finditer(line):
            if not any(m.start() < b and m.end() > a for a, b in taken):
                taken.append(m.span())
                yield m[0]


def sidecar(text: str, raw_chars: int) -> tuple[list[tuple[int, str]], int, str]:
    """Needles carried (line, value), how many more there are, and the list as text."""
    most, used, full, more = max(LEAST, raw_chars // SHARE), 0, False, 0
    seen: set[str] = set()
    kept: list[tuple[int, str]] = []
    for i, line in enumerate(text.split("\n"), 1):
        for v in line_needles(line):
            if v in seen:
                continue
            seen.add(v)
            cost = 3 + len(str(i)) + len(v.encode("utf-16-le")) // 2
            full = full or used + cost > most
            if full:
                more += 1
            else:
                used += cost
                kept.append((i, v))
    if not kept:
        return [], 0, ""
    head = f"·verbatim· {len(kept)}{f' of {len(kept) + more}' if more else ''} exact strings (read them here, not from pixels)"
    tail = f"\n… +{more} more (needle-dense; keep the source as text)" if more else ""
    return kept, more, head + "".join(f"\nL{i} {v}" for i, v in kept) + tail


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    needle = pa.list_(pa.struct([("line", pa.int64()), ("value", pa.string())]))
    for batch in batches:
        found = [sidecar(t or "", r if r is not None else len(t or "")) for t, r in zip(batch.column("text").to_pylist(), batch.column("raw_chars").to_pylist(), strict=True)]
        lists = pa.array([[{"line": i, "value": v} for i, v in kept] for kept, _, _ in found], needle)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([m for _, m, _ in found], pa.int64()), pa.array([t for _, _, t in found], pa.string())], names=["doc_id", "needles", "more", "sidecar"])


def sidecars(docs: DataFrame) -> DataFrame:
    """doc_id, needles, more, dense, sidecar, tokens of each text (doc_id, text, and raw_chars where the budget goes by another text)."""
    own = docs if "raw_chars" in docs.columns else docs.withColumn("raw_chars", F.length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = own.select("doc_id", "text", F.col("raw_chars").cast("long").alias("raw_chars")).mapInArrow(_scan, f"doc_id {kind}, needles array<struct<line: bigint, value: string>>, more bigint, sidecar string")
    return out.select("doc_id", "needles", "more", (F.col("more") > 0).alias("dense"), "sidecar", T.text_tokens(F.col("sidecar")).alias("tokens"))


def verbatim_mode(word: Column) -> Column:
    """full, lazy or off; what isn't recognised means full."""
    return F.when(F.lower(word).isin("lazy"), "lazy").when(F.lower(word).isin("off", "false"), "off").otherwise("full")


def pointer(found: Column) -> Column:
    """The line that stands for a list withheld."""
    return F.concat(F.lit("·verbatim· "), found.cast("string"), F.lit(" exact strings withheld (lazy) - fetch query=<substring>, or verify to settle one value"))
