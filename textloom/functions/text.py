"""Text primitives, log masks and line predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the results to match: white space, word boundaries, masks, weights.
#: Unicode White_Space, for Java character classes.
SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: A first look that rules out most characters at once, as white space is none of these.
NOT_PRINTABLE = "(?=[^!-~])"
WORD = "[0-9A-Za-z_]"
#: Before and after a word of ASCII word characters; EDGE is either, whatever the neighbours are.
HEAD, TAIL = f"(?<!{WORD})", f"(?!{WORD})"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
ANSI = "\\x1b\\[[0-9;]*[A-Za-z]"
#: Word characters may precede error and exception, so no boundary is looked for there.
IMPORTANT = (
    f"(?i)(?:error|exception)s?{TAIL}|(?=[ewfpctdras]){HEAD}(?:err|warn(?:ing)?s?|fail(?:s|ed|ure|ures)?|panic(?:s|ked)?|fatal|critical|traceback|denied|refused"
    f"|timeouts?|timed[^\\n\\r\\u2028\\u2029]?out|assert(?:s|ed|ion|ions)?|segfault(?:s|ed)?){TAIL}"
)
STAMP = "[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
# A first look at one character spares the lookbehind at most places.
UUID = f"(?i)(?=[0-9a-f]){HEAD}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}{TAIL}"
MASKS = (
    (STAMP, "<ts>"),
    (f"(?=[0-9]){HEAD}[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:[.,][0-9]+)?{TAIL}", "<time>"),
    (UUID, "<uuid>"),
    (f"(?i)(?=[0-9a-f]){HEAD}[0-9a-f]{{7,64}}{TAIL}", "<hex>"),
    (f"(?i)(?=[0-9]){HEAD}[0-9]+(?:\\.[0-9]+)?[ \\t\\u00a0]?(?:ms|us|[\\u00b5\\u03bc\\u039c]s|ns|s|m|h|%|[KMGT]i?B)?{EDGE}", "<n>"),
)
TOKEN_WEIGHTS = {"word": 161, "odd": 1501, "digit": 807, "punct": 690, "space": 428}
LONGEST_WORD = 14


def chars(text: Column) -> Column:
    """Code points."""
    return F.length(text).cast("long")


def octets(text: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(text).cast("long")


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def trim_space(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{SPACE}]+", ""), f"{NOT_PRINTABLE}[{SPACE}]+\\z", "")


def content_id(text: Column) -> Column:
    """First 12 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def percent_saved(before: Column, after: Column) -> Column:
    """round((1 - after / before) * 100), halves away from zero, in integers; 0 for nothing."""
    d = before - after
    size = F.floor((F.abs(d) * 200 + before) / (before * 2))
    return F.when(before == 0, F.lit(0)).otherwise(F.signum(d) * size).cast("long")


def text_tokens(text: Column) -> Column:
    """Estimated tokens from character classes, in per mille of weights, rounded half up.

    A run of ASCII letters counts as a word if it has a vowel and at most LONGEST_WORD letters, else
    as odd; other code points beyond ASCII count as punctuation and break runs.
    """
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    word_like = lambda r: (F.length(r) <= LONGEST_WORD) & r.rlike("[aeiouyAEIOUY]")
    word = F.aggregate(runs, F.lit(0), lambda a, r: a + F.when(word_like(r), F.length(r)).otherwise(0))
    # In longs: the weighted sum of a text of 3 MB may be beyond an int.
    n = F.length(text).cast("long")
    letters = n - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
    digits = n - F.length(F.translate(text, "0123456789", ""))
    space = n - F.length(F.translate(text, " \t\n\r", ""))
    w = TOKEN_WEIGHTS
    milli = word.cast("long") * w["word"] + (letters - word) * w["odd"] + digits * w["digit"] + space * w["space"] + (n - letters - digits - space) * w["punct"]
    return F.floor((milli + 500) / 1000).cast("long")


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, ANSI, "")


def last_frame(line: Column) -> Column:
    """What a terminal shows of a line: what follows the last carriage return, a final one aside."""
    return F.regexp_replace(F.regexp_replace(line, "\\r\\z", ""), "(?s)^.*\\r", "")


def is_important(line: Column) -> Column:
    return line.rlike(IMPORTANT)


def mask(line: Column) -> Column:
    """Volatile parts (times, ids, numbers) replaced by placeholders."""
    out = line
    for pattern, name in MASKS:
        out = F.regexp_replace(out, pattern, name)
    # No mask matches without one of these; most prose lines skip them all.
    return F.when(line.rlike("[0-9a-fA-F]"), out).otherwise(line)


def template(masked: Column) -> Column:
    """The masked line with every token that isn't all ASCII letters as <v>."""
    return F.array_join(F.transform(F.split(masked, f"[{SPACE}]+", -1), lambda t: F.when(t.rlike("^[A-Za-z]+\\z"), t).otherwise("<v>")), " ")


def squeezed_blank_lines(text: Column) -> Column:
    return F.when(text.contains("\n\n\n"), F.regexp_replace(text, "\\n{3,}", "\n\n")).otherwise(text)


def is_sensitive_path(path: Column) -> Column:
    """Whether a file of this name may hold credentials."""
    name = (
        "^\\.env(?:\\..+)?\\z|credential|secret|^id_(?:rsa|ed25519|ecdsa|dsa)(?:\\.pub)?\\z|\\.pem\\z|\\.p12\\z|\\.pfx\\z|\\.keystore\\z|\\.jks\\z|^\\.netrc\\z|^\\.npmrc\\z"
        "|^\\.pypirc\\z|\\.kdbx\\z|^known_hosts\\z|^\\.htpasswd\\z|\\.tfstate(?:\\.backup)?\\z"
    )
    base = F.lower(F.element_at(F.split(path, "[/\\\\]", -1), -1))
    folders = F.array(*[F.lit(x) for x in (".aws", ".ssh", ".gnupg", ".kube")])
    return base.rlike(name) | F.arrays_overlap(F.split(path, "[/\\\\]", -1), folders)


def is_volatile(prompt: Column) -> Column:
    """Whether a prompt holds a uuid, a time stamp or a signed token, which break prefix caches."""
    return prompt.rlike(UUID) | prompt.rlike(STAMP) | prompt.rlike("eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.")
