"""Credentials: which kinds a text holds, and the text without them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import HEAD, TAIL, WORD

# Fixed values of the results to match: kind and pattern, in order of replacement.
_B, _E = HEAD, TAIL
CREDENTIALS = (
    ("aws-key", f"{_B}(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{{16}}{_E}"),
    ("gcp-key", f"{_B}AIza[0-9A-Za-z_-]{{35}}(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"),
    ("github-token", f"{_B}(?:ghp|gho|ghu|ghs|ghr)_[0-9A-Za-z]{{36}}{_E}"),
    ("github-pat", f"{_B}github_pat_[0-9A-Za-z_]{{82}}{_E}"),
    ("slack-token", f"{_B}xox[baprs]-[0-9A-Za-z-]{{10,}}"),
    ("stripe-key", f"{_B}(?:sk|rk)_live_[0-9A-Za-z]{{16,}}{_E}"),
    ("api-key", f"{_B}sk-(?:ant-|proj-)?[A-Za-z0-9_-]{{20,}}(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"),
    ("private-key", "-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----"),
    ("jwt", f"{_B}eyJ[A-Za-z0-9_-]{{10,}}\\.eyJ[A-Za-z0-9_-]{{10,}}\\.[A-Za-z0-9_-]{{10,}}(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"),
)
_S = "\\x09-\\x0D\\x20\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: An assignment whose left side names a secret; the value is the second group.
NAMED = (
    f"(?i)((?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))[A-Za-z0-9_.-]*(?:secret|password|passwd|token|credential|auth[_-]?key|api[_-]?key|access[_-]?key|private[_-]?key)\"?"
    f"[{_S}]*[=:][{_S}]*\"?)([^{_S}\"',;`\\[]{{8,}})(\"?)"
)


#: What a text must hold for a kind's pattern to be worth trying. Texts without any of it, most of all texts, are passed by.
LITERALS = {
    "aws-key": ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA"), "gcp-key": ("AIza",), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github-pat": ("github_pat_",), "slack-token": ("xox",),
    "stripe-key": ("_live_",), "api-key": ("sk-",), "private-key": ("PRIVATE KEY-----",), "jwt": ("eyJ",),
}
NAMES = f"(?i)(?:secret|password|passwd|token|credential|auth[_-]?key|api[_-]?key|access[_-]?key|private[_-]?key)\"?[{_S}]*[=:]"


def _maybe(text: Column, kind: str) -> Column:
    return text.rlike(NAMES) if kind == "named-secret" else reduce(or_, [text.contains(x) for x in LITERALS[kind]])


def credential_kinds(text: Column) -> Column:
    """Sorted kinds found in a text; never the secrets themselves."""
    kinds = [F.when(_maybe(text, k) & text.rlike(p), F.lit(k)) for k, p in (*CREDENTIALS, ("named-secret", NAMED))]
    return F.array_sort(F.filter(F.array(*kinds), lambda k: k.isNotNull()))


def redacted(text: Column) -> tuple[Column, Column]:
    """The text with every secret replaced by its kind, and how many values were replaced."""
    count, out = F.lit(0), text
    for kind, pattern in CREDENTIALS:
        count = count + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, f"[redacted:{kind}]")
    count = count + F.regexp_count(out, F.lit(NAMED))
    # A replacement makes no literal of another kind, so the text itself says whether any of them can match.
    some = reduce(or_, [_maybe(text, k) for k in (*LITERALS, "named-secret")])
    return F.when(some, F.regexp_replace(out, NAMED, "$1[redacted:named-secret]$3")).otherwise(text), F.when(some, count).when(text.isNotNull(), 0).cast("long")
