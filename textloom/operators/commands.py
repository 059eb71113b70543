"""Command output crushed: progress and noise lines go; a success keeps only its summary lines.

Rules are rows of a constant table compiled into expressions; captures are rows (doc_id, cmd, exit, text).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the results to match.
SPINNER = "⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏"
PROGRESS = f"^[{T.SPACE}\\uFEFF]*[\\[(]?[0-9]{{1,3}}%[\\])]?[{T.SPACE}\\uFEFF]*\\z"
BLANK = f"^[{T.SPACE}\\uFEFF]*\\z"
HUNK_BODY, LIST_ROWS = 100, 200
HUNK_HEADER = "^(?:diff --git|index |--- |\\+\\+\\+ |@@ )"


class Rule(NamedTuple):
    """Lines that are noise, lines that sum up a success, and whether noise goes before the summary is sought."""

    name: str
    commands: tuple[str, ...]
    subs: tuple[str, ...]
    noise: str
    success: str | None
    noise_first: bool


RULES = (
    Rule(
        "cargo", ("cargo",), (),
        f"^[{T.SPACE}]*(?:Compiling|Downloading|Downloaded|Checking|Fresh|Updating|Locking|Adding|Removing|Installing|Installed|Building|Blocking|Running|Finished) ",
        "test result:|^warning", False,
    ),
    Rule(
        "npm-install", ("npm", "pnpm", "yarn", "bun"), ("install", "i", "add", "ci", "update", "up"), "^npm (?:WARN|notice) |^> ",
        "^(?:added|removed|changed|up to date|audited|found [0-9]+ vulnerabilit|[0-9]+ vulnerabilit|Done in|[0-9]+ packages? installed)", False,
    ),
    Rule("pytest", ("pytest", "py.test"), (), "^[.FEsxX]{4,}\\z", "^=+ .* =+\\z", True),
    Rule("go-test", ("go",), ("test",), "^=== (?:RUN|PAUSE|CONT) ", f"^(?:ok|PASS){T.TAIL}", True),
    Rule("git-status", ("git",), ("status",), f"^[{T.SPACE}]*\\(use \"git .*\\)\\z", None, True),
    Rule("tsc", ("tsc",), (), BLANK, None, True),
    Rule("eslint", ("eslint",), (), BLANK, "^(?:✖|.*problems? \\()", True),
)
LISTS = (("ls", ""), ("find", ""), ("grep", ""), ("rg", ""), ("fd", ""), ("docker", "ps"), ("kubectl", "get"))


def base_name(cmd: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.get(cmd, F.lit(0)), F.lit("")), "(?s)^.*[/\\\\]", ""), "\\.exe\\z", "")


def _ruled(rule: Rule) -> tuple[Column, Column]:
    """Lines left of ``shown`` by a rule, and whether it changed them."""
    quiet = F.filter("shown", lambda x: ~x.rlike(rule.noise))
    changed = F.size(quiet) < F.size("shown")
    if rule.success is None:
        return quiet, changed
    summary = F.filter(quiet if rule.noise_first else F.col("shown"), lambda x: x.rlike(rule.success))
    summed = (F.col("exit") == 0) & (F.size(summary) > 0)
    return F.when(summed, summary).otherwise(quiet), changed | summed


def _hunks() -> Column:
    """Lines of a diff with at most HUNK_BODY lines of each hunk's body; a count stands for the others."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside"), F.lit(0).alias("n"))
    more = lambda a: F.when(a["inside"] & (a["n"] > HUNK_BODY), F.array(F.concat(F.lit("[... "), (a["n"] - HUNK_BODY).cast("string"), F.lit(" lines truncated]")))).otherwise(F.array().cast("array<string>"))

    def step(a: Column, x: Column) -> Column:
        head = x.rlike(HUNK_HEADER)
        keep = F.when(head, F.concat(a["out"], more(a), F.array(x))).when(a["inside"] & (a["n"] >= HUNK_BODY), a["out"]).otherwise(F.concat(a["out"], F.array(x)))
        return F.struct(keep.alias("out"), F.when(head, x.startswith("@@ ")).otherwise(a["inside"]).alias("inside"), F.when(head, 0).when(a["inside"], a["n"] + 1).otherwise(a["n"]).alias("n"))

    return F.aggregate("shown", start, step, lambda a: F.concat(a["out"], more(a)))


def crushed(captures: DataFrame) -> DataFrame:
    """doc_id, text, rule (null if nothing shrank) of captures (doc_id, cmd array<string>, exit, text)."""
    frames = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, "(?s)^.*\\r", ""))
    spin = f"^[{SPINNER} \\t]*[{SPINNER}][{SPINNER} \\t]*\\z"
    shown = F.filter(frames, lambda x: ~x.rlike(spin) & ~x.rlike(PROGRESS))
    rows = captures.select("doc_id", "cmd", "exit", "text", shown.alias("shown"), base_name(F.col("cmd")).alias("base"), F.coalesce(F.get("cmd", F.lit(1)), F.lit("")).alias("sub"))
    lines, label = F.col("shown"), F.lit(None).cast("string")
    for rule in RULES:
        fits = F.col("base").isin(*rule.commands) & (F.col("sub").isin(*rule.subs) if rule.subs else F.lit(True))
        left, changed = _ruled(rule)
        lines, label = F.when(fits, left).otherwise(lines), F.when(fits, F.when(changed, rule.name)).otherwise(label)
    diff = (F.col("base") == "git") & F.col("sub").isin("diff", "show")
    hunks = _hunks()
    lines, label = F.when(diff, hunks).otherwise(lines), F.when(diff, F.when(F.exists(hunks, lambda x: x.rlike("^\\[\\.\\.\\. [0-9]+ lines truncated\\]\\z")) & (hunks != F.col("shown")), "git-diff")).otherwise(label)
    listed = F.lit(False)
    for base, sub in LISTS:
        listed = listed | ((F.col("base") == base) & ((F.col("sub") == sub) if sub else F.lit(True)))
    cap = F.concat(F.slice("shown", 1, LIST_ROWS), F.array(F.concat(F.lit("[... "), (F.size("shown") - LIST_ROWS).cast("string"), F.lit(" more lines]"))))
    over = listed & (F.size("shown") > LIST_ROWS)
    lines, label = F.when(over, cap).otherwise(lines), F.when(over, "list-cap").otherwise(label)
    rows = rows.select("doc_id", "text", "cmd", lines.alias("lines"), label.alias("label")).withColumn("out", F.array_join("lines", "\n"))
    rows = rows.withColumn("out", F.when(F.col("out").rlike(BLANK), "ok").otherwise(F.col("out")))
    better = (F.size("cmd") > 0) & (F.col("text") != "") & (F.length("out") < F.length("text"))
    return rows.select("doc_id", F.when(better, F.col("out")).otherwise(F.col("text")).alias("text"), F.when(better, F.coalesce("label", F.lit("generic"))).alias("rule"))


def captured(runs: DataFrame) -> DataFrame:
    """``runs`` (stdout, stderr) with text: both streams of a command as one."""
    err = F.coalesce("stderr", F.lit(""))
    return runs.withColumn("text", F.when(err == "", F.coalesce("stdout", F.lit(""))).otherwise(F.concat(F.coalesce("stdout", F.lit("")), F.lit("\n--- stderr ---\n"), err)))
