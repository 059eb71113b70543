"""The engine's tools for single texts: a registry of knobs, argument checks, and one call for each tool.

    call(spark, "distill", {"text": log, "query": "timeout"})

Each call runs the same plan as for a table, on a table of one row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import geometry, jsonrows, ladder, ledger, lines, needles, pages, pricing, secrets, store
from .operators.distill import distill, searched
from .plans import pipeline
from .sources import tables

# Fixed values of the results to match.
INLINE_PAGES, MAX_LEVEL = 6, 4


@dataclass(frozen=True)
class Knob:
    kind: str
    required: bool = False
    choices: tuple[str, ...] = ()
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    knobs: dict[str, Knob] = field(default_factory=dict)

    def schema(self) -> dict[str, Any]:
        """JSON Schema of the arguments."""
        shown = lambda k: {"type": k.kind} | ({"enum": list(k.choices)} if k.choices else {}) | ({"minimum": k.low} if k.low is not None else {}) | ({"maximum": k.high} if k.high is not None else {})
        return {"type": "object", "properties": {n: shown(k) for n, k in self.knobs.items()}, "required": [n for n, k in self.knobs.items() if k.required], "additionalProperties": False}


_TEXT = {"text": Knob("string", True)}
_STAGES = {"level": Knob("integer", low=0, high=MAX_LEVEL), "distill": Knob("boolean"), "query": Knob("string"), "codebook": Knob("boolean"), "table": Knob("boolean"), "crush": Knob("boolean")}
_PAGES = {"font": Knob("string", choices=("normal", "tiny")), "verbatim": Knob("string", choices=("full", "lazy", "off"))}
TOOLS = {
    t.name: t
    for t in (
        Tool("render", "Text to image pages, with the exact strings beside them", _TEXT | _STAGES | _PAGES),
        Tool("estimate", "What a text costs as text and as pages, and which route to take", _TEXT | _STAGES | _PAGES | {"model": Knob("string"), "cached": Knob("boolean"), "rates": Knob("string")}),
        Tool("distill", "A log without its repetitions; important lines stay", _TEXT | {"query": Knob("string"), "crush": Knob("boolean"), "table": Knob("boolean")}),
        Tool("compress", "Prose at a level of the loss ladder", _TEXT | {"level": Knob("integer", low=0, high=MAX_LEVEL)}),
        Tool("stats", "Totals of the event log", {"path": Knob("string", True)}),
        Tool("stash", "Keep a text under the id of its content", _TEXT | {"path": Knob("string", True)}),
        Tool("fetch", "Part of a kept text, by lines, pattern or words", {"path": Knob("string", True), "id": Knob("string", True), "lines": Knob("string"), "query": Knob("string"), "find": Knob("string"), "top": Knob("integer", low=1, high=32), "redact": Knob("boolean"), "verbatim": _PAGES["verbatim"]}),
        Tool("verify", "Whether a kept text holds a value, or one close to it", {"path": Knob("string", True), "id": Knob("string", True), "value": Knob("string", True)}),
    )
}


def missing_required(name: str, args: dict[str, Any]) -> list[str]:
    return [k for k, knob in TOOLS[name].knobs.items() if knob.required and args.get(k) is None]


def furniture_tokens(spark: SparkSession) -> int:
    """Tokens that the tools' own schemas take."""
    text = json.dumps([{"name": t.name, "description": t.about, "input_schema": t.schema()} for t in TOOLS.values()], separators=(",", ":"))
    return spark.range(1).select(T.text_tokens(F.lit(text))).first()[0]


def one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def _first(df: DataFrame) -> dict[str, Any]:
    row = df.first()
    return {} if row is None else {k: v for k, v in row.asDict(True).items() if k != "doc_id"}


def _stages(args: dict[str, Any]) -> dict[str, Any]:
    return {k: args[k] for k in ("crush", "table", "distill", "query", "codebook") if args.get(k)}


def _level(args: dict[str, Any], default: int = 0) -> int:
    return max(0, min(int(args.get("level", default)), MAX_LEVEL))


def render(spark: SparkSession, args: dict[str, Any]) -> dict[str, Any]:
    docs, font = one(spark, args["text"]), args.get("font", "normal")
    kinds = docs.select(secrets.credential_kinds(F.col("text"))).first()[0]
    if kinds:
        return {"refused": f"credentials are never imaged: {', '.join(kinds)}"}
    text = pipeline.staged(docs, _level(args), **_stages(args)).select("doc_id", F.col("compressed").alias("text"))
    side = _first(needles.sidecars(text.withColumn("raw_chars", F.lit(len(args["text"])))))
    mode = args.get("verbatim", "full")
    if side["dense"] and mode != "off":
        return {"refused": "more exact strings than the list beside the pages can carry; keep the source as text"}
    shown = "" if mode == "off" else side["sidecar"] if mode == "full" else text.select(needles.pointer(F.lit(len(side["needles"]) + side["more"]))).first()[0]
    drawn = pages.rendered(text, font).orderBy("page_no").limit(INLINE_PAGES).collect()
    return {"sidecar": shown, "pages": [bytes(r.png) for r in drawn], "n_pages": geometry.walked(text, font).first().pages}


def estimate(spark: SparkSession, args: dict[str, Any]) -> dict[str, Any]:
    docs = one(spark, args["text"])
    knobs = {"model": args.get("model"), "font": args.get("font", "normal"), "verbatim": args.get("verbatim", "full"), "cached": bool(args.get("cached")), "rates": pricing.rates(args.get("rates"))}
    advice = pipeline.recommended(docs)
    told = _first(pipeline.estimated(docs, _level(args), advice=advice, **knobs, **_stages(args)))
    steer = told.pop("steer")
    return told | {"reason": f"{told['reason']}; {steer}" if steer else told["reason"], "recommend": _first(advice)}


def distilled(spark: SparkSession, args: dict[str, Any]) -> dict[str, Any]:
    docs, counts, marker = one(spark, args["text"]), {}, ""
    if args.get("crush") and (few := _first(jsonrows.crushed(docs))):
        docs, counts["crush"] = one(spark, few["text"]), {"kept": few["kept"], "rows": few["rows"]}
        whole = one(spark, args["text"]).select(T.content_id(F.col("text"))).first()[0]
        marker = f"\n·crushed· kept {few['kept']} of {few['rows']} rows - full set: fetch {whole} (--query re | --lines a-b)"
    if args.get("table") and (cells := _first(jsonrows.table_encoded(docs))):
        docs, counts["table"] = one(spark, cells["text"]), {"rows": cells["rows"], "cols": cells["cols"]}
    out = _first(distill(docs, args.get("query")))
    return out | {"distilled": out["distilled"] + marker} | counts


def fetch(spark: SparkSession, args: dict[str, Any]) -> dict[str, Any]:
    asked = [k for k in ("query", "lines", "find") if args.get(k) is not None]
    if len(asked) != 1:
        raise ValueError("give exactly one of query, lines or find")
    docs = store.read(spark, args["path"], args["id"])
    if docs.isEmpty():
        raise ValueError(f"unknown stash id: {args['id']}")
    if asked == ["lines"]:
        first, dash, last = args["lines"].partition("-")
        if not (dash and first.isdecimal() and last.isdecimal()):
            raise ValueError("bad lines range")
        out = store.fetch_lines(docs, int(first), int(last))
    elif asked == ["find"]:
        out = store.fetch_find(docs, args["find"], int(args.get("top", store.TOP)))
    else:
        out = distill(docs, args["query"]).select("doc_id", F.col("distilled").alias("text"))
    head = ""
    if asked == ["query"]:
        counted = lines.match_count(docs, searched(spark, args["query"], "")).first()
        head = f"[query matched {counted.matched} of {counted.total} lines]"
    if asked != ["find"] and (drawn := _as_pages(out, args.get("verbatim", "full"), head)):
        return drawn
    text, n = secrets.redacted(F.col("text"))
    got = _first(out.select(text.alias("text"), n.alias("n_redacted")) if args.get("redact", True) else out.select("text"))
    return got | {"text": f"{head}\n{got['text']}"} if head else got


def _as_pages(docs: DataFrame, verbatim: str, head: str) -> dict[str, Any] | None:
    """A fetched slice as pages with its exact strings, where that is clearly cheaper than text."""
    found = F.size("needles") + F.col("more")
    shipped = {"off": F.lit(0).cast("long"), "lazy": T.text_tokens(needles.pointer(found))}.get(verbatim, F.col("tokens"))
    beside = {"off": F.lit(""), "lazy": F.when(found > 0, needles.pointer(found)).otherwise("")}.get(verbatim, F.col("sidecar"))
    side = needles.sidecars(docs).select("doc_id", beside.alias("sidecar"), shipped.alias("side_tokens"), (F.col("dense") & F.lit(verbatim != "off")).alias("dense"))
    raw = docs.select("doc_id", T.text_tokens(F.col("text")).alias("raw"), F.size(secrets.credential_kinds(F.col("text"))).alias("n_credentials"))
    rows = raw.join(geometry.walked(docs).select("doc_id", "pages", "tokens"), "doc_id").join(side, "doc_id").withColumn("cost", F.col("tokens") + F.col("side_tokens"))
    won = rows.where(pricing.may_be_pages(F.col("raw"), F.col("cost"), F.col("pages"), F.col("n_credentials"), F.col("dense"))).first()
    if won is None:
        return None
    marker = f"[slice imaged as {won['pages']} PNG page(s), ~{won['cost']} vs ~{won['raw']} text tokens. ↵=newline →=tab ⇥N=indent{f'; {head[1:-1]}' if head else ''}]"
    return {"text": marker, "sidecar": won["sidecar"], "pages": [bytes(r.png) for r in pages.rendered(docs).orderBy("page_no").collect()]}


def stash(spark: SparkSession, args: dict[str, Any]) -> dict[str, Any]:
    docs = one(spark, args["text"])
    store.write(docs, args["path"])
    return _first(store.overview(docs))


def compress(spark: SparkSession, args: dict[str, Any]) -> dict[str, Any]:
    out = ladder.compress(one(spark, args["text"]), _level(args, 1))
    return _first(out.withColumn("tokens", T.text_tokens(F.col("compressed"))))


_CALLS: dict[str, Callable[[SparkSession, dict[str, Any]], dict[str, Any]]] = {
    "render": render,
    "estimate": estimate,
    "distill": distilled,
    "compress": compress,
    "stats": lambda spark, args: _first(ledger.totals(tables.read_events(spark, args["path"]))),
    "stash": stash,
    "fetch": fetch,
    "verify": lambda spark, args: _first(store.verified(store.read(spark, args["path"], args["id"]), args["value"])),
}


def call(spark: SparkSession, name: str, args: dict[str, Any]) -> dict[str, Any]:
    """Run a tool; unknown names, missing and unknown arguments are errors."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    if missing := missing_required(name, args):
        raise ValueError(f"missing: {', '.join(missing)}")
    if unknown := sorted(set(args) - set(TOOLS[name].knobs)):
        raise ValueError(f"unknown: {', '.join(unknown)}")
    for k, v in args.items():
        knob = TOOLS[name].knobs[k]
        if v is not None and knob.choices and v not in knob.choices:
            raise ValueError(f"{k} must be one of {', '.join(knob.choices)}")
    return _CALLS[name](spark, args)
