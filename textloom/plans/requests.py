"""Requests to a model with their long texts as image pages: which blocks go, what stands for them, what that saves.

A request is a JSON body (req_id, body); its content is rows (req_id, msg, block, item, role, kind, text, marked, block_marked), which
is all that the decisions need. Each distinct text is staged, measured and scanned once, however many requests carry it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialog, geometry, needles, pages, pricing, secrets
from . import pipeline

# Fixed values of the results to match.
DECIMAL = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def strict_number(text: str | None, default: float) -> float:
    """A finite decimal number; whatever else a text holds (nothing, spaces, other bases) gives the default."""
    if text is None or not re.fullmatch(DECIMAL, text):
        return default
    number = float(text)
    return number if math.isfinite(number) else default


def strict_count(text: str, most: int) -> int | None:
    """A whole number of digits, a plus allowed, up to ``most``."""
    return int(text) if re.fullmatch(r"\+?[0-9]+", text) and int(text) <= most else None


@dataclass(frozen=True)
class Settings:
    """What may become pages, and how."""

    min_chars: int = dialog.MIN_CHARS
    ratio: float = dialog.RATIO / 100
    min_save: int = dialog.MIN_SAVE
    max_pages: int = dialog.MAX_PAGES
    recent: int = dialog.RECENT
    level: int = 0
    distill: bool = False
    table: bool = False
    codebook: bool = False
    font: str = "normal"
    cache: bool = True
    verbatim: str = "full"

    @classmethod
    def of(cls, given: Mapping[str, str]) -> Settings:
        """Settings from texts by name; what is empty or no number keeps its default."""
        own = {}
        for f in fields(cls):
            text = given.get(f.name, "")
            if text == "":
                continue
            if isinstance(f.default, bool):
                own[f.name] = text.lower() not in ("0", "false", "off")
            elif isinstance(f.default, str):
                own[f.name] = text
            else:
                own[f.name] = type(f.default)(strict_number(text, f.default))
        return cls(**own)


def blocks(requests: DataFrame) -> DataFrame:
    """The content of ``requests`` (req_id, body) as rows, of messages from 0 on: block and item are 0 where content is one text, item counts a tool result's parts.

    kind: text, tool_result, or what else the block calls itself, without text. marked: it, or for parts their block (block_marked), carries a cache breakpoint.
    n_messages and n_marked are of the whole request, n_marked with breakpoints of system and tools. Bodies that are no JSON object with messages give no rows.
    """
    body = F.try_parse_json("body")
    get = lambda v, path, kind: F.try_variant_get(v, f"$.{path}", kind)
    many = lambda v, path: get(v, path, "array<variant>")
    marks = lambda list_: F.coalesce(F.size(F.filter(list_, lambda b: get(b, "cache_control", "variant").isNotNull())), F.lit(0))
    reqs = requests.select("req_id", body.alias("b")).select("req_id", many(F.col("b"), "messages").alias("messages"), (marks(many(F.col("b"), "system")) + marks(many(F.col("b"), "tools"))).alias("n_outside"))
    reqs = reqs.where("messages is not null").withColumns({"n_messages": F.size("messages"), "n_marked": F.col("n_outside") + F.aggregate("messages", F.lit(0), lambda a, m: a + marks(many(m, "content")))})
    msgs = reqs.select("req_id", "n_messages", "n_marked", F.posexplode("messages").alias("msg", "m"))
    whole = get(F.col("m"), "content", "string")
    listed = many(F.col("m"), "content")
    row = "struct<block:int,item:int,kind:string,text:string,marked:boolean,block_marked:boolean>"

    def made(block: Column, item: Column, kind: Column, text: Column, marked: Column, block_marked: Column) -> Column:
        return F.struct(block.alias("block"), item.alias("item"), kind.alias("kind"), text.alias("text"), marked.alias("marked"), block_marked.alias("block_marked"))

    def part(b: Column, i: Column) -> Column:
        kind, marked = F.coalesce(get(b, "type", "string"), F.lit("")), get(b, "cache_control", "variant").isNotNull()
        inner = many(b, "content")
        one = lambda text: F.array(made(i, F.lit(0), kind, text, marked, marked))
        item = lambda x, j: made(i, j, F.lit("tool_result"), F.when(get(x, "type", "string") == "text", get(x, "text", "string")), marked | get(x, "cache_control", "variant").isNotNull(), marked)
        return (
            F.when(kind == "text", one(get(b, "text", "string"))).when((kind == "tool_result") & (F.size(inner) > 0), F.transform(inner, item))
            .when((kind == "tool_result") & inner.isNull(), one(get(b, "content", "string"))).otherwise(one(F.lit(None).cast("string"))).cast(f"array<{row}>")
        )

    plain = F.array(made(F.lit(0), F.lit(0), F.lit("string"), whole, F.lit(False), F.lit(False))).cast(f"array<{row}>")
    rows = F.when(listed.isNotNull(), F.flatten(F.transform(listed, part))).when(whole.isNotNull(), plain)
    return msgs.select("req_id", "n_messages", "n_marked", "msg", F.coalesce(get(F.col("m"), "role", "string"), F.lit("")).alias("role"), F.explode(rows).alias("r")).select("req_id", "n_messages", "n_marked", "msg", "role", "r.*")


def measured(texts: DataFrame, settings: Settings) -> DataFrame:
    """digest, shown, orig_chars, raw_tokens, pages, image_cost, n_carried, beside of texts (digest, text) that may go out as pages: shown is what the pages show, beside the list that comes with them."""
    s = settings
    own = texts.select(F.col("digest").alias("doc_id"), "text")
    staged = s.level > 0 or s.distill or s.table or s.codebook
    shown = pipeline.staged(own, s.level, distill=s.distill, table=s.table, book=s.codebook).select("doc_id", F.col("compressed").alias("text")) if staged else own
    size = geometry.walked(shown, s.font).select("doc_id", "pages", F.col("tokens").alias("page_tokens"))
    raw = own.select("doc_id", T.chars(F.col("text")).cast("long").alias("orig_chars"), T.text_tokens(F.col("text")).alias("raw_tokens"))
    rows = raw.join(shown.withColumnRenamed("text", "shown"), "doc_id").join(size, "doc_id")
    if s.verbatim == "off":
        rows = rows.withColumns({"n_carried": F.lit(0).cast("long"), "beside": F.lit(""), "dense": F.lit(False), "side_tokens": F.lit(0).cast("long")})
    else:
        side = needles.sidecars(rows.select("doc_id", F.col("shown").alias("text"), F.col("orig_chars").alias("raw_chars")))
        some = F.size("needles") > 0
        lazy = needles.pointer(F.size("needles") + F.col("more"))
        beside = F.when(some, lazy).otherwise("") if s.verbatim == "lazy" else F.col("sidecar")
        tokens = T.text_tokens(lazy) if s.verbatim == "lazy" else F.col("tokens")
        rows = rows.join(side.select("doc_id", F.size("needles").cast("long").alias("n_carried"), beside.alias("beside"), "dense", tokens.alias("side_tokens")), "doc_id")
    rows = rows.withColumn("image_cost", F.col("page_tokens") + F.col("side_tokens"))
    worth = (F.col("pages") <= s.max_pages) & ~F.col("dense") & (F.col("image_cost") <= F.col("raw_tokens") * F.lit(s.ratio)) & (F.col("raw_tokens") - F.col("image_cost") >= s.min_save)
    return rows.where(worth).select(F.col("doc_id").alias("digest"), "shown", "orig_chars", "raw_tokens", "pages", "image_cost", "n_carried", "beside")


def _marker(verbatim: str) -> Column:
    word = lambda c: F.col(c).cast("string")
    carried = F.when((F.col("n_carried") > 0) & F.lit(verbatim == "full"), F.concat(F.lit("; the ·verbatim· block next carries "), word("n_carried"), F.lit(" exact strings as text - read ids from there, not from the pages"))).otherwise("")
    return F.concat(F.lit("["), word("orig_chars"), F.lit(" chars imaged in place as "), word("n_pages"), F.lit(" PNG page(s), ~"), word("image_cost"), F.lit(" vs ~"), word("raw_tokens"), F.lit(" text tokens. ↵=newline →=tab ⇥N=indent"), carried, F.lit("]"))


def _pointer() -> Column:
    return F.concat(F.lit("["), F.col("orig_chars").cast("string"), F.lit(" chars, byte-identical to a block imaged above ("), F.col("n_pages").cast("string"), F.lit(" PNG page(s)); not repeated]"))


def transformed(content: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The blocks of ``content`` that are replaced: req_id, msg, block, item, digest, action, shown, marker, beside, pages, orig_chars, raw_tokens, cost_tokens, saved, breakpoint.

    Only unmarked texts of user messages before the last ``recent`` ones go, long ones without credentials, where pages are
    cheap enough. The first of a request's equal texts becomes pages (image), others a line that points there (pointer).
    breakpoint: the last replaced block, where a cache breakpoint goes if the request has fewer than four and that message's last block has none.
    """
    s = settings or Settings()
    text = F.col("text")
    may = (F.col("role") == "user") & F.col("kind").isin("string", "text", "tool_result") & ~F.col("marked") & (F.col("msg") < F.col("n_messages") - max(1, s.recent)) & (F.length(text) >= s.min_chars)
    long = content.where(may).withColumn("digest", F.sha2(text, 256))
    texts = long.select("digest", "text").dropDuplicates(["digest"]).where(F.size(secrets.credential_kinds(text)) == 0)
    rows = long.drop("text").join(measured(texts, s).withColumnRenamed("pages", "n_pages"), "digest")
    again = F.row_number().over(Window.partitionBy("req_id", "digest").orderBy("msg", "block", "item")) > 1
    rows = rows.withColumn("action", F.when(again, "pointer").otherwise("image")).withColumn("marker", F.when(again, _pointer()).otherwise(_marker(s.verbatim)))
    cost = F.when(F.col("action") == "pointer", T.text_tokens(F.col("marker"))).otherwise(F.col("image_cost"))
    rows = rows.withColumns({"cost_tokens": cost, "saved": F.col("raw_tokens") - cost, "pages": F.when(F.col("action") == "image", F.col("n_pages")).otherwise(0).cast("long"), "beside": F.when(F.col("action") == "image", F.col("beside")).otherwise("")})
    ends = content.groupBy("req_id", "msg").agg(F.max_by("block_marked", F.struct("block", "item")).alias("end_marked"))
    last = F.row_number().over(Window.partitionBy("req_id").orderBy(F.desc("msg"), F.desc("block"), F.desc("item"))) == 1
    rows = rows.withColumn("last", last).join(ends, ["req_id", "msg"])
    placed = F.col("last") & F.lit(s.cache) & (F.col("n_marked") < dialog.BREAKPOINTS) & ~F.col("end_marked")
    return rows.select("req_id", "msg", "block", "item", "digest", "action", "shown", "marker", "beside", "pages", "orig_chars", "raw_tokens", "cost_tokens", "saved", placed.alias("breakpoint"))


def totals(replaced: DataFrame) -> DataFrame:
    """req_id, imaged_blocks, orig_chars, image_count, saved_tokens, cached of requests that ``transformed`` changes."""
    sum_ = lambda c: F.sum(c).cast("long")
    return replaced.groupBy("req_id").agg(F.count("*").alias("imaged_blocks"), sum_("orig_chars").alias("orig_chars"), sum_("pages").alias("image_count"), sum_("saved").alias("saved_tokens"), F.max("breakpoint").alias("cached"))


def cache_aware(replaced: DataFrame, requests: DataFrame) -> DataFrame:
    """req_id, saved_tokens_cache_aware by the sessions of ``requests`` (req_id, conv_id, req, model, saw_cache): replays ride cache reads, a first flip is a cache write."""
    key = pricing.rate_key(F.col("model"))
    hundredths = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in pricing.RATES.items() for x in (k, round(float(v[i]) * 100))]), key)
    sessions = requests.select("req_id", "conv_id", "req", "model", "saw_cache")
    caching = F.coalesce(F.max(F.col("saw_cache").cast("int")).over(Window.partitionBy("conv_id").orderBy("req").rangeBetween(Window.unboundedPreceding, -1)) == 1, F.lit(False))
    own = replaced.select("req_id", "action", F.col("digest").alias("text"), "raw_tokens", "cost_tokens").join(sessions.withColumn("caching", caching), "req_id")
    saved = dialog.cache_aware_saved(F.col("raw_tokens"), F.col("cost_tokens"), F.col("caching"), F.col("replayed"), hundredths(2), hundredths(3))
    # Within a request a pointer's text is known by then.
    own = dialog.replays(own).withColumn("replayed", F.col("replayed") | (F.col("action") == "pointer"))
    return own.groupBy("req_id").agg(F.sum(saved).cast("long").alias("saved_tokens_cache_aware"))


def _patch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies with the blocks that replace their texts put in."""
    for batch in batches:
        out = []
        for body, changes in zip(batch.column("body").to_pylist(), batch.column("changes").to_pylist(), strict=True):
            if not changes:
                out.append(body)
                continue
            messages = (request := json.loads(body))["messages"]
            # From the end, so that places before stay what they were.
            for c in sorted(changes, key=lambda c: (c["msg"], c["block"], c["item"]), reverse=True):
                new = [{"type": "text", "text": t} for t in (c["marker"], c["beside"]) if t]
                new += [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": png}} for png in c["images"] or []]
                message = messages[c["msg"]]
                if isinstance(message["content"], str):
                    message["content"] = new
                elif (block := message["content"][c["block"]])["type"] == "text":
                    message["content"][c["block"] : c["block"] + 1] = new
                elif isinstance(block["content"], str):
                    block["content"] = new
                else:
                    block["content"][c["item"] : c["item"] + 1] = new
            for c in changes:
                if c["breakpoint"]:
                    messages[c["msg"]]["content"][-1]["cache_control"] = {"type": "ephemeral"}
            out.append(json.dumps(request, ensure_ascii=False, separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([batch.column("req_id"), pa.array(out, pa.string()), pa.array([bool(c) for c in batch.column("changes").to_pylist()], pa.bool_())], names=["req_id", "body", "changed"])


def rewritten(requests: DataFrame, settings: Settings | None = None) -> DataFrame:
    """req_id, body, changed of ``requests`` (req_id, body): texts replaced by marker, exact strings and pages, in this order; other bodies stay as they are, byte for byte."""
    s = settings or Settings()
    replaced = transformed(blocks(requests), s)
    texts = replaced.where("action = 'image'").select(F.col("digest").alias("doc_id"), F.col("shown").alias("text")).dropDuplicates(["doc_id"])
    drawn = pages.rendered(texts, s.font).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.base64("png").alias("png")))).alias("drawn"))
    images = drawn.select(F.col("doc_id").alias("digest"), F.lit("image").alias("action"), F.transform("drawn", lambda p: p["png"]).alias("images"))
    change = F.struct("msg", "block", "item", "marker", "beside", "images", "breakpoint")
    changes = replaced.join(images, ["digest", "action"], "left").groupBy("req_id").agg(F.collect_list(change).alias("changes"))
    kind = requests.schema["req_id"].dataType.simpleString()
    return requests.select("req_id", "body").join(changes, "req_id", "left").mapInArrow(_patch, f"req_id {kind}, body string, changed boolean")
