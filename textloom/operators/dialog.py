"""Conversations as requests: what may be imaged, what repeats, what breaks the prompt cache, what tools cost.

A conversation's request t holds its turns 0 to t; turns are rows (conv_id, turn, role, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .secrets import credential_kinds

# Fixed values of the results to match.
MIN_CHARS, RATIO, MIN_SAVE, MAX_PAGES, RECENT, BREAKPOINTS, NAMED_UNUSED = 4000, 75, 300, 20, 1, 4, 8


def eligible(turns: DataFrame, min_chars: int = MIN_CHARS, recent: int = RECENT) -> DataFrame:
    """Turns with back (1 is the last of its conversation), recent, eligible: user turns before the last ones, long and free of credentials."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    own = turns.withColumn("back", back).withColumn("recent", F.col("back") <= max(1, recent))
    return own.withColumn("eligible", (F.col("role") == "user") & ~F.col("recent") & (F.length("text") >= min_chars) & (F.size(credential_kinds(F.col("text"))) == 0))


def worth_imaging(raw: Column, cost: Column, pages: Column, dense: Column) -> Column:
    return (pages <= MAX_PAGES) & ~dense & (cost * 100 <= raw * RATIO) & (raw - cost >= MIN_SAVE)


def repeats(turns: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Eligible turns with first: the turn of the same text that comes first in the conversation; later ones point to it."""
    own = eligible(turns, min_chars).where("eligible")
    return own.withColumn("first", F.min("turn").over(Window.partitionBy("conv_id", F.sha2("text", 256)))).select("conv_id", "turn", "first", (F.col("first") < F.col("turn")).alias("is_pointer"))


def block_id(role: Column, text: Column) -> Column:
    """Identity of a block of a request: role and canonical JSON of its text."""
    json = F.to_json(F.array(text))
    return F.substring(F.sha2(F.concat(F.encode(role, "UTF-8"), F.lit(b"\x00"), F.encode(F.substring(json, F.lit(2), F.length(json) - 2), "UTF-8")), 256), 1, 12)


def requests(turns: DataFrame) -> DataFrame:
    """conv_id, req, blocks: the block ids of each request, turns 0 to req."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", F.col("turn").alias("req"), F.collect_list(block_id(F.col("role"), F.col("text"))).over(order).alias("blocks"))


def break_of(prev: Column, cur: Column) -> Column:
    """struct<index, kind> of where ``cur`` leaves ``prev``, null if ``prev`` is a prefix of it.

    evicted: cur is shorter, or its block at the index stood later in prev; added: prev's block there stands later in
    cur; reordered: both; modified: neither.
    """
    m = F.least(F.size(prev), F.size(cur))
    same = F.zip_with(F.slice(prev, F.lit(1), m), F.slice(cur, F.lit(1), m), lambda a, b: a == b)
    at = F.array_position(same, False) - 1
    index = F.when(at >= 0, at).otherwise(m).cast("long")
    later = lambda a, x: F.array_contains(F.slice(a, (index + 1).cast("int"), F.lit(1 << 30)), x)
    p, c = F.get(prev, index.cast("int")), F.get(cur, index.cast("int"))
    stays, came = F.coalesce(later(cur, p), F.lit(False)), F.coalesce(later(prev, c), F.lit(False))
    kind = F.when((at < 0) & (F.size(cur) < F.size(prev)), "evicted").when(stays & came, "reordered").when(stays, "added").when(came, "evicted").otherwise("modified")
    return F.when(~((at < 0) & (F.size(cur) >= F.size(prev))), F.struct(index.alias("index"), kind.alias("kind")))


def cache_breaks(reqs: DataFrame) -> DataFrame:
    """conv_id, req, index, kind of requests (conv_id, req, blocks and, to price it, tokens of each block) that break the cache of the one before; rebilled with tokens."""
    order = Window.partitionBy("conv_id").orderBy("req")
    own = reqs.withColumn("prev", F.lag("blocks").over(order)).where("size(prev) > 0").withColumn("brk", break_of(F.col("prev"), F.col("blocks"))).where("brk is not null")
    priced = [F.aggregate(F.slice("tokens", (F.col("brk.index") + 1).cast("int"), F.lit(1 << 30)), F.lit(0).cast("long"), lambda a, x: a + x).alias("rebilled")] if "tokens" in reqs.columns else []
    return own.select("conv_id", "req", F.col("brk.index").alias("index"), F.col("brk.kind").alias("kind"), *priced)


def replays(blocks: DataFrame) -> DataFrame:
    """``blocks`` (conv_id, req, text, ...) with replayed: the same text was in an earlier request of the conversation."""
    first = F.min("req").over(Window.partitionBy("conv_id", F.sha2("text", 256)))
    return blocks.withColumn("replayed", first < F.col("req"))


def cache_aware_saved(raw: Column, cost: Column, caching: Column, replayed: Column, read: Column, write: Column) -> Column:
    """Tokens saved by imaging a block; read and write are multipliers in hundredths."""
    rounded = lambda x: (F.signum(x) * F.floor((F.abs(x) + 50) / 100)).cast("long")
    return F.when(~caching, raw - cost).when(replayed, rounded((raw - cost) * read)).otherwise(rounded(raw * read) - rounded(cost * write))


def ledger(blocks: DataFrame, read: int = 10, write: int = 125) -> DataFrame:
    """``blocks`` (conv_id, req, text, raw_tokens, cost_tokens, saw_cache) with caching (seen in an earlier request), replayed and saved."""
    before = Window.partitionBy("conv_id").orderBy("req").rangeBetween(Window.unboundedPreceding, -1)
    own = replays(blocks).withColumn("caching", F.coalesce(F.max(F.col("saw_cache").cast("int")).over(before) == 1, F.lit(False)))
    return own.withColumn("saved", cache_aware_saved(F.col("raw_tokens"), F.col("cost_tokens"), F.col("caching"), F.col("replayed"), F.lit(read), F.lit(write)))


def breakpoints(imaged: DataFrame) -> DataFrame:
    """conv_id, turn where a cache breakpoint goes: the last imaged turn, if fewer than four stand already (conv_id, turn, imaged, n_breakpoints)."""
    return imaged.groupBy("conv_id").agg(F.max(F.when(F.col("imaged"), F.col("turn"))).alias("turn"), F.sum("n_breakpoints").alias("n")).where((F.col("turn").isNotNull()) & (F.col("n") < BREAKPOINTS)).select("conv_id", "turn")


def tool_tax(advertised: DataFrame, used: DataFrame) -> DataFrame:
    """req_id, unused (sorted, the first eight), n_unused, tokens of tools advertised (req_id, name, tokens) and never used (req_id, name), for requests that use any."""
    idle = advertised.join(used.select("req_id").distinct(), "req_id", "left_semi").join(used.select("req_id", "name").distinct(), ["req_id", "name"], "left_anti")
    named = F.array_sort(F.collect_set("name"))
    return idle.groupBy("req_id").agg(named.alias("names"), F.sum("tokens").alias("tokens")).select("req_id", F.slice("names", 1, NAMED_UNUSED).alias("unused"), F.size("names").cast("long").alias("n_unused"), "tokens")


def usage(body: Column) -> Column:
    """struct of input, cache_read, cache_create (first mention each) and output (largest) token counts in a response body."""
    first = lambda k: F.coalesce(F.regexp_extract(body, f'"{k}"\\s*:\\s*([0-9]+)', 1).try_cast("long"), F.lit(0)).alias
    most = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit('"output_tokens"\\s*:\\s*([0-9]+)'), F.lit(1)), lambda x: x.try_cast("long"))), F.lit(0))
    return F.struct(first("input_tokens")("input"), first("cache_read_input_tokens")("cache_read"), first("cache_creation_input_tokens")("cache_create"), most.alias("output"))


def is_message_request(method: Column, path: Column, encoding: Column) -> Column:
    """Requests that the transformation applies to."""
    route = F.regexp_replace(path, "\\?.*", "")
    return (method == "POST") & route.startswith("/v1/messages") & ~route.contains("count_tokens") & (F.coalesce(encoding, F.lit("")).isin("", "identity"))
