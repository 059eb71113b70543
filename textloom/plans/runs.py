"""Captured commands as what an agent reads: crushed, distilled, and kept whole where they are long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import commands, store
from ..operators.distill import distill

# Fixed value of the results to match.
INLINE = 8000


def ran(captures: DataFrame, query: str | None = None) -> DataFrame:
    """doc_id, text, id of captures (doc_id, cmd array<string>, exit, text): id, of the whole capture, where it must be stashed.

    Long captures are told by what is left of them, or by a map of the whole if that is long too. No exit code counts as 0.
    """
    own = captures.withColumn("exit", F.coalesce("exit", F.lit(0)))
    less = commands.crushed(own)
    left = distill(less.select("doc_id", "text"), query).select("doc_id", "distilled", "out_lines")
    raw = own.select("doc_id", "exit", "text", T.chars(F.col("text")).alias("chars"), F.size(F.split("text", "\n", -1)).cast("string").alias("n"))
    rows = raw.join(left, "doc_id").join(less.select("doc_id", "rule"), "doc_id").withColumn("left", T.chars(F.col("distilled")))
    rows = rows.withColumns({"long": F.col("chars") > INLINE, "map": (F.col("chars") > INLINE) & (F.col("left") > INLINE)})
    told = store.overview(rows.where("map").select("doc_id", "text")).select("doc_id", F.col("text").alias("told"))
    rule = F.coalesce(F.concat(F.lit(" · rule "), F.col("rule")), F.lit(""))
    head = F.concat(F.lit("[run] exit "), F.col("exit").cast("string"), F.lit(" · "), F.col("n"), F.lit(" -> "), F.col("out_lines").cast("string"), F.lit(" lines · "), T.percent_saved(F.col("chars"), F.col("left")).cast("string"), F.lit("% of chars removed"), rule)
    id = T.content_id(F.col("text"))
    kept = F.when(F.col("long"), F.concat(F.lit("\nfull output stashed: fetch "), id, F.lit(" [--query re] [--lines a-b]"))).otherwise("")
    body = F.when(F.col("map"), F.col("told")).otherwise(F.concat("distilled", kept))
    return rows.join(told, "doc_id", "left").select("doc_id", F.concat(head, F.lit("\n"), body).alias("text"), F.when(F.col("long"), id).alias("id"))


def keep(captures: DataFrame, path: str) -> None:
    """Stash the captures that ``ran`` refers to."""
    store.write(captures.where(T.chars(F.col("text")) > INLINE).select("text"), path)
