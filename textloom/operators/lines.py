"""Texts to lines and back. Rows carry (doc_id, pos); nothing relies on physical order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), line. A final newline gives a final empty line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def join_lines(lines: DataFrame, *order: str) -> DataFrame:
    """doc_id, text: lines joined in ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy("doc_id").agg(rows.alias("rows")).select("doc_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def line_stats(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_important, chars, bytes, tokens of each text, without exploding it."""
    t = F.col("text")
    lines = F.split(t, "\n", -1)
    return docs.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, T.is_important)).cast("long").alias("n_important"),
        T.chars(t).alias("chars"), T.octets(t).alias("bytes"), T.text_tokens(t).alias("tokens"),
    )


def match_count(docs: DataFrame, query: str) -> DataFrame:
    """doc_id, matched, total: lines that match ``query``, case counting."""
    lines = F.split("text", "\n", -1)
    return docs.select("doc_id", F.size(F.filter(lines, lambda x: x.rlike(query))).cast("long").alias("matched"), F.size(lines).cast("long").alias("total"))
