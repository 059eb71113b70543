"""Codebooks: recurring long tokens and path prefixes become one-character sigils, spelled out in a legend."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the results to match.
SIGILS = "§¤¢£¥µ¶ª°±¬×÷ØÞßæðøþ¡¿"
MIN_CHARS, MIN_COUNT, LEGEND_COST, DEPTH = 12, 3, 3, 3


def _strings(token: Column) -> Column:
    """A token and its path prefixes from the third segment on."""
    parts = F.split(token, "/", -1)
    prefixes = F.transform(F.sequence(F.lit(DEPTH), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.filter(F.when(F.size(parts) >= DEPTH, F.concat(F.array(token), prefixes)).otherwise(F.array(token)), lambda s: F.length(s) >= MIN_CHARS)


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, value, n of tokens and path prefixes of 12 code points or more."""
    tokens = docs.select("doc_id", F.explode(F.split("text", f"[{T.SPACE}]+", -1)).alias("token")).where("token != ''")
    return tokens.select("doc_id", F.explode(_strings(F.col("token"))).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, value, n, saved, rank of what occurs three times or more, by characters saved."""
    some = token_counts(docs).where(F.col("n") >= MIN_COUNT).withColumn("saved", (F.length("value") - 1) * F.col("n"))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("saved"), "value")))


def choose(ranked: list[tuple[str, int]], text: str) -> list[tuple[str, str]]:
    """(sigil, value): in order of rank, what saves more than its legend costs and neither extends nor begins one chosen."""
    free = [s for s in SIGILS if s not in text]
    out: list[tuple[str, str]] = []
    for value, n in ranked:
        if len(out) == len(free):
            break
        size = len(value)
        if (size - 1) * n > size + LEGEND_COST and not any(u.startswith(value) or value.startswith(u) for _, u in out):
            out.append((free[len(out)], value))
    return out


def encode(text: str, book: list[tuple[str, str]]) -> str:
    for sigil, value in sorted(book, key=lambda b: -len(b[1])):
        text = text.replace(value, sigil)
    return text + "\n·legend· " + " ".join(f"{s}={v}" for s, v in book) if book else text


def decode(text: str, book: list[tuple[str, str]]) -> str:
    body = text.rsplit("\n·legend· ", 1)[0] if book else text
    for sigil, value in book:
        body = body.replace(sigil, value)
    return body


def with_candidates(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, ``more``, ranked (rank, value, n of its candidates) of ``docs``. Only candidates are shuffled, then met by their text."""
    ranked = candidates(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("ranked"))
    return docs.select("doc_id", "text", *more).join(ranked, "doc_id", "left")


def applied(docs: DataFrame) -> DataFrame:
    """doc_id, encoded, entries, book of each text of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sigil = pa.list_(pa.struct([("sigil", pa.string()), ("value", pa.string())]))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            encoded, books = [], []
            for text, rows in zip(batch.column("text").to_pylist(), batch.column("ranked").to_pylist(), strict=True):
                book = choose([(r["value"], r["n"]) for r in rows or ()], text or "")
                books.append([{"sigil": s, "value": v} for s, v in book])
                encoded.append(None if text is None else encode(text, book))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoded, pa.string()), pa.array([len(b) for b in books], pa.int64()), pa.array(books, sigil)], names=["doc_id", "encoded", "entries", "book"])

    return with_candidates(docs).select("doc_id", "text", "ranked").mapInArrow(run, f"doc_id {kind}, encoded string, entries bigint, book array<struct<sigil: string, value: string>>")
