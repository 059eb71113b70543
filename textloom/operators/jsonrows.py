"""JSON row sets held in one text: recognised, thinned out, and written as a columnar table.

Rows are canonical compact JSON: keys sorted, whole floats as integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.json import let

# Fixed values of the results to match.
MIN_ROWS, HEAD_ROWS, TAIL_ROWS, IMPORTANT_ROWS = 30, 10, 5, 40
COLUMNS = "·cols·"
#: No cell, or one that needs no parser to be seen to be JSON.
SIMPLE = "^(?:|0|-?[1-9][0-9]{0,17}|\"[0-9A-Za-z_ ]*\")\\z"


def _each(text: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of each row of a text that is a JSON array of two rows or more, or as many lines; null where it is null for any."""
    whole = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(f"^[{T.SPACE}\\uFEFF]*\\z"))
    shown = lambda a, row: let(F.transform(a, row), lambda b: F.when((F.size(b) >= 2) & F.forall(b, lambda x: x.isNotNull()), b))
    # A text that begins otherwise is neither.
    some = text.rlike(f"^[{T.SPACE}\\uFEFF]*[\\[{{]")
    # Lines are parsed where their rows are made, so that a text's parsed lines aren't all held.
    return F.when(some, let(whole, lambda a: F.when(a.isNotNull(), shown(a, made)).otherwise(shown(lines, lambda x: made(F.try_parse_json(x))))))


def rows_of(text: Column) -> Column:
    """Canonical rows of a text that is a JSON array of two objects or more, or as many lines of objects; else null."""
    return _each(text, lambda v: let(F.to_json(v), lambda x: F.when(x.startswith("{"), x)))


def _cells_of(text: Column) -> Column:
    """Keys and canonical values of each of the rows of ``rows_of``."""
    cells = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    return _each(text, lambda v: F.transform(cells(v), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value"))))


def _numbered(docs: DataFrame, rows: Column, name: str, *more: Column) -> DataFrame:
    # What ``more`` takes from the text is evaluated before the rows are made, for each row would carry the text otherwise.
    held = docs.select("doc_id", "text", *more)
    # The outer form keeps the optimizer from evaluating the rows once more in a filter.
    return held.select("doc_id", *held.columns[2:], F.posexplode_outer(rows).alias("row_no", name)).where("row_no is not null")


def parsed_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, ``more``, row_no (from 0), row, of texts that are row sets."""
    return _numbered(docs, rows_of(F.col("text")), "row", *more)


def crushed(docs: DataFrame) -> DataFrame:
    """doc_id, text, kept, rows: first, last and important rows of row sets of 30 rows or more that lose rows thereby."""
    rows = parsed_rows(docs)
    by = Window.partitionBy("doc_id")
    rows = rows.withColumns({"rows": F.count("*").over(by), "first": F.min("row_no").over(Window.partitionBy("doc_id", "row"))})
    rows = rows.where((F.col("rows") >= MIN_ROWS) & (F.col("row_no") == F.col("first"))).withColumn("important", T.is_important(F.col("row")))
    up = by.orderBy("row_no")
    rows = rows.withColumns({"at": F.row_number().over(up), "back": F.row_number().over(by.orderBy(F.desc("row_no"))), "seen": F.sum(F.col("important").cast("int")).over(up)})
    kept = rows.where((F.col("at") <= HEAD_ROWS) | (F.col("back") <= TAIL_ROWS) | (F.col("important") & (F.col("seen") <= IMPORTANT_ROWS)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda r: r["row"]), "\n")
    out = kept.groupBy("doc_id").agg(text.alias("text"), F.count("*").alias("kept"), F.max("rows").alias("rows"))
    return out.where("kept < rows")


def _quoted(name: Column) -> Column:
    json = F.to_json(F.array(name))
    return F.substring(json, F.lit(2), F.length(json) - 2)


def _table(rows: Column, names: Column) -> Column:
    """text, rows, cols of the table of ``rows`` (arrays of key and value) under ``names``."""
    line = lambda held: F.array_join(F.transform(names, lambda k: F.coalesce(F.element_at(held, k), F.lit(""))), "\t")
    lines = F.transform(rows, lambda r: let(F.map_from_entries(r), line))
    head = F.concat(F.lit(COLUMNS + "\t"), F.array_join(F.transform(names, lambda k: _quoted(k)), "\t"))
    text = F.concat(head, F.lit("\n"), F.array_join(lines, "\n"))
    return F.struct(text.alias("text"), F.size(rows).cast("long").alias("rows"), F.size(names).cast("long").alias("cols"))


def _shorter(table: Column, before: Column) -> Column:
    return F.filter(F.array(table), lambda t: (t["cols"] > 0) & (F.length(t["text"]) < before))


def table_encoded(docs: DataFrame) -> DataFrame:
    """doc_id, text, rows, cols: row sets as a table of tab-separated cells under a line of column names, where that is shorter.

    Each row is parsed once, to cells, before its document's rows are gathered; the work grows with the cells.
    """
    rows = _numbered(docs, _cells_of(F.col("text")), "cells", F.length("text").alias("before"))
    sets = rows.groupBy("doc_id").agg(F.max("before").alias("before"), F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("rows"), F.collect_set(F.transform("cells", lambda c: c["key"])).alias("keys"))
    names = F.array_sort(F.array_distinct(F.flatten("keys")))
    made = let(names, lambda n: _table(F.transform("rows", lambda r: r["cells"]), n))
    return sets.select("doc_id", F.explode_outer(_shorter(made, F.col("before"))).alias("t")).where("t is not null").select("doc_id", "t.text", "t.rows", "t.cols")


def tables_of(docs: DataFrame) -> DataFrame:
    """The rows of ``table_encoded``, for long texts: cells become a table where they are parsed.

    Gathered as rows they are copied several times, and each copy is many times as large as the text.
    """
    names = lambda rows: F.array_sort(F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(r, lambda c: c["key"])))))
    made = let(_cells_of(F.col("text")), lambda rows: F.when(rows.isNotNull(), let(names(rows), lambda n: _table(rows, n))))
    # The outer form keeps the optimizer from making the tables once more in a filter.
    return docs.select("doc_id", F.explode_outer(_shorter(made, F.length("text"))).alias("t")).where("t is not null").select("doc_id", "t.text", "t.rows", "t.cols")


def table_decoded(tables: DataFrame) -> DataFrame:
    """doc_id, text: tables back to lines of JSON; null where the text is no table."""
    lines = F.split("text", "\n", -1)
    names = F.transform(F.split(F.regexp_replace(F.element_at(lines, 1), f"^{COLUMNS}\\t", ""), "\t", -1), lambda c: F.to_json(F.try_parse_json(c)))
    # Each line's cells, split once.
    rows = F.transform(F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~x.rlike(f"^[{T.SPACE}\\uFEFF]*\\z")), lambda x: F.split(x, "\t", -1))
    fit = F.element_at(lines, 1).startswith(COLUMNS + "\t") & (F.size(lines) >= 2) & F.forall("names", lambda n: F.coalesce(n.startswith('"'), F.lit(False)))
    fit = fit & F.forall("lines", lambda x: F.forall(x, lambda c: c.rlike(SIMPLE) | F.try_parse_json(c).isNotNull()))

    def row(cells: Column) -> Column:
        pairs = F.zip_with("names", cells, lambda n, c: F.when(n.isNotNull() & (c != ""), F.concat(n, F.lit(":"), c)))
        return F.concat(F.lit("{"), F.array_join(F.filter(pairs, lambda p: p.isNotNull()), ","), F.lit("}"))

    held = tables.select("doc_id", "text", names.alias("names"), rows.alias("lines"))
    return held.select("doc_id", F.when(fit, F.array_join(F.transform("lines", lambda x: row(x)), "\n")).alias("text"))
