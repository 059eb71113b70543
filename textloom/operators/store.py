"""A content-addressed store of texts, and what is looked up in it: line ranges, slices, words, exact and near values.

A text's id is the start of its SHA-256, so writing is idempotent; the table is partitioned by the first two
digits, and looking up an id reads one of them with the id pushed down to the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .distill import collapsed, distill, prepared, suppression, top_repeats
from .lines import split_lines
from .secrets import redacted

# Fixed values of the results to match.
MAX_WORDS, TOP, MOST_TOP, AROUND, WHOLE, PART, MIN_FUZZY, CANDIDATES, MAP_REPEATS, EXEMPLAR = 8, 8, 32, 2, 3, 1, 4, 8, 5, 160
ID = "^[0-9a-f]{12}$"


def stashed(docs: DataFrame) -> DataFrame:
    """id, bytes, n_lines, text of each distinct text of ``docs`` (text)."""
    own = docs.where("text is not null").select(T.content_id(F.col("text")).alias("id"), T.octets(F.col("text")).alias("bytes"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), "text")
    return own.dropDuplicates(["id"])


def write(docs: DataFrame, path: str) -> None:
    """Add the texts that the store under ``path`` doesn't hold."""
    spark = docs.sparkSession
    new = stashed(docs).withColumn("part", F.substring("id", 1, 2))
    try:
        new = new.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.write.mode("append").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str, id: str) -> DataFrame:
    """The text of one id, as (doc_id, text)."""
    if not re.fullmatch(ID, id):
        raise ValueError(f"unknown stash id: {id}")
    return spark.read.parquet(path).where((F.col("part") == id[:2]) & (F.col("id") == id)).select(F.col("id").alias("doc_id"), "text")


def fetch_lines(docs: DataFrame, first: int, last: int) -> DataFrame:
    """doc_id, text: lines ``first`` to ``last``, both brought into the text's range."""
    if first > last:
        raise ValueError("bad lines range")
    lines = F.split("text", "\n", -1)
    n = F.size(lines)
    at = lambda x: F.least(F.greatest(F.lit(1), F.lit(min(x, (1 << 31) - 1))), n)
    return docs.select("doc_id", F.array_join(F.slice(lines, at(first), at(last) - at(first) + 1), "\n").alias("text"))


def fetch_query(docs: DataFrame, query: str) -> DataFrame:
    """doc_id, text, n_redacted: the distilled slice around matches, without credentials."""
    out = distill(docs, query).withColumn("t", F.col("distilled"))
    text, n = redacted(F.col("t"))
    return out.select("doc_id", text.alias("text"), n.alias("n_redacted"))


def find_words(find: str) -> list[str]:
    words = list(dict.fromkeys(w.lower() for w in find.split()))[:MAX_WORDS]
    if not words:
        raise ValueError("find needs at least one word")
    return words


def line_score(line: Column, words: list[str]) -> Column:
    """3 for each word that stands by itself, 1 for one inside another."""

    def one(w: str) -> Column:
        whole = f"(?iu)(?<![0-9A-Za-z_]){re.escape(w)}(?![0-9A-Za-z_])"
        return F.when(line.rlike(whole), WHOLE).when(F.lower(line).contains(w), PART).otherwise(0)

    return sum((one(w) for w in words[1:]), one(words[0]))


def anchors(docs: DataFrame, find: str, top: int = TOP) -> DataFrame:
    """doc_id, n_lines, line (from 1), score, hits: the best lines, earlier ones first among equals."""
    words = find_words(find)
    lines = docs.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n_lines"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    scored = lines.select("doc_id", "n_lines", (F.col("pos") + 1).alias("line"), line_score(F.col("text"), words).alias("score")).where("score > 0")
    by = Window.partitionBy("doc_id")
    ranked = scored.withColumns({"hits": F.count("*").over(by), "rank": F.row_number().over(by.orderBy(F.desc("score"), "line"))})
    return ranked.where(F.col("rank") <= max(1, min(top, MOST_TOP))).drop("rank")


def windows(docs: DataFrame, find: str, top: int = TOP) -> DataFrame:
    """doc_id, first, last, score, hits: two lines around each anchor, joined where they touch."""
    best = anchors(docs, find, top).withColumns({"a": F.greatest(F.lit(1), F.col("line") - AROUND), "b": F.least(F.col("n_lines"), F.col("line") + AROUND)})
    by = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(F.col("a") > F.col("reach") + 1, F.lit(True))).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    runs = best.withColumn("reach", before).withColumn("island", island)
    return runs.groupBy("doc_id", "island").agg(F.min("a").cast("long").alias("first"), F.max("b").cast("long").alias("last"), F.max("score").cast("long").alias("score"), F.max("hits").alias("hits")).drop("island")


def fetch_find(docs: DataFrame, find: str, top: int = TOP) -> DataFrame:
    """doc_id, text: the windows in order with their lines, and a closing count."""
    n = len(find_words(find))
    runs = windows(docs, find, top).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "score"))).alias("runs"), F.max("hits").alias("hits"))
    lines = F.split("text", "\n", -1)
    shown = F.transform("runs", lambda r: F.concat(F.lit("·find· L"), r["first"].cast("string"), F.lit("-"), r["last"].cast("string"), F.lit(" score "), r["score"].cast("string"), F.lit("\n"), F.array_join(F.slice(lines, r["first"].cast("int"), (r["last"] - r["first"] + 1).cast("int")), "\n")))
    end = F.concat(F.lit(f"·find· {n} words · "), F.coalesce("hits", F.lit(0)).cast("string"), F.lit(" lines matched"), F.when(F.col("hits").isNotNull(), F.concat(F.lit(" · "), F.size("runs").cast("string"), F.lit(" windows"))).otherwise(""))
    return docs.select("doc_id", "text").join(runs, "doc_id", "left").select("doc_id", F.when(F.col("hits").isNull(), end).otherwise(F.concat(F.array_join(shown, "\n"), F.lit("\n"), end)).alias("text"))


def verified(docs: DataFrame, value: str) -> DataFrame:
    """doc_id, status, line, found, candidates: whether a text holds ``value``, or strings one substitution or one swap of neighbours away."""
    if not value:
        raise ValueError("verify needs a non-empty value")
    at = F.instr("text", value)
    before = F.substring(F.col("text"), F.lit(1), at - 1)
    line_of = lambda s: (F.length(s) - F.length(F.translate(s, "\n", "")) + 1).cast("long")
    exact = docs.select("doc_id", "text", F.when(at > 0, line_of(before)).alias("line"))
    if len(value) < MIN_FUZZY:
        near = None
    else:
        # One pattern for each place: that place wrong, or that place and the next swapped.
        e = [re.escape(c) for c in value]
        wrong = ["".join([*e[:i], "(?s:.)", *e[i + 1 :]]) for i in range(len(e))]
        swapped = ["".join([*e[:i], e[i + 1], e[i], *e[i + 2 :]]) for i in range(len(e) - 1) if value[i] != value[i + 1]]
        # Lookahead, so that matches may overlap.
        hits = F.regexp_extract_all("text", F.lit("(?=(" + "|".join(wrong + swapped) + "))"), F.lit(1))
        near = F.array_sort(F.array_distinct(hits))
    found = exact.withColumn("near", F.when(F.col("line").isNull(), near) if near is not None else F.lit(None).cast("array<string>"))
    n = F.when(F.col("near").isNull(), 0).otherwise(F.size("near"))
    status = F.when(F.col("line").isNotNull(), "exact").when(n == 1, "corrected").when(n > 1, "ambiguous").otherwise("absent")
    one = F.when(n == 1, F.element_at("near", 1))
    where = F.substring(F.col("text"), F.lit(1), F.instr(F.col("text"), one) - 1)
    return found.select(
        "doc_id", status.alias("status"), F.coalesce("line", F.when(n == 1, line_of(where))).alias("line"), F.when(F.col("line").isNotNull(), F.lit(value)).otherwise(one).alias("found"),
        F.when((n > 1), F.slice("near", 1, CANDIDATES)).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )


def overview(docs: DataFrame) -> DataFrame:
    """doc_id, id, text: what a stashed text holds, for those who fetch parts of it."""
    told = top_repeats(suppression(collapsed(prepared(split_lines(docs)))))
    line = F.concat(F.lit("  ×"), F.col("count").cast("string"), F.when(F.col("kind") == "template", " (template)").otherwise(""), F.lit("  "), F.col("exemplar"))
    top = told.where(F.col("rank") <= MAP_REPEATS).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]), "\n").alias("top"))
    lines = F.split("text", "\n", -1)
    last = F.coalesce(F.get(F.reverse(F.filter(lines, lambda x: x != "")), F.lit(0)), F.lit(""))
    short = lambda x: T.first_chars(T.trim_space(x), EXEMPLAR)
    word = lambda c: F.col(c).cast("string")
    rows = docs.select("doc_id", "text").join(distill(docs).drop("distilled"), "doc_id").join(top, "doc_id", "left").withColumn("id", T.content_id(F.col("text")))
    text = F.concat(
        F.lit("stashed "), F.col("id"), F.lit(" · "), word("orig_bytes"), F.lit(" bytes · "), word("orig_lines"), F.lit(" lines\ndistill map: "), word("orig_lines"), F.lit(" -> "), word("out_lines"), F.lit(" lines · "), word("saved_pct"),
        F.lit("% of chars removable · "), word("important_kept"), F.lit(" error/warn lines"), F.coalesce(F.concat(F.lit("\ntop repeats:\n"), F.col("top")), F.lit("")),
        F.lit("\nfirst: "), short(F.element_at(lines, 1)), F.lit("\nlast: "), short(last), F.lit('\nfetch: {"id":"'), F.col("id"), F.lit('","query":"<regex>"} or {"id":"'), F.col("id"), F.lit('","lines":"a-b"}'),
    )
    return rows.select("doc_id", "id", text.alias("text"))
