"""Stages composed: row selection, columnar table, distillation, codebook, ladder; then geometry, price and advice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import codebook, geometry, jsonrows, ladder, needles, pricing, secrets
from ..operators.distill import distill as distilled


def _replaced(docs: DataFrame, better: DataFrame, **counts: str) -> DataFrame:
    """``docs`` with the text of ``better`` (doc_id, text, ...) where it has one."""
    new = better.select("doc_id", F.col("text").alias("_new"), *[F.col(v).cast("long").alias(k) for k, v in counts.items()])
    out = docs.join(new, "doc_id", "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in counts}) if counts else out


def staged(docs: DataFrame, level: float = 0, crush: bool = False, distill: bool = False, query: str | None = None, book: bool = False, table: bool = False, codebook: bool | None = None) -> DataFrame:  # noqa: PLR0913
    """doc_id, compressed, kept, rows, cols, entries, protected_lines of each text: stages that are asked for, in their fixed order."""
    book = book if codebook is None else codebook
    out = docs.select("doc_id", "text")
    zero = {c: F.lit(0).cast("long") for c in ("kept", "rows", "cols", "entries")}
    if crush:
        out = _replaced(out, jsonrows.crushed(out), kept="kept", rows="rows")
    if table:
        out = _replaced(out, jsonrows.table_encoded(out.select("doc_id", "text")), cols="cols")
    if distill or query is not None:
        out = _replaced(out, distilled(out.select("doc_id", "text"), query).withColumnRenamed("distilled", "text"))
    if book:
        out = _replaced(out, _books(out.select("doc_id", "text")), entries="entries")
    out = out.withColumns({k: v for k, v in zero.items() if k not in out.columns})
    done = ladder.compress(out.select("doc_id", "text"), level).drop("level")
    whole = docs.select("doc_id", T.content_id(F.col("text")).alias("id"))
    marker = F.concat(F.lit("\n·crushed· kept "), F.col("kept").cast("string"), F.lit(" of "), F.col("rows").cast("string"), F.lit(" rows - full set: fetch "), F.col("id"), F.lit(" (--query re | --lines a-b)"))
    out = out.drop("text").join(done, "doc_id").join(whole, "doc_id").withColumn("compressed", F.when(F.col("rows") > 0, F.concat("compressed", marker)).otherwise(F.col("compressed")))
    return out.select("doc_id", "compressed", "kept", "rows", "cols", "entries", "protected_lines")


def _books(docs: DataFrame) -> DataFrame:
    return codebook.applied(docs).select("doc_id", F.col("encoded").alias("text"), "entries")


#: Between the parts of an id of form and document.
SEP = "\x1f"


def _form(base: str, docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` under ids of form and document."""
    return docs.select(F.concat(F.lit(base + SEP), F.col("doc_id").cast("string")).alias("doc_id"), "text")


def _measured(forms: DataFrame) -> DataFrame:
    """doc_id, text_tokens, with_book, pages, normal, tiny of each text of ``forms`` as it is (0) and, where it has one, under its codebook (1).

    Each text is coded and measured where it is, one after the other; neither it nor its coded form comes back.
    """
    schema = "doc_id string, text_tokens bigint, with_book int, pages bigint, normal bigint, tiny bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id, text, tokens, ranked in zip(*(batch.column(c) for c in ("doc_id", "text", "text_tokens", "ranked")), strict=True):
                plain = text.as_py() or ""
                out.append((id.as_py(), tokens.as_py(), 0, *geometry.font_sizes(plain)))
                if book := codebook.choose([(r["value"], r["n"]) for r in ranked.as_py() or ()], plain):
                    out.append((id.as_py(), tokens.as_py(), 1, *geometry.font_sizes(codebook.encode(plain, book))))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "text_tokens", "with_book", "pages", "normal", "tiny"])

    told = forms.withColumn("text_tokens", T.text_tokens(F.col("text")))
    return codebook.with_candidates(told, "text_tokens").select("doc_id", "text", "text_tokens", "ranked").mapInArrow(run, schema)


def recommended(docs: DataFrame) -> DataFrame:
    """One row a document: the cheapest reversible page form, its tiny price, the distilled form, the plain text route and the thinned-out row set.

    All forms of all documents are rows of one frame, coded and measured together, and met again by document.
    Frames that several steps read are persisted, so that each is planned and evaluated once; ``clearCache`` frees them.
    Those of all forms, several times as large as the texts, are kept on disk, to leave memory to long texts.
    """
    docs = docs.select("doc_id", "text").persist()
    whole = _form("raw", docs).unionByName(_form("table", jsonrows.tables_of(docs))).persist(StorageLevel.DISK_ONLY)
    slim = distilled(whole).select(F.concat(F.lit("slim_"), F.col("doc_id")).alias("doc_id"), F.col("distilled").alias("text"))
    few = jsonrows.crushed(docs).persist()
    forms = whole.unionByName(slim).unionByName(_form("crush", few)).unionByName(_form("crush_table", jsonrows.tables_of(few.select("doc_id", "text")))).persist(StorageLevel.DISK_ONLY)
    name = F.split("doc_id", SEP)
    sizes = _measured(forms).withColumns({"base": name[0], "id": name[1].cast(docs.schema["doc_id"].dataType)})
    # Of the plain and the coded form the cheaper one, the plain one among equals.
    best = sizes.groupBy("base", "id").agg(
        F.min(F.struct(F.col("normal").alias("tokens"), "with_book", F.col("pages").alias("pages"), F.col("tiny").alias("tiny"))).alias("w"),
        F.max("text_tokens").alias("text_tokens"),
    )
    bases = ("raw", "table", "slim_raw", "slim_table", "crush", "crush_table")
    rows = best.groupBy(F.col("id").alias("doc_id")).agg(*[F.max(F.when(F.col("base") == b, F.struct("w", "text_tokens"))).alias(b) for b in bases])
    less = lambda a, b: F.coalesce(F.col(f"{a}.w.tokens") < F.col(f"{b}.w.tokens"), F.lit(False))
    table, crush_table = less("table", "raw"), less("crush_table", "crush")
    rev, dis = F.when(table, F.col("table.w")).otherwise(F.col("raw.w")), F.when(table, F.col("slim_table")).otherwise(F.col("slim_raw"))
    cr = F.when(crush_table, F.col("crush_table.w")).otherwise(F.col("crush.w"))
    space = ladder.compress(docs, 1).select("doc_id", T.text_tokens(F.col("compressed")).alias("space_tokens"))
    rows = rows.withColumns({"raw_tokens": F.col("raw.text_tokens"), "rev": rev, "dis": dis, "cr": cr, "by_table": table}).join(space, "doc_id").join(few.select("doc_id", "kept", F.col("rows").alias("n")), "doc_id", "left")
    crush_text = F.when(F.col("n").isNotNull(), F.col("crush.text_tokens"))
    return rows.select(
        "doc_id", "raw_tokens", (F.col("rev.with_book") == 1).alias("codebook"), F.col("by_table").alias("table"), F.col("rev.tokens").alias("image_tokens"), F.col("rev.pages").alias("pages"), F.col("rev.tiny").alias("tiny_tokens"),
        F.col("dis.w.tokens").alias("distilled_image_tokens"), F.col("dis.text_tokens").alias("distilled_text_tokens"), F.when(F.col("space_tokens") < F.col("raw_tokens"), "whitespace").otherwise("none").alias("transform"),
        F.least("space_tokens", "raw_tokens").alias("text_tokens"), F.col("n").alias("crush_rows"), F.col("kept").alias("crush_kept"), crush_text.alias("crush_text_tokens"), F.col("cr.tokens").alias("crush_image_tokens"),
        F.when(F.col("n").isNotNull(), T.percent_saved(F.col("raw_tokens"), F.least(crush_text, F.col("cr.tokens")))).alias("crush_saved_pct"),
    )


def _credentials(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(secrets.credential_kinds(F.col("text"))).alias("n_credentials"))


def estimated(docs: DataFrame, level: float = 0, model: str | None = None, font: str = "normal", verbatim: str = "full", cached: bool = False, advice: DataFrame | None = None, rates: pricing.Rates = pricing.RATES, **stages: bool) -> DataFrame:  # noqa: PLR0913
    """One row a document: stages applied, pages and tokens, exact strings, verdict, read-back level and route.

    A model or a cached text adds the price in dollars. With ``advice`` (``recommended``) the route weighs the advised page
    form, and steer says where the thinned-out row set would be cheaper still.
    """
    done = staged(docs, level, **stages)
    text = done.select("doc_id", F.col("compressed").alias("text"))
    raw = docs.select("doc_id", T.chars(F.col("text")).alias("orig_chars"), T.text_tokens(F.col("text")).alias("raw_tokens"), T.text_tokens(F.col("text")).alias("text_tokens"))
    side = needles.sidecars(text.join(raw.select("doc_id", F.col("orig_chars").alias("raw_chars")), "doc_id"))
    found = F.size("needles") + F.col("more")
    shipped: Column = {"off": F.lit(0).cast("long"), "lazy": T.text_tokens(needles.pointer(found))}.get(verbatim, F.col("tokens"))
    side = side.select("doc_id", shipped.alias("side_tokens"), (F.col("dense") & F.lit(verbatim != "off")).alias("dense"), found.cast("long").alias("n_needles"))
    space = ladder.compress(docs, 1).select("doc_id", T.text_tokens(F.col("compressed")).alias("space_tokens"))
    size = geometry.walked(text, font).select("doc_id", "pages", F.col("tokens").alias("image_tokens"), "dims")
    rows = raw.join(size, "doc_id").join(side, "doc_id").join(space, "doc_id").join(_credentials(docs), "doc_id").join(done.select("doc_id", T.chars(F.col("compressed")).alias("stage_chars"), "protected_lines"), "doc_id")
    rows = rows.withColumns({"model": F.lit(model).cast("string"), "cached": F.lit(cached), "verdict": pricing.verdict()})
    priced = bool(model) or cached
    rows = pricing.cost_verdict(rows, rates) if priced else rows.withColumn("cheaper", F.lit(None).cast("string"))
    rows = rows.withColumn("own_tokens", F.col("image_tokens"))
    crush = [f"crush_{c}" for c in ("kept", "rows", "text_tokens", "image_tokens")]
    if advice is not None:
        rows = rows.drop("image_tokens").join(advice.select("doc_id", "image_tokens", *crush), "doc_id")
    out = pricing.route(rows).withColumn("image_tokens", F.col("own_tokens")).withColumn("level", pricing.fidelity_level(F.col("raw_tokens"), F.col("image_tokens"), F.lit(font == "tiny"), pricing.is_weak_reader(F.col("model"))))
    saved = T.percent_saved(F.col("raw_tokens"), F.col("image_tokens") + F.col("side_tokens"))
    out = pricing.steered(out) if advice is not None else out
    more = [*(["text_usd", "image_usd", "cheaper", "cost_saved_pct", "breakeven"] if priced else []), *(["steer"] if advice is not None else [])]
    return out.select("doc_id", "orig_chars", "stage_chars", "pages", "image_tokens", "raw_tokens", "side_tokens", "n_needles", "dense", "n_credentials", "protected_lines", saved.alias("total_saved_pct"), "verdict", "level", "pick", "tokens", "fidelity", "reason", *more)
