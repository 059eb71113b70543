"""Log distillation: repeated blocks and near-duplicate lines go, important lines always stay.

1. Runs of a block of 1 to 8 lines, equal but for volatile parts, become the first block and a marker.
2. Of lines with one masked form the first two stay; of masked forms with one template, the first three.
3. With a query, only matching and important lines and two lines around them stay.

All windows share the partitioning by document. The one sequential step, choosing runs that
don't overlap, sees only the lines where a run may begin.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import split_lines

# Fixed values of the results to match.
MIN_RUN, MAX_CYCLE, KEEP_EXACT, KEEP_TEMPLATE, TOP, EXEMPLAR, CONTEXT, SHORT = 3, 8, 2, 3, 40, 160, 2, 4


def prepared(lines: DataFrame) -> DataFrame:
    """doc_id, pos, line to those and masked, important."""
    own = lines.select("doc_id", "pos", T.last_frame(T.strip_ansi(F.col("line"))).alias("line"))
    return own.withColumns({"masked": T.mask(F.col("line")), "important": T.is_important(F.col("line"))})


def run_starts(rows: DataFrame) -> DataFrame:
    """doc_id, pos, k, r: the best block length and number of repetitions for a run that begins at pos."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    # From the end on, so that each line's frame grows out of the next one's; a frame to the end would be gone through anew for each line.
    on = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ks = range(1, MAX_CYCLE + 1)
    same = {f"e{k}": F.coalesce((F.lead("masked", k).over(by) == F.col("masked")) & ~F.lead("important", k).over(by), F.lit(False)) for k in ks}
    # Distances to the next line that breaks the run, and to the next important one.
    far = F.lit(1 << 40)
    ends = {f"l{k}": F.coalesce(F.min(F.when(~F.col(f"e{k}"), F.col("pos"))).over(on) - F.col("pos"), F.lit(0)) for k in ks}
    ends["clear"] = F.coalesce(F.min(F.when(F.col("important"), F.col("pos"))).over(on) - F.col("pos"), far)
    found = rows.withColumns(same).withColumns(ends)
    choice = lambda k: F.struct((F.floor(F.col(f"l{k}") / k) * k).alias("saved"), F.lit(-k).alias("less"), (F.floor(F.col(f"l{k}") / k) + 1).alias("r"))
    valid = lambda k: (F.col("clear") >= k) & (F.floor(F.col(f"l{k}") / k) + 1 >= MIN_RUN)
    best = F.array_max(F.array(*[F.when(valid(k), choice(k)) for k in ks]))
    return found.select("doc_id", "pos", best.alias("b")).where("b is not null").select("doc_id", "pos", (-F.col("b.less")).cast("long").alias("k"), F.col("b.r").cast("long").alias("r"))


def chosen_runs(starts: DataFrame) -> DataFrame:
    """Of the run starts of each document, those met when one goes on behind every run taken."""
    kind = starts.schema["doc_id"].dataType.simpleString()

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        free, keep = 0, []
        for p, k, r in zip(*(table.column(c).to_pylist() for c in ("pos", "k", "r")), strict=True):
            keep.append(p >= free)
            if p >= free:
                free = p + k * r
        return table.filter(pa.array(keep, pa.bool_()))

    return starts.groupBy("doc_id").applyInArrow(walk, f"doc_id {kind}, pos bigint, k bigint, r bigint")


def collapsed(rows: DataFrame) -> DataFrame:
    """Prepared rows with runs collapsed: doc_id, pos (doubled; a marker's is odd), line, masked (null for markers), important."""
    runs = chosen_runs(run_starts(rows)).select("doc_id", "pos", F.struct("pos", "k", "r").alias("run"))
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.join(runs, ["doc_id", "pos"], "left").withColumn("run", F.last("run", ignorenulls=True).over(by))
    into = F.col("pos") - F.col("run.pos")
    inside = F.coalesce(into < F.col("run.k") * F.col("run.r"), F.lit(False))
    label = F.concat(F.lit("   [×"), F.col("run.r").cast("string"), F.when(F.col("run.k") == 1, F.lit(" similar]")).otherwise(F.concat(F.lit(" similar "), F.col("run.k").cast("string"), F.lit("-line blocks]"))))
    mark = F.struct((F.col("pos") * 2 + 1).alias("pos"), label.alias("line"), F.lit(None).cast("string").alias("masked"), F.lit(False).alias("important"))
    own = F.struct((F.col("pos") * 2).alias("pos"), "line", "masked", "important")
    kept = seen.where(~inside | (into < F.col("run.k")))
    parts = F.when(inside & (into == F.col("run.k") - 1), F.array(own, mark)).otherwise(F.array(own))
    return kept.select("doc_id", F.inline(parts))


def suppression(rows: DataFrame) -> DataFrame:
    """Collapsed rows with what becomes of them: passed (by itself), rn (of its masked form), crn (of its template, among first ones), n, cn."""
    bare = T.trim_space(F.col("line"))
    passed = F.col("important") | F.col("masked").isNull() | bare.startswith("[×") | (F.length(bare) < SHORT)
    own = rows.withColumn("passed", passed).withColumn("key", F.when(~F.col("passed"), F.col("masked")))
    by_key = Window.partitionBy("doc_id", "passed", "key")
    own = own.withColumns({"rn": F.row_number().over(by_key.orderBy("pos")), "n": F.count("*").over(by_key)})
    first = ~F.col("passed") & (F.col("rn") == 1)
    own = own.withColumn("template", F.when(first, T.template(F.col("masked")))).withColumn("first", first)
    by_template = Window.partitionBy("doc_id", "first", "template")
    return own.withColumns({"crn": F.row_number().over(by_template.orderBy("pos")), "cn": F.count("*").over(by_template)})


def is_kept() -> Column:
    return F.col("passed") | (F.col("first") & (F.col("crn") <= KEEP_TEMPLATE)) | (~F.col("first") & (F.col("rn") <= KEEP_EXACT))


def top_repeats(rows: DataFrame) -> DataFrame:
    """doc_id, rank, count, kind, exemplar of the most repeated masked forms and templates, from suppression()."""
    exemplar = T.first_chars(T.trim_space(F.col("line")), EXEMPLAR).alias("exemplar")
    exact = rows.where(F.col("first") & (F.col("n") > KEEP_EXACT)).select("doc_id", F.col("n").alias("count"), F.lit("exact").alias("kind"), exemplar, "pos")
    alike = rows.where(F.col("first") & (F.col("crn") == 1) & (F.col("cn") > KEEP_TEMPLATE)).select("doc_id", F.col("cn").alias("count"), F.lit("template").alias("kind"), exemplar, "pos")
    order = Window.partitionBy("doc_id").orderBy(F.desc("count"), "kind", "pos")
    return exact.unionByName(alike).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("doc_id", "rank", "count", "kind", "exemplar")


def summed_up(told: DataFrame) -> DataFrame:
    """One row a document from suppression(): doc_id, lines (array of line, important in output order) and counts.

    Everything is one aggregation, so that what leads to it is evaluated once.
    """
    exemplar = T.first_chars(T.trim_space(F.col("line")), EXEMPLAR)
    entry = lambda n, kind: F.struct((-F.col(n)).alias("less"), F.lit(kind).alias("kind"), "pos", exemplar.alias("exemplar"))
    rows = told.groupBy("doc_id").agg(
        F.count_if(F.col("masked").isNull()).alias("collapsed_runs"),
        F.count_if("important").alias("important_kept"),
        F.count_if(~F.col("passed") & ~F.col("first") & (F.col("rn") > KEEP_EXACT)).alias("suppressed"),
        F.count_if(F.col("first") & (F.col("crn") > KEEP_TEMPLATE)).alias("template_suppressed"),
        F.collect_list(F.when(is_kept(), F.struct("pos", "line", "important"))).alias("body"),
        F.collect_list(F.when(F.col("first") & (F.col("n") > KEEP_EXACT), entry("n", "exact"))).alias("exact"),
        F.collect_list(F.when(F.col("first") & (F.col("crn") == 1) & (F.col("cn") > KEEP_TEMPLATE), entry("cn", "template"))).alias("alike"),
    )
    word = lambda c: c.cast("string")
    gone = F.col("suppressed") + F.col("template_suppressed")
    head = F.concat(F.lit("── "), word(gone), F.lit(" repeated lines suppressed ("), word(F.col("suppressed")), F.lit(" exact ×N, "), word(F.col("template_suppressed")), F.lit(" same-template; first occurrences kept above) ──"))
    tag = lambda e: F.when(e["kind"] == "template", F.lit(" (template)")).otherwise(F.lit(""))
    tail = F.transform(F.slice(F.array_sort(F.concat("exact", "alike")), 1, TOP), lambda e: F.concat(F.lit("  ×"), word(-e["less"]), tag(e), F.lit("  "), e["exemplar"]))
    added = F.transform(F.concat(F.array(head), tail), lambda x: F.struct(x.alias("line"), T.is_important(x).alias("important")))
    body = F.transform(F.array_sort("body"), lambda r: F.struct(r["line"].alias("line"), r["important"].alias("important")))
    return rows.select("doc_id", F.when(gone > 0, F.concat(body, added)).otherwise(body).alias("lines"), "collapsed_runs", "important_kept", "suppressed", "template_suppressed")


def searched(spark: SparkSession, query: str, flags: str = "(?i)") -> str:
    """``query`` as a pattern for any case; one that isn't a pattern where it will run stands for itself."""
    pattern = f"{flags}{query}"
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return flags + re.escape(query)
    return pattern


def sliced(rows: DataFrame, query: str, context: int = CONTEXT) -> DataFrame:
    """Lines (doc_id, pos, line, important) that match ``query`` (any case) or are important, with ``context`` lines around; gaps become one line that counts them."""
    pattern = searched(rows.sparkSession, query)
    order = Window.partitionBy("doc_id").orderBy("pos")
    hit = (F.col("important") | F.col("line").rlike(pattern)).cast("int")
    near = rows.withColumn("hit", hit).withColumn("keep", F.max("hit").over(order.rowsBetween(-context, context)) == 1)
    # A gap's count stands where its first line was: the line before it was kept, or there is none.
    near = near.withColumn("gap", F.sum(F.col("keep").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    by_gap = Window.partitionBy("doc_id", "gap")
    near = near.withColumns({"n": F.count_if(~F.col("keep")).over(by_gap), "at": F.min(F.when(~F.col("keep"), F.col("pos"))).over(by_gap)})
    told = F.when(F.col("keep"), F.col("line")).when(F.col("pos") == F.col("at"), F.concat(F.lit("… "), F.col("n").cast("string"), F.lit(" lines omitted")))
    return near.select("doc_id", "pos", told.alias("line")).where("line is not null")


def distill(docs: DataFrame, query: str | None = None) -> DataFrame:
    """doc_id, distilled and its counts, for each text of ``docs`` (doc_id, text)."""
    rows = summed_up(suppression(collapsed(prepared(split_lines(docs)))))
    before = docs.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("orig_lines"), T.octets(F.col("text")).alias("orig_bytes"))
    text = F.transform("lines", lambda x: x["line"])
    if query is not None:
        one = sliced(rows.select("doc_id", F.posexplode("lines").alias("pos", "x")).select("doc_id", "pos", "x.line", "x.important"), query)
        one = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
        rows = rows.drop("lines").join(one, "doc_id")
    out = before.join(rows.withColumns({"out_lines": F.size("lines").cast("long"), "distilled": F.array_join(text, "\n")}).drop("lines"), "doc_id")
    out = out.withColumn("out_bytes", T.octets(F.col("distilled")))
    return out.withColumn("saved_pct", T.percent_saved(F.col("orig_bytes"), F.col("out_bytes")))
