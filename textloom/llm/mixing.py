"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources in code point order (null last) weigh 3, 1, 2, repeating, and share ``budget`` times
all words; a source's target stops at ``most`` times its own words and the excess is shared
out anew by weight until none is above. That is water filling, solved in closed form:
with sources ordered by cap / weight, the capped ones are a prefix of that order.

Every document of a source is expected target / source size times. Its documents lie in the
order (size class, hash of doc_id); the expected copies are summed along it, one
random offset is added, and a document is emitted once for each integer boundary crossed. Since
the order goes by size, the words taken follow the target closely. The running sum needs no task
that holds a source: rows are counted by cell (source, size class, range of hashes; the class is the whole part of 16 fourth roots of the
size), the counts of the cells are summed along the order, and rows are numbered inside their cells. There are ``SALTS`` ranges of hashes for each ``ROWS`` rows,
so cells don't grow with the table; how many there are changes no result.

Words are counted once and kept beside doc_id and source; texts are read again only by ``mix``, which emits them.

Defined results: null and empty texts have size 0 and take 0 words, but may be emitted; very long texts are as any other;
a null source is a source; repeated rows are numbered each; the hash of the doc_id makes
reruns agree; empty tables give no rows; ``mix`` carries all columns, whatever their names; ``copies`` replaces those it is named after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2.0
SALTS, ROWS, SEED = 256, 1 << 28, 7


def n_words(text: Column) -> Column:
    """Maximal runs of other than space and \\t to \\r."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")), F.lit(0))


def hashed(*cols: Column) -> Column:
    """32 bits of the md5 of the columns as text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size to these and target (double). One row a source: they are ordered in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(n - 1, F.lit(len(weights))) + 1)
    w = sizes.select("source", "source_size", n.alias("n"), weight.alias("weight"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "n")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"cap": F.col("source_size") * F.lit(most), "all": F.sum("source_size").over(every) * F.lit(budget)})
    w = w.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The level holds from the first source on whose cap it does not exceed.
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("n"), F.col("level").alias("level")))).over(every)
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(first["level"] * F.col("weight"), F.col("cap"))).alias("target"))


#: Columns that ``copies`` adds.
ADDED = ("size", "source_size", "target", "copies")


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, "doc_id", "source", n_words(F.col("text")).cast("long").alias("size"))


def counted(base: DataFrame, rows: DataFrame, weights: tuple, budget: float, most: float, seed: int) -> DataFrame:
    """``rows`` (doc_id, source, size, others) with source_size, target and copies; ``base``: doc_id, source and size of the same rows."""
    salts = SALTS * (1 + base.count() // ROWS)

    def in_cells(df: DataFrame) -> DataFrame:
        df = df.withColumns({"class": F.when(F.col("size") > 0, F.floor(F.sqrt(F.sqrt(F.col("size").cast("double"))) * 16)).otherwise(0).cast("int"), "hash": hashed(F.lit(seed), F.col("doc_id")), "name": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))})
        return df.withColumn("salt", F.floor(F.col("hash") * salts / 2**32).cast("int"))

    cells = in_cells(base).groupBy("name", "source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("name").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    target = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    target = target.withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source")
    start = cells.select("name", "class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(target, "name")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hashed(F.lit(seed), F.lit("offset"), F.col("name")) / F.lit(2.0**32)
    rank = F.col("before") + F.row_number().over(Window.partitionBy("name", "class", "salt").orderBy("hash", "doc_id", "size"))
    up_to = lambda r: F.floor(F.col("offset") + F.col("rate") * r)
    found = in_cells(rows).join(start, ["name", "class", "salt"]).withColumns({"rate": rate, "offset": offset, "rank": rank})
    return found.withColumn("copies", F.least(F.lit(int(most)), up_to(F.col("rank")) - up_to(F.col("rank") - 1)).cast("int"))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, others) with size, source_size, target and copies (int), which replace columns of these names."""
    rows = measured(docs, F.struct("*").alias("row"))
    found = counted(stash(measured(docs)), rows, weights, budget, most, seed)
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    base = stash(measured(docs))
    return counted(base, base, weights, budget, most, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    found = counted(stash(measured(docs)), measured(docs, F.struct("*").alias("row")), weights, budget, most, seed)
    return found.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
