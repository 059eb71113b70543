"""Shards by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group. Groups are packed as units: a group that holds more than
1 / (shards * FINE) of all bytes, tokens or rows is a unit by itself, and only one that holds more than
1 / PART of a shard's share of one is split, into pieces of about that size by a hash of the doc_id; all smaller
groups are bundled by a hash of the text into shards * BUNDLES units. So the units are
bounded in number (BUNDLES * shards + 3 * (FINE + 2 * PART) * shards) whatever the input,
and are packed on the driver: largest first, each into the shard where the dot product of
its vector with the residual capacities is highest among those it fits (else of all).

The law that holds is ``bytes``: shards' sizes are near equal (the pieces packed last
are small). Slots count from 0 in each shard: a unit's rows are numbered among
themselves and shifted by the rows of the units before it, so no shard's rows meet in one task; nor do a unit's, which are numbered by
ranges of the doc_id's hash, one for each ``ROWS`` rows that a bundle has on average, and shifted by the rows of the ranges before.
The plan has a row for each range of a unit.

Defined results: a null text has no bytes and checksum 0 (that of no bytes) and all null
texts are one group, as are all empty ones; repeated rows are placed each, those of one doc_id in one piece;
a very long text may exceed a shard's share and then fills it; extra columns are ignored by ``assign`` and carried by ``shard``, which
replaces those named size, text_crc32, shard and slot; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

SHARDS, BUNDLES, FINE, PART, ROWS = 24, 256, 64, 4, 200_000
RECORD = 8  # bytes of a record besides its text


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != ""))


def pack(units: list[tuple[str, int, int, int]], shards: int) -> list[tuple[str, int, int]]:
    """(unit, bytes, tokens, rows) to (unit, shard, rows placed before it in the shard)."""
    if not units:
        return []
    need = np.array([u[1:] for u in units], dtype=np.float64)
    total = need.sum(0)
    need = need / np.where(total > 0, total, 1) * shards
    room = np.ones((shards, 3))
    rows = np.zeros(shards, np.int64)
    out = []
    for i in sorted(range(len(units)), key=lambda i: (-need[i].max(), units[i][0])):
        score = room @ need[i]
        fits = (room >= need[i] - 1e-12).all(1)
        to = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        out.append((units[i][0], to, int(rows[to])))
        room[to] -= need[i]
        rows[to] += units[i][3]
    return out


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size, tokens, crc and key (of equal texts) of ``docs``, and ``more``."""
    text = F.col("text")
    return docs.select(
        *more, "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD).alias("size"), F.when(text.isNull(), 0).otherwise(n_tokens(text)).cast("long").alias("tokens"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"), F.coalesce(F.md5(text), F.lit("")).alias("key"),
    )


def planned(base: DataFrame, shards: int) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """From measured rows: what adds unit and cell to measured rows, and the plan (unit, cell, shard, before)."""
    spark = base.sparkSession
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = base.agg(*sums).first()
    part = F.greatest(*[F.col(c) / F.lit(float(max(total[c] or 0, 1)) / (shards * FINE)) for c in ("size", "tokens", "n")])
    # At most 3 * FINE * shards groups can be heavy: each holds that part of one of three totals.
    heavy = base.groupBy("key").agg(*sums).where(part > 1).withColumn("pieces", F.ceil(part * PART / FINE).cast("int")).select("key", "pieces")
    heavy = spark.createDataFrame([tuple(r) for r in heavy.collect()], "key string, pieces int")
    cells = 1 + total["n"] // (shards * BUNDLES * ROWS)

    def in_units(rows: DataFrame) -> DataFrame:
        light = F.concat(F.lit("b"), F.pmod(F.xxhash64("key"), F.lit(shards * BUNDLES)))
        unit = F.when(F.col("pieces").isNull(), light).otherwise(F.concat("key", F.lit("-"), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))))
        rows = rows.join(F.broadcast(heavy), "key", "left").withColumns({"unit": unit, "hash": F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 32)})
        return rows.withColumn("cell", F.floor(F.col("hash") * cells / 2**32).cast("int"))

    found = sorted(tuple(r) for r in in_units(base).groupBy("unit", "cell").agg(*sums).collect())
    units: dict[str, list[int]] = {}
    for unit, _, *need in found:
        units[unit] = [a + b for a, b in zip(units.get(unit, [0, 0, 0]), need, strict=True)]
    to = {unit: [shard, before] for unit, shard, before in pack([(unit, *need) for unit, need in units.items()], shards)}
    plan = []
    for unit, cell, _, _, n in found:
        plan.append((unit, cell, *to[unit]))
        to[unit][1] += n
    return in_units, spark.createDataFrame(plan, "unit string, cell int, shard int, before long")


def placed(rows: DataFrame, in_units: Callable[[DataFrame], DataFrame], plan: DataFrame, *keep: Column) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("unit", "cell").orderBy("hash", "doc_id", "crc")) - 1
    return in_units(rows).withColumn("at", at).join(F.broadcast(plan), ["unit", "cell"]).select(*keep, "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` (doc_id, text, others) with size, text_crc32, shard and slot; columns of these names are replaced."""
    in_units, plan = planned(stash(measured(docs)), shards)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    return placed(measured(docs, F.struct("*").alias("row")), in_units, plan, *own)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text)."""
    base = stash(measured(docs))
    return placed(base, *planned(base, shards), F.col("doc_id"))
