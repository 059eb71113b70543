"""Tables, text files, JSON rows and event logs as DataFrames, and the matching sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_sensitive_path

EVENT_SCHEMA = (
    "ts string, tool string, input_tokens bigint, cache_read_tokens bigint, cache_create_tokens bigint, output_tokens bigint, baseline_tokens bigint, saved_tokens_cache_aware bigint, compressed boolean, orig_chars bigint, "
    "image_count bigint, cacheBreak struct<index: bigint, kind: string, rebilled: bigint>, toolTax struct<unused: array<string>, tokens: bigint>, volatileSystem boolean, blocks array<string>"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than cores, as small files of few row groups have; a scan of more splits stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_texts(spark: SparkSession, *paths: str, allow_sensitive: bool = False) -> DataFrame:
    """doc_id (the path), text: a row for each file; files that may hold credentials are left out unless allowed."""
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return files if allow_sensitive else files.where(~is_sensitive_path(F.col("doc_id")))


def read_rows(spark: SparkSession, *paths: str, schema: str | None = None, array: bool = False) -> DataFrame:
    """JSON rows, a line each or whole arrays; lines that don't parse are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED").option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(list(paths))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log as rows for ``operators.ledger``: lines that don't parse are dropped, fields of other types are null."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("pos", F.monotonically_increasing_id())
    parsed = lines.where(F.try_parse_json("value").isNotNull()).select("pos", F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("pos", "e.*")
    renamed = {"break_kind": F.col("cacheBreak.kind"), "break_index": F.col("cacheBreak.index"), "break_rebilled": F.col("cacheBreak.rebilled"), "tax_tokens": F.col("toolTax.tokens"), "volatile_system": F.col("volatileSystem")}
    return parsed.withColumns(renamed).drop("cacheBreak", "toolTax", "volatileSystem")


def append_events(events: DataFrame, path: str) -> None:
    """Add rows to the event log as lines of JSON."""
    events.write.mode("append").json(path)
