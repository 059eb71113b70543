"""The subpackage's queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .html_text import main_text
from .language import languages
from .licenses import licenses
from .mixing import mixture
from .near_dedup import near_duplicates
from .quality import judged
from .scoring import scored
from .shared import table
from .sharding import assign
from .token_files import round_trip


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents")).drop("spans")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_licenses": op3_licenses,
    "op4_decontaminate": op4_decontaminate,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_lm_score": op8_lm_score,
    "op9_token_files": op9_token_files,
    "op10_mixing": op10_mixing,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4_SQL = f"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents), bw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)),
dg AS (SELECT r, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
hit AS (SELECT r, i, k, item_id FROM dg JOIN win USING (k, g)), pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS xs FROM hit GROUP BY r),
wi AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT item_id, list_distinct(list_slice(ws, i, i + k - 1)) AS ts, ws[i] AS w FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0))),
tok AS (SELECT r, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS i FROM dw), tf AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
rare AS (SELECT id, arg_min(t, (coalesce(n, 0), t)) AS t FROM (SELECT id, unnest(ts) AS t FROM wi) LEFT JOIN tf USING (t) GROUP BY id),
c AS (SELECT tok.r, item_id, ts, w, i, ws FROM tok JOIN rare USING (t) JOIN wi USING (id) JOIN dw ON dw.r = tok.r WHERE list_has_all(list_slice(ws, greatest(i - 40, 1), i + 40), ts)),
a AS (SELECT r, item_id, ts, w, ws, unnest(range(greatest(i - 20, 1), least(i + 20, len(ws)) + 1)) AS p FROM c),
nr AS (SELECT r, count(DISTINCT item_id) AS n FROM a WHERE ws[p] = w AND list_has_all(list_slice(ws, greatest(p - 20, 1), p + 20), ts) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(xs), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(xs, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(nr.n, 0) AS n_near_items FROM dw LEFT JOIN pos USING (r) LEFT JOIN it USING (r) LEFT JOIN nr USING (r)"""

OP10_SQL = """WITH d AS (SELECT doc_id, source, CAST(len([w FOR w IN string_split_regex(coalesce(text, ''), '[ \\t-\\r]+') IF w <> '']) AS BIGINT) AS size, CAST('0x' || left(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '-')), 8) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(n - 1) % 3 + 1] AS DOUBLE) AS wt, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, row_number() OVER o AS fr, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM w WINDOW o AS (ORDER BY source_size / wt, n)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT min_by(lev, fr) FROM f WHERE lev * wt <= cap) * wt, cap)) AS target FROM f),
r AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN size > 0 THEN floor(sqrt(sqrt(size::DOUBLE)) * 16) ELSE 0 END, h, doc_id, size) AS rk,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, CAST('0x' || left(md5('7|offset|' || coalesce('s' || d.source, '')), 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * least(2, floor(u + rate * rk) - floor(u + rate * (rk - 1))) AS BIGINT) AS taken FROM r"""

ORACLES: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op10_mixing": OP10_SQL}
