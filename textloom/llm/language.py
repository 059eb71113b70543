"""Language identification by the nearest of several centroids per language.

A text is a vector of its byte n-grams (1 to 3 bytes of letters, A-Z lowered, other characters as one
boundary) hashed to ``DIM`` places, log(1 + count) times inverse document frequency, normalised.
Each language has up to ``CENTROIDS`` centroids from spherical k-means over a sample; a
text gets the language of the centroid with the highest cosine, its score. It is rejected when the
cosine distance to that centroid is beyond the language's reach. Short texts lie farther from any
centroid than long ones, so reach goes by the number of distinct n-grams: sample rows that had no part in the clustering give the
median score at each length, and texts are rejected under ``SLACK`` times the ``QUANTILE`` quantile of
those rows' scores, each as a part of the median at its length. For texts shorter than the sample has, the median is carried on.

Fitting takes at most ``SAMPLE`` rows a language, distinct doc_ids of the least hash, of the ``LANGS`` commonest languages.
Rows are first thinned by a bound on that hash, from an estimate of the language's distinct doc_ids, so that no task gathers more than
about twice the sample, whatever the input and however often an id is repeated. Language
by language the fit runs in tasks; only document frequencies and centroids come to the driver.

Defined results: ``und`` with score 0 and rejected for null texts, texts without a letter, and for all
texts if nothing was learned; ties go to the first language in code point order; repeated
rows are predicted each; other columns are ignored (or kept by ``identified``, but for lang_pred, score and rejected, which are
replaced); a very long text is one row as any other, held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import words as W
from .shared import stash

DIM, SAMPLE, CENTROIDS, ROUNDS, LANGS = 4096, 1000, 4, 12, 512
QUANTILE, SLACK = 0.01, 0.45
#: Rows that a centroid, and a length at which scores are known, stand for at least; of so many sample rows one is kept for the reach.
FEW, KEPT = 5, 4
ROWS = 1024  # texts held as dense vectors at a time
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def grams(text: pa.Array) -> np.ndarray:
    """(texts, DIM) counts of hashed n-grams."""
    data, offs = W.raw(text)
    n = len(text)
    doc = np.repeat(np.arange(n), np.diff(offs))
    plain = np.where(LETTER[data], W.LOWER[data], np.uint8(32)).astype(np.uint32)
    inside = LETTER[data]
    out = np.zeros(n * DIM, np.float32)
    value = np.zeros(len(data), np.uint32)
    for k in (1, 2, 3):
        m = max(0, len(data) - k + 1)
        value = value[:m] * np.uint32(256) + plain[k - 1 : k - 1 + m]
        # Inside one text, and with no two boundaries beside each other.
        ok = doc[:m] == doc[k - 1 : k - 1 + m]
        if k == 1:
            ok &= inside
        for j in range(k - 1):
            ok &= inside[j : j + m] | inside[j + 1 : j + 1 + m]
        h = (value[ok] + np.uint32(k << 24)) * np.uint32(2654435761)
        place = doc[:m][ok] * DIM + (h >> np.uint32(20)).astype(np.int64) % DIM
        out += np.bincount(place, minlength=n * DIM)
    return out.reshape(n, DIM)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            for at in range(0, part.num_rows, ROWS):
                yield part.slice(at, ROWS)


def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in dealt(batches):
        x = grams(part.column("text"))
        row, place = np.nonzero(x)
        offs = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=part.num_rows))].astype(np.int32))
        yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("_h"), pa.ListArray.from_arrays(offs, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(x[row, place]))], names=["lang", "_h", "place", "count"])


def dense(table: pa.Table) -> np.ndarray:
    table = table.sort_by("_h").combine_chunks()
    x = np.zeros((table.num_rows, DIM), np.float32)
    for i, (p, c) in enumerate(zip(table.column("place"), table.column("count"), strict=True)):
        x[i, p.values.to_numpy()] = c.values.to_numpy()
    return x[x.sum(1) > 0]


def frequencies(table: pa.Table) -> pa.Table:
    x = dense(table)
    return pa.table({"n": pa.array([len(x)], pa.int64()), "df": pa.array([(x > 0).sum(0).tolist()], pa.list_(pa.int64()))})


def centred(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun with the text nearest to the mean and then texts farther than nine in ten from those chosen; without clusters of few."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argsort((x @ x[chosen].T).max(1), kind="stable")[len(x) // 10]))
    c = x[np.unique(chosen)]
    for _ in range(ROUNDS):
        to = np.argmax(x @ c.T, 1)
        new = np.stack([x[to == j].sum(0) if (to == j).any() else c[j] for j in range(len(c))])
        c = new / np.linalg.norm(new, axis=1, keepdims=True)
    size = np.bincount(np.argmax(x @ c.T, 1), minlength=len(c))
    return c[size >= min(FEW, size.max())]


def reach(score: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Lengths (log2 of distinct n-grams), median scores at these, and the least part of the median that is near enough."""
    level = np.log2(np.maximum(grams, 1))
    at, median = [], []
    for c in range(13):
        own = level.astype(int) == c
        if own.sum() >= FEW:
            at.append(level[own].mean())
            median.append(float(np.median(score[own])))
    if not at:
        return np.zeros(0), np.zeros(0), 0.0
    long = level >= int(at[0])
    return np.array(at), np.array(median), SLACK * float(np.quantile(score[long] / np.interp(level[long], at, median), QUANTILE))


FITTED = "lang string, at array<double>, median array<double>, low double, centroids array<array<float>>"


def clustered(table: pa.Table, idf: np.ndarray, k: int) -> pa.Table:
    counts = dense(table)
    x, lang = weighted(counts, idf), table.column("lang")[0].as_py()
    rows = []
    if len(x):
        # Every fourth row is kept for the reach, if that leaves enough.
        own = np.arange(len(x)) % KEPT == KEPT - 1 if len(x) >= 10 * KEPT else np.ones(len(x), bool)
        c = centred(x[~own] if not own.all() else x, k)
        at, median, low = reach((x[own] @ c.T).max(1), (counts[own] > 0).sum(1))
        rows = [{"lang": lang, "at": at.tolist(), "median": median.tolist(), "low": low, "centroids": c.tolist()}]
    kinds = [("lang", pa.string()), ("at", pa.list_(pa.float64())), ("median", pa.list_(pa.float64())), ("low", pa.float64()), ("centroids", pa.list_(pa.list_(pa.float32())))]
    return pa.Table.from_pylist(rows, pa.schema(kinds))


class Model:
    def __init__(self, rows: list, idf: np.ndarray) -> None:
        """``rows``: as of FITTED, in order of language."""
        self.langs, self.idf = [r.lang for r in rows for _ in r.centroids], idf
        self.centroids = np.array([x for r in rows for x in r.centroids], np.float32).reshape(-1, DIM)
        # The least score that is near enough, by language and log2 of distinct n-grams in sixteenths.
        steps = np.arange(16 * 13) / 16
        # Of shorter texts than the sample has, the median falls with the root of their n-grams.
        self.low = np.array([r.low * np.interp(steps, r.at, r.median) * 2 ** (np.minimum(steps - r.at[0], 0) / 2) if r.at else 0 * steps for r in rows for _ in r.centroids])

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        n = len(text)
        data, offs = W.raw(text)
        some = np.zeros(n, bool)
        doc = np.repeat(np.arange(n), np.diff(offs))
        some[doc[LETTER[data] & (data < 128)]] = True
        high = np.zeros(n, bool)
        high[doc[data >= 128]] = True
        for i in np.flatnonzero(high & ~some):
            some[i] = any(c.isalpha() for c in text[int(i)].as_py())
        if not self.langs:
            some[:] = False
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        counts = grams(text)
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = np.argmax(cosine, 1)
        score = np.where(some, np.clip(cosine[np.arange(n), best], 0, 1), 0).astype(np.float64)
        return [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], score, (score < self.low[best, (16 * np.log2(np.maximum((counts > 0).sum(1), 1))).astype(np.int64)]) | ~some


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model from ``docs`` (doc_id, text, lang), of rows that aren't held out and have a language."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", F.xxhash64("doc_id").alias("_h"), "text")
    # At most LANGS rows.
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("_h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    part = {r.lang: min(1.0, (2 * sample + 100) / max(r.n, 1)) for r in sizes}
    bounds = docs.sparkSession.createDataFrame([(lang, int(p * 2**32)) for lang, p in part.items()], "lang string, _most long")
    thin = known.where(F.col("text").isNotNull()).join(F.broadcast(bounds), "lang").where(F.shiftrightunsigned(F.xxhash64("_h"), 32) < F.col("_most"))
    order = Window.partitionBy("lang").orderBy("_h")
    chosen = thin.groupBy("lang", "_h").agg(F.min("text").alias("text")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    vectors = stash(chosen.select("lang", "_h", "text").mapInArrow(sparse, "lang string, _h bigint, place array<int>, count array<float>"))
    df = vectors.groupBy("lang").applyInArrow(frequencies, "n bigint, df array<bigint>").collect()
    n = sum(r.n for r in df)
    idf = np.log((1 + n) / (1 + np.array([r.df for r in df], np.float64).sum(0) if df else np.ones(DIM))).astype(np.float32) + np.float32(1)
    return Model(sorted(vectors.groupBy("lang").applyInArrow(lambda t: clustered(t, idf, centroids), FITTED).collect(), key=lambda r: r.lang), idf)


def predictions(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part in dealt(batches):
        lang, score, rejected = model.predict(part.column("text"))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*part.schema.names, "lang_pred", "score", "rejected"])


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected (columns of these names are replaced)."""
    model = model or fit(docs)
    own = docs.drop("lang_pred", "score", "rejected")
    schema = StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return own.mapInArrow(lambda it: predictions(it, model), schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs``."""
    model = fit(docs)
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without those rejected."""
    return identified(docs.select(F.struct("*").alias("_row"), "text"), fit(docs)).where("not rejected").select("_row.*")
