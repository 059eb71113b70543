"""All ten operators on columns with clashing names, very long texts, ties, repeated rows and nulls."""

from collections import Counter

import pytest

from textloom.llm import decontaminate, html_text, language, licenses, mixing, near_dedup, quality, scoring, sharding, shared, token_files

#: Names that the operators use themselves.
CLASHING = (
    "label size source_size target taken copies copy row shard slot text_crc32 grown_shard unit cell key crc tokens pieces hash class salt name rate offset rank before xx node bands band centre class_id "
    "_row _hit _id _xx _size _own _h _n score rejected lang_pred held_out n_words n_hit n_items items segment starts hits labels spans n_base votes quality kept words lines t file block n at ids ids_crc32 start n_tokens number level"
).split()
LONG = "the quick brown fox jumps over the lazy dog and " * 12_000 + "ends here."
TEXTS = [LONG, LONG, "", None, "...", "a", "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog", "cc by 4.0, all rights reserved", "Ωμέγα και άλφα", "line\n" * 60, "x" * 50_000]
ROWS = [(i, t, "en" if t else None, ("s1", None, "s2")[i % 3]) for i, t in enumerate(TEXTS)]
ROWS = [*ROWS, ROWS[6], ROWS[6], (None, "no id here", "en", "s1"), (None, None, None, None), (6, "the same id, another text", "fr", "s2")]


def tokenized(d):
    P = pytest.importorskip("public_tokenizers")
    return token_files.round_trip(d, P.path("word_bpe_49k.json"))


OPERATORS = {
    "near_duplicates": near_dedup.near_duplicates,
    "assign": sharding.assign,
    "shard": sharding.shard,
    "licenses": licenses.licenses,
    "contamination": lambda d: decontaminate.contamination(d, items(d)),
    "languages": language.languages,
    "judged": quality.judged,
    "scored": scoring.scored,
    "round_trip": tokenized,
    "mixture": mixing.mixture,
    "copies": mixing.copies,
}


def items(d):
    return d.sparkSession.createDataFrame([(1, "quick brown fox", 7), (2, None, 7), (1, "quick brown fox", 7)], "item_id long, text string, doc_id long")


@pytest.fixture(scope="module")
def clashing(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return d.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASHING])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_its_result(clashing, name):
    got = OPERATORS[name](clashing)
    assert len(set(got.columns)) == len(got.columns)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in ROWS)


def test_rows_that_stay_stay_whole(spark, clashing):
    whole = Counter(str(r) for r in clashing.collect())
    for out, fewer in ((near_dedup.keep_one(clashing), True), (decontaminate.clean(clashing, items(clashing)), True), (language.accepted(clashing), True), (mixing.mix(clashing), False)):
        assert out.columns == clashing.columns
        got = Counter(str(r) for r in out.collect())
        assert set(got) <= set(whole) and got
        assert not fewer or all(n <= whole[k] for k, n in got.items())
    carried = sharding.shard(clashing).drop("size", "text_crc32", "shard", "slot")
    left = clashing.drop("size", "text_crc32", "shard", "slot")
    assert Counter(str(r) for r in carried.collect()) == Counter(str(r) for r in left.collect())


def test_pages_with_clashing_names_and_very_long_html(spark):
    rows = [(i, "http://a.org/", f"<article><p>{t or ''}</p></article>" if t is not None else None) for i, t in enumerate(TEXTS)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *[f"page_id AS `{c}`" for c in ("host", "runs", "strict", "text", "n_chars", "unit", "found")])
    got = {r.page_id: r.text for r in html_text.main_text(d).collect()}
    assert got == {i: " ".join((t or "").split()) for i, t in enumerate(TEXTS)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
