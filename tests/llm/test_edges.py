"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from twinsift.llm import bpe, langid, licenses, mixing, pii, quality, sharding, simhash, topk, toxicity
from twinsift.llm.queries import CATEGORIES, RANKS

CLASHES = (
    "id h size spans fp ids ends n_tokens score rejected lang_pred stratum row part shard slot b value labelled good "
    "target planned budget n_words fingerprint component_id least root labels word context draw x kind start stop repeats"
).split()
ROWS = [
    (1, "the cat sat on the mat", "en", "a", 22),
    (1, "the cat sat on the mat", "en", "a", 22),
    (2, "", "en", None, 0),
    (3, None, None, "b", None),
    (None, "le chat est sur la table", "fr", None, 24),
    (4, "long words " * 20_000, "en", "b", 220_000),
    (5, "1" * 30_000 + "." * 1000, None, "", 31_000),
    (6, "\n \t ", "fr", "a", 4),
    (7, "é😀 日本 'LL don't\r\n", "fr", "c", 15),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({x: F.lit("clash") for x in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda d, _: mixing.mix(d),
    "bpe": lambda d, _: bpe.round_trip(d, RANKS),
    "langid": lambda d, _: langid.identify(d),
    "toxicity": lambda d, y: toxicity.classify(d, y, CATEGORIES),
    "quality": lambda d, y: quality.judge(d, y),
    "licenses": lambda d, _: licenses.scan(d),
    "sharding": lambda d, _: sharding.shard(d),
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "pii": lambda d, _: pii.digest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(name, docs, labels):
    found = OPERATORS[name](docs, labels).collect()
    assert sorted(str(x["doc_id"]) for x in found) == sorted(str(x[0]) for x in ROWS)
    same = [tuple(x) for x in found if x["doc_id"] == 1]
    if name != "sharding":
        assert same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, labels):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_topk_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, []), (5, [1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({x: F.lit(1) for x in ("id", "x", "asks", "block", "rank")})
    found = [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 100 == 0, 3).orderBy("rank", "vec_id").collect()]
    one = [(0, 1, None, 27 << 20), (0, 2, 0, 5 << 20), (0, 3, 6, 5 << 20)]
    assert found == [x for x in one for _ in range(2)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_redaction_keeps_columns(docs):
    found = pii.redact(docs)
    assert found.columns == docs.columns and found.count() == len(ROWS)
