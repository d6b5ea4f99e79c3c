"""Stages over empty tables, nulls, repeated rows and extra columns."""

import pytest

import corpus_pipeline as p
from tests.llm.test_jaccard import shingles

SF = "/root/testdata/sf0.001"
LONG = "a quite ordinary sentence with enough words to be a shingle set of its own here"
ROWS = [
    (1, LONG, "en", "a", 5, 0.5), (1, LONG, "en", "a", 5, 0.5), (2, LONG, None, "b", None, None), (3, None, "en", None, 0, 1.0), (4, "", None, "a", 0, None),
    (None, LONG + " and more", "en", "b", 3, 2.0), (6, "x " * 60_000, "en", "a", 9, 3.0), (7, LONG.upper() + " ÉÉ", "fr", "c", 1, 1.0), (7, "another text under one id", "fr", "c", 1, 1.0),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").selectExpr("*", "'k' AS sid", "1 AS copies", "2 AS size", "'z' AS label")


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, k):
    stage, docs = p.STAGES[k][1], frame(spark, ROWS)
    out = stage(spark, docs, SF)
    if k < 4:
        assert out.columns == docs.columns
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    if k == 1:
        assert len(rows) == len(ROWS)
    if k == 2:
        assert sorted(i for i in ids if i is not None) == [1, 3, 4, 6, 7] and ids.count(None) == 0  # the row of null id is a near copy of document 1
    if k == 3:
        words = lambda xs: sum(len((t or "").split()) for t in xs)
        assert max(ids.count(i) for i in {1, 2, 6}) <= 4 and ids.count(6) <= 2 and ids.count(2) == 2
        assert words(r["text"] for r in rows if r["source"] == "b") == 2 * words(t for _, t, _, s, _, _ in ROWS if s == "b")
    if k == 4:
        assert len(rows) == len(ROWS) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert stage(spark, docs.limit(0), SF).collect() == []
    assert shingles(None) == set()
