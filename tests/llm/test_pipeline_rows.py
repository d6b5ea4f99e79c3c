"""The near-duplicate stage on ids that repeat with other texts, and on null ids."""

import corpus_pipeline as p


def test_rows_of_one_id_are_decided_by_their_own_text(spark):
    base = " ".join(f"word{k}" for k in range(30))
    rows = [(1, base)] + [(i, base + " more") for i in range(10, 20)] + [(i, f"a text of its own under the repeated id {i}") for i in range(10, 20)]
    rows += [(None, base), (None, "a copied text without an id stands here")] + [(None, "a copied text without an id stands here")] + [(None, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in p.near_duplicate_stage(spark, df, "").collect()))
    want = [(0, ""), (0, ""), (0, "a copied text without an id stands here"), (1, base)] + [(i, f"a text of its own under the repeated id {i}") for i in range(10, 20)]
    assert got == sorted(want)
