"""Stored tables: look-ups read few files, grow by appending and say what scans say."""

import random

from pyspark.sql import functions as F

from tessera.operators import catalog, graph
from tessera.sources import stored


def test_adjacency(spark, monkeypatch):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(500)]
    steps = spark.createDataFrame(pairs, "source string, target string")
    name = stored.store_adjacency(steps)
    run = stored.look_up(spark, name, "source", ["n1", "n2"])._jdf.queryExecution()
    buckets = run.sparkPlan().collectLeaves().head().optionalBucketSet()
    assert buckets.isDefined() and buckets.get().cardinality() <= 2 and "PushedFilters: [In(source, [n1,n2])]" in run.toString()
    for start, depth in ((["n1"], 3), (["n1", "n2", "n2"], 6), (["none"], 2), ([], 2)):
        origin = spark.createDataFrame([("x", s) for s in start], "origin string, id string")
        want = {(r["id"], r["distance"]) for r in graph.reach(steps, origin, depth).collect()}
        for most in (5000, 3):  # beyond so many values the frontier is a frame
            monkeypatch.setattr(stored, "LOOK_UPS", most)
            got = [tuple(r) for r in stored.stored_reach(spark, name, start, depth).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    more = stored.store(spark.createDataFrame([("n1", "added")], "source string, target string"), "source", 16, name)
    assert more == name and "added" in {r["id"] for r in stored.stored_reach(spark, name, ["n1"], 1).collect()}


def test_search(spark):
    rng = random.Random(2)
    words = ["pay", "payment", "repayments", "the", "this", "thin", "loan", "LOAN", "xy", "mention", "men", "with", "interest-rate", "rate.", "(rate)"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(7))) or None) for k in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    index = stored.store_postings(df.where("doc_id < 70"), "doc_id", "text")
    stored.append_postings(index, df.where("doc_id >= 70"), "doc_id", "text")
    assert spark.table(index["grams"]).count() == spark.table(index["grams"]).distinct().count()
    for question in ("payment mentions", "thin", "thi men", "interest-rate loans", "nothing like it", "an", "rate pay men loan"):
        want = [tuple(r) for r in catalog.keyword_search(df, question, "text", "doc_id", limit=200).collect()] if any(len(w) > 2 for w in question.split()) else []
        got = [tuple(r) for r in stored.stored_search(spark, index, question, "doc_id", limit=200).collect()]
        assert got == want, question
    assert stored.look_up(spark, index["postings"], "term", spark.range(0).select(F.col("id").cast("string"))).count() == 0
