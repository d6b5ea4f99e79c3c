"""Targets and fitted words against plain computations."""

import random
import re
from fractions import Fraction
from itertools import product

from tessera.llm.mixing import fit_counts, mix, op3_source_mix


def plain_targets(sizes, weights=(5, 2, 1)):
    """Shares by weight, again and again: whoever is above twice its size gives its excess to the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed = {}
    while True:
        left = Fraction(3, 2) * sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        goal = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if goal[s] > 2 * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: Fraction(2 * sizes[s]) for s in over}


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check(rows, docs, exact):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + words(text)
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]] and r["target"] == float(want[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= exact(s), (s, t, float(want[s]))


def test_many_sources_reach_their_targets(spark):
    r = random.Random(9)
    names = [f"s{k}" for k in range(400)] + ["", "é", "Z", "\U0001f600", "￿", None]
    docs = [(k, " ".join("w" * (1 + r.randrange(3)) for _ in range(r.choice([0, 1, 2, 3, 5, 50]))), r.choice(names[: 1 + k % len(names)] + names[-2:])) for k in range(4000)]
    docs += [(5000, None, "hot"), (5001, "", None)] + [(k, "a b c", "hot") for k in range(6000, 8000)] + docs[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS words", "2 AS weight", "'k' AS skey")
    longest = {}
    for _, text, source in docs:
        longest[source] = max(longest.get(source, 0), words(text))
    rows = mix(df).collect()
    check(rows, docs, lambda s: 1 + longest[s])
    assert sorted(map(str, mix(df).collect())) == sorted(map(str, rows))


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    check(rows, docs, lambda s: 1 + 0.02 * sum(words(t) for _, t, x in docs if x == s))
    taken = {r["doc_id"]: r["copies"] * r["size"] for r in rows}
    assert {r["doc_id"]: r["taken"] for r in op3_source_mix(spark, sf).collect()} == taken


def test_fitted_counts_reach_the_best_sum():
    """Bounded knapsack against every choice of counts."""
    r = random.Random(10)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 30), 4))
        counts = [r.randrange(1, 5) for _ in lengths]
        budget = r.randrange(sum(n * c for n, c in zip(lengths, counts, strict=True)) + 5)
        sums = {sum(k * n for k, n in zip(ks, lengths, strict=True)) for ks in product(*[range(c + 1) for c in counts])}
        got = fit_counts(lengths, counts, budget, "s")
        reached = sum(k * n for k, n in zip(got, lengths, strict=True))
        # An equal share of each length is taken first, so the rest reaches the best sum or nearly.
        assert reached <= budget and max(x for x in sums if x <= budget) - reached <= max(lengths)


def test_one_source_and_sources_without_words(spark):
    one = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "x")], "doc_id long, text string, source string")
    rows = mix(one).collect()
    assert {r["target"] for r in rows} == {7.5} and sum(r["copies"] * r["size"] for r in rows) in (7, 8)
    empty = spark.createDataFrame([(1, "", "x"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["target"], r["source_size"]) for r in mix(empty).collect()] == [(0.0, 0)] * 2
    assert mix(one.limit(0)).collect() == []
