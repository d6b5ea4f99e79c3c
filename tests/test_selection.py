"""Diverse selection against the plain greedy choice, and inputs on either side of branches."""

import random

from tessera.operators import models
from tessera.operators.mining import compile_condition


def greedy(rows, count, bias):
    """The survey's choice: by priority first, then the largest mean difference from all selected."""
    ordered = sorted(rows, key=lambda r: (-models.PRIORITY_RANKS.get(r[4], 0), r[0]))
    if len(ordered) <= count:
        return {r[0] for r in ordered}
    chosen = ordered[: int(count * (1 - bias))]
    rest = [r for r in ordered if r[1:4] not in {c[1:4] for c in chosen}]
    while len(chosen) < count and rest:
        best = max(rest, key=lambda r: (sum(sum(a != b for a, b in zip(r[1:4], c[1:4])) for c in chosen), -rest.index(r)))
        chosen.append(best)
        rest.remove(best)
    return {r[0] for r in chosen}


def test_diverse_selection(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, "a", "b", "c"]), rng.randrange(9), rng.choice(["x", "y"]), rng.choice(["critical", "high", "medium", "low", "odd"])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, f1 string, f2 int, f3 string, priority string")
    for count, bias, pulled in ((40, 0.5, 1000), (25, 0.8, 3), (10, 1.0, 1), (400, 0.5, 10)):
        got = models.diverse_selection(df, "id", ["f1", "f2", "f3"], "priority", count, bias, pulled)
        assert {r["id"] for r in got.collect()} == greedy(rows, count, bias) and got.columns == df.columns
    assert models.diverse_selection(df.limit(0), "id", ["f1"], "priority", 3).collect() == []


def test_branches_are_decided_alone(spark):
    leaf = lambda f, o, v: {"field": f, "operator": o, "value": v}
    rules = [
        leaf("a", "equals", 5), {"all": [leaf("a", "greater_than", 1), leaf("b", "less_than", 7), {"any": [leaf("c", "less_or_equal", 2), leaf("a", "greater_or_equal", 90)]}]},
        {"not": {"any": [{"all": [leaf("a", "not_equals", 3), leaf("b", "greater_than", 4)]}, leaf("c", "less_than", 0)]}}, {"all": [leaf("a", "less_than", 3), leaf("a", "greater_than", 8)]},
    ]
    signature = spark.createDataFrame([(f, 0.0, 100.0) for f in "abc"], "name string, low double, high double")
    leaves = lambda r: [x for p in r.get("all", r.get("any", [r["not"]] if "not" in r else [])) for x in leaves(p)] or [r]
    for rule in rules:
        rows = models.branch_cases(rule, signature, ["a", "b", "c"]).collect()
        for n, comparison in enumerate(leaves(rule)):
            some = {r["side"]: r for r in rows if r["leaf"] == n}
            values = {"below": comparison["value"] - 1, "on": comparison["value"], "above": comparison["value"] + 1}
            for side, r in some.items():
                assert r[comparison["field"]] == values[side]
            # The whole follows the comparison, or always its contrary where an odd number of negations stand above.
            own = spark.createDataFrame([(s, *[some[s][f] for f in "abc"]) for s in some] or [("none", 0.0, 0.0, 0.0)], "side string, a double, b double, c double").select("side", compile_condition(comparison).alias("own"))
            assert len({some[r["side"]]["outcome"] == r["own"] for r in own.collect() if r["side"] in some}) <= 1
        reached = {n: {r["outcome"] for r in rows if r["leaf"] == n} for n in range(len(leaves(rule)))}
        assert all(v == {True, False} for v in reached.values()) or rule is rules[-1]
    # Two comparisons that never hold together: neither side can be decided by one of them alone.
    assert not any(r["outcome"] for r in models.branch_cases(rules[-1], signature, ["a", "b", "c"]).collect())
