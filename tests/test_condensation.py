"""Strong components, acyclic labels and exact reachability against plain searches over random graphs."""

import random

import pytest

from tessera.operators import condensation as c


def closure(n, pairs):
    """What each node reaches by a path of at least one edge."""
    out = {v: set() for v in range(n)}
    for a, b in pairs:
        out[a].add(b)
    reached = {}
    for v in range(n):
        seen, queue = set(), list(out[v])
        while queue:
            w = queue.pop()
            if w not in seen:
                seen.add(w)
                queue += out[w]
        reached[v] = seen
    return reached


def graphs():
    rng = random.Random(3)
    ring = [(i, (i + 1) % 12) for i in range(12)]
    yield "ring and tail", 15, ring + [(3, 12), (12, 13), (14, 0), (14, 14)]
    yield "chain", 8, [(i + 1, i) for i in range(7)]
    yield "random with cycles", 25, [(rng.randrange(25), rng.randrange(25)) for _ in range(34)]
    yield "acyclic", 20, [(b, a) for a, b in (sorted(rng.sample(range(20), 2)) for _ in range(26))]
    yield "two rings one way", 10, [(0, 1), (1, 2), (2, 0), (5, 6), (6, 7), (7, 8), (8, 5), (2, 5), (9, 0)]
    yield "no edges", 4, []


@pytest.mark.parametrize("name,n,pairs", list(graphs()), ids=[g[0] for g in graphs()])
def test_against_searches(spark, name, n, pairs):
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs] * 2 + [(None, "n00"), ("n00", "outside")], "source string, target string")
    nodes = spark.createDataFrame([(f"n{k:02}",) for k in range(n)], "id string")
    reached = closure(n, pairs)
    got = {r["id"]: (r["component"], r["size"], r["cyclic"]) for r in c.strong_components(edges, nodes).collect()}
    for v in range(n):
        own = {w for w in reached[v] if v in reached[w]} | {v}
        assert got[f"n{v:02}"] == (f"n{min(own):02}", len(own), v in reached[v])
    counts = {r["id"]: r["reachable"] for r in c.reach_counts(edges.where("target <> 'outside'"), nodes).collect()}
    assert counts == {f"n{v:02}": len(reached[v] - {v}) for v in range(n)}


def test_empty(spark):
    edges, nodes = spark.createDataFrame([], "source string, target string"), spark.createDataFrame([], "id string")
    assert c.strong_components(edges, nodes).collect() == [] and c.reach_counts(edges, nodes).collect() == []


def test_labels_are_intervals_of_trees(spark):
    """A tree's root needs one row, whatever its size; merged intervals neither overlap nor touch."""
    pairs = [(k, (k - 1) // 3) for k in range(1, 60)]
    steps = spark.createDataFrame([(b, a) for a, b in pairs], "source long, target long")
    nodes = spark.range(60).selectExpr("id", "1L AS weight")
    labels, own = c.reach_labels(steps, nodes)
    assert labels.count() == 60 and sorted(r["lo"] for r in own.collect()) == list(range(60))
    some = spark.createDataFrame([(1, 0, 2), (1, 1, 5), (1, 5, 6), (1, 9, 10), (1, 9, 12), (2, 0, 1)], "id long, lo long, hi long")
    assert sorted(map(tuple, c.merged(some).collect())) == [(1, 0, 6), (1, 9, 12), (2, 0, 1)]


def test_running_sums(spark):
    rows = [(g, k, k % 4 + 1) for g in "ab" for k in range(50)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    got = {(r["g"], r["k"]): r["before"] for r in c.running_sums(df, "g", "k", "v").collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}
