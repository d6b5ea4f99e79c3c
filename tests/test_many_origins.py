"""Searches from many origins with a row a node, third sides of triangles, and labels that alternate."""

import random
from collections import Counter, deque

import pytest

from tessera.operators import graph


def graph_of(n, m, seed=5):
    r = random.Random(seed)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    near = {v: set() for v in range(n)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return pairs, near


def frames(spark, n, pairs):
    name = lambda v: f"n{v:02}"
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "source string, target string")
    return edges, spark.createDataFrame([(name(v),) for v in range(n)], "id string")


def distances(near, v):
    far, queue = {v: 0}, deque([v])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in far:
                far[y] = far[x] + 1
                queue.append(y)
    return far


def counting(rows):
    def cut(df):
        df = df.localCheckpoint()
        rows.append(df.count())
        return df

    return cut


def test_distances_from_many_origins(spark):
    pairs, near = graph_of(90, 100)
    edges, nodes = frames(spark, 90, pairs)
    want = [d for v in range(70) for d in distances(near, v).values() if d]
    got = graph.path_lengths(edges, nodes, 70).first()
    assert got["diameter"] == max(want) and got["mean_length"] == pytest.approx(sum(want) / len(want), abs=1e-12)
    rows = []
    graph.distance_counts(graph.both_ways(edges), graph.first_nodes(nodes, 70), counting(rows))
    assert max(rows) <= 2 * len(pairs)
    assert tuple(graph.path_lengths(edges.limit(0), nodes).first()) == (None, None)


def test_betweenness_holds_a_row_a_node(spark):
    pairs, near = graph_of(30, 45)
    edges, nodes = frames(spark, 30, pairs)
    total = Counter()
    for s in range(12):
        far, ways, share = distances(near, s), Counter({s: 1}), Counter()
        order = sorted(far, key=far.get)
        for x in order:
            for y in near[x]:
                if far[y] == far[x] + 1:
                    ways[y] += ways[x]
        for x in reversed(order):
            for y in near[x]:
                if far[y] == far[x] + 1:
                    share[x] += ways[x] / ways[y] * (1 + share[y])
            if x != s:
                total[x] += share[x]
    rows = []
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(edges, nodes, 12, counting(rows)).collect()}
    top = max(total.values())
    assert got == {f"n{v:02}": pytest.approx(total[v] / top, abs=1e-12) for v in range(30)}
    assert max(rows) <= 2 * len(pairs)


def test_triangles(spark):
    pairs, near = graph_of(25, 90)
    want = {f"n{v:02}": sum(b in near[a] for a in near[v] for b in near[v] if a < b) for v in near}
    got = {r["id"]: r["triangles"] for r in graph.triangles(frames(spark, 25, pairs)[0]).collect()}
    assert got == {v: k for v, k in want.items() if k}


def test_numbers_stand_for_ids(spark):
    edges = spark.createDataFrame([("b", "a", "x"), ("b", "a", "y"), ("b", None, "z"), ("q", "b", "x")], "source string, target string, type string")
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "id string, weight int")
    links, ids = graph.renumbered(edges, nodes)
    assert sorted(map(tuple, links.select("source", "target", "type").collect()), key=str) == [(1, 0, "x"), (1, 0, "y"), (1, None, "z"), (2, 1, "x")]
    assert sorted(map(tuple, ids.select("weight", "id").collect())) == [(1, 0), (2, 1), (3, 1), (4, None)]


@pytest.mark.parametrize("crowd", [250_000, 3])
def test_labels_that_alternate(spark, monkeypatch, crowd):
    """Labels of few rounds, and of very many, which end when they alternate."""
    monkeypatch.setattr(graph, "STEPS_OF_TASK", crowd)
    pairs, near = graph_of(24, 26)
    edges, nodes = frames(spark, 24, pairs)
    state, states = {v: v for v in near}, []
    for _ in range(300):
        states.append(state)
        votes = {v: Counter(state[w] for w in near[v]) for v in near}
        state = {v: min(votes[v], key=lambda x: (-votes[v][x], x)) if votes[v] else state[v] for v in near}  # noqa: B023
    for rounds in (1, 2, 3, 298, 299):
        rows = []
        got = {r["id"]: r["label"] for r in graph.label_propagation(edges, nodes, rounds, counting(rows)).collect()}
        assert got == {f"n{v:02}": f"n{x:02}" for v, x in states[rounds].items()}
        assert len(rows) < 40
