"""Forces between all pairs, edge by edge, against the layout by cells."""

import math

from tessera.operators import graph


def simulate(ids, edges, iterations, repulsion=100.0, length=150.0, gravity=0.1):
    n = len(ids)
    at = {v: [math.cos(2 * math.pi * i / n) * n**0.5 * 50, math.sin(2 * math.pi * i / n) * n**0.5 * 50, 0.0, 0.0] for i, v in enumerate(sorted(ids))}
    for k in range(iterations):
        alpha = 1 - k / iterations
        for a in at:
            for b in at:
                if a < b:
                    dx, dy = at[b][0] - at[a][0], at[b][1] - at[a][1]
                    d = math.hypot(dx, dy) or 1
                    fx, fy = dx / d * repulsion * alpha / d**2, dy / d * repulsion * alpha / d**2
                    at[a][2] -= fx
                    at[a][3] -= fy
                    at[b][2] += fx
                    at[b][3] += fy
        for a, b in edges:
            if a in at and b in at:
                dx, dy = at[b][0] - at[a][0], at[b][1] - at[a][1]
                d = math.hypot(dx, dy) or 1
                f = (d - length) / d * alpha * 0.5
                at[a][2] += dx * f
                at[a][3] += dy * f
                at[b][2] -= dx * f
                at[b][3] -= dy * f
        for p in at.values():
            p[2] -= p[0] * gravity * alpha
            p[3] -= p[1] * gravity * alpha
            p[0], p[1], p[2], p[3] = p[0] + p[2], p[1] + p[3], p[2] * 0.6, p[3] * 0.6
    return at


def test_forces(spark):
    ids = [f"n{k}" for k in range(8)]
    edges = [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n3", "n4"), ("n3", "n4"), ("n5", "n5"), ("n6", "outside")]
    nodes, links = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "source string, target string")
    # A fine raster has every node alone in its cell, so that every pair counts.
    got = {r["id"]: (r["x"], r["y"]) for r in graph.force_layout(nodes, links, iterations=3, grid=64).collect()}
    want = simulate(ids, edges, 3)
    assert set(got) == set(ids)
    assert all(math.isclose(got[i][j], want[i][j], rel_tol=1e-6, abs_tol=1e-6) for i in ids for j in (0, 1)), (got, want)
    # A raster of one cell still pushes all apart and pulls neighbours together.
    coarse = {r["id"]: (r["x"], r["y"]) for r in graph.force_layout(nodes, links, iterations=3, grid=1).collect()}
    assert len(set(coarse.values())) == 8 and math.dist(coarse["n0"], coarse["n1"]) < math.dist(coarse["n0"], coarse["n4"])
    assert graph.force_layout(nodes.limit(0), links).collect() == []
