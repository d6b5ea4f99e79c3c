"""Graph planning, matching and small helpers against plain computations."""

import functools
import operator
import random

from tessera.operators import catalog, compare, components, graph, models, planning, telemetry


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "uses") for a, b in pairs], "source string, target string, type string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n, "part") for n in names], "id string, type string")


def reachable(pairs, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def some_dag(seed, n=14, m=18):
    r = random.Random(seed)
    names = [f"n{k:02d}" for k in range(n)]
    return names, [(names[i], names[j]) for i, j in (sorted(r.sample(range(n), 2), reverse=True) for _ in range(m))]


def test_long_chains_keep_their_levels(spark):
    chain = [(f"c{k:03d}", f"c{k - 1:03d}") for k in range(1, 40)]
    got = dict(map(tuple, graph.longest_levels(edges_of(spark, chain), nodes_of(spark, [f"c{k:03d}" for k in range(40)])).collect()))
    assert got == {f"c{k:03d}": k for k in range(40)}


def test_components_of_long_paths_and_nothing(spark):
    pairs = [(k, k + 1) for k in range(700)] + [(1000, 1001), (None, 7), (2000, 2000)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(701)} | {1000: 1000, 1001: 1000, 2000: 2000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_critical_path(spark):
    names, pairs = some_dag(3)
    pairs += [("x", "y"), ("y", "x"), ("z", "x")]
    effort = {n: (k * 7) % 5 + 1.0 for k, n in enumerate([*names, "x", "y", "z"])}
    best = {}

    def dist(n):
        if n not in best:
            needs = [(dist(b), b) for a, b in set(pairs) if a == n]
            best[n] = effort[n] + max((d for d, _ in needs), default=0)
        return best[n]

    for n in names:
        dist(n)
    nodes = spark.createDataFrame(list(effort.items()), "id string, effort double")
    paths = planning.longest_paths(edges_of(spark, pairs), nodes)
    assert {r["id"]: r["dist"] for r in paths.collect()} == best | {"x": None, "y": None, "z": None}
    path = sorted(planning.critical_path(paths).collect(), key=lambda r: r["dist"])
    assert path[-1]["dist"] == max(best.values()) and path[0]["dist"] == effort[path[0]["id"]]
    assert all((b["id"], a["id"]) in pairs and b["dist"] == a["dist"] + effort[b["id"]] for a, b in zip(path, path[1:]))
    one = planning.parallelization(paths).first()
    assert one["parallelization"] == sum(effort.values()) / max(best.values())


def test_critical_path_of_equal_ends(spark):
    nodes = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 3.0), ("d", 1.0), ("e", 1.0)], "id string, effort double")
    paths = planning.longest_paths(edges_of(spark, [("c", "a"), ("b", "a"), ("e", "c"), ("d", "c")]), nodes)
    assert {tuple(r) for r in planning.critical_path(paths).collect()} == {("a", 2.0), ("c", 5.0), ("d", 6.0)}


def test_parallel_branches(spark):
    names, pairs = some_dag(5, 9, 8)
    ties = {n: reachable(pairs, n) | reachable([(b, a) for a, b in pairs], n) for n in names}
    want, taken = [], set()
    for n in names:
        if n not in taken:
            group = {n} | {o for o in names if o != n and o not in taken and o not in ties[n]}
            if len(group) > 1:
                want += [(len({w[0] for w in want}), x) for x in group]
                taken |= group
    order = sorted({b for b, _ in want})
    got = planning.parallel_branches(edges_of(spark, pairs), nodes_of(spark, names)).collect()
    assert sorted(map(tuple, got)) == sorted((order.index(b), x) for b, x in want)


def test_risks_follow_every_rule(spark):
    columns = "id string, loc int, cyclomatic int, test_coverage int, doc_coverage int, debt_hours int, business_rules int, external_calls int, criticality string, language string, owners int, dependencies int, dependents int, cycles int, coupling double"
    worst = ("w", 20_000, 101, 10, 20, 201, 101, 21, "critical", "cobol", 0, 26, 21, 1, 8.0)
    mild = ("m", 100, 5, None, None, None, 1, 1, "low", "java", 2, 1, 1, 0, 1.0)
    df = spark.createDataFrame([worst, mild], columns)
    got = planning.risk_factors(df, team=2, days=10, coupled=True).collect()
    # Of the sixteen rules two exclude each other twice: a complexity is high or moderate, a module critical or important.
    assert len([r for r in got if r["id"] == "w"]) == 14 + 2 and {r["factor"] for r in got if r["id"] == "m"} == {"resources"}
    assert {(r["factor"], r["severity"], r["score"]) for r in got} >= {("complexity", "critical", 0.8 * 0.7 * 4 * 2.5), ("coupling", "high", 8.0), ("circular", "high", 0.8 * 0.7 * 3 * 2.5)}
    risks = {r["id"]: r for r in planning.module_risk(df, df.sparkSession.createDataFrame(got)).collect()}
    for k in "mw":
        mean = sum(r["score"] for r in got if r["id"] == k) / sum(r["id"] == k for r in got)
        assert abs(risks[k]["score"] - mean) < 1e-9 and risks[k]["level"] == ("medium" if 3 <= mean < 5 else "low")


def test_places_in_groups(spark):
    rows = [(g, k) for g in "abc" for k in range(50 if g == "b" else 3)] + [(None, 1)]
    got = graph.placed(spark.createDataFrame(rows, "g string, k long").repartition(7), ["g"], ["k"]).collect()
    want = {("b", k): k for k in range(50)} | {(g, k): k for g in "ac" for k in range(3)}
    assert {(r["g"], r["k"]): r["place"] for r in got if r["g"]} == want


def test_reachable_estimates_are_near(spark):
    names, pairs = some_dag(7, 30, 60)
    got = {r["id"]: r["reachable"] for r in graph.reachable_estimates(edges_of(spark, pairs), nodes_of(spark, names)).collect()}
    assert all(abs(got[n] - len(reachable(pairs, n))) <= 1 for n in names)


def test_greedy_matches(spark):
    r = random.Random(1)
    rows = [(f, a, b, r.choice([0.2, 0.31, 0.5, 0.71, 0.9])) for f in "xy" for a in range(8) for b in range(8) if r.random() < 0.6]
    want = set()
    for f in "xy":
        used = set()
        for a in range(8):
            best = max(((s, -b) for g, c, b, s in rows if (g, c) == (f, a) and s > 0.3 and b not in used), default=None)
            if best:
                used.add(-best[1])
                want.add((f, a, -best[1], best[0], "direct" if best[0] > 0.7 else "refactored"))
    got = compare.greedy_matches(spark.createDataFrame(rows, "f string, a int, b int, score double"), ["f"])
    assert {tuple(x) for x in got.collect()} == want


def test_many_short_passages(spark):
    """Beyond the bound of a broadcast: by word and by first characters, the same as by search."""
    r = random.Random(2)
    words = ["ab", "cab", "x", "yy", "long-enough-word", "abc", "bc"]
    docs = [(k, " ".join(r.choice(words) for _ in range(8))) for k in range(20)] + [(99, ""), (100, None)]
    passages = sorted({r.choice(words) for _ in range(9)} | {f"{a} {b}" for a in words[:4] for b in words[:4]} | {f"{a} {b} {c}" for a, b, c in (r.sample(words, 3) for _ in range(9))} | {"", "a", "ough-word x"})
    d, p = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame([(x,) for x in passages], "passage string")
    want = sorted((i, x) for i, t in docs for x in passages if t and x and x in t)
    for bound in (1000, 20, 2):
        got = catalog.containing(d, p, "text", "passage", bound).select("id", "passage").collect()
        assert sorted(map(tuple, got)) == want, bound


def test_shrinking():
    assert models.shrunk(1000, lambda x: x >= 17) == 17
    assert models.shrunk("aaaaaXbbb", lambda t: "X" in t) == "X"
    assert models.shrunk({"n": 50, "t": "abc"}, lambda d: d["n"] > 3) == {"n": 4, "t": ""}
    assert models.budgets(100, {"a": 3, "b": 1}) == {"a": 75, "b": 25} and [k for k, _ in models.text_cases()] == ["empty", "blank", "long"]


def test_running_sums_by_bucket(spark):
    rows = [(g, k, (k * 7) % 5 + 0.0) for g in "ab" for k in range(100)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    from pyspark.sql import functions as F

    plain, cut = (telemetry.cumulative(df, ["g"], ["k"], "v", b).select("g", "k", "total").collect() for b in (None, F.floor(F.col("k") / 9)))
    assert sorted(map(tuple, plain)) == sorted(map(tuple, cut))


def test_a_cycle_is_no_order(spark):
    import pytest

    with pytest.raises(ValueError, match="a, b"):
        planning.pipeline_order(graph.longest_levels(edges_of(spark, [("a", "b"), ("b", "a"), ("c", "d")]), nodes_of(spark, "abcd")))


def test_project_costs(spark):
    """A small and a large project by hand."""
    rows = [
        # overall: code 40 (12), data 10*2+2*5+1*3=33 (6.6), integration 2*3+1*2+0=8 (2), rules 4*2+1*5=13 (3.25) -> 23.85 -> 24
        (1, 10_000.0, 20.0, 10, 1, 2, 2, 1, 0, 4, 1, "cobol-java", "senior", 2),
        # code 100 (30), data 100 (20), integration 100 (25), rules 100 (25) -> 100
        (2, 2_000.0, 75.0, 60, 5, 9, 20, 10, 8, 80, 10, "rpg-java", None, None),
        (3, 0.0, None, 0, 0, 0, 0, 0, 0, 0, 0, None, "junior", 1),
    ]
    names = "id int, lines double, procedure_complexity double, structures int, nested_structures int, tables int, dependencies int, files int, apis int, rules int, unsure_rules int, pair string, team string, team_size int"
    got = {r["id"]: r for r in planning.project_costs(planning.project_effort(planning.project_complexity(spark.createDataFrame(rows, names)))).collect()}
    # 10 * 15 * 1.0 * 1.0 * 0.8 = 120 days: 18, 18, 48, 24, 12
    assert [got[1][c] for c in ("overall", "analysis_days", "design_days", "development_days", "testing_days", "deployment_days", "total_days", "least_days", "most_days")] == [24, 18, 18, 48, 24, 12, 120, 96, 144]
    assert [got[1][c] for c in ("labor", "infrastructure", "licensing", "contingency", "total_cost", "weeks")] == [96_000, 9_600, 4_800, 22_080, 132_480, 15]
    # 2 * 12 * 1.8 * 1.6 = 69.12 days: 10, 10, 28, 14, 7 = 69, seven tenths 48.3, 1.3 times 89.7
    assert [got[2][c] for c in ("overall", "total_days", "least_days", "most_days", "weeks")] == [100, 69, 48, 90, 6]
    assert [got[3][c] for c in ("overall", "total_days", "total_cost", "weeks")] == [0, 0, 0, 0]


def test_module_risk_on_the_bound_of_a_level(spark):
    scores = (4.199999999999999, 3.5999999999999996, 4.0, 1.7999999999999998, 1.25, 3.15)  # their mean is 3, but not that of their sum as doubles in this order
    factors = spark.createDataFrame([(1, x) for x in scores], "id int, score double").coalesce(1)
    got = planning.module_risk(spark.createDataFrame([(1,), (2,)], "id int"), factors).collect()
    assert functools.reduce(operator.add, scores) / 6 < 3 and {tuple(r) for r in got} == {(1, 3.0, "medium"), (2, 0.0, "low")}
