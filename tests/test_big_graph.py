"""Graphs by numbers, crowded targets and quarters that stay spread."""

import random

from tessera.operators import graph, models, planning


def frames(spark, pairs, names):
    return spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame([(n,) for n in names], "id string")


def test_numbers_keep_the_order_of_ids(spark):
    edges, nodes = frames(spark, [("b", "z"), ("b", "z"), ("x10", "x9"), (None, "q"), ("a", "a")], ["x9", "b", "c", None])
    links, ids = graph.numbered(edges, nodes)
    rows = {r["id"]: r["number"] for r in ids.collect()}
    assert sorted(rows, key=rows.get) == ["a", "b", "c", "x10", "x9", "z"]
    assert {tuple(r) for r in links.collect()} == {(rows["b"], rows["z"]), (rows["x10"], rows["x9"]), (rows["a"], rows["a"])}


def test_components_are_named_by_ends_that_are_no_nodes(spark):
    edges, nodes = frames(spark, [("b", "a"), ("c", "b"), ("y", "x")], ["b", "c", "y", "z"])
    assert {tuple(r) for r in graph.components(edges, nodes).collect()} == {("b", "a"), ("c", "a"), ("y", "x"), ("z", "z")}


def test_crowded_target_needs_no_pairs(spark):
    """30,000 providers of one target, each much used: 900 million pairs of providers."""
    n = 30_000
    edges = spark.range(n).selectExpr("explode(array(struct('p' || id AS source, 'hub' AS target), struct('u1' AS source, 'p' || id AS target), struct('u2' AS source, 'p' || id AS target), struct('u3' AS source, 'p' || id AS target), struct('u4' AS source, 'p' || id AS target))) AS x").select("x.*")
    few, _ = frames(spark, [(f"v{k}", s) for s in ("s1", "s2") for k in range(4)] + [("s1", "t"), ("s2", "t"), ("s2", "w")], [])
    edges = edges.unionByName(few)
    nodes = edges.selectExpr("source AS id").union(edges.select("target")).distinct()
    got = [tuple(r) for r in graph.bottlenecks(edges, nodes).collect()]
    # The hub has no targets of its own.
    assert got == [("hub", n, 0, 1.0), ("s1", 4, 1, 0.5), ("s2", 4, 1, 0.5)]


def test_quarters_by_group(spark):
    r = random.Random(3)
    rows = [(g, r.choice([None, *range(n)])) for g, n in (("a", 5), ("b", 50), (None, 9)) for _ in range(41)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(x["g"], x["case"]): x["value"] for x in models.partition_cases(df, "v", by=["g"]).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        q = [v[0], *(v[max(0, -(-len(v) * k // 4) - 1)] for k in (1, 2, 3)), v[-1]]
        assert [got[g, f"quarter-{k + 1}"] for k in range(4)] == [(q[k] + q[k + 1]) / 2 for k in range(4)]
    assert got["empty", "quarter-1"] is None and got["empty", "mean"] is None
    plan = models.partition_cases(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()


def test_branches_store_the_edges_once(spark):
    edges, nodes = frames(spark, [("a", "b"), ("c", "d"), ("e", "f")], "abcdef")
    columns = []

    def cut(df):
        columns.append(tuple(df.columns))
        return df.localCheckpoint()

    got = {tuple(r) for r in planning.parallel_branches(edges, nodes, cut).collect()}
    assert got == {(0, x) for x in "acdef"} and columns.count(("source", "target")) == 1


def test_searches_hold_a_bounded_part_of_the_steps(spark, monkeypatch):
    from tessera.sources import stored

    edges = spark.range(3000).selectExpr("concat('a', id % 300) AS source", "concat('b', id % 7) AS target", "'calls' AS type")
    monkeypatch.setattr(graph, "STEPS_OF_TASK", 500)
    steps = graph.by_source(graph.both_ways(edges))
    assert steps.rdd.getNumPartitions() == 12 and steps.count() == 6000
    start = spark.createDataFrame([("a1", "a1")], "origin string, id string")
    found = {r["id"]: r["distance"] for r in graph.reach(graph.both_ways(edges.unionByName(edges)), start).collect()}
    plain, frontier, near = {"a1": 0}, {"a1"}, {}
    for r in edges.distinct().collect():
        near.setdefault(r["source"], set()).add(r["target"])
        near.setdefault(r["target"], set()).add(r["source"])
    while frontier:
        frontier = {y for x in frontier for y in near[x]} - set(plain)
        plain |= dict.fromkeys(frontier, max(plain.values()) + 1)
    assert found == plain
    monkeypatch.setattr(stored, "STEPS_OF_BUCKET", 200)
    rows = spark.table(stored.store_adjacency(graph.both_ways(edges.unionByName(edges))))
    assert rows.count() == rows.distinct().count() == sum(map(len, near.values()))
    assert len({r[0] for r in rows.selectExpr("input_file_name()").collect()}) > 16


def unbroadcast(spark):
    """Joins of small test data planned as those of large tables; gives the settings before."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    return before


def restore(spark, before):
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_round_does_not_shuffle_the_steps_again(spark, monkeypatch):
    edges = spark.range(3000).selectExpr("concat('a', id % 300) AS source", "concat('b', id % 7) AS target", "'calls' AS type")
    monkeypatch.setattr(graph, "STEPS_OF_TASK", 100)
    adaptive, before = spark.conf.get("spark.sql.adaptive.enabled"), unbroadcast(spark)
    try:
        steps = graph.by_source(graph.both_ways(edges))
        assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
        frontier = spark.range(300).selectExpr("concat('a', id) AS id")
        met = frontier.join(steps, frontier["id"] == steps["source"])
        # One task for each of those that the steps are stored in, not for each of the session's.
        assert met.rdd.getNumPartitions() == steps.rdd.getNumPartitions() == 60
        assert met.count() == 3000
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(source" not in plan
    finally:
        restore(spark, before)


def test_items_meet_their_orders_in_bounded_tasks(spark, monkeypatch):
    import re

    from tessera.plans import roles

    sf_dir = "/root/testdata/sf0.001"
    want = {tuple(r) for r in roles.edges(spark, sf_dir).collect()}
    monkeypatch.setattr(roles, "ITEMS_OF_TASK", 500)
    before = unbroadcast(spark)
    try:
        found = roles.edges(spark, sf_dir)
        tasks = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)
        plan = found._jdf.queryExecution().executedPlan().toString()
        for key in ("l_orderkey", "o_orderkey"):
            assert {int(n) for n in re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\)", plan)} == {tasks}
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(want) and set(rows) == want
    finally:
        restore(spark, before)
