"""Operators without an SQL twin, and edge cases: brute force, round trips, invariants."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import catalog, compare, graph, mining, models, quality, telemetry, traces
from tessera.operators.components import connected_components
from tessera.sources import exports, schema


def edges_of(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "source string, target string, type string")


def nodes_of(spark, ids):
    return spark.createDataFrame([(i, "rule", i, 1.0) for i in ids], "id string, type string, name string, confidence double")


def random_graph(seed, n=30, m=45):
    r = random.Random(seed)
    ids = [f"n{k:02d}" for k in range(n)]
    return ids, sorted({(r.choice(ids), r.choice(ids)) for _ in range(m)})


def test_components_equal_union_find(spark):
    for seed in (1, 2):
        ids, pairs = random_graph(seed, 40, 30)
        root = {i: i for i in ids}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        got = dict(map(tuple, graph.components(edges_of(spark, pairs), nodes_of(spark, ids)).collect()))
        assert got == {i: find(i) for i in ids}


def test_components_of_a_long_chain_and_nulls(spark):
    chain = [(k, k + 1) for k in range(200)] + [(None, 500), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(201)} | {500: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_betweenness_equals_brandes(spark):
    ids, pairs = random_graph(3)
    near = {i: set() for i in ids}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    total = dict.fromkeys(ids, 0.0)
    for s in sorted(ids)[:50]:
        order, ways, dist, before = [], {s: 1.0}, {s: 0}, {}
        queue = [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] = ways.get(w, 0) + ways[v]
                    before.setdefault(w, []).append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                share[v] += ways[v] / ways[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    top = max(total.values())
    got = dict(map(tuple, graph.betweenness(edges_of(spark, pairs), nodes_of(spark, ids)).collect()))
    assert all(abs(got[i] - total[i] / top) < 1e-9 for i in ids)


def test_levels_leave_cycles_null(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")]
    got = dict(map(tuple, graph.longest_levels(edges_of(spark, pairs), nodes_of(spark, "abcxyz")).collect()))
    assert got == {"c": 0, "b": 1, "a": 2, "x": None, "y": None, "z": None}


def test_traversal_limits_and_invariants(spark):
    ids, pairs = random_graph(4)
    e, start = edges_of(spark, pairs), spark.createDataFrame([("n00", "n00")], "origin string, id string")
    near = {r["id"] for r in graph.reach(e, start, 2).collect()}
    far = {r["id"] for r in graph.reach(e, start, 3).collect()}
    everything = {r["id"] for r in graph.reach(e, start).collect()}
    assert near <= far <= everything
    assert all(len(set(r["path"])) == len(r["path"]) for r in graph.simple_paths(e, "n00", "n05").collect())
    assert sum(r["rank"] for r in graph.pagerank(e, nodes_of(spark, ids), 5).collect()) <= 1.0 + 1e-9


def test_copybook(spark):
    text = """
       01 REC.
          05 ID PIC 9(4).
          05 AMOUNT PIC S9(5)V99 COMP-3.
          05 NAMES OCCURS 2.
             10 FIRST-NAME PIC X(3).
             10 LAST-NAME PIC X(5).
          05 WHOLE REDEFINES NAMES PIC X(16).
          05 COUNTER PIC S9(9) COMP.
    """
    fields = {f.name: f for f in schema.parse_copybook(text)}
    assert [(f.start, f.length) for f in (fields["ID"], fields["AMOUNT"], fields["NAMES"], fields["WHOLE"], fields["COUNTER"])] == [(1, 4), (5, 4), (9, 8), (9, 16), (25, 4)]
    assert fields["AMOUNT"].kind == "decimal" and fields["AMOUNT"].scale == 2 and fields["REC"].length == 28 and fields["NAMES"].occurs == 2


def test_dbd_and_cluster():
    segments = schema.parse_dbd("DBD NAME=X\n SEGM NAME=CUST,PARENT=0,BYTES=100\n FIELD NAME=(CUSTNO,SEQ,U),BYTES=8,START=1,TYPE=C\n SEGM NAME=ORD,PARENT=CUST,BYTES=50\n FIELD NAME=QTY,BYTES=4,START=9,TYPE=P")
    assert [s["primary_key"] for s in segments] == [["CUSTNO"], []] and segments[1]["foreign_key"] == "cust_id"
    c = schema.parse_cluster("DEFINE CLUSTER (NAME(A.B) INDEXED KEYS(8 0) RECORDSIZE(80 120))")
    assert (c["kind"], c["columns"]) == ("KSDS", [("record_key", "char(8)"), ("record", "varchar(120)")])
    assert schema.parse_cluster("DEFINE CLUSTER (NAME(X) NUMBERED RECORDSIZE(10 10))")["columns"][0] == ("rrn", "bigint")


def test_numbers_of_legacy_fields(spark):
    rows = [(bytes.fromhex(h), t) for h, t in (("12345C", "12345"), ("00012D", "-12"), ("1A3C", None), ("", None))]
    df = spark.createDataFrame(rows, "raw binary, want string")
    assert [(None if r[0] is None else str(r[0])) for r in df.select(scalar.unpack_decimal(F.col("raw"))).collect()] == [t for _, t in rows]
    z = spark.createDataFrame([("12C",), ("12L",), ("123",), ("xx",)], "t string").select(scalar.zoned_decimal(F.col("t"), 1).cast("double")).collect()
    assert [r[0] for r in z] == [12.3, -12.3, 12.3, None]
    b = spark.createDataFrame([(bytearray((-5).to_bytes(4, "big", signed=True)),), (bytearray((70000).to_bytes(4, "big")),)], "raw binary").select(scalar.binary_number(F.col("raw"))).collect()
    assert [int(r[0]) for r in b] == [-5, 70000]
    t = spark.createDataFrame([(bytearray("HELLO 1".encode("cp037")),), (None,)], "raw binary").select(scalar.ebcdic_text(F.col("raw"))).collect()
    assert [r[0] for r in t] == ["HELLO 1", None]
    p = spark.createDataFrame([(Decimal(-1234567),), (Decimal(0),)], "n decimal(9,0)")
    assert [int(r[0]) for r in p.select(scalar.unpack_decimal(scalar.pack_decimal(F.col("n"), 9))).collect()] == [-1234567, 0]


def test_java_hash(spark):
    texts = ["", "abc", "Customer#000000001", "zzzzzzzzzzzzzzzz"]

    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(telemetry.java_hash(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]


def test_compare_details(spark):
    df = spark.createDataFrame([(float("nan"), float("nan")), (1.0, 1.00005), (1.0, 1.5), (1.0, 9.0), (None, 1.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(compare.numeric_severity(F.col("a"), F.col("b"))).collect()] == [None, None, "warning", "critical", "critical", None]
    a = spark.createDataFrame([([1, 2], [1, 2]), ([1, 2], [1, 3]), ([1], [1, 2])], "a array<int>, b array<int>")
    assert [r[0] for r in a.select(compare.array_difference(F.col("a"), F.col("b"))).collect()] == [-1, 1, -2]
    j = spark.createDataFrame([(1, '{"a": {"b": 1, "c": {"d": "x"}}, "e": null}')], "k int, j string")
    assert {(r["path"], r["value"]) for r in compare.leaves(j, "k", "j").collect()} == {("$.a.b", "1"), ("$.a.c.d", "x"), ("$.e", None)}
    same = spark.createDataFrame([(1, 2.0, "x")], "k int, n double, t string")
    assert compare.keyed_diff(same, same, ["k"], ["n"], ["t"]).collect() == []


def test_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], "id int, name string")
    assert quality.column_profile(empty).collect()[0]["total"] == 0
    assert quality.orphan_count(empty, "id", empty, "id").first()[0] == 0
    assert quality.checksum(empty, [F.col("id")]).first()["rows"] == 0
    assert graph.density(edges_of(spark, []), nodes_of(spark, [])).first()["density"] == 0.0
    assert models.linear_fit(spark.createDataFrame([], "x double, y double"), "x", "y").collect() in ([], [(None, None, None)])
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert constant.agg(traces.guarded_corr("x", "y")).first()[0] is None
    assert catalog.revenue_summary(spark.createDataFrame([("refund", True, 5.0)], "kind string, completed boolean, amount double")).first()["average"] is None


def test_ebcdic_exports_and_rules(spark):
    n, e = nodes_of(spark, ["a<b"]), edges_of(spark, [("a<b", "c")])
    for kind in ("dot", "mermaid", "graphml", "gexf", "json", "csv"):
        lines = [r["line"] for r in exports.graph_lines(n, e, kind).orderBy("part", "line").collect()]
        assert len(lines) == 4
        assert ("&lt;" in lines[1]) == (kind in ("graphml", "gexf"))
    df = spark.createDataFrame([(1, 'a,"b"\nc')], "k int, t string")
    assert df.select(exports.csv_line(F.col("k"), F.col("t"))).first()[0] == '1,"a,""b""\nc"'
    assert df.where(mining.compile_condition({"not": {"field": "k", "operator": "greater_or_equal", "value": 2}})).count() == 1


def test_depth_never_negative(spark):
    rows = [(1, k, t) for k, t in enumerate("xxexxeee", 1)]
    df = spark.createDataFrame(rows, "session_id int, seq int, type string")
    got = [r["depth"] for r in traces.call_depth(df, ["e"], ["x"]).orderBy("seq").collect()]
    depth, want = 0, []
    for _, _, t in rows:
        depth = max(0, depth + (1 if t == "e" else -1))
        want.append(depth)
    assert got == want


def test_boundary_and_random_cases_repeat(spark):
    s = spark.createDataFrame([("x", 1.0, 3.0, 2.0, 0.5)], "name string, low double, high double, mean double, stddev double")
    a, b = (sorted(map(tuple, models.random_cases(df, 50, 9).collect())) for df in (s, s.repartition(3)))
    assert a == b and all(1.0 <= v <= 3.0 for _, _, v in a)


def test_passages_by_word_equal_broadcast(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox jumps"), (2, "quick brown"), (3, None), (4, "a b"), (5, "the quick\nbrown fox jumps")], "k int, t string")
    passages = spark.createDataFrame([(1, "he quick brown fo"), (2, "a b"), (3, "no such passage here")], "p int, passage string")
    got = [sorted((r["k"], r["p"]) for r in catalog.containing(docs, passages, "t", "passage", most).collect()) for most in (2000, 1)]
    assert got[0] == got[1] == [(1, 1), (4, 2)]


def test_five_node_graph(spark):
    nodes = spark.createDataFrame([("prog", "program"), ("main", "procedure"), ("calc", "procedure"), ("rule", "rule"), ("data", "data")], "id string, type string").withColumns({"name": F.upper("id"), "confidence": F.lit(1.0)})
    edges = spark.createDataFrame([("prog", "main", "contains"), ("prog", "calc", "contains"), ("calc", "data", "uses"), ("calc", "rule", "implements")], "source string, target string, type string")
    start = lambda i: spark.createDataFrame([(i, i)], "origin string, id string")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(graph.impact(edges, start("calc"))) == {"calc", "data", "rule"}
    assert ids(graph.impact(edges, start("data"))) == {"data", "calc", "rule"}
    assert ids(graph.subgraph(edges, nodes, start("main"), 1)) == {"main", "prog"}
    assert ids(graph.subgraph(edges, nodes, start("main"), 2)) == {"main", "prog", "calc"}
    assert ids(graph.subgraph(edges, nodes, start("main"), 3, node_types=("procedure",))) == {"main", "prog"}
    assert [r["path"] for r in graph.simple_paths(edges, "prog", "data").collect()] == [["prog", "calc", "data"]]
    assert graph.density(edges, nodes).first()["density"] == 4 / 20
    assert {r["id"]: r["degree"] for r in graph.degrees(edges, nodes).collect()} == {"prog": 2, "main": 1, "calc": 3, "rule": 1, "data": 1}
    assert graph.components(edges, nodes).select("component").distinct().count() == 1
    out = graph.run_query(nodes, edges, {"type": "nodes", "types": ("procedure",), "limit": 1})
    assert ids(out["nodes"]) == {"calc"} and out["found"].first()["found"] == 2
    assert graph.simple_cycles(edges).count() == 0 and graph.clustering(edges).first()["clustering"] == 0.0


def test_parsers_of_each_language(spark):
    from tessera.sources import parsers

    samples = {
        "cobol": [("       PROGRAM-ID. LOANPROC.", "program", "LOANPROC"), ("           PERFORM CALC-INT", "perform", "CALC-INT"), ("           COPY CUSTREC.", "copy", "CUSTREC"), ("           COMPUTE X = 1", None, None)],
        "fortran": [("      SUBROUTINE INTRST(P, R)", "subroutine", "INTRST"), ("      CALL ROUND2(X)", "call", "ROUND2"), ("      REAL RATE", "data", "RATE")],
        "vb6": [("Public Function Total(x As Double)", "function", "Total"), ("Private Sub Form_Load()", "sub", "Form_Load"), ("Dim tax As Currency", "data", "tax")],
        "java": [("public class Invoice {", "class", "Invoice"), ("  public double total(int n) {", "method", "total"), ("import java.util.List;", "import", "java.util.List")],
        "rpg": [("     FCUSTFILE  IF   E", "file", "CUSTFILE"), ("       dcl-proc calcTax;", "procedure", "calcTax"), ("       dcl-s total packed(9:2);", "data", "total")],
        "pli": [("PAYROLL: PROC OPTIONS(MAIN);", "procedure", "PAYROLL"), ("  CALL PRINTIT;", "call", "PRINTIT"), ("  DCL RATE FIXED DEC(5,2);", "data", "RATE")],
        "natural": [("DEFINE SUBROUTINE CALC-TAX", "subroutine", "CALC-TAX"), ("CALLNAT 'SUBPROG' #A", "call", "SUBPROG"), ("1 #AMOUNT (N9.2)", "data", "AMOUNT")],
        "hlasm": [("MAINPGM  CSECT", "section", "MAINPGM"), ("         CALL SUBR", "call", "SUBR"), ("WORK     DS    F", "data", "WORK")],
        "cics": [("EXEC CICS LINK PROGRAM('SUB1') END-EXEC", "command", "LINK"), ("    FILE('CUSTF')", "file", "CUSTF")],
    }
    for language, rows in samples.items():
        df = spark.createDataFrame([(k, line) for k, (line, _, _) in enumerate(rows)], "line_no int, line string")
        got = [(r["kind"], r["name"]) for r in parsers.parse_units(df, language).orderBy("line_no").collect()]
        assert got == [(k, n) for _, k, n in rows if k], language
