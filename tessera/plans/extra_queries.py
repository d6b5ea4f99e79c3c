"""Queries that dispatch, bundle, parse or plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators import models as m
from tessera.operators import quality as q
from tessera.operators import telemetry as o
from tessera.operators import traces as t
from tessera.plans.model_queries import UNIT
from tessera.plans.registry import query
from tessera.plans.graph_queries import DEGREES, FAR, LEVELS, LPA, MEASURES, UNDIRECTED, at, levels
from tessera.plans.roles import edges, nodes, runs, tree_edges, with_roles
from tessera.plans.source_queries import GIVEN, LEVELS_SQL, PICTURES, STEPS, catalog, pictures, profile, sizes
from tessera.session import table
from tessera.sources import parsers, schema

GRAPH, TREE = with_roles("nodes", "edges"), with_roles("nodes", "tree")
GRAPH_R, TREE_R = with_roles("nodes", "edges", recursive=True), with_roles("nodes", "tree", recursive=True)


@query("G6_dispatcher", GRAPH_R + ", st AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), w AS (SELECT 'n:3' AS id, 0 AS d UNION SELECT st.target, d + 1 FROM w JOIN st ON st.source = w.id WHERE d < 2) SELECT id, type FROM nodes WHERE id IN (SELECT id FROM w) ORDER BY id LIMIT 25")
def dispatcher(spark, sf):
    out = g.run_query(nodes(spark, sf), edges(spark, sf), {"type": "subgraph", "source": "n:3", "depth": 2, "limit": 25})
    return out["nodes"].select("id", "type")


@query("G22_grid_layout", GRAPH + ", k AS (SELECT id, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS k FROM nodes) SELECT id, (k % 10 * 100)::DOUBLE AS x, (k // 10 * 100)::DOUBLE AS y FROM k")
def grid(spark, sf):
    return g.layout(nodes(spark, sf), "grid")


@query("G22_circular_layout", GRAPH + ", k AS (SELECT id, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY type) AS n FROM nodes) SELECT id, round(cos(2 * pi() * k / n) * 100, 4) + 0.0 AS x, round(sin(2 * pi() * k / n) * 100, 4) + 0.0 AS y FROM k")
def circle(spark, sf):
    return g.layout(nodes(spark, sf), "circular").select("id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


RANKED = "k AS (SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY level) AS n FROM {lev})"


@query("G22_hierarchical_layout", GRAPH_R + LEVELS + ", " + RANKED.format(lev="lev") + " SELECT id, (k * 100)::DOUBLE AS x, (level * 100)::DOUBLE AS y FROM k")
def hierarchy(spark, sf):
    return g.layout(nodes(spark, sf), "hierarchical", levels=levels(spark, sf))


@query("G22_radial_layout", GRAPH_R + UNDIRECTED + ", w AS (SELECT 'r:0' AS id, 0 AS d UNION SELECT u.target, d + 1 FROM w JOIN u ON u.source = w.id WHERE d < 5), m AS (SELECT id, min(d) AS level FROM w GROUP BY 1), " + RANKED.format(lev="m") + " SELECT id, round(cos(2 * pi() * k / n) * 100 * level, 4) + 0.0 AS x, round(sin(2 * pi() * k / n) * 100 * level, 4) + 0.0 AS y FROM k")
def radial(spark, sf):
    rings = g.reach(g.both_ways(edges(spark, sf)), at(spark, "r:0")).select("id", F.col("distance").alias("level"))
    return g.layout(nodes(spark, sf), "radial", levels=rings).select("id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


def force_round(k, rounds, grid=8):
    """One round of forces as SQL, from p{k} to p{k+1}."""
    a, top = f"{1 - k / rounds!r}::DOUBLE", grid - 1
    place = lambda c: f"least({top}, floor(coalesce(({c} - {c}0) * {grid} / nullif({c}1 - {c}0, 0), 0)))::INT"
    return f"""bx{k} AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p{k}), h{k} AS MATERIALIZED (SELECT id, x, y, vx, vy, {place('x')} * {grid} + {place('y')} AS cell FROM p{k}, bx{k}),
c{k} AS MATERIALIZED (SELECT cell, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM h{k} GROUP BY 1), q{k} AS (SELECT h.id, h.x, h.y, h.vx, h.vy, c.n - (c.cell = h.cell)::INT AS n, (c.sx - CASE WHEN c.cell = h.cell THEN h.x ELSE 0 END) AS sx, (c.sy - CASE WHEN c.cell = h.cell THEN h.y ELSE 0 END) AS sy FROM h{k} h, c{k} c),
d{k} AS (SELECT *, sx / n - x AS dx, sy / n - y AS dy FROM q{k} WHERE n > 0), r{k} AS MATERIALIZED (SELECT id, sum(-dx / l * 100 * {a} / (l * l) * n) AS fx, sum(-dy / l * 100 * {a} / (l * l) * n) AS fy FROM (SELECT *, coalesce(nullif(sqrt(dx * dx + dy * dy), 0), 1) AS l FROM d{k}) GROUP BY 1),
e{k} AS (SELECT source, target, b.x - a.x AS dx, b.y - a.y AS dy, coalesce(nullif(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 0), 1) AS l FROM edges JOIN p{k} a ON a.id = source JOIN p{k} b ON b.id = target),
g{k} AS MATERIALIZED (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT source AS id, dx * (l - 150) / l * {a} * 0.5 AS fx, dy * (l - 150) / l * {a} * 0.5 AS fy FROM e{k} UNION ALL SELECT target, -dx * (l - 150) / l * {a} * 0.5, -dy * (l - 150) / l * {a} * 0.5 FROM e{k}) GROUP BY 1),
s{k} AS (SELECT p.id, p.x, p.y, p.vx + coalesce(r.fx, 0) + coalesce(g.fx, 0) - p.x * 0.1 * {a} AS vx, p.vy + coalesce(r.fy, 0) + coalesce(g.fy, 0) - p.y * 0.1 * {a} AS vy FROM p{k} p LEFT JOIN r{k} r USING (id) LEFT JOIN g{k} g USING (id)),
p{k + 1} AS MATERIALIZED (SELECT id, x + vx AS x, y + vy AS y, vx * 0.6::DOUBLE AS vx, vy * 0.6::DOUBLE AS vy FROM s{k})"""


FORCE = TREE + ", p0 AS (SELECT id, cos(2 * pi() * k / n) * sqrt(n) * 50 AS x, sin(2 * pi() * k / n) * sqrt(n) * 50 AS y, 0::DOUBLE AS vx, 0::DOUBLE AS vy FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM nodes)), " + ", ".join(force_round(k, 3) for k in range(3))


@query("G22_force_layout", FORCE + " SELECT id, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y FROM p3")
def force(spark, sf):
    found = g.force_layout(nodes(spark, sf), tree_edges(spark, sf), iterations=3, grid=8)
    return found.select("id", (F.round("x", 2) + 0.0).alias("x"), (F.round("y", 2) + 0.0).alias("y"))


@query("A21_full_analysis", GRAPH_R + FAR + DEGREES + LPA.removeprefix(UNDIRECTED) + MEASURES + """, ek AS (SELECT id, count(*) AS k FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1), m2 AS (SELECT count(*) * 2.0::DOUBLE AS m2 FROM edges),
cs AS (SELECT label, count(*) AS size FROM l10 GROUP BY 1), cx AS (SELECT la AS label, (la = lb)::INT AS inner_ FROM e2 UNION ALL SELECT lb, 0 FROM e2 WHERE la <> lb), cc AS (SELECT label, sum(inner_) AS internal, sum(1 - inner_) AS external FROM cx GROUP BY 1),
co AS (SELECT CASE WHEN size > 1 THEN coalesce(internal, 0) * 2.0::DOUBLE / (size * (size - 1)) ELSE 0 END AS cohesion, coalesce(external / (internal + external)::DOUBLE, 0) AS coupling FROM cs LEFT JOIN cc USING (label)),
cw AS (SELECT target AS id, source AS dep FROM edges UNION SELECT cw.id, e.source FROM cw JOIN edges e ON e.target = cw.dep), dep AS (SELECT n.id, count(cw.dep) AS dependents FROM nodes n LEFT JOIN cw ON cw.id = n.id GROUP BY n.id), lab AS (SELECT id, id AS label FROM nodes UNION SELECT u.target, lab.label FROM lab JOIN u ON u.source = lab.id WHERE lab.label < u.target), comp AS (SELECT id, min(label) AS c FROM lab GROUP BY id),
k AS (SELECT source, count(*) AS k FROM u GROUP BY 1 HAVING count(*) >= 2), t AS (SELECT a.source, count(*) AS t FROM u a JOIN u b ON a.source = b.source AND a.target < b.target JOIN u c ON c.source = a.target AND c.target = b.target GROUP BY 1),
risk AS (SELECT id FROM nodes JOIN deg USING (id) WHERE (degree > 10)::INT * 3 + (confidence < 0.5)::INT * 3 + (type = 'supplier' AND in_degree > 5)::INT * 2 + (out_degree = 0 AND in_degree > 3)::INT * 2 > 3 LIMIT 20),
b AS (SELECT * FROM deg WHERE in_degree > 3 AND in_degree > 1.5 * out_degree), p AS (SELECT DISTINCT source, target FROM edges), alt AS (SELECT a.source AS id, count(DISTINCT c.source) AS n FROM p a JOIN p c ON a.target = c.target AND a.source <> c.source WHERE a.source IN (SELECT id FROM b) GROUP BY 1),
neck AS (SELECT id FROM b LEFT JOIN alt USING (id) WHERE 1.0 / (coalesce(n, 0) + 1) > 0.3 LIMIT 10), v AS (
SELECT 'nodes' AS measure, (SELECT count(*) FROM nodes)::DOUBLE AS value UNION ALL SELECT 'edges', (SELECT count(*) FROM edges) UNION ALL SELECT 'density', (SELECT count(*) FROM edges) / (SELECT count(*) * (count(*) - 1) FROM nodes)::DOUBLE
UNION ALL SELECT 'mean_degree', avg(degree) FROM deg UNION ALL SELECT 'max_degree', max(degree) FROM deg UNION ALL SELECT 'components', count(DISTINCT c) FROM comp UNION ALL SELECT 'diameter', max(d) FROM m WHERE d > 0 UNION ALL SELECT 'mean_length', avg(d) FROM m WHERE d > 0
UNION ALL SELECT 'clustering', avg(coalesce(t.t, 0) * 2.0::DOUBLE / (k.k * (k.k - 1))) FROM k LEFT JOIN t USING (source) UNION ALL SELECT 'high_risk', count(*) FROM risk UNION ALL SELECT 'bottlenecks', count(*) FROM neck
UNION ALL SELECT 'orphans', count(*) FROM deg WHERE degree = 0 UNION ALL SELECT 'cycles', 0
UNION ALL SELECT 'modularity', (sum(CASE WHEN la = lb THEN 1.0::DOUBLE ELSE 0 END) - sum((a.k * b.k)::DOUBLE) / max(m2)) / max(m2) FROM e2 JOIN ek a ON e2.source = a.id JOIN ek b ON e2.target = b.id CROSS JOIN m2
UNION ALL SELECT 'communities', count(*) FROM co UNION ALL SELECT 'mean_cohesion', avg(cohesion) FROM co UNION ALL SELECT 'mean_coupling', avg(coupling) FROM co UNION ALL SELECT 'critical_nodes', least(10, count(*)) FROM nodes
UNION ALL SELECT 'single_points', least(10, count(*)) FROM dep JOIN deg USING (id) WHERE dependents > 0.1 * (SELECT count(*) FROM nodes) AND out_degree <= 2) SELECT measure, round(value, 8) AS value FROM v""")
def bundle(spark, sf):
    return g.structure(edges(spark, sf), nodes(spark, sf), "supplier").withColumn("value", F.round("value", 8))


#: Bytes that a column of a kind takes.
WIDTHS = {"bigint": 8, "int": 4, "double": 8, "timestamp": 8, "string": 30}
WIDTH_SQL = "CASE data_type WHEN 'BIGINT' THEN 8 WHEN 'INTEGER' THEN 4 WHEN 'DOUBLE' THEN 8 WHEN 'TIMESTAMP' THEN 8 ELSE 30 END"
HIERARCHY = (("region", "0"), ("nation", "REGION"), ("customer", "NATION"), ("orders", "CUSTOMER"))


def widths(spark, sf, names):
    """{table: [(column, bytes)]} of given tables, from Spark's profile of them: a row for each column."""
    out = {}
    for r in sorted(profile(spark, sf, names).collect(), key=lambda r: r["ordinal"]):
        out.setdefault(r["table_name"], []).append((r["column_name"].upper(), WIDTHS[r["data_type"]]))
    return out


@query("E5_segments", "WITH h(t, parent) AS (VALUES " + ", ".join(f"('{t}', {'NULL' if parent == '0' else repr(parent)})" for t, parent in HIERARCHY) + f"""), c AS (SELECT table_name AS t, sum({WIDTH_SQL})::INT AS bytes, upper(min_by(column_name, ordinal_position)) AS first FROM information_schema.columns GROUP BY 1)
SELECT upper(t) AS name, parent, bytes, CASE WHEN parent IS NULL THEN first ELSE '' END AS primary_key, lower(parent) || '_id' AS foreign_key FROM h JOIN c USING (t)""")
def segments(spark, sf):
    """A hierarchical definition of the given tables, from their schemas."""
    text, of = "DBD NAME=TRADE\n", widths(spark, sf, [name for name, _ in HIERARCHY])
    for name, parent in HIERARCHY:
        columns, start = of[name], 1
        text += f" SEGM NAME={name.upper()},PARENT={parent},BYTES={sum(w for _, w in columns)}\n"
        for k, (column, width) in enumerate(columns):
            text += f" FIELD NAME={f'({column},SEQ,U)' if k == 0 else column},BYTES={width},START={start},TYPE=C\n"
            start += width
    rows = [(s["name"], s["parent"], s["bytes"], ",".join(s["primary_key"]), s["foreign_key"]) for s in schema.parse_dbd(text)]
    return spark.createDataFrame(rows, "name string, parent string, bytes int, primary_key string, foreign_key string")


@query("E6_cluster_tables", "WITH c AS (SELECT table_name AS t, sum(" + WIDTH_SQL + ") AS bytes, min_by(" + WIDTH_SQL + ", ordinal_position) AS key FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in GIVEN) + """) GROUP BY 1)
SELECT 'T.' || upper(t) AS name, CASE t WHEN 'lineitem' THEN 'RRDS' ELSE 'KSDS' END AS kind, unnest([CASE t WHEN 'lineitem' THEN 'rrn' ELSE 'record_key' END, 'record']) AS column_name, unnest([CASE t WHEN 'lineitem' THEN 'bigint' ELSE 'char(' || key || ')' END, 'varchar(' || bytes || ')']) AS column_type FROM c""")
def clusters(spark, sf):
    """Cluster definitions of the given tables, from their schemas; items are numbered records."""
    rows, of = [], widths(spark, sf, GIVEN)
    for name in GIVEN:
        columns = of[name]
        size = sum(w for _, w in columns)
        keys = "NUMBERED" if name == "lineitem" else f"INDEXED KEYS({columns[0][1]} 0)"
        c = schema.parse_cluster(f"DEFINE CLUSTER (NAME(T.{name.upper()}) {keys} RECORDSIZE({size} {size}))")
        rows += [(c["name"], c["kind"], *column) for column in c["columns"]]
    return spark.createDataFrame(rows, "name string, kind string, column_name string, column_type string")


@query("E16_etl_run", "SELECT c_mktsegment AS segment, count(*) AS n, sum(trunc(c_acctbal)::BIGINT)::BIGINT AS balance FROM customer WHERE trunc(c_acctbal)::INT > 0 GROUP BY 1")
def etl_run(spark, sf):
    done = schema.transform(table(spark, sf, "customer"), STEPS)
    return done.groupBy(F.substring_index("tag", "-", 1).alias("segment")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@query("E17_plan", LEVELS_SQL + """, n AS (SELECT count(*) AS columns, count(DISTINCT table_name) AS tables FROM cat), r AS (SELECT count(*) AS n FROM rel)
SELECT 'relations' AS part, n AS rows FROM r UNION ALL SELECT 'tables', tables FROM n UNION ALL SELECT 'estimate', 1 UNION ALL SELECT 'target', columns + 1 FROM n UNION ALL SELECT 'statements', tables + 2 * r.n FROM n, r UNION ALL SELECT 'phases', tables FROM n UNION ALL SELECT 'checks', tables + tables - 1 + r.n FROM n, r""")
def plan(spark, sf):
    parts = schema.migration_plan(catalog(spark, sf), sizes(spark, sf), "postgresql")
    return q.union_all([df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("part"), "rows") for k, df in parts.items()])


@query("E17_phases", LEVELS_SQL + " SELECT id AS table_name, level + 1 AS phase FROM lev")
def phases(spark, sf):
    return schema.migration_plan(catalog(spark, sf), sizes(spark, sf), "postgresql")["phases"]


@query("M24_jcl_steps", "SELECT o_custkey AS file, o_orderkey * 2 + 1 AS line_no, 'J' || o_orderkey AS job, 'STEP1' AS step, 'PGM' || o_orderstatus AS program FROM orders")
def jcl(spark, sf):
    k = F.col("o_orderkey")
    both = F.array(F.struct((k * 2).alias("line_no"), F.concat(F.lit("//J"), k.cast("string"), F.lit(" JOB CLASS=A")).alias("line")), F.struct((k * 2 + 1).alias("line_no"), F.concat(F.lit("//STEP1 EXEC PGM=PGM"), "o_orderstatus").alias("line")))
    lines = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.explode(both).alias("x")).select("file", "x.*")
    return parsers.jcl_steps(lines)


@query("M25_rule_cases", with_roles("runs") + ", s AS (SELECT flag AS name, min(quantity)::DOUBLE AS lo, max(quantity)::DOUBLE AS hi FROM runs GROUP BY 1) SELECT name, count(*) AS n, round(sum(v), 4)::DOUBLE AS total FROM (SELECT name, unnest([lo, lo - 0.001, hi, hi + 0.001, 0, -1, hi * 1.1]) AS v FROM s) GROUP BY 1")
def rule_cases(spark, sf):
    signature = runs(spark, sf).groupBy(F.col("flag").alias("name")).agg(F.min("quantity").cast("double").alias("low"), F.max("quantity").cast("double").alias("high"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("stddev"))
    cases = m.boundary_cases(signature).where("case NOT LIKE 'mean%'")
    return cases.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("O2_sampling", "SELECT user_id, count(*) AS n FROM events WHERE " + UNIT.format("user_id::VARCHAR") + " < 0.25 GROUP BY 1")
def sampling(spark, sf):
    return t.sampled(table(spark, sf, "events"), "user_id", 0.25).groupBy("user_id").agg(F.count("*").alias("n"))


@query("P18_sequential_reads", "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS read_no, '00' AS status FROM orders UNION ALL SELECT o_custkey, count(*) + 1, '10' FROM orders GROUP BY 1")
def sequential(spark, sf):
    return parsers.sequential_reads(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


# Events as a program over files: a user's file is opened, read, written and closed by what they do; it holds what they ordered.
FILE_PROGRAM = """st AS (SELECT event_id AS step, user_id AS file, CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN CASE WHEN value > 40 THEN 'OPEN-OUTPUT' ELSE 'OPEN' END WHEN 'error' THEN 'CLOSE' WHEN 'purchase' THEN 'WRITE' ELSE 'READ-NEXT' END AS operation, event_id::VARCHAR AS data FROM events),
rc AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS record_no, o_orderstatus AS data FROM orders),
nx AS (SELECT file, list({'step': step, 'op': operation, 'd': data} ORDER BY step) AS ops FROM st GROUP BY 1), hd AS (SELECT file, list(data ORDER BY record_no) AS held FROM rc GROUP BY 1),
sim AS (SELECT file, ops, 0 AS k, coalesce(held, []) AS held, 0 AS pos, false AS is_open, NULL::VARCHAR AS status, NULL::VARCHAR AS data, NULL::VARCHAR AS operation, NULL::BIGINT AS step FROM nx LEFT JOIN hd USING (file)
UNION ALL SELECT file, ops, k + 1, CASE WHEN ops[k + 1].op = 'OPEN-OUTPUT' THEN [] WHEN is_open AND ops[k + 1].op = 'WRITE' THEN list_append(held, ops[k + 1].d) ELSE held END,
 CASE WHEN ops[k + 1].op LIKE 'OPEN%' THEN 0 WHEN is_open AND ops[k + 1].op LIKE 'READ%' AND pos < len(held) THEN pos + 1 ELSE pos END, CASE WHEN ops[k + 1].op LIKE 'OPEN%' THEN true WHEN ops[k + 1].op = 'CLOSE' THEN false ELSE is_open END,
 CASE WHEN ops[k + 1].op LIKE 'OPEN%' THEN '00' WHEN NOT is_open THEN '42' WHEN ops[k + 1].op LIKE 'READ%' AND pos >= len(held) THEN '10' ELSE '00' END, CASE WHEN is_open AND ops[k + 1].op LIKE 'READ%' AND pos < len(held) THEN held[pos + 1] END, ops[k + 1].op, ops[k + 1].step FROM sim WHERE k < len(ops))"""


@query("P18_file_program", f"WITH RECURSIVE {FILE_PROGRAM} SELECT step, file, operation, status, data FROM sim WHERE k > 0")
def file_program(spark, sf):
    kind = F.col("event_type")
    operation = F.when(kind == "view", "READ").when(kind == "click", F.when(F.col("value") > 40, "OPEN-OUTPUT").otherwise("OPEN")).when(kind == "error", "CLOSE").when(kind == "purchase", "WRITE").otherwise("READ-NEXT")
    steps = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("user_id").alias("file"), operation.alias("operation"), F.col("event_id").cast("string").alias("data"))
    held = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("record_no"), F.col("o_orderstatus").alias("data"))
    return parsers.file_program(steps, held)


@query("T5_normalized_events", "SELECT CASE event_type WHEN 'click' THEN 'external_call' WHEN 'view' THEN 'file_read' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'db_query' END AS type, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1")
def normalized_events(spark, sf):
    kinds = {"click": "call", "view": "READ", "error": "ABEND", "purchase": "exec-sql", "signup": "unheard-of"}
    kind = F.lit(None).cast("string")
    for name, raw in kinds.items():
        kind = F.when(F.col("event_type") == name, raw).otherwise(kind)
    return t.normalized(table(spark, sf, "events").withColumn("kind", kind), "cobol").groupBy("type").agg(F.count("*").alias("n"))


@query("F11_retry_delays", "SELECT event_id, round(least(100.0 * pow(2, event_id % 8), 5000.0))::BIGINT AS delay_ms, event_type IN ('error', 'view') AS retryable FROM events")
def retry_delays(spark, sf):
    return table(spark, sf, "events").select("event_id", o.retry_delay(F.col("event_id") % 8, 100, 2, 5000).alias("delay_ms"), o.retryable(F.col("event_type"), ["ERR", "^view$"]).alias("retryable"))


@query("I5_projects", "SELECT source AS project, count(*) AS files, count(DISTINCT substr(sha256(coalesce(text, '')), 1, 16)) AS unique_files, sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT AS lines FROM documents GROUP BY 1")
def projects(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").groupBy(F.col("source").alias("project")).agg(
        F.count("*").alias("files"), F.count_distinct(F.substring(F.sha2(text.cast("binary"), 256), 1, 16)).alias("unique_files"), F.sum(F.size(F.split(text, "\n"))).alias("lines"))


@query("I6_cobol_units", "SELECT kind, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'program' WHEN 1 THEN 'call' WHEN 2 THEN 'data' WHEN 3 THEN 'paragraph' END AS kind FROM part) WHERE kind IS NOT NULL GROUP BY 1")
def cobol_units(spark, sf):
    k, name = F.col("p_partkey") % 5, F.concat(F.lit("X-"), F.col("p_partkey").cast("string"))
    line = (
        F.when(k == 0, F.concat(F.lit("       PROGRAM-ID. "), name, F.lit("."))).when(k == 1, F.concat(F.lit("           CALL '"), name, F.lit("'.")))
        .when(k == 2, F.concat(F.lit("       05 "), name, F.lit(" PIC 9."))).when(k == 3, F.concat(name, F.lit("."))).otherwise("      * comment")
    )
    return parsers.parse_units(table(spark, sf, "part").select("p_partkey", line.alias("line")), "cobol").groupBy("kind").agg(F.count("*").alias("n"))


SOURCES = {
    "fortran": ("program", "      PROGRAM X{}", "call", "      CALL S{}"), "vb6": ("function", "Public Function F{}()", "data", "  Dim V{} As Integer"), "java": ("class", "public class C{} {{", "import", "import a.b{};"),
    "rpg": ("procedure", "  dcl-proc P{};", "data", "  dcl-s V{} int(10);"), "pli": ("procedure", " P{}: PROC OPTIONS(MAIN);", "call", "   CALL S{}(A);"), "natural": ("subroutine", "DEFINE SUBROUTINE S-{}", "call", "CALLNAT 'N{}'"),
    "hlasm": ("section", "S{} CSECT", "data", "D{} DS F"), "cics": ("command", "EXEC CICS LINK{} COMMAREA(A)", "file", "  FILE('F{}')"),
}
NAMES = {"fortran": ("X", "S"), "vb6": ("F", "V"), "java": ("C", "a.b"), "rpg": ("P", "V"), "pli": ("P", "S"), "natural": ("S-", "N"), "hlasm": ("S", "D"), "cics": ("LINK", "F")}


@query("I6_units", " UNION ALL ".join(f"SELECT '{k}' AS language, CASE s_suppkey % 2 WHEN 0 THEN '{a}' ELSE '{b}' END AS kind, CASE s_suppkey % 2 WHEN 0 THEN '{NAMES[k][0]}' ELSE '{NAMES[k][1]}' END || s_suppkey AS name FROM supplier" for k, (a, _, b, _) in SOURCES.items()))
def units(spark, sf):
    out, key = [], F.col("s_suppkey")
    for language, (_, a, _, b) in SOURCES.items():
        line = F.when(key % 2 == 0, F.replace(F.lit(a.replace("{{", "{")), F.lit("{}"), key.cast("string"))).otherwise(F.replace(F.lit(b), F.lit("{}"), key.cast("string")))
        out.append(parsers.parse_units(table(spark, sf, "supplier").select(line.alias("line")), language).select(F.lit(language).alias("language"), "kind", "name"))
    return q.union_all(out)


@query("I7_rule_document", "SELECT p_brand, '# ' || p_brand || chr(10) || string_agg('- ' || p_type || ': ' || n, chr(10) ORDER BY p_type) AS body FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY p_brand")
def rule_document(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("p_type", F.concat(F.lit("- "), "p_type", F.lit(": "), F.col("n").cast("string")).alias("line"))))
    return counts.groupBy("p_brand").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body")).select("p_brand", F.concat(F.lit("# "), "p_brand", F.lit("\n"), "body").alias("body"))


@query("F3_math", "SELECT p_partkey, round(sqrt(p_retailprice) + ln(p_size) + log10(p_size) + power(p_size, 2) - abs(-p_size) + sign(p_size) + ceil(p_retailprice) - floor(p_retailprice), 4) AS v FROM part")
def math(spark, sf):
    s, p = F.col("p_size"), F.col("p_retailprice")
    v = F.sqrt(p) + F.ln(s) + F.log10(s) + F.pow(s, F.lit(2)) - F.abs(-s) + F.signum(s) + F.ceil(p) - F.floor(p)
    return table(spark, sf, "part").select("p_partkey", F.round(v, 4).alias("v"))


@query("F5_dates", "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days, strftime(l_shipdate, '%Y%m%d') AS compact FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def dates(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", F.date_diff("l_shipdate", "o_orderdate").cast("long").alias("days"), F.date_format("l_shipdate", "yyyyMMdd").alias("compact"))


@query("F6_arrays", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'small', 'ring'])) AS common, list_contains(string_split(p_name, ' '), 'ring') AS ring, array_to_string(list_sort(string_split(p_name, ' ')), ',') AS sorted FROM part")
def arrays(spark, sf):
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(words, F.array(F.lit("red"), F.lit("small"), F.lit("ring")))).cast("long").alias("common"), F.array_contains(words, "ring").alias("ring"), F.array_join(F.array_sort(words), ",").alias("sorted"))


JAVA = "(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296))"


@query("F8_hashes", f"SELECT s_suppkey, CASE WHEN {JAVA} >= 2147483648 THEN {JAVA} - 4294967296 ELSE {JAVA} END AS java, substr(sha256(k), 1, 16) AS sha FROM (SELECT s_suppkey, s_name AS k FROM supplier)")
def hashes(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", o.java_hash(F.col("s_name")).alias("java"), F.substring(F.sha2(F.col("s_name").cast("binary"), 256), 1, 16).alias("sha"))


@query("F10_custom_comparator", "SELECT count(*) AS n, count(*) FILTER (abs(l_extendedprice * (1 - l_discount) - l_extendedprice) <= l_extendedprice * 0.05) AS near FROM lineitem")
def custom(spark, sf):
    """A caller's comparator as an Arrow-batched function over two columns."""

    def compare(batches):
        for f in batches:
            yield pd.DataFrame({"near": (f["a"] - f["b"]).abs() <= f["b"] * 0.05})

    pairs = table(spark, sf, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"), F.col("l_extendedprice").alias("b"))
    return pairs.mapInPandas(compare, "near boolean").agg(F.count("*").alias("n"), F.count_if("near").alias("near"))


@query("P12_picture_explained", f"WITH {PICTURES} SELECT x.pic AS pic, any_value(x.digits + x.characters) AS length, any_value(x.kind) AS kind, count(*) AS n FROM pics GROUP BY 1")
def picture_explained(spark, sf):
    from tessera.functions.scalar import picture

    parts = picture(F.col("pic"))
    return pictures(spark, sf).groupBy("pic", parts["length"].alias("length"), parts["kind"].alias("kind")).agg(F.count("*").alias("n"))


