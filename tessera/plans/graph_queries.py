"""Queries of graphs over foreign keys, purchases and event transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators.condensation import reach_counts, strong_components
from tessera.plans.registry import query
from tessera.plans.roles import edges, ident, nodes, trace, tree_edges, with_roles
from tessera.session import table

GRAPH, TREE = with_roles("nodes", "edges"), with_roles("nodes", "tree")
GRAPH_R, TREE_R = with_roles("nodes", "edges", recursive=True), with_roles("nodes", "tree", recursive=True)
UNDIRECTED = ", u AS (SELECT source, target FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target)"
DEGREES = """, deg AS (SELECT n.id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree FROM nodes n
LEFT JOIN (SELECT target AS id, count(*) AS k FROM edges GROUP BY 1) i ON n.id = i.id LEFT JOIN (SELECT source AS id, count(*) AS k FROM edges GROUP BY 1) o ON n.id = o.id)"""
STEPS = """trans AS (SELECT DISTINCT type AS source, next AS target FROM (SELECT event_type AS type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL)"""


def transitions(spark, sf):
    """Which event type follows which in some session: a small graph with cycles."""
    steps = trace(spark, sf).select(F.col("type").alias("source"), F.expr("lead(type) OVER (PARTITION BY session_id ORDER BY seq)").alias("target"))
    return steps.where("target IS NOT NULL").distinct().withColumn("type", F.lit("calls"))


def at(spark, node):
    return spark.createDataFrame([(node, node)], "origin string, id string")


ORDER_VERSIONS = "SELECT o_custkey AS id, o_orderkey AS ver, o_orderstatus AS state FROM orders"


@query("G1_upsert_nodes", "SELECT o_custkey AS id, max(o_orderkey) AS ver, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY 1")
def upsert_nodes(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ver"), F.col("o_orderstatus").alias("state"))
    return g.upsert(rows, ["id"], "ver")


@query("G2_upsert_edges", "SELECT source, target, x.v AS ver, x.w AS weight FROM (SELECT l_partkey AS source, l_suppkey AS target, max({'v': l_orderkey * 10 + l_linenumber, 'w': l_quantity}) AS x FROM lineitem GROUP BY 1, 2)")
def upsert_edges(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ver"), F.col("l_quantity").alias("weight"))
    return g.upsert(rows, ["source", "target"], "ver")


@query("G3_rules_graph", """SELECT type, count(*) AS n FROM (SELECT DISTINCT 'data_' || s AS source, 'rule_' || p_partkey AS target, 'uses' AS type FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS s FROM part)
UNION SELECT DISTINCT 'rule_' || p_partkey, 'data_' || s, 'modifies' FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS s FROM part)) GROUP BY type""")
def rules_graph(spark, sf):
    rules = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.array("p_brand", "p_type").alias("inputs"), F.split("p_name", " ").alias("outputs"))
    return g.rules_graph(rules)[1].groupBy("type").agg(F.count("*").alias("n"))


@query("G4_procedures_graph", """SELECT type, count(*) AS n FROM (SELECT DISTINCT 'prog_' || p_brand AS a, 'proc_' || p_brand || '_' || p_type AS b, 'contains' AS type FROM part
UNION SELECT DISTINCT 'proc_' || p_brand || '_' || p_type, 'proc_' || p_brand || '_' || c, 'calls' FROM (SELECT p_brand, p_type, unnest(string_split(p_name, ' ')) AS c FROM part)) GROUP BY type""")
def procedures_graph(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("program"), F.col("p_type").alias("name"), F.split("p_name", " ").alias("calls"))
    return g.procedures_graph(p)[1].groupBy("type").agg(F.count("*").alias("n"))


@query("G5_regulation_edges", GRAPH + " SELECT 'reg_gdpr' AS source, id AS target, 'affected-by' AS type FROM (SELECT DISTINCT 'c:' || user_id AS id FROM events) WHERE id IN (SELECT id FROM nodes)")
def regulation_edges(spark, sf):
    affected = table(spark, sf, "events").select(ident("c", "user_id").alias("id")).distinct()
    return g.regulation_edges("gdpr", affected, nodes(spark, sf))


@query("G7_node_filter", GRAPH + " SELECT id, type FROM nodes WHERE type IN ('nation', 'supplier') AND regexp_matches(name, '(?i)a.*1|^S')")
def node_filter(spark, sf):
    return g.filter_nodes(nodes(spark, sf), ("nation", "supplier"), name="a.*1|^S").select("id", "type")


@query("G8_edge_filter", GRAPH + " SELECT type, count(*) AS n FROM edges WHERE type IN ('uses', 'calls') GROUP BY type")
def edge_filter(spark, sf):
    return g.filter_edges(edges(spark, sf), ("uses", "calls")).groupBy("type").agg(F.count("*").alias("n"))


PATHS = f"""WITH RECURSIVE {STEPS}, p AS (SELECT ['signup'] AS path, target AS here FROM trans WHERE source = 'signup' AND target <> 'signup'
UNION ALL SELECT list_append(path, here), t.target FROM p JOIN trans t ON t.source = p.here WHERE p.here <> 'purchase' AND NOT list_contains(path, t.target) AND t.target <> p.here AND len(path) < 5)"""


@query("G9_simple_paths", PATHS + " SELECT array_to_string(list_append(path, here), '>') AS path FROM p WHERE here = 'purchase'")
def paths(spark, sf):
    return g.simple_paths(transitions(spark, sf), "signup", "purchase").select(F.array_join("path", ">").alias("path"))


@query("G10_path_nodes", PATHS + ", f AS (SELECT list_append(path, here) AS path FROM p WHERE here = 'purchase'), x AS (SELECT unnest(path) AS id, unnest(range(len(path))) AS pos FROM f) SELECT id, min(pos) AS first_pos FROM x GROUP BY id")
def path_nodes(spark, sf):
    return g.path_nodes(g.simple_paths(transitions(spark, sf), "signup", "purchase"))


def reach_sql(prefix, steps, start, depth):
    return f"""{prefix}, st AS ({steps}), w AS (SELECT {start} AS id, 0 AS distance UNION SELECT st.target, distance + 1 FROM w JOIN st ON st.source = w.id WHERE distance < {depth})
SELECT id, min(distance)::BIGINT AS distance FROM w GROUP BY id"""


@query("G11_subgraph", reach_sql(GRAPH_R, "SELECT source, target FROM edges UNION SELECT target, source FROM edges", "'n:3'", 2))
def subgraph(spark, sf):
    return g.subgraph(edges(spark, sf), nodes(spark, sf), at(spark, "n:3")).select("id", "distance")


@query("G12_impact", reach_sql(GRAPH_R, "SELECT source, target FROM edges UNION SELECT target, source FROM edges WHERE type IN ('uses', 'depends-on', 'reads')", "'s:1'", 3))
def impact(spark, sf):
    return g.impact(edges(spark, sf), at(spark, "s:1")).select("id", "distance")


@query("G13_by_regulation", GRAPH + " SELECT type, count(*) AS n FROM nodes WHERE id IN (SELECT 'c:' || user_id FROM events) GROUP BY type")
def by_regulation(spark, sf):
    return nodes(spark, sf).join(regulation_edges(spark, sf).select(F.col("target").alias("id")), "id", "left_semi").groupBy("type").agg(F.count("*").alias("n"))


@query("G14_data_flow", GRAPH + " SELECT DISTINCT 'producer' AS role, source AS id FROM edges WHERE target = 'n:3' AND type IN ('uses', 'reads') UNION ALL SELECT DISTINCT 'consumer', target FROM edges WHERE source = 'n:3' AND type IN ('depends-on')")
def data_flow(spark, sf):
    return g.data_flow(edges(spark, sf), "n:3", ("uses", "reads"), ("depends-on",))


@query("G15_statistics", GRAPH + " SELECT 'nodes' AS kind, type, count(*) AS n FROM nodes GROUP BY ROLLUP (type) UNION ALL SELECT 'edges', type, count(*) FROM edges GROUP BY ROLLUP (type)")
def graph_statistics(spark, sf):
    count = lambda df, kind: df.rollup("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes(spark, sf), "nodes").unionByName(count(edges(spark, sf), "edges"))


@query("G16_view_filter", GRAPH + " SELECT id FROM nodes WHERE type IN ('customer', 'supplier') AND contains(lower(name), '00000001') AND confidence BETWEEN 0.5 AND 0.85")
def view_filter(spark, sf):
    return g.view_filter(nodes(spark, sf), ("customer", "supplier"), "00000001", 0.5, 0.85).select("id")


@query("G17_induced_edges", GRAPH + " SELECT type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM nodes WHERE confidence >= 0.8) AND target IN (SELECT id FROM nodes WHERE confidence >= 0.8) GROUP BY type")
def induced(spark, sf):
    return g.induced_edges(edges(spark, sf), nodes(spark, sf).where("confidence >= 0.8")).groupBy("type").agg(F.count("*").alias("n"))


@query("G18_degrees", GRAPH + DEGREES + " SELECT * FROM deg")
def degrees(spark, sf):
    return g.degrees(edges(spark, sf), nodes(spark, sf))


@query("G19_pagerank", GRAPH + ", o AS (SELECT source, count(*) AS k FROM edges GROUP BY 1), l AS MATERIALIZED (SELECT e.source, e.target, o.k FROM edges e JOIN o USING (source)), c AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS MATERIALIZED (SELECT id, 1 / n AS rank FROM nodes, c)" + "".join(
    f", r{k + 1} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * coalesce(g.got, 0) AS rank FROM nodes n CROSS JOIN c LEFT JOIN (SELECT target, sum(rank / k) AS got FROM l JOIN r{k} ON l.source = r{k}.id GROUP BY 1) g ON g.target = n.id)" for k in range(20)) + " SELECT id, round(rank, 9) AS rank FROM r20")
def pagerank(spark, sf):
    return g.pagerank(edges(spark, sf), nodes(spark, sf)).withColumn("rank", F.round("rank", 9))


@query("G20_type_clusters", GRAPH + ", k AS (SELECT type, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS k FROM nodes) SELECT type, count(*) AS n, min(k % 100) * 50 - 20 AS \"left\", max(k % 100) * 50 + 20 AS \"right\", max(k // 100) * 50 + 20 AS bottom FROM k GROUP BY type HAVING count(*) >= 2")
def type_clusters(spark, sf):
    return g.type_clusters(nodes(spark, sf))


DESCRIBED = GRAPH + """, dn AS (SELECT id, type, name, confidence, type || ' no ' || split_part(id, ':', 2) AS description, [type, 't' || (split_part(id, ':', 2)::BIGINT % 7)] AS tags FROM nodes)"""


def described(spark, sf):
    """Nodes with a description and tags."""
    key = F.split("id", ":")[1]
    return nodes(spark, sf).withColumn("description", F.concat("type", F.lit(" no "), key)).withColumn("tags", F.array(F.col("type"), F.concat(F.lit("t"), (key.cast("long") % 7).cast("string"))))


@query("G21_substring_search", DESCRIBED + " SELECT id FROM dn WHERE contains(lower(name), 'no 1') OR contains(lower(description), 'no 1') OR contains(lower(type), 'no 1')")
def substring(spark, sf):
    return g.view_filter(described(spark, sf), text="No 1", columns=("name", "description", "type")).select("id")


@query("G21_tags", DESCRIBED + " SELECT id FROM dn WHERE list_has_any(tags, ['t3', 'region']) AND contains(lower(name), '1')")
def tagged(spark, sf):
    return g.view_filter(described(spark, sf), text="1", tags=("t3", "region"), columns=("name",)).select("id")


@query("G23_api_impact", GRAPH_R + UNDIRECTED + ", w AS (SELECT 'n:3' AS id, 0 AS d UNION SELECT u.target, d + 1 FROM w JOIN u ON u.source = w.id WHERE d < 3), m AS (SELECT id, min(d) AS d FROM w GROUP BY 1) SELECT d AS distance, count(*) AS n FROM m GROUP BY d")
def api_impact(spark, sf):
    return g.reach(g.both_ways(edges(spark, sf)), at(spark, "n:3"), 3).groupBy("distance").agg(F.count("*").alias("n"))


@query("G24_api_search", DESCRIBED + """, m AS (SELECT id, CASE WHEN contains(lower(name), '12') THEN 1 WHEN contains(lower(description), '12') THEN 2 WHEN len(list_filter(tags, lambda t: contains(lower(t), '12'))) > 0 THEN 3 END AS k FROM dn WHERE type IN ('nation', 'region', 'supplier'))
SELECT id, ['name', 'description', 'tag'][k] AS match_type FROM m WHERE k IS NOT NULL ORDER BY k, id LIMIT 50""")
def api_search(spark, sf):
    return g.search(described(spark, sf), "12", types=("nation", "region", "supplier"))


@query("G24_tag_search", DESCRIBED + " SELECT id, 'tag' AS match_type FROM dn WHERE list_contains(tags, 't5') ORDER BY id LIMIT 50")
def tag_search(spark, sf):
    return g.search(described(spark, sf), "T5")


@query("G25_node_detail", GRAPH + " SELECT 'out' AS direction, type, target AS other FROM edges WHERE source = 's:1' UNION ALL SELECT 'in', type, source FROM edges WHERE target = 's:1'")
def detail(spark, sf):
    return g.neighbours(edges(spark, sf), "s:1")


@query("A1_adjacency", GRAPH + UNDIRECTED + " SELECT source AS id, count(*) AS neighbours FROM u GROUP BY 1")
def adjacency(spark, sf):
    return g.undirected(edges(spark, sf)).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("neighbours"))


@query("A2_density", GRAPH + ", a AS (SELECT count(*) AS m FROM edges), b AS (SELECT count(*) AS n FROM nodes) SELECT n, m, m / (n * (n - 1))::DOUBLE AS density FROM a, b")
def density(spark, sf):
    return g.density(edges(spark, sf), nodes(spark, sf))


@query("A3_degree_summary", GRAPH + DEGREES + " SELECT round(avg(degree), 6)::DOUBLE AS mean_degree, max(degree) AS max_degree FROM deg")
def degree_summary(spark, sf):
    return degrees(spark, sf).agg(F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))


@query("A4_components", GRAPH_R + UNDIRECTED + ", w AS (SELECT id, id AS label FROM nodes UNION SELECT u.target, w.label FROM w JOIN u ON u.source = w.id WHERE w.label < u.target) SELECT id, min(label) AS component FROM w GROUP BY id")
def components(spark, sf):
    return g.components(edges(spark, sf), nodes(spark, sf))


FAR = UNDIRECTED + ", f AS (SELECT id FROM nodes ORDER BY id LIMIT 100), w AS (SELECT id AS origin, id, 0 AS d FROM f UNION SELECT origin, u.target, d + 1 FROM w JOIN u ON u.source = w.id WHERE d < 4), m AS (SELECT origin, id, min(d) AS d FROM w GROUP BY 1, 2)"


@query("A5_path_lengths", TREE_R + FAR + " SELECT max(d)::BIGINT AS diameter, round(avg(d), 8) AS mean_length FROM m WHERE d > 0")
def path_lengths(spark, sf):
    return g.path_lengths(tree_edges(spark, sf), nodes(spark, sf)).withColumn("mean_length", F.round("mean_length", 8))


@query("A6_bfs_distances", reach_sql(GRAPH_R, "SELECT source, target FROM edges UNION SELECT target, source FROM edges", "'c:1'", 4))
def bfs(spark, sf):
    return g.reach(g.both_ways(edges(spark, sf)), at(spark, "c:1")).select("id", "distance")


@query("A7_clustering", GRAPH + UNDIRECTED + """, k AS (SELECT source, count(*) AS k FROM u GROUP BY 1 HAVING count(*) >= 2),
t AS (SELECT a.source, count(*) AS t FROM u a JOIN u b ON a.source = b.source AND a.target < b.target JOIN u c ON c.source = a.target AND c.target = b.target GROUP BY 1)
SELECT round(avg(coalesce(t.t, 0) * 2.0::DOUBLE / (k.k * (k.k - 1))), 8) AS clustering FROM k LEFT JOIN t USING (source)""")
def clustering(spark, sf):
    return g.clustering(edges(spark, sf)).withColumn("clustering", F.round("clustering", 8))


LPA = UNDIRECTED + ", l0 AS MATERIALIZED (SELECT id, id AS label FROM nodes)" + "".join(
    f", l{k + 1} AS MATERIALIZED (SELECT l.id, coalesce(b.label, l.label) AS label FROM l{k} l LEFT JOIN (SELECT source, label FROM (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, label) AS r FROM u JOIN l{k} x ON u.target = x.id GROUP BY source, label) WHERE r = 1) b ON b.source = l.id)" for k in range(10))


@query("A8_communities", GRAPH + LPA + " SELECT id, label FROM l10")
def communities(spark, sf):
    return g.label_propagation(edges(spark, sf), nodes(spark, sf))


MEASURES = ", e2 AS (SELECT a.label AS la, b.label AS lb, e.source, e.target FROM edges e JOIN l10 a ON e.source = a.id JOIN l10 b ON e.target = b.id)"


@query("A9_modularity", GRAPH + LPA + MEASURES + """, k AS (SELECT id, count(*) AS k FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1), m AS (SELECT count(*) * 2.0::DOUBLE AS m2 FROM edges)
SELECT round((sum(CASE WHEN la = lb THEN 1.0::DOUBLE ELSE 0 END) - sum((a.k * b.k)::DOUBLE) / max(m2)) / max(m2), 8) AS modularity FROM e2 JOIN k a ON e2.source = a.id JOIN k b ON e2.target = b.id CROSS JOIN m""")
def modularity(spark, sf):
    links, ids = g.renumbered(edges(spark, sf).select("source", "target"), nodes(spark, sf))
    return g.edge_modularity(links, g.label_propagation(links, ids)).withColumn("modularity", F.round("modularity", 8))


@query("A10_dominant_type", GRAPH + LPA + " SELECT label, type FROM (SELECT label, type, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, type) AS r FROM nodes JOIN l10 USING (id) GROUP BY label, type) WHERE r = 1")
def dominant(spark, sf):
    return g.dominant_type(nodes(spark, sf), communities(spark, sf))


@query("A11_cohesion", GRAPH + LPA + MEASURES + """, s AS (SELECT label, count(*) AS size FROM l10 GROUP BY 1), x AS (SELECT la AS label, (la = lb)::INT AS inner_ FROM e2 UNION ALL SELECT lb, 0 FROM e2 WHERE la <> lb),
c AS (SELECT label, sum(inner_)::BIGINT AS internal, sum(1 - inner_)::BIGINT AS external FROM x GROUP BY 1)
SELECT label, size, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, round(CASE WHEN size > 1 THEN coalesce(internal, 0) * 2.0::DOUBLE / (size * (size - 1)) ELSE 0 END, 8) AS cohesion,
round(coalesce(external / (internal + external)::DOUBLE, 0), 8) AS coupling FROM s LEFT JOIN c USING (label)""")
def cohesion(spark, sf):
    links, ids = g.renumbered(edges(spark, sf).select("source", "target"), nodes(spark, sf).select("id", F.col("id").alias("name")))
    found = g.cluster_measures(links, g.label_propagation(links, ids))
    out = found.join(ids.withColumnRenamed("id", "label"), "label").drop("label").withColumnRenamed("name", "label")
    return out.withColumn("cohesion", F.round("cohesion", 8)).withColumn("coupling", F.round("coupling", 8))


# The graph is a forest, so each pair of nodes has one way between them.
BETWEEN = UNDIRECTED + """, f AS (SELECT id FROM nodes ORDER BY id LIMIT 50), w AS (SELECT id AS origin, id, [id] AS path FROM f UNION ALL SELECT origin, u.target, list_append(path, u.target) FROM w JOIN u ON u.source = w.id WHERE NOT list_contains(path, u.target)),
inner_ AS (SELECT unnest(path[2:-2]) AS id FROM w), n AS (SELECT id, count(*) AS n FROM inner_ GROUP BY 1), bt AS (SELECT id, coalesce(n / (SELECT max(n) FROM n)::DOUBLE, 0) AS betweenness FROM nodes LEFT JOIN n USING (id))"""


@query("A12_betweenness", TREE_R + BETWEEN + " SELECT * FROM bt")
def betweenness(spark, sf):
    return g.betweenness(tree_edges(spark, sf), nodes(spark, sf))


@query("A13_critical_nodes", TREE_R + BETWEEN + DEGREES + """ SELECT id, betweenness, CASE WHEN out_degree > 2 * in_degree THEN 'high-fan-out' WHEN in_degree > 2 * out_degree THEN 'high-fan-in' WHEN in_degree > 5 AND out_degree > 5 THEN 'hub' ELSE 'bridge' END AS reason
FROM bt JOIN deg USING (id) ORDER BY betweenness DESC, id LIMIT 10""")
def critical(spark, sf):
    return g.critical_nodes(betweenness(spark, sf), g.degrees(tree_edges(spark, sf), nodes(spark, sf)))


CLOSURE = ", w AS (SELECT target AS id, source AS dep FROM edges UNION SELECT w.id, e.source FROM w JOIN edges e ON e.target = w.dep), dep AS (SELECT n.id, count(w.dep) AS dependents FROM nodes n LEFT JOIN w ON w.id = n.id GROUP BY n.id)"


@query("A14_transitive_dependents", GRAPH_R + CLOSURE + " SELECT * FROM dep")
def dependents(spark, sf):
    return g.transitive_dependents(edges(spark, sf), nodes(spark, sf))


@query("A15_bottlenecks", GRAPH + DEGREES + """, b AS (SELECT * FROM deg WHERE in_degree > 3 AND in_degree > 1.5 * out_degree), p AS (SELECT DISTINCT source, target FROM edges),
alt AS (SELECT a.source AS id, count(DISTINCT c.source) AS n FROM p a JOIN p c ON a.target = c.target AND a.source <> c.source WHERE a.source IN (SELECT id FROM b) GROUP BY 1)
SELECT id, in_degree, coalesce(n, 0) AS alternatives, 1.0::DOUBLE / (coalesce(n, 0) + 1) AS impact FROM b LEFT JOIN alt USING (id) WHERE 1.0::DOUBLE / (coalesce(n, 0) + 1) > 0.3 ORDER BY impact DESC, in_degree DESC, id LIMIT 10""")
def bottlenecks(spark, sf):
    return g.bottlenecks(edges(spark, sf), nodes(spark, sf))


@query("A16_high_risk", GRAPH + DEGREES + """, s AS (SELECT id, round((CASE WHEN degree > 10 THEN 0.3 ELSE 0 END + CASE WHEN confidence < 0.5 THEN 0.3 ELSE 0 END + CASE WHEN type = 'rule' AND in_degree > 5 THEN 0.2 ELSE 0 END
+ CASE WHEN out_degree = 0 AND in_degree > 3 THEN 0.2 ELSE 0 END)::DOUBLE, 4) AS risk FROM nodes JOIN deg USING (id)) SELECT * FROM s WHERE risk > 0.3 ORDER BY risk DESC, id LIMIT 20""")
def high_risk(spark, sf):
    return g.high_risk(degrees(spark, sf), nodes(spark, sf))


@query("A17_single_points", GRAPH_R + CLOSURE + DEGREES + " SELECT id, dependents FROM dep JOIN deg USING (id) WHERE dependents > 0.1 * (SELECT count(*) FROM nodes) AND out_degree <= 2 ORDER BY dependents DESC, id LIMIT 10")
def single_points(spark, sf):
    return g.single_points(dependents(spark, sf), degrees(spark, sf))


@query("A18_orphans", GRAPH + " SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM edges WHERE type = 'calls' UNION SELECT target FROM edges WHERE type = 'calls')")
def orphans(spark, sf):
    return g.orphans(g.filter_edges(edges(spark, sf), ("calls",)), nodes(spark, sf))


CYCLES = f"""WITH RECURSIVE {STEPS}, e AS (SELECT source, target FROM trans WHERE source <> target), p AS (SELECT [source, target] AS path FROM e WHERE target > source
UNION ALL SELECT list_append(path, e.target) FROM p JOIN e ON e.source = path[-1] WHERE e.target > path[1] AND NOT list_contains(path, e.target) AND len(path) < 5),
c AS (SELECT path FROM p JOIN e ON e.source = path[-1] AND e.target = path[1])"""


@query("A19_cycles", CYCLES + " SELECT array_to_string(path, '>') AS cycle FROM c")
def cycles(spark, sf):
    return g.simple_cycles(transitions(spark, sf)).select(F.array_join("path", ">").alias("cycle"))


def first_ids(test):
    return f"(SELECT list(id ORDER BY id) FROM (SELECT id FROM x WHERE {test} ORDER BY id LIMIT 5))"


@query("A20_recommendations", GRAPH + DEGREES + ", x AS (SELECT n.id, n.type, n.confidence, d.degree FROM nodes n JOIN deg d USING (id)), r AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS advice, '{s}' AS severity, (SELECT count(*) FROM x WHERE {t}) AS n, {first_ids(t)} AS f, {least} AS least" for a, s, t, least in (
        ("high-coupling", "high", "degree > 15", 0), ("orphans", "medium", "degree = 0", 0), ("low-confidence-rules", "high", "type = 'supplier' AND confidence < 0.5", 0), ("test-coverage", "medium", "type = 'supplier'", 10))
) + ") SELECT advice, severity, n, array_to_string(f, ' ') AS first_nodes FROM r WHERE n > least")
def recommendations(spark, sf):
    found = g.recommendations(nodes(spark, sf), degrees(spark, sf), strong_components(edges(spark, sf), nodes(spark, sf)), "supplier")
    return found.withColumn("first_nodes", F.array_join("first_nodes", " "))


@query("D1_direct_dependencies", GRAPH + " SELECT source AS id, count(DISTINCT target) AS dependencies FROM edges WHERE type IN ('calls', 'uses', 'depends-on', 'reads', 'imports') GROUP BY 1")
def direct(spark, sf):
    return g.filter_edges(edges(spark, sf), g.DEPENDS).groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("dependencies"))


@query("D2_transitive_dependencies", GRAPH_R + ", w AS (SELECT source AS id, target AS dep FROM edges UNION SELECT w.id, e.target FROM w JOIN edges e ON e.source = w.dep) SELECT id, count(*) AS dependencies FROM w WHERE id <> dep GROUP BY id")
def transitive(spark, sf):
    return reach_counts(edges(spark, sf), nodes(spark, sf)).where("reachable > 0").select("id", F.col("reachable").alias("dependencies"))


@query("A20_cycle_advice", CYCLES + " SELECT 'circular-dependencies' AS advice, 'high' AS severity, count(*) AS n FROM c HAVING count(*) > 0")
def cycle_advice(spark, sf):
    return g.recommendations(nodes(spark, sf).limit(0), degrees(spark, sf).limit(0), g.simple_cycles(transitions(spark, sf))).select("advice", "severity", "n")


@query("D2_reachable_estimates", TREE_R + ", w AS (SELECT source AS id, target AS dep FROM edges UNION SELECT w.id, e.target FROM w JOIN edges e ON e.source = w.dep) SELECT n.id, count(w.dep) AS reachable FROM nodes n LEFT JOIN w ON w.id = n.id GROUP BY n.id")
def reachable_estimates(spark, sf):
    # Few needs each, so the sketches are exact here.
    return g.reachable_estimates(tree_edges(spark, sf), nodes(spark, sf))


# Urgent orders lead from customers to suppliers, returns of much lead back: a graph with cycles of many lengths.
TRADE = with_roles("nodes", recursive=True) + """, trade AS (SELECT DISTINCT 'c:' || o_custkey AS source, 's:' || l_suppkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'
UNION SELECT DISTINCT 's:' || l_suppkey, 'c:' || o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 40)"""
STRONG = """, w AS (SELECT source AS id, target AS dep FROM trade UNION SELECT w.id, e.target FROM w JOIN trade e ON e.source = w.dep), both_ AS (SELECT a.id, a.dep FROM w a JOIN w b ON a.id = b.dep AND a.dep = b.id),
strong AS (SELECT n.id, least(n.id, coalesce(min(dep), n.id)) AS component, count(dep) > 0 AS cyclic FROM nodes n LEFT JOIN both_ USING (id) GROUP BY n.id)"""


def trade(spark, sf):
    """Who orders urgently from whom, and who takes back much from whom."""
    sold = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    customer, supplier = ident("c", "o_custkey"), ident("s", "l_suppkey")
    orders = sold.where("o_orderpriority = '1-URGENT'").select(customer.alias("source"), supplier.alias("target"))
    return orders.union(sold.where("l_returnflag = 'R' AND l_quantity >= 40").select(supplier, customer)).distinct()


@query("A19_strong_components", TRADE + STRONG + " SELECT id, component, count(*) OVER (PARTITION BY component) AS size, cyclic FROM strong")
def strong(spark, sf):
    return strong_components(trade(spark, sf), nodes(spark, sf))


@query("D3_cyclic_groups", TRADE + STRONG + " SELECT component, count(*) AS modules, max(id) AS last_id FROM strong WHERE cyclic GROUP BY 1")
def cyclic_groups(spark, sf):
    return strong(spark, sf).where("cyclic").groupBy("component").agg(F.count("*").alias("modules"), F.max("id").alias("last_id"))


@query("D4_coupling_any_cycle", TRADE + STRONG + """, a AS (SELECT n.id, (SELECT count(*) FROM trade WHERE target = n.id) AS ca, (SELECT count(*) FROM trade WHERE source = n.id) AS ce, cyclic::BIGINT AS cycles FROM nodes n JOIN strong USING (id)),
b AS (SELECT *, coalesce(ce / nullif(ca + ce, 0)::DOUBLE, 0) AS instability FROM a)
SELECT id, ca, ce, cycles, round(instability, 8) AS instability, least(10.0, ((ca + ce) / 2.0 + 2 * cycles) * CASE WHEN instability > 0.7 OR instability < 0.3 THEN 1.5 ELSE 1 END)::DOUBLE AS score FROM b""")
def coupling_any_cycle(spark, sf):
    links, ids = trade(spark, sf).withColumn("type", F.lit("calls")), nodes(spark, sf)
    return g.coupling(links, ids, strong_components(links, ids)).withColumn("instability", F.round("instability", 8))


@query("A14_dependents_with_cycles", TRADE + ", w AS (SELECT target AS id, source AS dep FROM trade UNION SELECT w.id, e.source FROM w JOIN trade e ON e.target = w.dep) SELECT n.id, count(w.dep) AS dependents FROM nodes n LEFT JOIN w ON w.id = n.id AND w.dep <> n.id GROUP BY n.id")
def dependents_with_cycles(spark, sf):
    return g.transitive_dependents(trade(spark, sf), nodes(spark, sf))


@query("D3_cycle_lengths", CYCLES + " SELECT len(path) AS length, count(*) AS n FROM c GROUP BY 1")
def cycle_lengths(spark, sf):
    return g.simple_cycles(transitions(spark, sf)).groupBy(F.size("path").cast("long").alias("length")).agg(F.count("*").alias("n"))


COUPLING = GRAPH + """, p AS (SELECT DISTINCT source, target FROM edges), a AS (SELECT n.id, (SELECT count(*) FROM p WHERE p.target = n.id) AS ca, (SELECT count(*) FROM p WHERE p.source = n.id) AS ce FROM nodes n),
b AS (SELECT *, coalesce(ce / nullif(ca + ce, 0)::DOUBLE, 0) AS instability FROM a), cp AS (SELECT id, ca, ce, 0::BIGINT AS cycles, round(instability, 8) AS instability, round(least(10.0, (ca + ce) / 2.0 * CASE WHEN instability > 0.7 OR instability < 0.3 THEN 1.5 ELSE 1 END), 6)::DOUBLE AS score FROM b)"""


def coupled(spark, sf):
    return g.coupling(edges(spark, sf), nodes(spark, sf)).withColumn("instability", F.round("instability", 8)).withColumn("score", F.round("score", 6))


query("D4_coupling", COUPLING + " SELECT * FROM cp")(coupled)


@query("D5_most_coupled", COUPLING + " SELECT id, score FROM cp ORDER BY score DESC, id LIMIT 10")
def most_coupled(spark, sf):
    return coupled(spark, sf).select("id", "score").orderBy(F.desc("score"), "id").limit(10)


@query("D5_leaves_and_roots", COUPLING + " SELECT CASE WHEN ca = 0 THEN 'leaf' ELSE 'root' END AS kind, count(*) AS n FROM cp WHERE ca = 0 OR ce = 0 GROUP BY 1")
def leaves(spark, sf):
    return coupled(spark, sf).where("ca = 0 OR ce = 0").groupBy(F.when(F.col("ca") == 0, "leaf").otherwise("root").alias("kind")).agg(F.count("*").alias("n"))


LEVELS = ", lv AS (SELECT id, 0 AS level FROM nodes UNION SELECT e.source, lv.level + 1 FROM lv JOIN edges e ON e.target = lv.id WHERE lv.level < 10), lev AS (SELECT id, max(level)::BIGINT AS level FROM lv GROUP BY 1)"


@query("D7_topological_levels", GRAPH_R + LEVELS + " SELECT * FROM lev")
def levels(spark, sf):
    return g.longest_levels(edges(spark, sf), nodes(spark, sf))


@query("D9_coupling_bottleneck", GRAPH + DEGREES + " SELECT id, round((in_degree + out_degree) / 10.0, 4)::DOUBLE AS impact FROM deg WHERE in_degree > 3 AND out_degree > 3")
def coupling_bottleneck(spark, sf):
    return degrees(spark, sf).where("in_degree > 3 AND out_degree > 3").select("id", F.round(F.col("degree") / 10, 4).alias("impact"))


@query("D10_waves", GRAPH_R + LEVELS + ", r AS (SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY id) AS k FROM lev) SELECT level, CAST(ceil(k / 50.0) AS BIGINT) AS wave, count(*) AS n FROM r GROUP BY 1, 2")
def waves(spark, sf):
    ranked = g.placed(levels(spark, sf), ["level"], ["id"])
    return ranked.groupBy("level", (F.floor(F.col("place") / 50) + 1).alias("wave")).agg(F.count("*").alias("n"))


@query("D11_sequence_score", GRAPH_R + LEVELS + ", pos AS (SELECT id, row_number() OVER (ORDER BY level, id) AS p FROM lev) SELECT greatest(0, 100 - 5 * count(*) FILTER (a.p < b.p))::BIGINT AS score FROM edges e JOIN pos a ON e.source = a.id JOIN pos b ON e.target = b.id")
def sequence_score(spark, sf):
    pos = levels(spark, sf).select("id", F.struct("level", "id").alias("p"))
    joined = edges(spark, sf).join(pos.select(F.col("id").alias("source"), F.col("p").alias("a")), "source").join(pos.select(F.col("id").alias("target"), F.col("p").alias("b")), "target")
    return joined.agg(F.greatest(F.lit(0), 100 - 5 * F.count_if(F.col("a") < F.col("b"))).alias("score"))


@query("D12_level_widths", GRAPH_R + LEVELS + " SELECT level, count(*) AS independent FROM lev GROUP BY level")
def widths(spark, sf):
    return levels(spark, sf).groupBy("level").agg(F.count("*").alias("independent"))


@query("D17_cost", "SELECT o_custkey, ceil(sum(l_quantity * 8 * 0.5 * CASE l_returnflag WHEN 'A' THEN 150 WHEN 'R' THEN 120 ELSE 100 END) * 1.02 * 1.15)::BIGINT AS cost FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def cost(spark, sf):
    rate = F.when(F.col("l_returnflag") == "A", 150).when(F.col("l_returnflag") == "R", 120).otherwise(100)
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    total = F.sum((F.col("l_quantity") * 8 * rate).cast("decimal(20,2)")) * F.lit("0.5").cast("decimal(3,2)") * F.lit("1.02").cast("decimal(3,2)") * F.lit("1.15").cast("decimal(3,2)")
    return joined.groupBy("o_custkey").agg(F.ceil(total).cast("long").alias("cost"))


@query("D18_code_metrics", """SELECT lang, sum(len(list_filter(string_split(text, ' '), lambda w: w IN ('the', 'des', 'los', 'und'))))::BIGINT AS keywords, max(len(string_split(text, chr(10)))) AS most_lines, round(sum(log10(1 + length(text))), 4) AS volume FROM documents GROUP BY lang""")
def code_metrics(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.sum(F.size(F.filter(F.split("text", " "), lambda w: w.isin("the", "des", "los", "und")))).alias("keywords"), F.max(F.size(F.split("text", "\n"))).cast("long").alias("most_lines"), F.round(F.sum(F.log10(1 + F.length("text"))), 4).alias("volume"))


@query("D20_pipeline_order", GRAPH_R + LEVELS + " SELECT level, min(id) AS first_id, max(id) AS last_id FROM lev GROUP BY level")
def pipeline_order(spark, sf):
    return levels(spark, sf).groupBy("level").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("N7_dependencies", reach_sql(GRAPH_R, "SELECT source, target FROM edges WHERE type IN ('calls', 'uses', 'depends-on', 'reads')", "'c:1'", 3))
def nl_dependencies(spark, sf):
    return g.reach(g.filter_edges(edges(spark, sf), ("calls", "uses", "depends-on", "reads")), at(spark, "c:1"), 3).select("id", "distance")


@query("N8_impact_paths", GRAPH_R + ", w AS (SELECT 'r:0' AS id, ['r:0'] AS path UNION ALL SELECT e.source, list_append(w.path, e.source) FROM w JOIN edges e ON e.target = w.id WHERE len(path) <= 4) SELECT id, array_to_string(path, '<') AS path FROM w WHERE len(path) > 1")
def impact_paths(spark, sf):
    back = edges(spark, sf).select("source", "target")
    level = spark.createDataFrame([("r:0", ["r:0"])], "id string, path array<string>")
    found = []
    for _ in range(4):
        level = level.join(back, F.col("id") == F.col("target")).select(F.col("source").alias("id"), F.concat("path", F.array("source")).alias("path"))
        found.append(level)
    return g.union_all(found).select("id", F.array_join("path", "<").alias("path"))


@query("N9_data_flow", GRAPH + " SELECT DISTINCT 'producer' AS role, source AS id FROM edges WHERE target = 's:1' UNION ALL SELECT DISTINCT 'consumer', target FROM edges WHERE source = 's:1'")
def nl_flow(spark, sf):
    return g.data_flow(edges(spark, sf), "s:1", (), ())


@query("N10_code_path", GRAPH + " SELECT other, type FROM (SELECT target AS other, type FROM edges WHERE source = 'n:3' UNION ALL SELECT source, type FROM edges WHERE target = 'n:3')")
def code_path(spark, sf):
    return g.neighbours(edges(spark, sf), "n:3").select("other", "type")


@query("N11_summary_nodes", GRAPH + " SELECT type, min(id) AS id FROM nodes GROUP BY type")
def summary_nodes(spark, sf):
    return nodes(spark, sf).groupBy("type").agg(F.min("id").alias("id"))
