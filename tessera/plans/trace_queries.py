"""Queries over events as execution traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import traces as t
from tessera.plans.catalog_queries import RANGES, ranges
from tessera.plans.registry import query
from tessera.plans.roles import runs, trace, with_roles
from tessera.session import table

TRACE, RUNS = with_roles("trace"), with_roles("runs")
TYPES = ("click", "error", "purchase", "signup", "view")
DEPTH = TRACE + """, s AS (SELECT *, sum(CASE type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS x FROM trace),
d AS (SELECT *, CAST(x - least(0, min(x) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS depth FROM s)"""
ISLANDS = TRACE + """, c AS (SELECT *, CASE WHEN type = lag(type) OVER (PARTITION BY session_id ORDER BY seq) THEN 0 ELSE 1 END AS n FROM trace), i AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c)"""


@query("T1_session_cap", TRACE + " SELECT session_id, count(*) AS n, max(seq) AS last FROM trace WHERE seq <= 100000 GROUP BY 1")
def session_cap(spark, sf):
    return t.first_of_session(trace(spark, sf)).groupBy("session_id").agg(F.count("*").alias("n"), F.max("seq").cast("long").alias("last"))


@query("T2_trace_list", TRACE + " SELECT event_id, session_id FROM trace WHERE type = 'error' AND value >= 5 AND ts >= TIMESTAMP '2024-01-03' ORDER BY ts, event_id LIMIT 50 OFFSET 20")
def trace_list(spark, sf):
    hits = trace(spark, sf).where("type = 'error' AND value >= 5 AND ts >= TIMESTAMP_NTZ '2024-01-03'")
    return hits.orderBy("ts", "event_id").offset(20).limit(50).select("event_id", "session_id")


@query("T3_type_metrics", TRACE + " SELECT session_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (type = '{x}') AS n_{x}" for x in TYPES) + " FROM trace GROUP BY 1")
def type_metrics(spark, sf):
    return t.type_metrics(trace(spark, sf), TYPES)


@query("T4_call_depth", DEPTH + " SELECT session_id, max(depth) AS deepest, sum(depth)::BIGINT AS total FROM d GROUP BY 1")
def call_depth(spark, sf):
    return t.call_depth(trace(spark, sf), ["signup"], ["error"]).groupBy("session_id").agg(F.max("depth").alias("deepest"), F.sum("depth").alias("total"))


@query("T6_query", TRACE + " SELECT type, count(*) AS n, min(event_id) AS first_event FROM trace WHERE value BETWEEN 1 AND 100 AND type <> 'view' AND ts >= TIMESTAMP '2024-01-03' GROUP BY type")
def trace_query(spark, sf):
    return trace(spark, sf).where("value BETWEEN 1 AND 100 AND type <> 'view' AND ts >= TIMESTAMP_NTZ '2024-01-03'").groupBy("type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("T7_event_groups", "SELECT coalesce(CASE WHEN event_type = 'purchase' THEN 'txn' END, CASE WHEN event_type = 'error' THEN 'job' END, 'session-' || user_id) AS key, count(*) AS n FROM events GROUP BY 1")
def event_groups(spark, sf):
    kind = F.col("event_type")
    key = F.coalesce(F.when(kind == "purchase", "txn"), F.when(kind == "error", "job"), F.concat(F.lit("session-"), F.col("user_id").cast("string")))
    return table(spark, sf, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("T8_masking", "SELECT c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) AS masked FROM customer")
def masking(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", t.masked(F.col("c_name")).alias("masked"))


@query("T9_parse_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_payload(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("T10_mainframe_metrics", "SELECT count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) FILTER (event_type = 'error') AS users_with_errors, round(sum(value), 2) AS value FROM events")
def mainframe_metrics(spark, sf):
    error = F.col("event_type") == "error"
    return table(spark, sf, "events").agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("users"), F.count_if(error).alias("errors"), F.count_distinct(F.when(error, F.col("user_id"))).alias("users_with_errors"), F.round(F.sum("value"), 2).alias("value"))


@query("T11_procedure_stats", DEPTH + """, b AS (SELECT *, row_number() OVER (PARTITION BY session_id, depth ORDER BY seq) AS k FROM d WHERE type = 'signup'), e AS (SELECT session_id, depth + 1 AS depth, ts, row_number() OVER (PARTITION BY session_id, depth ORDER BY seq) AS k FROM d WHERE type = 'error'),
p AS (SELECT b.type, b.depth, e.ts AS ets, (epoch_us(e.ts) - epoch_us(b.ts)) / 1000.0::DOUBLE AS ms FROM b LEFT JOIN e ON b.session_id = e.session_id AND b.depth = e.depth AND b.k = e.k)
SELECT type, depth, count(*) AS calls, count(ets) AS closed, round(avg(ms) FILTER (ms >= 0), 3) AS mean_ms FROM p GROUP BY 1, 2""")
def procedure_stats(spark, sf):
    depths = t.call_depth(trace(spark, sf), ["signup"], ["error"])
    return t.procedure_stats(depths, ["signup"], ["error"]).withColumn("mean_ms", F.round("mean_ms", 3))


@query("T11_callers", DEPTH.replace("WHEN 'signup' THEN 1", "WHEN 'signup' THEN 1 WHEN 'view' THEN 1").replace("WHEN 'error' THEN -1", "WHEN 'error' THEN -1 WHEN 'click' THEN -1") + """, en AS (SELECT * FROM d WHERE type IN ('signup', 'view'))
SELECT caller, callee, count(*) AS calls FROM (SELECT type AS callee, (SELECT arg_max(p.type, p.seq) FROM en p WHERE p.session_id = en.session_id AND p.depth = en.depth - 1 AND p.seq < en.seq) AS caller FROM en WHERE depth > 1) WHERE caller IS NOT NULL GROUP BY 1, 2""")
def callers(spark, sf):
    return t.callers(t.call_depth(trace(spark, sf), ["signup", "view"], ["error", "click"]), ["signup", "view"])


@query("T12_path_islands", ISLANDS + " SELECT session_id, min(seq) AS first_seq, type AS value, count(*) AS length FROM i GROUP BY session_id, island, type HAVING count(*) > 1")
def path_islands(spark, sf):
    return t.islands(trace(spark, sf)).where("length > 1").select("session_id", F.col("first_seq").cast("long").alias("first_seq"), "value", "length")


@query("T13_snapshots", TRACE + ", g AS (SELECT session_id, type AS name, epoch_ms(ts) // 3600000 AS slot, arg_max(value, seq) AS value FROM trace GROUP BY 1, 2, 3) SELECT name, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY name")
def snapshots(spark, sf):
    return t.snapshots(trace(spark, sf), "type", "value", "ts", 3_600_000).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("T14_reads_before_write", TRACE + ", r AS (SELECT type, session_id, seq, count(*) FILTER (type = 'view') OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS reads FROM trace) SELECT session_id, sum(reads)::BIGINT AS reads, count(*) AS writes FROM r WHERE type = 'purchase' GROUP BY 1")
def reads_before(spark, sf):
    return t.reads_before(trace(spark, sf), "purchase", "view").groupBy("session_id").agg(F.sum(F.size("reads")).alias("reads"), F.count("*").alias("writes"))


@query("T15_decision_rules", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def decision_rules(spark, sf):
    return t.frequent(table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k")), ["event_type", "k"])


@query("T15_conditions", "SELECT event_type AS condition, count(*) AS n, round(avg((value > 20)::INT), 8) AS frequency FROM events GROUP BY 1 HAVING count(*) >= 2")
def conditions(spark, sf):
    seen = table(spark, sf, "events").select(F.col("event_type").alias("condition"), (F.col("value") > 20).alias("holds"))
    return t.learned_validations(seen, "condition", "holds", 2).withColumn("frequency", F.round("frequency", 8))


@query("T16_calculations", "SELECT p_brand || p_size AS place, count(*) AS n, min(p_type) AS constant FROM part GROUP BY 1 HAVING count(*) >= 2 AND min(p_type) = max(p_type)")
def calculations(spark, sf):
    seen = table(spark, sf, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("place"), "p_type")
    return t.learned_calculations(seen, "place", "p_type", 2)


@query("T16_decisions", TRACE + """, b AS (SELECT session_id, type, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM trace WHERE type IN ('signup', 'purchase')), p AS (SELECT session_id, string_agg(type, '>' ORDER BY k) AS path FROM b GROUP BY 1), l AS (SELECT session_id, arg_max(type, seq) AS outcome FROM trace GROUP BY 1)
SELECT path, outcome, count(*) AS n FROM p JOIN l USING (session_id) GROUP BY 1, 2 HAVING count(*) >= 1""")
def decisions(spark, sf):
    return t.learned_decisions(trace(spark, sf), path_types=("signup", "purchase"), least=1)


@query("T16_transforms", """WITH o AS (SELECT p_type AS place, p_name AS a, CASE p_type WHEN 'ECONOMY' THEN upper(p_name) WHEN 'PROMO' THEN trim(p_name) WHEN 'SMALL' THEN p_name || '!' ELSE lower(p_name) END AS b FROM part)
SELECT place, CASE WHEN bool_and(b = a) THEN 'identity' WHEN bool_and(b = upper(a)) THEN 'upper' WHEN bool_and(b = lower(a)) THEN 'lower' WHEN bool_and(b = trim(a)) THEN 'trim' END AS transform, count(*) AS n FROM o GROUP BY 1 HAVING count(*) >= 5 AND (bool_and(b = a) OR bool_and(b = upper(a)) OR bool_and(b = lower(a)) OR bool_and(b = trim(a)))""")
def transforms(spark, sf):
    a, kind = F.col("p_name"), F.col("p_type")
    b = F.when(kind == "ECONOMY", F.upper(a)).when(kind == "PROMO", F.trim(a)).when(kind == "SMALL", F.concat(a, F.lit("!"))).otherwise(F.lower(a))
    return t.learned_transforms(table(spark, sf, "part").select(kind.alias("place"), a.alias("a"), b.alias("b")), "place", "a", "b")


@query("T17_field_signature", TRACE + """, x AS (SELECT type, value, row_number() OVER (PARTITION BY type ORDER BY value) AS r FROM (SELECT DISTINCT type, value FROM trace))
SELECT t.type, count(*) AS n, count(*) - count(t.value) AS nulls, count(DISTINCT t.value) AS cardinality, min(t.value) AS low, max(t.value) AS high, (SELECT count(*) FROM x WHERE x.type = t.type AND r <= 10) AS examples FROM trace t GROUP BY t.type""")
def signature(spark, sf):
    return t.field_signature(trace(spark, sf), "value", ["type"]).withColumn("examples", F.size("examples").cast("long"))


LINES = "lines AS (SELECT event_id, ['ECONOMY','STANDARD','PROMO','MEDIUM','LARGE','SMALL'][(event_id % 6 + 1)::INT] AS file, user_id * 7 % 5000 AS line FROM events)"


def lines(spark, sf):
    files = F.array(*map(F.lit, ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "LARGE", "SMALL")))
    return table(spark, sf, "events").select("event_id", F.element_at(files, (F.col("event_id") % 6 + 1).cast("int")).alias("file"), (F.col("user_id") * 7 % 5000).alias("line"))


@query("T18_rule_validation", f"WITH {RANGES}, {LINES} SELECT r.rule, count(*) AS hits FROM lines e JOIN ranges r ON e.file = r.file AND e.line BETWEEN r.first AND r.last GROUP BY r.rule")
def rule_validation(spark, sf):
    return t.range_counts(lines(spark, sf), ranges(spark, sf)).groupBy("rule").agg(F.sum("hits").alias("hits"))


TEXTS = LINES.replace("SELECT event_id,", "SELECT event_id, event_type || ' of user ' || user_id || ' worth ' || (event_id % 9) AS text,")


@query("T18_validated_rules", f"""WITH {RANGES}, {TEXTS}, rt AS (SELECT *, CASE WHEN rule % 2 = 0 THEN ['click', 'user', 'x', 'y'] ELSE ['error', 'q', 'z', 'y'] END AS terms FROM ranges), h AS (SELECT r.rule, len(list_intersect(r.terms, string_split(e.text, ' '))) >= 0.3 * 4 AS ok, string_split(e.text, ' ')[1] AS word FROM lines e JOIN rt r ON e.file = r.file AND e.line BETWEEN r.first AND r.last),
c AS (SELECT rule, word, row_number() OVER (PARTITION BY rule ORDER BY count(*) DESC, word) AS k FROM h GROUP BY rule, word), w AS (SELECT rule, string_agg(word, ' ' ORDER BY k) AS first_words FROM c WHERE k <= 5 GROUP BY 1)
SELECT rule, count(*) AS events, count(*) FILTER (ok) AS matched, round(count(*) FILTER (ok) / count(*)::DOUBLE, 8) AS match_rate, count(*) FILTER (ok) >= 0.7 * count(*) AS valid, any_value(first_words) AS first_words FROM h JOIN w USING (rule) GROUP BY rule""")
def validated_rules(spark, sf):
    text = F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"), F.lit(" worth "), (F.col("event_id") % 9).cast("string"))
    events = lines(spark, sf).join(table(spark, sf, "events").select("event_id", text.alias("text")), "event_id")
    terms = F.when(F.col("rule") % 2 == 0, F.array(*map(F.lit, ("click", "user", "x", "y")))).otherwise(F.array(*map(F.lit, ("error", "q", "z", "y"))))
    return t.validated_rules(events, ranges(spark, sf).withColumn("terms", terms)).withColumn("match_rate", F.round("match_rate", 8))


@query("T19_rule_coverage", f"WITH {RANGES}, {LINES} SELECT count(*) AS rules, count(*) FILTER (EXISTS (SELECT 1 FROM lines e WHERE e.file = r.file AND e.line BETWEEN r.first AND r.last)) AS covered FROM ranges r")
def rule_coverage(spark, sf):
    all_ = ranges(spark, sf)
    seen = t.range_counts(lines(spark, sf), all_).select("rule").distinct().withColumn("hit", F.lit(1))
    return all_.join(seen, "rule", "left").agg(F.count("*").alias("rules"), F.count("hit").alias("covered"))


@query("T20_branch_gaps", "SELECT user_id, NOT bool_or(value > 40) AS missing FROM events GROUP BY user_id HAVING NOT (bool_or(value > 40) AND bool_or(value <= 40))")
def branch_gaps(spark, sf):
    return t.branch_coverage(table(spark, sf, "events").withColumn("side", F.col("value") > 40), ["user_id"], "side")[1]


@query("T20_branch_coverage", "WITH s AS (SELECT user_id, bool_or(value > 40)::INT + bool_or(value <= 40)::INT AS n FROM events GROUP BY 1) SELECT count(*) AS locations, sum(n)::BIGINT AS observed, round(100.0 * sum(n) / (2 * count(*)), 6)::DOUBLE AS coverage FROM s")
def branch_coverage(spark, sf):
    found = t.branch_coverage(table(spark, sf, "events").withColumn("side", F.col("value") > 40), ["user_id"], "side")[0]
    return found.withColumn("coverage", F.round("coverage", 6))


@query("T21_edge_case_coverage", """WITH tr AS (SELECT event_id AS trace, event_type AS domain, string_split(event_type || ' ' || (user_id % 50) || ' ' || (event_id % 30), ' ') AS w FROM events), cs AS (SELECT n_nationkey AS "case", ['click', 'error', 'view'][n_nationkey % 3 + 1] AS domain, [(n_nationkey % 3 * 11)::VARCHAR, (n_nationkey + 20)::VARCHAR, 'never', 'k' || n_nationkey] AS k FROM nation)
SELECT "case", coalesce(max(len(list_intersect(k, w))), 0) / len(list_distinct(any_value(k)))::DOUBLE > 0.3 AS covered, coalesce(max(len(list_intersect(k, w))), 0) / len(list_distinct(any_value(k)))::DOUBLE AS best FROM cs LEFT JOIN tr USING (domain) GROUP BY 1""")
def edge_cases(spark, sf):
    k = F.col("n_nationkey")
    text = lambda c: c.cast("string")
    cases = table(spark, sf, "nation").select(k.alias("case"), F.element_at(F.array(*map(F.lit, ("click", "error", "view"))), (k % 3 + 1).cast("int")).alias("domain"), F.array(text(k % 3 * 11), text(k + 20), F.lit("never"), F.concat(F.lit("k"), text(k))).alias("keywords"))
    said = F.concat_ws(" ", "event_type", text(F.col("user_id") % 50), text(F.col("event_id") % 30))
    return t.edge_case_coverage(cases, table(spark, sf, "events").select(F.col("event_id").alias("trace"), F.col("event_type").alias("domain"), said.alias("text")))


@query("T22_coverage_summary", f"WITH {RANGES}, {LINES}, c AS (SELECT r.file, avg((EXISTS (SELECT 1 FROM lines e WHERE e.file = r.file AND e.line BETWEEN r.first AND r.last))::INT) AS s FROM ranges r GROUP BY 1) SELECT file, round(s, 8) AS coverage, CASE WHEN s >= 0.8 THEN 'good' WHEN s >= 0.7 THEN 'fair' WHEN s >= 0.5 THEN 'poor' ELSE 'bad' END AS level FROM c")
def coverage_summary(spark, sf):
    all_ = ranges(spark, sf)
    seen = t.range_counts(lines(spark, sf), all_).select("rule").distinct().withColumn("hit", F.lit(1))
    share = all_.join(seen, "rule", "left").groupBy("file").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("s"))
    level = F.when(F.col("s") >= 0.8, "good").when(F.col("s") >= 0.7, "fair").when(F.col("s") >= 0.5, "poor").otherwise("bad")
    return share.select("file", F.round("s", 8).alias("coverage"), level.alias("level"))


@query("T23_observations", TRACE + """, o AS (SELECT *, lag(value) OVER (PARTITION BY session_id, type ORDER BY seq) AS before, last_value(CASE WHEN type <> 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS other, lead(type) OVER (PARTITION BY session_id ORDER BY seq) AS following FROM trace)
SELECT 'changes' AS kind, type AS key, count(*) AS n, round(avg(value - before), 6) AS mean FROM o WHERE before IS NOT NULL GROUP BY type UNION ALL SELECT 'writes', 'purchase', count(*), round(avg(value - other), 6) FROM o WHERE type = 'purchase' AND other IS NOT NULL
UNION ALL SELECT 'conditions', following, count(*), round(avg(value), 6) FROM o WHERE type = 'error' AND following IS NOT NULL GROUP BY following""")
def observations(spark, sf):
    found = t.observations(trace(spark, sf))
    step = F.round(F.avg(F.col("result") - F.col("given")), 6).alias("mean")
    some = [found[k].groupBy("key").agg(F.count("*").alias("n"), step).select(F.lit(k).alias("kind"), "key", "n", "mean") for k in ("changes", "writes")]
    last = found["conditions"].groupBy(F.col("result").alias("key")).agg(F.count("*").alias("n"), F.round(F.avg("given"), 6).alias("mean")).select(F.lit("conditions").alias("kind"), "key", "n", "mean")
    return some[0].unionByName(some[1]).unionByName(last)


@query("T24_functional_mapping", "WITH p AS (SELECT p_type AS k, p_brand AS i, count(*) AS n, count(DISTINCT p_size % 2) AS o FROM part GROUP BY 1, 2) SELECT k, sum(n)::BIGINT AS observations, count(*) AS inputs, bool_and(o = 1) AS functional FROM p GROUP BY k HAVING count(*) >= 2 AND sum(n) >= 3")
def functional(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_type").alias("k"), F.col("p_brand").alias("i"), (F.col("p_size") % 2).alias("o"))
    return t.functional_mappings(df, "k", "i", "o")


@query("T25_correlation_rules", RUNS + " SELECT round(corr(price, net), 6) AS price_net, round(corr(quantity, net), 6) AS quantity_net, round(corr(discount, net), 6) AS discount_net FROM runs")
def correlations(spark, sf):
    return runs(spark, sf).agg(*[F.round(t.guarded_corr(c, "net"), 6).alias(f"{c}_net") for c in ("price", "quantity", "discount")])


@query("T26_formulas", RUNS + """, f AS (SELECT price, discount, net, price - price * discount AS y FROM runs) SELECT formula, holds FROM (
SELECT 'y = price' AS formula, bool_and(abs(y - price) <= 1e-4) AS holds FROM f UNION ALL SELECT 'y = k * price', var_pop(y / price) < 1e-4 FROM f UNION ALL SELECT 'y = net', bool_and(abs(y - net) <= 1e-4) FROM f
UNION ALL SELECT 'y = k * net', var_pop(y / net) < 1e-4 FROM f UNION ALL SELECT 'y = price + net', bool_and(abs(y - price - net) <= 1e-4) FROM f)""")
def formulas(spark, sf):
    return t.formulas(runs(spark, sf).withColumn("y", F.col("price") - F.col("price") * F.col("discount")), ["price", "net"], "y")


@query("T27_rule_check", RUNS + " SELECT count(*) AS n, count(*) FILTER (abs(net - price * (1 - discount)) <= 0.01) AS matched, count(*) FILTER (abs(net - price * (1 - discount)) > 0.01) AS violated FROM runs")
def rule_check(spark, sf):
    return t.check_formula(runs(spark, sf), F.col("price") * (1 - F.col("discount")), "net")


@query("T28_merged_rules", """WITH r AS (SELECT event_id AS id, event_type AS category, list_sort([(event_id % 3)::VARCHAR, (event_id % 2)::VARCHAR]) AS i, [(event_id % 5)::VARCHAR] AS o, value / 1000 AS c, user_id AS s FROM events)
SELECT category, array_to_string(i, ' ') AS inputs, array_to_string(o, ' ') AS outputs, min(id) FILTER (c = m) AS id, max(c) AS confidence, sum(s)::BIGINT AS support, count(*) AS merged FROM (SELECT *, max(c) OVER (PARTITION BY category, i, o) AS m FROM r) GROUP BY category, i, o""")
def merged(spark, sf):
    k, text = F.col("event_id"), (lambda c: c.cast("string"))
    rules = table(spark, sf, "events").select(k.alias("id"), F.col("event_type").alias("category"), F.array(text(k % 3), text(k % 2)).alias("inputs"), F.array(text(k % 5)).alias("outputs"), (F.col("value") / 1000).alias("confidence"), F.col("user_id").alias("support"))
    return t.merged_rules(rules).select("category", F.array_join("inputs", " ").alias("inputs"), F.array_join("outputs", " ").alias("outputs"), "id", "confidence", "support", "merged")


@query("T28_suggested_tests", "WITH s AS (SELECT event_type AS field, min(value) AS low, max(value) AS high FROM events GROUP BY 1) SELECT field, reason, CAST(v AS VARCHAR) AS value FROM (SELECT field, 'minimum' AS reason, low AS v FROM s UNION ALL SELECT field, 'maximum', high FROM s UNION ALL SELECT field, 'middle', (low + high) / 2 FROM s UNION ALL SELECT field, 'zero', 0 FROM s) UNION ALL SELECT 'props', 'empty', ''")
def suggested(spark, sf):
    numbers = table(spark, sf, "events").groupBy(F.col("event_type").alias("field")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return t.suggested_tests(numbers.unionByName(spark.createDataFrame([("props", None, None)], "field string, low double, high double")))
