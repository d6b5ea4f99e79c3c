"""Queries of module scores, critical paths, branches, risk and effort."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators import planning as p
from tessera.plans.graph_queries import COUPLING, CYCLES, coupled, transitions
from tessera.plans.registry import query
from tessera.plans.roles import edges, modules, nodes, with_roles
from tessera.session import table

GRAPH, MODULES = with_roles("nodes", "edges"), with_roles("nodes", "edges", "modules")
MODULES_R = with_roles("nodes", "edges", "modules", recursive=True)


def case(column, values, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


@query("D4_coupling_with_cycles", CYCLES + """, ns AS (SELECT source AS id FROM trans UNION SELECT target FROM trans), on_ AS (SELECT id, count(*) AS cycles FROM (SELECT unnest(path) AS id FROM c) GROUP BY 1),
a AS (SELECT ns.id, (SELECT count(*) FROM trans WHERE target = ns.id) AS ca, (SELECT count(*) FROM trans WHERE source = ns.id) AS ce, coalesce(cycles, 0) AS cycles FROM ns LEFT JOIN on_ USING (id)),
b AS (SELECT *, coalesce(ce / nullif(ca + ce, 0)::DOUBLE, 0) AS instability FROM a)
SELECT id, ca, ce, cycles, round(instability, 8) AS instability, least(10.0, ((ca + ce) / 2.0 + 2 * cycles) * CASE WHEN instability > 0.7 OR instability < 0.3 THEN 1.5 ELSE 1 END)::DOUBLE AS score FROM b""")
def cyclic_coupling(spark, sf):
    links = transitions(spark, sf)
    ends = links.select(F.col("source").alias("id")).union(links.select("target")).distinct()
    return g.coupling(links, ends, g.simple_cycles(links)).withColumn("instability", F.round("instability", 8))


@query("D6_module_score", COUPLING.replace(GRAPH, MODULES) + f""" SELECT id, round({p.SCORE_WEIGHTS['complexity']} * (1 - least(cyclomatic / 100.0, 1)) + {p.SCORE_WEIGHTS['criticality']} * {case('criticality', p.CRITICALITY_SCORE, 0.5)}
+ {p.SCORE_WEIGHTS['dependencies']} * (1 - least(dependents / 20.0, 1)) + {p.SCORE_WEIGHTS['risk']} * (1 - score / 10), 6)::DOUBLE AS module_score FROM modules JOIN cp USING (id)""")
def module_score(spark, sf):
    joined = modules(spark, sf).join(coupled(spark, sf).select("id", F.col("score").alias("coupling")), "id")
    return joined.select("id", F.round(p.module_score(), 6).alias("module_score"))


# The graph has at most four nodes in a chain, so four steps reach every end.
CHAINS = """, w AS (SELECT id, [id] AS path, loc / 200.0::DOUBLE AS dist FROM modules UNION ALL SELECT e.source, list_append(w.path, e.source), w.dist + m.loc / 200.0::DOUBLE FROM w JOIN edges e ON e.target = w.id JOIN modules m ON m.id = e.source)"""


@query("D8_critical_path", MODULES_R + CHAINS + ", best AS (SELECT path FROM w ORDER BY dist DESC, id LIMIT 1) SELECT unnest(path) AS id FROM best")
def critical_path(spark, sf):
    return p.critical_path(longest(spark, sf)).select("id")


@query("D8_parallelization", MODULES_R + CHAINS + ", x AS (SELECT (SELECT max(dist) FROM w) AS path_length, (SELECT sum(loc / 200.0::DOUBLE) FROM modules) AS total) SELECT round(path_length, 6) AS path_length, round(total, 6) AS sequential_effort, round(total / path_length, 6) AS parallelization FROM x")
def parallelization(spark, sf):
    return p.parallelization(longest(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("path_length", "sequential_effort", "parallelization")])


def longest(spark, sf):
    return p.longest_paths(edges(spark, sf), modules(spark, sf).withColumn("effort", F.col("loc") / 200))


# In order of id, one seed after another.
BRANCHES = with_roles("nodes", "edges", recursive=True) + """, w AS (SELECT source AS id, target AS o FROM edges UNION SELECT w.id, e.target FROM w JOIN edges e ON e.source = w.o), tied AS (SELECT id, list(DISTINCT o) AS t FROM (SELECT id, o FROM w UNION ALL SELECT o, id FROM w) GROUP BY 1),
st AS (SELECT (SELECT list(id ORDER BY id) FROM nodes) AS rest, []::VARCHAR[] AS skipped, 0 AS branch, []::VARCHAR[] AS found, -1 AS number
UNION ALL SELECT CASE WHEN len(g) = 0 THEN rest[2:] ELSE list_filter(rest[2:], lambda x: NOT list_contains(g, x)) END, CASE WHEN len(g) = 0 THEN list_append(skipped, rest[1]) ELSE list_filter(skipped, lambda x: NOT list_contains(g, x)) END,
 branch + (len(g) > 0)::INT, CASE WHEN len(g) = 0 THEN [] ELSE list_append(g, rest[1]) END, branch
 FROM (SELECT st.*, list_filter(list_concat(rest[2:], skipped), lambda x: NOT list_contains(coalesce(t, []), x)) AS g FROM st LEFT JOIN tied ON tied.id = rest[1] WHERE len(rest) > 0))"""


@query("D12_parallel_branches", BRANCHES + " SELECT number AS branch, unnest(found) AS id FROM st")
def branches(spark, sf):
    return p.parallel_branches(edges(spark, sf), nodes(spark, sf))


def factor_rows(team, days):
    out = []
    for name, category, condition, severity, pr, im in p.RISK_RULES:
        test, level = (x.format(team=team, days=days) for x in (condition, severity))
        out.append(f"SELECT id, '{name}' AS factor, '{category}' AS category, {level} AS severity, least(10.0, {pr}::DOUBLE * {im}::DOUBLE * {case(f'({level})', p.SEVERITY_WEIGHT, 1)} * 2.5::DOUBLE)::DOUBLE AS score FROM modules WHERE {test}")
    return " UNION ALL ".join(out)


FACTORS = f", fs AS ({factor_rows(2, 40)})"


@query("D13_risk_factors", MODULES + FACTORS + " SELECT id, factor, category, severity, round(score, 6) AS score FROM fs")
def risk_factors(spark, sf):
    return p.risk_factors(modules(spark, sf), team=2, days=40).withColumn("score", F.round("score", 6))


@query("D13_coupled_factors", COUPLING.replace(GRAPH, MODULES) + " SELECT id, 'coupling' AS factor, 'integration' AS category, CASE WHEN score > 7 THEN 'high' ELSE 'medium' END AS severity, score FROM cp WHERE score > 5")
def coupled_factors(spark, sf):
    joined = modules(spark, sf).join(coupled(spark, sf).select("id", F.col("score").alias("coupling"), "cycles"), "id")
    return p.risk_factors(joined, coupled=True).where("factor IN ('circular', 'coupling')")


@query("D14_factor_score", MODULES + FACTORS + " SELECT factor, severity, count(*) AS n, round(max(score), 6) AS top FROM fs GROUP BY factor, severity")
def factor_scores(spark, sf):
    return p.risk_factors(modules(spark, sf), team=2, days=40).groupBy("factor", "severity").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("top"))


@query("D15_module_risk", MODULES + FACTORS + ", m AS (SELECT id, coalesce(avg(score), 0) AS score FROM modules LEFT JOIN fs USING (id) GROUP BY 1) SELECT id, round(score, 8) AS score, CASE WHEN score >= 7 THEN 'critical' WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS level FROM m")
def module_risk(spark, sf):
    df = modules(spark, sf)
    return p.module_risk(df, p.risk_factors(df, team=2, days=40)).withColumn("score", F.round("score", 8))


BASE = f"(loc * 0.5::DOUBLE / 8 * {case('CASE WHEN cyclomatic <= 10 THEN $$low$$ WHEN cyclomatic <= 20 THEN $$medium$$ WHEN cyclomatic <= 50 THEN $$high$$ ELSE $$veryHigh$$ END', p.COMPLEXITY_FACTOR, 1)} * {case('language', p.LANGUAGE_FACTOR, 1)} * {case('criticality', p.CRITICALITY_FACTOR, 1)})".replace("$$", "'")
EFFORT = ", ph AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS phase, ceil(round({BASE} * {share}::DOUBLE, 9))::BIGINT AS days FROM modules" for n, share in p.PHASES.items()) + ")"


@query("D16_phases", MODULES + EFFORT + " SELECT * FROM ph")
def phases(spark, sf):
    return p.phase_efforts(modules(spark, sf))


@query("D16_effort", MODULES + EFFORT + """, x AS (SELECT m.*, t.days * CASE WHEN external_calls > 10 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN doc_coverage < 30 THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN test_coverage < 50 THEN 1.25::DOUBLE ELSE 1 END * CASE WHEN dependencies > 15 THEN 1.1::DOUBLE ELSE 1 END
* CASE WHEN business_rules > 50 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN debt_hours > 100 THEN 1.1::DOUBLE ELSE 1 END AS total FROM modules m JOIN (SELECT id, sum(days)::DOUBLE AS days FROM ph GROUP BY 1) t USING (id))
SELECT id, ceil(round(total, 9))::BIGINT AS person_days, ceil(round(total, 9) / 5)::BIGINT AS person_weeks, round(greatest(0.3::DOUBLE, least(0.95::DOUBLE, 0.8::DOUBLE * (doc_coverage / 100.0::DOUBLE * 0.3::DOUBLE + 0.7::DOUBLE) * CASE WHEN cyclomatic > 50 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN loc > 10000 THEN 0.9::DOUBLE ELSE 1 END)), 6) AS confidence FROM x""")
def effort(spark, sf):
    return p.effort(modules(spark, sf)).withColumn("confidence", F.round("confidence", 6))


# What a supplier delivered stands for a project: items for lines, parts for structures, orders for procedures, discounts for rules.
PROJECTS = """pj AS (SELECT l_suppkey AS id, sum(l_quantity)::DOUBLE AS lines, avg(l_linenumber * 12)::DOUBLE AS procedure_complexity, count(DISTINCT l_partkey) % 31 AS structures, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') % 7 AS nested_structures,
  count(DISTINCT l_tax) % 5 AS tables, count(*) % 11 AS dependencies, count(*) FILTER (l_returnflag = 'R') % 6 AS files, count(*) FILTER (l_linestatus = 'F') % 5 AS apis, count(*) FILTER (l_discount > 0.04) % 23 AS rules, count(*) FILTER (l_discount > 0.08) % 9 AS unsure_rules,
  ['cobol-java', 'vb6-csharp', 'fortran-python', 'rpg-java'][l_suppkey % 4 + 1] AS pair, ['senior', 'mid', 'junior', 'mixed', 'other'][l_suppkey % 5 + 1] AS team, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 9 + 1 END AS team_size FROM lineitem GROUP BY l_suppkey),
c4 AS (SELECT *, least(100, floor(procedure_complexity * 2 + 0.5))::BIGINT AS code_complexity, least(100, structures * 2 + tables * 5 + nested_structures * 3)::BIGINT AS data_complexity, least(100, dependencies * 3 + files * 2 + apis * 5)::BIGINT AS integration_complexity,
  least(100, rules * 2 + unsure_rules * 5)::BIGINT AS rule_complexity FROM pj),
ov AS (SELECT *, floor(0.3::DOUBLE * code_complexity + 0.2::DOUBLE * data_complexity + 0.25::DOUBLE * integration_complexity + 0.25::DOUBLE * rule_complexity + 0.5::DOUBLE)::BIGINT AS overall FROM c4),
dy AS (SELECT *, lines / 1000 * CASE pair WHEN 'cobol-java' THEN 15 WHEN 'vb6-csharp' THEN 6 WHEN 'fortran-python' THEN 10 ELSE 12 END::DOUBLE * CASE WHEN overall < 30 THEN 1.0::DOUBLE WHEN overall < 50 THEN 1.2::DOUBLE WHEN overall < 70 THEN 1.5::DOUBLE ELSE 1.8::DOUBLE END
  * CASE WHEN dependencies + apis + files < 5 THEN 1.0::DOUBLE WHEN dependencies + apis + files < 10 THEN 1.2::DOUBLE WHEN dependencies + apis + files < 20 THEN 1.4::DOUBLE ELSE 1.6::DOUBLE END * CASE team WHEN 'senior' THEN 0.8::DOUBLE WHEN 'junior' THEN 1.3::DOUBLE WHEN 'mixed' THEN 1.1::DOUBLE ELSE 1 END AS days FROM ov),
ef AS (SELECT *, floor(days * 0.15::DOUBLE + 0.5)::BIGINT AS analysis_days, floor(days * 0.15::DOUBLE + 0.5)::BIGINT AS design_days, floor(days * 0.4::DOUBLE + 0.5)::BIGINT AS development_days, floor(days * 0.2::DOUBLE + 0.5)::BIGINT AS testing_days, floor(days * 0.1::DOUBLE + 0.5)::BIGINT AS deployment_days FROM dy),
et AS (SELECT *, analysis_days + design_days + development_days + testing_days + deployment_days AS total_days FROM ef)"""


def projects(spark, sf):
    if_ = lambda c: F.count_if(F.expr(c))
    k = F.col("l_suppkey")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    grouped = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("lines"), F.avg(F.col("l_linenumber") * 12).alias("procedure_complexity"), (F.count_distinct("l_partkey") % 31).alias("structures"),
        (F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))) % 7).alias("nested_structures"), (F.count_distinct("l_tax") % 5).alias("tables"), (F.count("*") % 11).alias("dependencies"),
        (if_("l_returnflag = 'R'") % 6).alias("files"), (if_("l_linestatus = 'F'") % 5).alias("apis"), (if_("l_discount > 0.04") % 23).alias("rules"), (if_("l_discount > 0.08") % 9).alias("unsure_rules"),
    )
    return grouped.withColumns({"pair": pick(("cobol-java", "vb6-csharp", "fortran-python", "rpg-java")), "team": pick(("senior", "mid", "junior", "mixed", "other")), "team_size": F.when(k % 3 > 0, k % 9 + 1)}).withColumnRenamed("l_suppkey", "id")


COMPLEXITIES = ("overall", "code_complexity", "data_complexity", "integration_complexity", "rule_complexity")


@query("D19_complexity", f"WITH {PROJECTS} SELECT id, {', '.join(COMPLEXITIES)} FROM ov")
def project_complexity(spark, sf):
    return p.project_complexity(projects(spark, sf)).select("id", *COMPLEXITIES)


@query("D19_phase_costs", f"""WITH {PROJECTS} SELECT id, analysis_days, design_days, development_days, testing_days, deployment_days, total_days,
floor(total_days * CASE WHEN overall < 50 THEN 1 - 0.2::DOUBLE ELSE 1 - 0.3::DOUBLE END + 0.5)::BIGINT AS least_days, floor(total_days * CASE WHEN overall < 50 THEN 1 + 0.2::DOUBLE ELSE 1 + 0.3::DOUBLE END + 0.5)::BIGINT AS most_days,
total_days * 800 AS labor, floor(total_days * 800 * 0.1::DOUBLE + 0.5)::BIGINT AS infrastructure, floor(total_days * 800 * 0.05::DOUBLE + 0.5)::BIGINT AS licensing, floor(total_days * 800 * 1.15::DOUBLE * 0.2::DOUBLE + 0.5)::BIGINT AS contingency, floor(total_days * 800 * 1.15::DOUBLE * 1.2::DOUBLE + 0.5)::BIGINT AS total_cost,
ceil(total_days / (coalesce(team_size, 3) * least(1.0::DOUBLE, 0.6::DOUBLE + coalesce(team_size, 3) * 0.1::DOUBLE)) / 5)::BIGINT AS weeks FROM et""")
def phase_costs(spark, sf):
    out = p.project_costs(p.project_effort(p.project_complexity(projects(spark, sf))))
    phases = [f"{name}_days" for name in p.PHASE_SHARES]
    return out.select("id", *phases, "total_days", "least_days", "most_days", "labor", "infrastructure", "licensing", "contingency", "total_cost", "weeks")


CODE = {"comment": "^#", "procedure": "[.]", "data": "the", "call": "des", "branch": "and|und", "opens": r"\(", "closes": r"\)"}
METRICS = """cm AS (SELECT doc_id, lang, len(p)::BIGINT AS total_lines, len(list_filter(p, lambda l: trim(l) <> '' AND NOT starts_with(l, '#')))::BIGINT AS code_lines, len(list_filter(p, lambda l: starts_with(l, '#')))::BIGINT AS comment_lines, len(list_filter(p, lambda l: trim(l) = ''))::BIGINT AS blank_lines,
greatest(1, len(regexp_extract_all(t, '[.]')))::BIGINT AS procedures, len(regexp_extract_all(t, 'the'))::BIGINT AS data_structures, len(regexp_extract_all(t, 'des'))::BIGINT AS external_calls, len(regexp_extract_all(t, 'and|und'))::BIGINT + 1 AS cyclomatic FROM (SELECT doc_id, lang, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
cx AS (SELECT *, least(100, floor(round(least(25.0::DOUBLE, log10(code_lines + 1) * 8) + least(30.0::DOUBLE, cyclomatic * 0.5::DOUBLE) + least(20.0::DOUBLE, data_structures * 2.0::DOUBLE) + least(15.0::DOUBLE, external_calls * 1.5::DOUBLE) + CASE lang WHEN 'de' THEN 10 WHEN 'fr' THEN 6 ELSE 5 END, 9) + 0.5))::INT AS overall FROM cm),
cl AS (SELECT *, CASE WHEN overall <= 15 THEN 'trivial' WHEN overall <= 30 THEN 'low' WHEN overall <= 50 THEN 'medium' WHEN overall <= 70 THEN 'high' WHEN overall <= 85 THEN 'very_high' ELSE 'extreme' END AS level FROM cx)"""


def measured(spark, sf):
    """Documents as sources; languages stand for languages."""
    docs = table(spark, sf, "documents")
    return p.code_metrics(docs, "doc_id", "text", **CODE).join(docs.select("doc_id", F.when(F.col("lang") == "de", "cobol").when(F.col("lang") == "fr", "vb6").otherwise("other").alias("language")), "doc_id")


@query("D18_code_complexity", f"WITH {METRICS} SELECT doc_id, total_lines, code_lines, comment_lines, blank_lines, procedures, data_structures, external_calls, cyclomatic, overall, level FROM cl")
def code_complexity(spark, sf):
    return p.code_complexity(measured(spark, sf), F.col("language")).drop("language", "nesting")


@query("D18_quick_estimates", f"""WITH {METRICS}, h AS (SELECT doc_id, code_lines * CASE lang WHEN 'de' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END * CASE level WHEN 'trivial' THEN 0.5::DOUBLE WHEN 'low' THEN 0.8::DOUBLE WHEN 'medium' THEN 1 WHEN 'high' THEN 1.5::DOUBLE WHEN 'very_high' THEN 2 ELSE 3 END AS h FROM cl)
SELECT doc_id, ceil(round(h / 8 * 0.8::DOUBLE, 9))::BIGINT AS least_days, ceil(round(h / 8 * 1.5::DOUBLE, 9))::BIGINT AS most_days, floor(h * 87.5::DOUBLE * 0.8::DOUBLE + 0.5)::BIGINT AS least_cost, floor(h * 87.5::DOUBLE * 1.5::DOUBLE * 1.2::DOUBLE + 0.5)::BIGINT AS most_cost FROM h""")
def quick_estimates(spark, sf):
    rated = p.code_complexity(measured(spark, sf), F.col("language"))
    return p.quick_estimates(rated, F.col("language")).select("doc_id", "least_days", "most_days", "least_cost", "most_cost")


@query("D18_batch_metrics", f"WITH {METRICS} SELECT CASE lang WHEN 'de' THEN 'cobol' WHEN 'fr' THEN 'vb6' ELSE 'other' END AS language, count(*) AS files, " + ", ".join(f"sum({x})::BIGINT AS {x}" for x in ("total_lines", "code_lines", "comment_lines", "blank_lines", "procedures", "data_structures", "external_calls", "cyclomatic")) + " FROM cm GROUP BY 1")
def batch_metrics(spark, sf):
    return p.batch_metrics(measured(spark, sf), ["language"]).drop("nesting")


@query("D20_ordered", MODULES_R + ", lv AS (SELECT id, 0 AS level FROM nodes UNION SELECT e.source, lv.level + 1 FROM lv JOIN edges e ON e.target = lv.id WHERE lv.level < 10) SELECT id, max(level)::BIGINT AS level FROM lv GROUP BY 1")
def ordered(spark, sf):
    return p.pipeline_order(g.longest_levels(edges(spark, sf), nodes(spark, sf)))
