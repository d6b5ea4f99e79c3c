"""Queries of behaviour models over line items, and of telemetry over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import models as m
from tessera.operators import quality as q
from tessera.operators import telemetry as o
from tessera.plans.registry import query
from tessera.plans.roles import legacy_modern, runs, trace, with_roles
from tessera.session import table

RUNS, TRACE = with_roles("runs"), with_roles("trace")
UNIT = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
COLUMNS = ("quantity", "price", "discount", "tax", "net")


def rounded(df, digits, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("M1_signatures", RUNS + " SELECT flag, count(*) AS n, count(*) - count(quantity) AS nulls, count(DISTINCT quantity) AS cardinality, min(quantity) AS low, max(quantity) AS high FROM runs GROUP BY flag")
def signatures(spark, sf):
    return runs(spark, sf).groupBy("flag").agg(F.count("*").alias("n"), F.count_if(F.col("quantity").isNull()).alias("nulls"), F.count_distinct("quantity").alias("cardinality"), F.min("quantity").alias("low"), F.max("quantity").alias("high"))


def moments(c):
    return f"""SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS stddev,
round(avg(power({c} - (SELECT avg({c}) FROM runs), 3)) / power(stddev_pop({c}), 3), 4) AS skewness, round(kurtosis_pop({c}), 4) AS kurtosis FROM runs"""


@query("M2_distribution", RUNS + ", d AS (" + " UNION ALL ".join(map(moments, COLUMNS)) + ") SELECT *, CASE WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 1 THEN 'normal' WHEN abs(skewness) < 0.5 AND kurtosis <= -1 THEN 'uniform' WHEN abs(skewness) >= 0.5 THEN 'skewed' ELSE 'unknown' END AS shape FROM d")
def distribution(spark, sf):
    return rounded(m.distribution(runs(spark, sf), COLUMNS), 4, "mean", "stddev", "skewness", "kurtosis")


@query("M2_histogram", RUNS + ", e AS (SELECT min(price) AS lo, max(price) AS hi FROM runs) SELECT CAST(least(floor((price - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bucket, count(*) AS n FROM runs, e GROUP BY 1")
def histogram(spark, sf):
    return m.histogram(runs(spark, sf), "price")


@query("M3_categories", "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 8) AS share FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def categories(spark, sf):
    return rounded(m.categories(table(spark, sf, "events"), "event_type"), 8, "share")


@query("M4_correlations", RUNS + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM runs" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:]))
def correlations(spark, sf):
    return rounded(m.correlation_matrix(runs(spark, sf), COLUMNS), 6, "r")


@query("M5_equalities", RUNS + " SELECT 'discount = tax' AS invariant, round(avg((discount = tax)::INT), 8) AS hold_rate FROM runs UNION ALL SELECT 'quantity = line', round(avg((quantity = line)::INT), 8) FROM runs")
def equalities(spark, sf):
    return rounded(m.equality_rates(runs(spark, sf), [("discount", "tax"), ("quantity", "line")]), 8, "hold_rate")


@query("M6_linear_fit", RUNS + ", f AS (SELECT regr_slope(net, price) AS s, regr_intercept(net, price) AS i FROM runs) SELECT round(max(s), 6) AS slope, round(max(i), 3) AS intercept, round(1 - avg(abs(net - s * price - i)) / max(net), 6) AS accuracy FROM runs, f")
def linear(spark, sf):
    return m.linear_fit(runs(spark, sf), "price", "net").select(F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("accuracy", 6).alias("accuracy"))


@query("M7_conditional", "SELECT p_brand || '/' || p_type AS given, min(p_size) AS output, count(*) AS n, round(least(2.0 * count(*) / (SELECT count(*) FROM part), 0.95), 8)::DOUBLE AS confidence FROM part GROUP BY 1 HAVING count(DISTINCT p_size) = 1 AND count(*) >= 1")
def conditional(spark, sf):
    df = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("given"), "p_size")
    return rounded(m.conditional_constants(df, "given", "p_size", 1), 8, "confidence")


@query("M8_constraints", RUNS + " " + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) = count(*) AS required, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM runs" for c in ("quantity", "price", "discount", "tax")))
def constraints(spark, sf):
    df = runs(spark, sf)
    wide = df.agg(*[x for c in ("quantity", "price", "discount", "tax") for x in ((F.count_if(F.col(c).isNull()) == 0).alias(f"r_{c}"), F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"r_{c}").alias("required"), F.col(f"l_{c}").cast("double").alias("low"), F.col(f"h_{c}").cast("double").alias("high")) for c in ("quantity", "price", "discount", "tax")])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


@query("M9_edge_cases", RUNS + ", s AS (SELECT avg(net) AS a, stddev_pop(net) AS d FROM runs) SELECT flag, count(*) AS n, round(max(net), 4) AS top FROM runs, s WHERE abs(net - a) > 2 * d GROUP BY flag")
def edge_cases(spark, sf):
    return m.outliers(runs(spark, sf), "net").groupBy("flag").agg(F.count("*").alias("n"), F.round(F.max("net"), 4).alias("top"))


@query("M10_model_quality", RUNS + " SELECT round((avg((abs(net - price * (1 - discount)) < 1e-6)::INT) + avg((net <= price)::INT) + avg((tax >= 0)::INT)) / 3, 8) AS quality FROM runs")
def quality(spark, sf):
    return rounded(m.model_quality(runs(spark, sf), {"net": "abs(net - price * (1 - discount)) < 1e-6", "at most": "net <= price", "tax": "tax >= 0"}), 8, "quality")


@query("M11_predict", RUNS + ", a AS (SELECT flag, avg(net) AS mean FROM runs GROUP BY 1) SELECT r.flag, round(avg(abs(coalesce(r.price * (1 - r.discount), a.mean) - r.net)), 6) AS error FROM runs r JOIN a ON r.flag = a.flag GROUP BY r.flag")
def predict(spark, sf):
    df = runs(spark, sf)
    guess = F.coalesce(F.col("price") * (1 - F.col("discount")), F.col("mean"))
    return df.join(df.groupBy("flag").agg(F.avg("net").alias("mean")), "flag").groupBy("flag").agg(F.round(F.avg(F.abs(guess - F.col("net"))), 6).alias("error"))


PAIRS = with_roles("pairs")


@query("M9_rare_values", RUNS + " SELECT quantity AS value, count(*) AS n FROM runs GROUP BY 1 HAVING count(*) < 0.0205 * (SELECT count(*) FROM runs)")
def rare(spark, sf):
    return m.rare_values(runs(spark, sf), "quantity", 0.0205)


INVARIANTS = {"net at most price": "net <= price", "tax under 0.08": "tax < 0.08", "discount under 0.1": "discount < 0.0999"}


@query("M9_violations", RUNS + ", v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS invariant, count(*) FILTER (NOT ({c})) AS violations, count(*) AS n FROM runs" for k, c in INVARIANTS.items()) + ") SELECT invariant, violations, round(violations / n::DOUBLE, 8) AS rate FROM v WHERE violations > 0 AND violations / n::DOUBLE < 0.2")
def invariant_violations(spark, sf):
    return rounded(m.violations(runs(spark, sf), INVARIANTS, 0.2), 8, "rate")


@query("M12_divergences", PAIRS + """, j AS (SELECT a.k1, a.price AS p, b.price AS q, b.quantity AS n FROM legacy a JOIN modern b ON a.k1 = b.k1 AND a.k2 = b.k2)
SELECT CASE WHEN abs(p - q) <= 0.1 THEN NULL WHEN n IS NULL THEN 'edge_case' WHEN abs(p - q) <= 1.0 THEN 'tolerance_issue' WHEN k1 % 2 = 0 THEN 'model_error' ELSE 'code_bug' END AS kind, count(*) AS n FROM j GROUP BY 1""")
def divergences(spark, sf):
    a, b = legacy_modern(spark, sf)
    joined = a.select("k1", "k2", F.col("price").alias("p")).join(b.select("k1", "k2", F.col("price").alias("q"), "quantity"), ["k1", "k2"])
    sure = F.when(F.col("k1") % 2 == 0, 0.5).otherwise(0.9)
    return joined.groupBy(m.divergence_kind(F.col("p"), F.col("q"), 0.1, sure, F.col("quantity").isNull()).alias("kind")).agg(F.count("*").alias("n"))


@query("M13_validation_run", RUNS + " SELECT 'net' AS \"check\", 'error' AS severity, count(*) FILTER (net <= price) AS passed, count(*) FILTER (NOT net <= price) AS failed, false AS alert FROM runs UNION ALL SELECT 'discount', 'warning', count(*) FILTER (discount <= 0.05), count(*) FILTER (NOT discount <= 0.05), count(*) FILTER (NOT discount <= 0.05) > 0.3 * count(*) FROM runs")
def validation_run(spark, sf):
    checks = {"net": (F.col("net") <= F.col("price"), "error"), "discount": (F.col("discount") <= 0.05, "warning")}
    return m.validation_run(runs(spark, sf), checks, {"net": 0.0, "discount": 0.3}).drop("rate")


@query("M14_failure_groups", RUNS + " SELECT flag || ':' || status AS grp, count(*) AS n FROM runs WHERE discount > 0.05 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, grp LIMIT 10")
def failure_groups(spark, sf):
    return m.failure_groups(runs(spark, sf).where("discount > 0.05"), ["flag", "status"])


@query("M15_drift", RUNS + ", a AS (SELECT * FROM runs WHERE ts < TIMESTAMP '1998-01-01'), b AS (SELECT * FROM runs WHERE ts >= TIMESTAMP '1998-01-01'), d AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, abs((SELECT avg({c}) FROM b) - (SELECT avg({c}) FROM a)) / abs((SELECT avg({c}) FROM a)) AS s, abs((SELECT count(DISTINCT {c}) FROM b) - (SELECT count(DISTINCT {c}) FROM a)) / (SELECT count(DISTINCT {c}) FROM a)::DOUBLE AS k" for c in ("quantity", "price", "discount")) + ") SELECT column_name, round(s, 6) AS mean_shift, round(k, 6) AS cardinality_shift, s > 0.1 OR k > 0.2 AS drifted FROM d")
def drift(spark, sf):
    df = runs(spark, sf)
    out = m.drift(df.where("ts < TIMESTAMP_NTZ '1998-01-01'"), df.where("ts >= TIMESTAMP_NTZ '1998-01-01'"), ("quantity", "price", "discount"))
    return rounded(out, 6, "mean_shift", "cardinality_shift")


HALVES = RUNS + ", a AS (SELECT * FROM runs WHERE quantity < 25), b AS (SELECT * FROM runs WHERE quantity >= 25), h AS (SELECT 'cheap' AS invariant, (SELECT avg((price < 40000)::INT) FROM a) AS before, (SELECT avg((price < 40000)::INT) FROM b) AS after UNION ALL SELECT 'taxed', (SELECT avg((tax > 0.01)::INT) FROM a), (SELECT avg((tax > 0.01)::INT) FROM b))"


def halves(spark, sf):
    df = runs(spark, sf)
    return df.where("quantity < 25"), df.where("quantity >= 25")


HOLDS = {"cheap": "price < 40000", "taxed": "tax > 0.01"}


@query("M15_hold_rates", HALVES + " SELECT invariant, round(before, 8) AS before, round(after, 8) AS after, before - after > 0.1 AS drifted FROM h")
def hold_rates(spark, sf):
    return rounded(m.hold_rates(*halves(spark, sf), HOLDS), 8, "before", "after")


@query("M15_drift_score", HALVES + """, d AS (SELECT abs((SELECT avg(price) FROM b) - (SELECT avg(price) FROM a)) / (SELECT avg(price) FROM a) AS s, abs((SELECT count(DISTINCT price) FROM b) - (SELECT count(DISTINCT price) FROM a)) / (SELECT count(DISTINCT price) FROM a)::DOUBLE AS k),
f AS (SELECT coalesce(avg(before - after) FILTER (before - after > 0.1), 0) AS c, count(*) FILTER (before - after > 0.1) AS n FROM h), r AS (SELECT greatest(CASE WHEN s > 0.1 THEN s ELSE 0 END, CASE WHEN k > 0.2 THEN k ELSE 0 END, c) AS score, (s > 0.1)::INT + (k > 0.2)::INT + n AS findings FROM d, f)
SELECT round(score, 6) AS score, findings, score > 0.2 OR findings >= 3 AS retrain FROM r""")
def drift_score(spark, sf):
    a, b = halves(spark, sf)
    return rounded(m.drift_score(m.drift(a, b, ["price"]), m.hold_rates(a, b, HOLDS)), 6, "score")


@query("M16_trend", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS k, ok / n::DOUBLE - lag(ok / n::DOUBLE) OVER (ORDER BY day) AS change FROM d) SELECT CAST(day AS VARCHAR) AS day, n, ok, round(change, 8) AS change FROM r WHERE k <= 10")
def trend(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
    # One row a day: the last eleven days suffice for ten changes.
    last = days.orderBy(F.desc("day")).limit(11)
    return last.select("day", "n", "ok", F.round(F.expr("ok / n - lag(ok / n) OVER (ORDER BY day)"), 8).alias("change")).orderBy(F.desc("day")).limit(10).withColumn("day", F.col("day").cast("string"))


def signature(spark, sf):
    df = runs(spark, sf)
    parts = [df.agg(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("stddev")).select(F.lit(c).alias("name"), "*") for c in ("quantity", "price")]
    return q.union_all(parts)


@query("M17_boundary_cases", RUNS + ", s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, avg({c}) AS mean, stddev_pop({c}) AS sd FROM runs" for c in ("quantity", "price")) + """)
SELECT name, \"case\", round(value, 3) AS value FROM (SELECT name, unnest(['min','below-min','max','above-max','zero','minus-one','mean-2s','mean+2s','beyond']) AS \"case\", unnest([low, low - 0.001, high, high + 0.001, 0, -1, mean - 2 * sd, mean + 2 * sd, high * 1.1]) AS value FROM s)""")
def boundary(spark, sf):
    return rounded(m.boundary_cases(signature(spark, sf)), 3, "value")




@query("M17_random_cases", RUNS + ", s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM runs" for c in ("quantity", "price")) + "), d AS (SELECT *, unnest(range(1, 101)) AS k FROM s) SELECT name, k::INT AS k, round(low + " + UNIT.format("'7:' || name || ':' || k") + " * (high - low), 6) AS value FROM d")
def random_cases(spark, sf):
    return rounded(m.random_cases(signature(spark, sf), 100, 7), 6, "value")


@query("M17_partition_cases", RUNS + ", q AS (SELECT min(price) AS a, quantile_disc(price, 0.25) AS b, quantile_disc(price, 0.5) AS c, quantile_disc(price, 0.75) AS d, max(price) AS e, avg(price) AS m FROM runs) SELECT 'quarter-1' AS \"case\", round((a + b) / 2, 4) AS value FROM q UNION ALL SELECT 'quarter-2', round((b + c) / 2, 4) FROM q UNION ALL SELECT 'quarter-3', round((c + d) / 2, 4) FROM q UNION ALL SELECT 'quarter-4', round((d + e) / 2, 4) FROM q UNION ALL SELECT 'mean', round(m, 4) FROM q")
def partition_cases(spark, sf):
    return rounded(m.partition_cases(runs(spark, sf), "price"), 4, "value")


@query("M17_edge_cases", RUNS + " SELECT invariant, 'edge' AS strategy, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS invariant FROM runs WHERE NOT ({c})" for k, c in INVARIANTS.items()) + ") GROUP BY 1")
def edge_strategy(spark, sf):
    cases = runs(spark, sf).withColumn("id", F.col("run_id") * 10 + F.col("line"))
    return m.edge_and_invariant_cases(cases, INVARIANTS).where("strategy = 'edge'").groupBy("invariant", "strategy").agg(F.count("*").alias("n"))


@query("M18_synthesis_quality", RUNS + """, c AS (SELECT * FROM runs WHERE discount > 0.05), v AS (SELECT ((SELECT count(DISTINCT quantity) FROM c) / (SELECT count(DISTINCT quantity) FROM runs)::DOUBLE + (SELECT count(DISTINCT discount) FROM c) / (SELECT count(DISTINCT discount) FROM runs)::DOUBLE) / 2 AS value_coverage, (SELECT count(DISTINCT flag) FROM c) / 4.0 AS inv, least(1.0, (SELECT count(DISTINCT quantity) FROM c WHERE quantity > 45) / 10.0) AS edge, (SELECT count(DISTINCT status) FROM c) / 6.0::DOUBLE AS diversity)
SELECT (SELECT count(*) FROM c) AS cases, round(value_coverage, 6) AS value_coverage, inv::DOUBLE AS invariant_coverage, edge::DOUBLE AS edge_coverage, round(0.4 * value_coverage + 0.3 * inv + 0.3 * edge, 6)::DOUBLE AS overall, round(diversity, 6) AS diversity FROM v""")
def synthesis_quality(spark, sf):
    df = runs(spark, sf)
    cases = df.where("discount > 0.05").withColumns({"strategy": F.col("status"), "invariant": F.col("flag"), "edge": F.when(F.col("quantity") > 45, F.col("quantity"))})
    return rounded(m.synthesis_quality(cases, df, ["quantity", "discount"], 4, 10), 6, "value_coverage", "overall", "diversity")


@query("M19_golden_dataset", "WITH c AS (SELECT md5(CAST(l_linenumber AS VARCHAR) || '|' || l_returnflag || '|' || l_linestatus) AS input_hash, l_orderkey * 10 + l_linenumber AS id, l_quantity AS pr FROM lineitem), r AS (SELECT input_hash, id, count(*) OVER (PARTITION BY input_hash) AS replaced, row_number() OVER (PARTITION BY input_hash ORDER BY pr DESC, id) AS k FROM c) SELECT input_hash, id, replaced FROM r WHERE k = 1")
def golden(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return m.golden_dataset(df, ["l_linenumber", "l_returnflag", "l_linestatus"], "l_quantity", "id")


@query("M20_stratified_selection", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY " + UNIT.format("'1:' || o_orderkey") + ", o_orderkey) AS k FROM orders) WHERE k <= 20")
def selection(spark, sf):
    return m.stratified(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 20).select("o_orderkey", "o_orderstatus", "o_orderpriority")


# The first twenty by priority; then one by one the order that shares least with those selected.
DIVERSE = """WITH RECURSIVE c AS (SELECT o_orderkey AS id, o_orderstatus AS f1, o_orderpriority AS f2, strftime(o_orderdate, '%Y-%m') AS f3, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END, o_orderkey) AS r FROM orders),
b AS (SELECT * FROM c WHERE r <= 20), rest AS (SELECT * FROM c WHERE (f1, f2, f3) NOT IN (SELECT (f1, f2, f3) FROM b)),
g AS (SELECT 20::BIGINT AS k, (SELECT list(id) FROM b) AS ids, (SELECT list(f1) FROM b) AS s1, (SELECT list(f2) FROM b) AS s2, (SELECT list(f3) FROM b) AS s3
UNION ALL SELECT k + 1, list_append(ids, p.id), list_append(s1, p.f1), list_append(s2, p.f2), list_append(s3, p.f3) FROM (SELECT g.k, any_value(ids) AS ids, any_value(s1) AS s1, any_value(s2) AS s2, any_value(s3) AS s3,
 arg_min({'id': id, 'f1': f1, 'f2': f2, 'f3': f3}, (len(list_filter(s1, lambda x: x = f1)) + len(list_filter(s2, lambda x: x = f2)) + len(list_filter(s3, lambda x: x = f3))) * 1000000000 + r) AS p FROM g, rest WHERE NOT list_contains(ids, id) GROUP BY g.k) WHERE k < 40)"""


@query("M20_diverse_selection", DIVERSE + " SELECT unnest(ids) AS o_orderkey FROM g WHERE k = 40")
def diverse(spark, sf):
    kind = F.col("o_orderpriority")
    rank = F.when(kind == "1-URGENT", "critical").when(kind == "2-HIGH", "high").when(kind == "3-MEDIUM", "medium").when(kind == "5-LOW", "low").otherwise("none")
    cases = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", kind, F.date_format("o_orderdate", "yyyy-MM").alias("month"), rank.alias("priority"))
    return m.diverse_selection(cases, "o_orderkey", ["o_orderstatus", "o_orderpriority", "month"], "priority", 40).select("o_orderkey")


def bounds_of_runs(spark, sf):
    of = runs(spark, sf).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("quantity", "price", "discount") for f in (F.min, F.max)])
    return of.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"min_{c}").alias("low"), F.col(f"max_{c}").alias("high")) for c in ("quantity", "price", "discount")])).alias("x")).select("x.*")


BOUNDS = RUNS + ", b AS (SELECT unnest(['quantity', 'price', 'discount']) AS name, unnest([min(quantity), min(price), min(discount)]) AS low, unnest([max(quantity), max(price), max(discount)]) AS high FROM runs)"


@query("M26_symbolic_cases", BOUNDS + " SELECT name, unnest(['low', 'high', 'zero', 'middle', 'outside']) AS \"case\", unnest([low, high, 0, low + (high - low) / 2, CASE WHEN low > 0 THEN -1 ELSE high + 1 END]) AS value FROM b")
def symbolic(spark, sf):
    return m.symbolic_cases(bounds_of_runs(spark, sf))


@query("M26_property_cases", BOUNDS + " SELECT name, unnest(['positive', 'negative', 'zero', 'large', 'small']) AS property, unnest([abs(high), -abs(low), 0, high, low]) AS value FROM b")
def properties(spark, sf):
    return m.property_cases(bounds_of_runs(spark, sf))


RULE = {"any": [{"all": [{"field": "quantity", "operator": "greater_than", "value": 10}, {"field": "discount", "operator": "less_or_equal", "value": 3}]}, {"not": {"field": "price", "operator": "less_than", "value": 900}}]}


# Each comparison decides alone: the other of its pair holds, and the other way to the whole does not.
@query("M26_branch_cases", BOUNDS + """, u AS (SELECT max((low + high) / 2) FILTER (name = 'quantity') AS q, max((low + high) / 2) FILTER (name = 'discount') AS d, max((low + high) / 2) FILTER (name = 'price') AS p FROM b),
c AS (SELECT 0 AS leaf, s.side, s.v AS quantity, least(d, 2) AS discount, least(p, 899) AS price FROM u, (VALUES ('below', 9::DOUBLE), ('on', 10), ('above', 11)) s(side, v) UNION ALL SELECT 1, s.side, greatest(q, 11), s.v, least(p, 899) FROM u, (VALUES ('below', 2::DOUBLE), ('on', 3), ('above', 4)) s(side, v)
UNION ALL SELECT 2, s.side, least(q, 9), d, s.v FROM u, (VALUES ('below', 899::DOUBLE), ('on', 900), ('above', 901)) s(side, v)) SELECT *, (quantity > 10 AND discount <= 3) OR NOT price < 900 AS outcome FROM c""")
def branch_cases(spark, sf):
    return m.branch_cases(RULE, bounds_of_runs(spark, sf), ["quantity", "price", "discount"])


@query("M25_partition_cases", RUNS + """, q AS (SELECT flag, [min(quantity), quantile_disc(quantity, 0.25), quantile_disc(quantity, 0.5), quantile_disc(quantity, 0.75), max(quantity)] AS c, avg(quantity) AS mean FROM runs GROUP BY 1)
SELECT flag, unnest(['quarter-1', 'quarter-2', 'quarter-3', 'quarter-4', 'mean']) AS \"case\", round(unnest([(c[1] + c[2]) / 2, (c[2] + c[3]) / 2, (c[3] + c[4]) / 2, (c[4] + c[5]) / 2, mean]), 6)::DOUBLE AS value FROM q""")
def partition_cases_of_rules(spark, sf):
    """Rules are what a return flag says of quantities."""
    cases = m.partition_cases(runs(spark, sf), "quantity", by=["flag"])
    return cases.select("flag", "case", F.round("value", 6).alias("value"))


@query("M25_random_cases", RUNS + ", s AS (SELECT flag AS name, min(quantity)::DOUBLE AS low, max(quantity)::DOUBLE AS high FROM runs GROUP BY 1), d AS (SELECT name, low, high, unnest(range(1, 101))::INT AS k FROM s) SELECT name, k, round(low + " + UNIT.format("'5:' || name || ':' || k") + " * (high - low), 6)::DOUBLE AS value FROM d")
def random_cases_of_rules(spark, sf):
    signature = runs(spark, sf).groupBy(F.col("flag").alias("name")).agg(F.min("quantity").cast("double").alias("low"), F.max("quantity").cast("double").alias("high"))
    return m.random_cases(signature, 100, 5).select("name", "k", F.round("value", 6).alias("value"))


@query("M21_anonymize", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS hashed, regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[A-Za-z]', 'X', 'g') AS masked, CAST(floor(c_acctbal / 100) * 100 AS BIGINT) AS general, 'tok_' || substr(md5(c_mktsegment), 1, 12) AS token FROM customer")
def anonymize(spark, sf):
    name = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", m.anonymized(name, "hash").alias("hashed"), m.anonymized(name, "mask").alias("masked"), m.anonymized(F.col("c_acctbal"), "generalize").cast("long").alias("general"), m.anonymized(F.col("c_mktsegment"), "tokenize").alias("token"))


@query("M22_behaviour_drift", PAIRS + ", now AS (SELECT k1, k2, max(price) AS p FROM modern GROUP BY 1, 2), was AS (SELECT k1, k2, max(price) AS p FROM legacy GROUP BY 1, 2) SELECT count(*) AS cases, count(*) FILTER (was.k1 IS NULL) AS new_inputs, count(*) FILTER (was.k1 IS NOT NULL AND was.p <> now.p) AS changed, round(count(*) FILTER (was.k1 IS NULL OR was.p <> now.p) / count(*)::DOUBLE, 8) AS drift FROM now LEFT JOIN was ON now.k1 = was.k1 AND now.k2 = was.k2")
def behaviour_drift(spark, sf):
    a, b = legacy_modern(spark, sf)
    return rounded(m.case_drift(a, b, ["k1", "k2"], "price"), 8, "drift")


@query("M23_dataset_stats", "SELECT o_orderpriority AS priority, o_orderstatus AS strategy, count(*) AS n FROM orders GROUP BY CUBE (1, 2)")
def dataset_stats(spark, sf):
    return table(spark, sf, "orders").cube(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("strategy")).agg(F.count("*").alias("n"))


@query("M26_mutations", "WITH t AS (SELECT c_custkey, c_name AS t FROM customer) SELECT c_custkey, unnest(['reverse', 'upper', 'empty', 'repeat', 'cut', 'pad', 'swap', 'double']) AS mutation, unnest([reverse(t), upper(t), '', repeat(t, 3), left(t, length(t) // 2), ' ' || t || ' ', substr(t, 2, 1) || left(t, 1) || substr(t, 3), left(t, 1) || t]) AS value FROM t")
def mutated(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.explode(m.mutations(F.col("c_name"))).alias("x")).select("c_custkey", "x.*")


def suite_changes_(spark, sf):
    """Orders as changes of their customer's suite, months as versions."""
    version = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("suite"), version.alias("version"), F.col("o_orderkey").alias("test"), F.col("o_orderpriority").alias("rule"))


SUITE = "ch AS (SELECT o_custkey AS suite, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS version, o_orderpriority AS rule FROM orders)"


@query("M28_suite_versions", f"WITH {SUITE} SELECT suite, count(*) AS changes, max(version)::INT AS last_version FROM ch WHERE version > 6 AND version <= 60 GROUP BY 1")
def suite_versions(spark, sf):
    return m.suite_changes(suite_changes_(spark, sf), 6, 60)


@query("M28_suite_coverage", f"WITH {SUITE}, r AS (SELECT DISTINCT rule FROM ch UNION SELECT 'never tested') SELECT suite, count(DISTINCT rule) AS covered, round(100.0 * count(DISTINCT rule) / (SELECT count(*) FROM r), 6)::DOUBLE AS percent FROM ch GROUP BY 1")
def suite_coverage(spark, sf):
    changes = suite_changes_(spark, sf)
    rules = changes.select("rule").distinct().union(spark.createDataFrame([("never tested",)], "rule string"))
    return rounded(m.suite_coverage(changes, rules), 6, "percent")


# --- telemetry ---


@query("O1_ingest_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click', 'view') AND event_type NOT IN ('view') AND value >= 5 GROUP BY 1")
def ingest(spark, sf):
    return o.ingest(table(spark, sf, "events"), ("error", "click", "view"), ("view",), 5.0, kind="event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query("O3_span_conversion", "SELECT event_id, CAST(round(value * 1000000) AS BIGINT) AS nanos, CASE event_type WHEN 'click' THEN 'client' WHEN 'view' THEN 'server' ELSE 'internal' END AS kind, event_type <> 'error' AS ok FROM events")
def spans(spark, sf):
    kind = F.when(F.col("event_type") == "click", "client").when(F.col("event_type") == "view", "server").otherwise("internal")
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") * 1_000_000).cast("long").alias("nanos"), kind.alias("kind"), (F.col("event_type") != "error").alias("ok"))


RECORDS = "rec AS (SELECT event_id, CASE event_type WHEN 'error' THEN 30 WHEN 'purchase' THEN 101 WHEN 'click' THEN 110 WHEN 'view' THEN 116 ELSE 99 END AS record_type, ts, 'P' || user_id AS name, floor(value * 10) AS elapsed_ms, CASE WHEN event_id % 7 = 0 THEN 'ASRA' END AS abend, event_id % 3 AS aborts, event_id % 9 AS return_code, value / 2 AS cpu_ms, event_id % 50 AS rows, event_id % 4 AS puts, CASE WHEN event_id % 5 <> 0 THEN event_id % 6 END AS gets FROM events)"


def records(spark, sf):
    k, kind = F.col("event_id"), F.col("event_type")
    number = F.when(kind == "error", 30).when(kind == "purchase", 101).when(kind == "click", 110).when(kind == "view", 116).otherwise(99)
    return table(spark, sf, "events").select(
        "event_id", number.alias("record_type"), "ts", F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("name"), F.floor(F.col("value") * 10).alias("elapsed_ms"), F.when(k % 7 == 0, "ASRA").alias("abend"), (k % 3).alias("aborts"), (k % 9).alias("return_code"),
        (F.col("value") / 2).alias("cpu_ms"), (k % 50).alias("rows"), (k % 4).alias("puts"), F.when(k % 5 != 0, k % 6).alias("gets"),
    )


@query("O4_record_spans", f"WITH {RECORDS} SELECT CASE record_type WHEN 30 THEN 'batch' WHEN 101 THEN 'db2' WHEN 110 THEN 'cics' ELSE 'mq' END AS subsystem, CASE record_type WHEN 30 THEN 'BATCH:' WHEN 101 THEN 'DB2:' WHEN 110 THEN 'CICS:' ELSE 'MQ:' END || name AS operation, CASE WHEN record_type = 110 AND abend IS NOT NULL OR record_type = 101 AND aborts > 0 OR record_type = 30 AND return_code > 4 THEN 'ERROR' ELSE 'OK' END AS status, count(*) AS n, sum(CASE WHEN record_type <> 116 THEN elapsed_ms END)::BIGINT AS total FROM rec WHERE record_type <> 99 GROUP BY 1, 2, 3")
def record_spans(spark, sf):
    return o.smf_spans(records(spark, sf)).groupBy("subsystem", "operation", "status").agg(F.count("*").alias("n"), F.sum("duration").cast("long").alias("total"))


@query("O5_records_to_metrics", f"WITH {RECORDS}, p AS (SELECT 'cics.response_time' AS metric, elapsed_ms::DOUBLE AS v FROM rec WHERE record_type = 110 UNION ALL SELECT 'cics.cpu_time', cpu_ms FROM rec WHERE record_type = 110 UNION ALL SELECT 'db2.elapsed_time', elapsed_ms FROM rec WHERE record_type = 101 UNION ALL SELECT 'db2.rows_fetched', rows FROM rec WHERE record_type = 101 UNION ALL SELECT 'mq.messages_put', puts FROM rec WHERE record_type = 116 UNION ALL SELECT 'mq.messages_got', gets FROM rec WHERE record_type = 116) SELECT metric, count(v) AS n, round(sum(v), 2) AS total FROM p GROUP BY metric")
def records_to_metrics(spark, sf):
    return o.smf_metrics(records(spark, sf)).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("O6_metric_merge", "SELECT event_type || ':' || (user_id % 3) AS series, count(*) AS points, min(event_id) AS first_event FROM events GROUP BY 1")
def metric_merge(spark, sf):
    points = table(spark, sf, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 3).cast("string").alias("subsystem"), "event_id")
    half = F.col("event_id") % 2 == 0
    return o.merged_series(points.where(half), points.where(~half)).groupBy("series").agg(F.count("*").alias("points"), F.min("event_id").alias("first_event"))


@query("O7_counter_export", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def counter(spark, sf):
    return o.cumulative(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value", F.to_date("ts")).select("event_id", F.round("total", 4).alias("total"))


@query("O8_metric_query", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value >= 50 AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25' ORDER BY ts, event_id LIMIT 100")
def metric_query(spark, sf):
    hits = table(spark, sf, "events").where("event_type = 'purchase' AND value >= 50 AND ts BETWEEN TIMESTAMP_NTZ '2024-01-02' AND TIMESTAMP_NTZ '2024-01-25'")
    return hits.orderBy("ts", "event_id").limit(100).select("event_id")


@query("O9_correlation", "SELECT e.user_id, count(*) AS pairs FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 6 HOUR GROUP BY 1")
def correlation(spark, sf):
    ev = table(spark, sf, "events")
    e = ev.where("event_type = 'error'").select("user_id", F.col("ts").alias("ets"))
    p = ev.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("pts"))
    return e.join(p, "user_id").where("pts BETWEEN ets AND ets + INTERVAL 6 HOURS").groupBy("user_id").agg(F.count("*").alias("pairs"))


@query("O11_histogram_buckets", " UNION ALL ".join(f"SELECT event_type, {b}::DOUBLE AS le, count(*) FILTER (value / 100 <= {b}) AS \"count\" FROM events GROUP BY 1" for b in o.BUCKETS) + " UNION ALL SELECT event_type, NULL, count(*) FROM events GROUP BY 1")
def buckets(spark, sf):
    return o.bucket_counts(table(spark, sf, "events").withColumn("v", F.col("value") / 100), ["event_type"], "v")


@query("O12_path_normalization", "SELECT regexp_replace(regexp_extract(url, '^https?://[^/]+([^?]*)', 1), '/[0-9]+', '/:id', 'g') AS path, count(*) AS n FROM pages GROUP BY 1")
def paths(spark, sf):
    path = F.regexp_extract("url", "^https?://[^/]+([^?]*)", 1)
    return table(spark, sf, "pages").groupBy(o.normal_path(path).alias("path")).agg(F.count("*").alias("n"))


@query("O13_series_stats", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), s AS (SELECT event_type, list_sort(list(value)) AS v, sum(value) AS s, avg(value) AS a FROM r WHERE k <= 1000 GROUP BY 1) SELECT event_type, len(v) AS n, round(s, 2) AS \"sum\", round(a, 6) AS mean, v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[floor(len(v) * 0.99)::INT + 1] AS p99 FROM s")
def series(spark, sf):
    out = o.floor_percentiles(table(spark, sf, "events"), ["event_type"], "value", (0.5, 0.95, 0.99), "ts DESC, event_id DESC")
    return rounded(out, 6, "mean").withColumn("sum", F.round("sum", 2))


LIMITS = [("click", "gt", 100.0), ("error", "gte", 20.0), ("purchase", "lt", 1.0), ("view", "lte", 0.5)]


@query("O14_alerts", "WITH l(event_type, op, threshold) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in LIMITS) + ") SELECT event_type, op, count(*) AS n FROM events JOIN l USING (event_type) WHERE CASE op WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold WHEN 'gte' THEN value >= threshold WHEN 'lte' THEN value <= threshold END GROUP BY 1, 2")
def alerts(spark, sf):
    limits = F.broadcast(spark.createDataFrame(LIMITS, "event_type string, op string, threshold double"))  # configuration, four rows
    return o.alerts(table(spark, sf, "events"), limits, "event_type", "value").groupBy("event_type", "op").agg(F.count("*").alias("n"))


HYSTERESIS = TRACE + """, a AS (SELECT session_id, seq, type <> 'error' AS ok, CASE WHEN (type <> 'error') = lag(type <> 'error') OVER w THEN 0 ELSE 1 END AS n FROM trace WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
b AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY seq) AS streak FROM b),
d AS (SELECT *, CASE WHEN NOT ok AND streak >= 2 THEN 'unhealthy' WHEN ok AND streak >= 3 THEN 'healthy' END AS s FROM c), h AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'unknown') AS state FROM d)"""


def hysteresis(spark, sf):
    checks = trace(spark, sf).select("session_id", "seq", (F.col("type") != "error").alias("ok"))
    return o.consecutive(checks, ["session_id"], ["seq"], "ok", failures=2, successes=3)


@query("O15_consecutive_health", HYSTERESIS + " SELECT session_id, state, count(*) AS n FROM h GROUP BY 1, 2")
def health(spark, sf):
    return hysteresis(spark, sf).groupBy("session_id", "state").agg(F.count("*").alias("n"))


@query("O16_window_health", """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS e, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1)
SELECT start, n, round(e, 6) AS error_rate, p99, round(1 - e, 6) AS availability, CASE WHEN greatest(e / 0.5, p99 / 200.0) >= 2 OR 1 - e < 0.9 * 0.85 THEN 'critical' WHEN greatest(e / 0.5, p99 / 200.0) > 1 OR 1 - e < 0.85 THEN 'warning' ELSE 'healthy' END AS status FROM w""")
def window_health(spark, sf):
    out = o.window_health(table(spark, sf, "events"), [], "ts", "value", F.col("event_type") == "error", "1 hour", 200.0, 0.5, 0.85)
    return rounded(out, 6, "error_rate", "availability").withColumn("start", F.col("start").cast("timestamp_ntz"))


# Hourly sketches merged by event type: exact counts and extremes, percentiles whose true rank is as near as stated (a margin for small groups).
@query("O16_merged_percentiles", "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, true AS p50_near, true AS p99_near FROM events WHERE value IS NOT NULL GROUP BY 1")
def merged_percentiles(spark, sf):
    points = table(spark, sf, "events")
    stored = o.percentile_sketches(points, ["event_type"], "ts", "value", "1 hour")
    merged = o.merged_percentiles(stored, ["event_type"])
    ranks = points.join(F.broadcast(merged), "event_type").groupBy("event_type", "n", "low", "high").agg(*[
        F.struct((F.avg((F.col("value") < F.col(p)).cast("double"))).alias("under"), F.avg((F.col("value") <= F.col(p)).cast("double")).alias("upto")).alias(p) for p in ("p50", "p99")
    ])
    near = lambda p, q: ((F.col(f"{p}.under") <= q + 2 * o.KLL_ERROR) & (F.col(f"{p}.upto") >= q - 2 * o.KLL_ERROR)).alias(f"{p}_near")
    return ranks.select("event_type", "n", "low", "high", near("p50", 0.5), near("p99", 0.99))


@query("O17_violations", HYSTERESIS + ", t AS (SELECT session_id, seq, state, lag(state) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM h) SELECT CASE WHEN state = 'unhealthy' THEN 'alert' ELSE 'recovered' END AS event, count(*) AS n FROM t WHERE state <> before AND (state = 'unhealthy' OR before = 'unhealthy') GROUP BY 1")
def violations(spark, sf):
    changes = hysteresis(spark, sf).withColumn("before", F.expr("lag(state) OVER (PARTITION BY session_id ORDER BY seq)"))
    moved = changes.where("state <> before AND (state = 'unhealthy' OR before = 'unhealthy')")
    return moved.groupBy(F.when(F.col("state") == "unhealthy", "alert").otherwise("recovered").alias("event")).agg(F.count("*").alias("n"))


@query("O18_promotion", "SELECT user_id, bool_and(value < 400) AND avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) < 0.25 AS promote, bool_or(value > 300) AS rollback FROM events GROUP BY 1")
def promotion(spark, sf):
    rate = F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    return o.promotion(table(spark, sf, "events"), ["user_id"], [F.bool_and(F.col("value") < 400), rate < 0.25], F.col("value") > 300)


JAVA = "(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296))"
SIGNED = f"CASE WHEN {JAVA} >= 2147483648 THEN {JAVA} - 4294967296 ELSE {JAVA} END"


@query("O19_flag_variant", f"WITH h AS (SELECT c_custkey, {SIGNED} AS h FROM (SELECT c_custkey, c_name AS k FROM customer)) SELECT c_custkey, CASE WHEN abs(h) % 100 < 50 THEN 'a' WHEN abs(h) % 100 < 80 THEN 'b' END AS variant FROM h")
def flag_variant(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", o.variant(F.col("c_name"), {"a": 50, "b": 30}).alias("variant"))


FLAG = {
    "default": "off", "variants": {"a": (3, "one"), "b": (2, "two"), "c": (0, "three")},
    "rules": [
        {"priority": 2, "variant": "c", "conditions": [{"attribute": "segment", "operator": "in", "value": ["BUILDING", "MACHINERY"]}, {"attribute": "balance", "operator": "gte", "value": 5000}]},
        {"priority": 1, "variant": "b", "conditions": [{"attribute": "name", "operator": "matches", "value": "7$"}, {"attribute": "segment", "operator": "not-equals", "value": "HOUSEHOLD"}, {"operator": "percentage", "value": 60}]},
        {"priority": 3, "variant": "missing", "conditions": []}, {"priority": 4, "variant": "a", "conditions": [{"attribute": "balance", "operator": "lt", "value": -500}, {"attribute": "segment", "operator": "not-in", "value": ["FURNITURE"]}, {"attribute": "name", "operator": "not-contains", "value": "3"}]},
    ],
}


@query("O19_flag_rules", f"""WITH h AS (SELECT c_custkey, c_name AS k, c_mktsegment AS s, c_acctbal AS b, {SIGNED} AS h FROM (SELECT *, c_name AS k FROM customer))
SELECT c_custkey, CASE WHEN k LIKE '%7' AND s <> 'HOUSEHOLD' AND abs(h) % 100 < 60 THEN 'two' WHEN s IN ('BUILDING', 'MACHINERY') AND b >= 5000 THEN 'three' WHEN b < -500 AND s NOT IN ('FURNITURE') AND NOT contains(k, '3') THEN 'one' WHEN abs(h) % 5 < 3 THEN 'one' ELSE 'two' END AS value FROM h""")
def flag_rules(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return df.select("c_custkey", o.evaluate_flag(FLAG, F.col("name")).alias("value"))


ROUTES = [{"target": "new", "weight": 30, "conditions": [{"attribute": "event_type", "operator": "equals", "value": "signup"}]}, {"target": "old", "weight": 70}]


@query("O20_sticky_routing", f"""WITH h AS (SELECT event_id, user_id, event_type, {SIGNED} AS h FROM (SELECT *, event_id::VARCHAR AS k FROM events)), p AS (SELECT *, CASE WHEN event_type = 'signup' OR abs(h) % 100 < 30 THEN 'new' ELSE 'old' END AS t, CASE WHEN event_type = 'signup' THEN 'condition-match' ELSE 'weight-based' END AS r FROM h),
f AS (SELECT *, first_value(t) OVER (PARTITION BY user_id ORDER BY event_id) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM p), x AS (SELECT CASE WHEN n > 1 THEN t0 ELSE t END AS target, CASE WHEN n > 1 THEN 'sticky-session' ELSE r END AS reason FROM f)
SELECT target, reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM x), 6)::DOUBLE AS percent FROM x GROUP BY 1, 2""")
def sticky(spark, sf):
    routed = o.routed(table(spark, sf, "events"), ROUTES, F.col("event_id").cast("string"), "user_id", "event_id")
    return rounded(o.route_stats(routed), 6, "percent")


GLOBS = [{"name": "all", "pattern": "/*", "percent": 20}, {"name": "docs", "pattern": "/docs/*", "percent": 100, "shadow": True}, {"name": "one", "pattern": "/*/?", "percent": 60}, {"name": "off", "pattern": "/docs/very/long/*", "percent": 0, "enabled": False}]


@query("O21_strangler_routing", f"""WITH u AS (SELECT page_id, '/' || CASE page_id % 3 WHEN 0 THEN 'docs/' ELSE 'p/' END || page_id % 40 AS path, page_id::VARCHAR AS k, CASE page_id % 10 WHEN 4 THEN 'legacy' WHEN 5 THEN 'other' END AS o FROM pages), h AS (SELECT *, abs({SIGNED}) % 100 AS b FROM u),
r AS (SELECT *, CASE WHEN starts_with(path, '/docs/') THEN 'docs' WHEN regexp_matches(path, '^/.*/.$') THEN 'one' ELSE 'all' END AS rule FROM h), t AS (SELECT *, CASE WHEN o = 'legacy' THEN 'legacy' WHEN b < CASE rule WHEN 'docs' THEN 100 WHEN 'one' THEN 60 ELSE 20 END THEN 'modern' ELSE 'legacy' END AS target FROM r)
SELECT page_id, target, rule, CASE WHEN rule = 'docs' THEN CASE target WHEN 'legacy' THEN 'modern' ELSE 'legacy' END END AS shadow FROM t""")
def strangler_routing(spark, sf):
    k = F.col("page_id")
    path = F.concat(F.lit("/"), F.when(k % 3 == 0, "docs/").otherwise("p/"), (k % 40).cast("string"))
    override = F.when(k % 10 == 4, "legacy").when(k % 10 == 5, "other")
    return table(spark, sf, "pages").select("page_id", o.strangler_route(path, k.cast("string"), GLOBS, override).alias("r")).select("page_id", "r.*")


@query("O22_pipeline_metrics", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(user_id % 4)::BIGINT AS retries, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS healing, round(count(*) FILTER (event_type = 'purchase') / 24.0, 6)::DOUBLE AS throughput FROM events GROUP BY 1")
def pipeline_metrics(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "purchase", "completed").when(t == "error", "failed").when(t == "view", "healing").otherwise("waiting")
    tasks = table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("day"), status.alias("status"), (F.col("user_id") % 4).alias("retries"))
    return rounded(o.pipeline_metrics(tasks, ["day"]), 6, "throughput")


@query("O23_weight_aggregation", "SELECT l_linenumber AS layer, l_suppkey % 10 AS cell, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS weight FROM lineitem GROUP BY 1, 2")
def weight_aggregation(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({"layer": F.col("l_linenumber"), "cell": F.col("l_suppkey") % 10})
    return rounded(o.weighted_mean(df, ["layer", "cell"], "l_discount", "l_quantity"), 8, "weight")


@query("O24_contribution_rank", "SELECT l_suppkey, points, row_number() OVER (ORDER BY points DESC, l_suppkey) AS place FROM (SELECT l_suppkey, sum(l_quantity) AS points FROM lineitem GROUP BY 1) ORDER BY place LIMIT 20")
def contribution(spark, sf):
    top = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("points")).orderBy(F.desc("points"), "l_suppkey").limit(20)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("o"), "l_suppkey", "points"))).alias("x")).select(F.posexplode("x").alias("p", "x"))
    return ranked.select("x.l_suppkey", "x.points", (F.col("p") + 1).cast("long").alias("place"))


@query("O25_dashboard", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def dashboard(spark, sf):
    out = o.dashboard(table(spark, sf, "orders"), "o_orderdate", {"orders": F.count("*"), "value": F.round(F.sum("o_totalprice"), 2)})
    return out.select(F.col("period").cast("timestamp_ntz").alias("month"), "orders", "value")
