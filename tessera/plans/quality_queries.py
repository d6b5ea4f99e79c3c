"""Queries of profiling and validation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import quality as q
from tessera.plans.registry import query
from tessera.plans.roles import legacy_modern, with_roles
from tessera.session import TABLES, table

COUNTED = TABLES


@query("Q1_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in COUNTED))
def row_counts(spark, sf):
    return q.row_counts({t: table(spark, sf, t) for t in COUNTED})


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
RATED = ["doc_id", "lang", "source", "n_chars"]


@query("Q2_column_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM orders" for c in ORDERS))
def column_profile(spark, sf):
    return q.column_profile(table(spark, sf, "orders"), ORDERS)


@query("Q3_duplicate_keys", """SELECT 'l_orderkey' AS column_name, CAST(l_orderkey AS VARCHAR) AS key_value, count(*) AS occurrences
FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 ORDER BY 3 DESC, 2 LIMIT 100""")
def duplicate_keys(spark, sf):
    return q.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey")


RATES = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') / count(*)::DOUBLE, 8) AS null_rate,
round(count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'null')) / count(*)::DOUBLE, 8) AS unique_rate FROM documents""" for c in RATED)


def rates(spark, sf):
    return q.column_rates(table(spark, sf, "documents"), RATED).select("column_name", F.round("null_rate", 8).alias("null_rate"), F.round("unique_rate", 8).alias("unique_rate"))


query("Q4_column_rates", RATES)(rates)

PATTERN_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]


@query("Q5_patterns", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders" for c in ("o_orderkey", "o_orderpriority", "o_orderstatus")) + """),
m AS (""" + " UNION ALL ".join(f"SELECT column_name, '{n}' AS pattern, avg(CASE WHEN regexp_matches(value, '{p}') THEN 1.0 ELSE 0.0 END) AS match_rate FROM v WHERE value <> '' GROUP BY 1" for n, p in q.PATTERNS.items()) + """)
SELECT column_name, pattern, round(match_rate, 8) AS match_rate, (SELECT string_agg(value, '|' ORDER BY value) FROM (SELECT DISTINCT value FROM v WHERE v.column_name = m.column_name AND CASE m.pattern """ + " ".join(f"WHEN '{n}' THEN regexp_matches(value, '{p}')" for n, p in q.PATTERNS.items()) + """ END ORDER BY value LIMIT 3)) AS examples FROM m WHERE match_rate > 0.5""")
def patterns(spark, sf):
    out = q.detect_patterns(table(spark, sf, "orders"), ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    return out.withColumn("match_rate", F.round("match_rate", 8)).withColumn("examples", F.array_join("examples", "|"))


@query("Q6_quality_issues", f"""WITH rates AS ({RATES}) SELECT column_name,
CASE WHEN null_rate > 0.1 THEN 'high-null-rate' ELSE 'low-cardinality' END AS issue,
CASE WHEN null_rate > 0.5 THEN 'critical' WHEN null_rate > 0.1 THEN 'warning' ELSE 'info' END AS severity
FROM rates WHERE null_rate > 0.1 OR (unique_rate > 0 AND unique_rate < 0.01)""")
def issues(spark, sf):
    return q.quality_issues(rates(spark, sf))


@query("Q7_table_score", f"WITH rates AS ({RATES}) SELECT round(greatest(100.0 - sum(greatest(null_rate - 0.1, 0.0) * 50), 0.0), 6)::DOUBLE AS score FROM rates")
def score(spark, sf):
    return q.table_score(rates(spark, sf)).select(F.round("score", 6).alias("score"))


FOREIGN = [
    ("nation.region", "nation", "n_regionkey", "region", "r_regionkey"), ("customer.nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier.nation", "supplier", "s_nationkey", "nation", "n_nationkey"), ("orders.customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem.orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem.supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels.documents", "labels", "doc_id", "documents", "doc_id"),
    ("orders.events", "orders", "o_custkey", "events", "user_id"),
]


@query("Q8_referential_integrity", " UNION ALL ".join(
    f"SELECT '{n}' AS relationship, count(*) AS orphan_count FROM {c} c WHERE c.{cc} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{pc} = c.{cc})" for n, c, cc, p, pc in FOREIGN))
def integrity(spark, sf):
    return q.referential_integrity([(n, table(spark, sf, c), cc, table(spark, sf, p), pc) for n, c, cc, p, pc in FOREIGN])


@query("V1_null_checks", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count(*) = count({c}) AS passed FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")))
def null_checks(spark, sf):
    df = table(spark, sf, "lineitem")
    return q.null_checks(df, df.columns)


PAIRS = with_roles("pairs")


@query("V2_count_match", PAIRS + """ SELECT a AS source_value, b AS target_value, abs(a - b) AS delta, a = b AS passed
FROM (SELECT count(*) AS a FROM legacy) CROSS JOIN (SELECT count(*) AS b FROM modern)""")
def count_match(spark, sf):
    return q.count_match(*legacy_modern(spark, sf))


SUMMED = "CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(k1 AS VARCHAR), CAST(k2 AS VARCHAR), flag)), 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR)"


@query("V3_checksum_md5", PAIRS + f" SELECT a AS source_value, b AS target_value, a = b AS passed FROM (SELECT {SUMMED} AS a FROM legacy) CROSS JOIN (SELECT {SUMMED} AS b FROM modern)")
def checksum_md5(spark, sf):
    a, b = legacy_modern(spark, sf)
    return q.checksum_match(a, b, [F.col("k1"), F.col("k2"), F.col("flag")])


LENGTHS = "CAST(sum(length(concat_ws('|', CAST(k1 AS VARCHAR), CAST(k2 AS VARCHAR), flag))) AS VARCHAR)"


@query("V3_checksum_length", PAIRS + f" SELECT a AS source_value, b AS target_value, a = b AS passed FROM (SELECT {LENGTHS} AS a FROM legacy) CROSS JOIN (SELECT {LENGTHS} AS b FROM modern)")
def checksum_length(spark, sf):
    a, b = legacy_modern(spark, sf)
    return q.checksum_match(a, b, [F.col("k1"), F.col("k2"), F.col("flag")], "length")


@query("V3_checksum_crc32")
def checksum_crc32(spark, sf):
    a, b = legacy_modern(spark, sf)
    return q.checksum_match(a, b, [F.col("k1"), F.col("k2"), F.col("flag")], "crc32")


@query("V4_key_compare", PAIRS + """ SELECT CASE WHEN b.k1 IS NULL THEN 'missing' WHEN a.k1 IS NULL THEN 'added'
WHEN a.price IS NOT DISTINCT FROM b.price AND a.quantity IS NOT DISTINCT FROM b.quantity AND a.flag IS NOT DISTINCT FROM b.flag THEN 'equal' ELSE 'different' END AS status, count(*) AS n
FROM (SELECT k1 * 10 + k2 AS k, * FROM legacy) a FULL JOIN (SELECT k1 * 10 + k2 AS k, * FROM modern) b ON a.k = b.k GROUP BY 1""")
def key_compare(spark, sf):
    a, b = (df.withColumn("k", F.col("k1") * 10 + F.col("k2")) for df in legacy_modern(spark, sf))
    return q.sample_compare(a, b, "k", 1, ["price", "quantity", "flag"])


@query("V5_numeric_ranges", " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 4) AS avg_value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def ranges(spark, sf):
    out = q.numeric_ranges(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumn("avg_value", F.round("avg_value", 4))


@query("V5_range_match", PAIRS + """, s AS (SELECT 'price' AS c, min(price) a, max(price) b, avg(price) m FROM legacy UNION ALL SELECT 'quantity', min(quantity), max(quantity), avg(quantity) FROM legacy),
t AS (SELECT 'price' AS c, min(price) a, max(price) b, avg(price) m FROM modern UNION ALL SELECT 'quantity', min(quantity), max(quantity), avg(quantity) FROM modern)
SELECT s.c AS column_name, abs(s.a - t.a) <= 0.001 AS min_ok, abs(s.b - t.b) <= 0.001 AS max_ok, abs(s.m - t.m) <= 0.001 AS avg_ok,
abs(s.a - t.a) <= 0.001 AND abs(s.b - t.b) <= 0.001 AND abs(s.m - t.m) <= 0.001 AS passed FROM s JOIN t ON s.c = t.c""")
def range_match(spark, sf):
    return q.range_match(*legacy_modern(spark, sf), ["price", "quantity"])


@query("V6_target_orphans", PAIRS + " SELECT count(*) AS orphan_count FROM modern m WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = m.k1)")
def target_orphans(spark, sf):
    return q.orphan_count(legacy_modern(spark, sf)[1], "k1", table(spark, sf, "orders"), "o_orderkey")


@query("V7_continuous_drift", PAIRS + """ SELECT a AS source_value, b AS target_value, abs(a - b) AS delta, abs(a - b) <= a * 0.01 AS passed
FROM (SELECT count(*) AS a FROM legacy) CROSS JOIN (SELECT count(*) AS b FROM modern)""")
def continuous_drift(spark, sf):
    return q.count_match(*legacy_modern(spark, sf), tolerance=0.01)


KEYS = SUMMED.replace(", flag", "") if ", flag" in SUMMED else SUMMED


@query("V8_key_checksum_md5", PAIRS + f" SELECT a AS source_value, b AS target_value, a = b AS passed FROM (SELECT {KEYS} AS a FROM legacy) CROSS JOIN (SELECT {KEYS} AS b FROM modern)")
def key_checksum_md5(spark, sf):
    return q.checksum_match(*legacy_modern(spark, sf), [F.col("k1"), F.col("k2")])


@query("V8_key_checksum")
def key_checksum(spark, sf):
    return q.checksum_match(*legacy_modern(spark, sf), [F.col("k1"), F.col("k2")], "xxhash64")


@query("V9_validation_report", PAIRS + """, r AS (SELECT true AS critical, (SELECT count(*) FROM legacy) = (SELECT count(*) FROM modern) AS passed
UNION ALL SELECT false, abs((SELECT count(*) FROM legacy) - (SELECT count(*) FROM modern)) <= (SELECT count(*) FROM legacy) * 0.01
UNION ALL SELECT true, (SELECT count(*) FROM modern m WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = m.k1)) = 0)
SELECT critical, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM r GROUP BY critical""")
def report(spark, sf):
    checks = [
        (True, q.count_match(*legacy_modern(spark, sf)).select("passed")),
        (False, continuous_drift(spark, sf).select("passed")),
        (True, target_orphans(spark, sf).select((F.col("orphan_count") == 0).alias("passed"))),
    ]
    return q.validation_report(q.union_all([df.select(F.lit(c).alias("critical"), "passed") for c, df in checks]))
