"""Roles that driver tables play: graph, rules, traces, runs, metrics. Whole tables always.

``SQL`` holds the same roles as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

SQL = {
    "nodes": """nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'region' AS type, r_name AS name, 1.0::DOUBLE AS confidence FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name, 1.0::DOUBLE FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name, (CASE WHEN c_acctbal < 0 THEN 0.4 ELSE 0.9 END)::DOUBLE FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name, (CASE WHEN s_acctbal < 0 THEN 0.4 ELSE 0.8 END)::DOUBLE FROM supplier)""",
    "edges": """edges AS (
  SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'depends-on' AS type FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'uses' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'reads' FROM supplier
  UNION ALL SELECT DISTINCT 'c:' || o_custkey, 's:' || l_suppkey, 'calls' FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""",
    "tree": """edges AS (
  SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'depends-on' AS type FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'uses' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'reads' FROM supplier)""",
    "modules": """modules AS (
  SELECT id, k * 37 % 12000 AS loc, k * 7 % 130 AS cyclomatic, CASE WHEN k % 11 <> 0 THEN k * 3 % 100 END AS test_coverage, k * 5 % 100 AS doc_coverage, k * 13 % 250 AS debt_hours,
         k % 120 AS business_rules, k % 25 AS external_calls, ['low', 'medium', 'high', 'critical'][k % 4 + 1] AS criticality, ['cobol', 'fortran', 'vb6', 'java', 'mixed', 'rpg'][k % 6 + 1] AS language,
         k % 3 AS owners, coalesce(o.n, 0) AS dependencies, coalesce(i.n, 0) AS dependents
  FROM (SELECT id, split_part(id, ':', 2)::BIGINT AS k FROM nodes)
  LEFT JOIN (SELECT source AS id, count(DISTINCT target) AS n FROM edges GROUP BY 1) o USING (id) LEFT JOIN (SELECT target AS id, count(DISTINCT source) AS n FROM edges GROUP BY 1) i USING (id))""",
    "rules": """rules AS (
  SELECT d.doc_id, coalesce(d.text, '') AS text, d.lang AS category, d.source AS domain, coalesce(d.n_chars, 0) AS n_chars,
         CASE WHEN d.n_chars >= 5000 THEN 'critical' WHEN d.n_chars >= 2000 THEN 'high' WHEN d.n_chars >= 800 THEN 'medium' ELSE 'low' END AS criticality,
         CASE l.quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS review_status,
         (CASE l.toxic WHEN 1 THEN 0.3 WHEN 0 THEN 0.9 ELSE 0.6 END)::DOUBLE AS confidence
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "trace": """trace AS (
  SELECT event_id, ts, user_id AS session_id, event_type AS type, value, props,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events)""",
    "runs": """runs AS (
  SELECT l_orderkey AS run_id, l_linenumber AS line, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_returnflag AS flag, l_linestatus AS status, l_shipdate AS ts,
         l_extendedprice * (1 - l_discount) AS net
  FROM lineitem)""",
    "pairs": """legacy AS (SELECT l_orderkey AS k1, l_linenumber AS k2, l_extendedprice AS price, l_quantity AS quantity, l_returnflag AS flag FROM lineitem),
modern AS (
  SELECT l_orderkey AS k1, l_linenumber AS k2,
         CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice + 0.5 WHEN l_orderkey % 89 = 0 THEN l_extendedprice + 25 ELSE l_extendedprice END AS price,
         CASE WHEN l_orderkey % 83 = 0 THEN NULL ELSE l_quantity END AS quantity,
         CASE WHEN l_orderkey % 79 = 0 THEN lower(l_returnflag) || ' ' ELSE l_returnflag END AS flag
  FROM lineitem WHERE l_orderkey % 101 <> 0
  UNION ALL SELECT l_orderkey + 1000000000, l_linenumber, l_extendedprice, l_quantity, l_returnflag FROM lineitem WHERE l_orderkey % 103 = 0)""",
}


def with_roles(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the named roles."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)


def ident(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """id, type, name, confidence of regions, nations, customers and suppliers."""
    def part(name, prefix, key, label, kind, confidence):
        return table(spark, sf, name).select(ident(prefix, key).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("name"), confidence.cast("double").alias("confidence"))

    low = lambda c, otherwise: F.when(F.col(c) < 0, 0.4).otherwise(otherwise)
    return (
        part("region", "r", "r_regionkey", "r_name", "region", F.lit(1.0))
        .unionByName(part("nation", "n", "n_nationkey", "n_name", "nation", F.lit(1.0)))
        .unionByName(part("customer", "c", "c_custkey", "c_name", "customer", low("c_acctbal", 0.9)))
        .unionByName(part("supplier", "s", "s_suppkey", "s_name", "supplier", low("s_acctbal", 0.8)))
    )


def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    """source, target, type of the foreign keys nation, customer and supplier."""
    def part(name, a, b, kind):
        return table(spark, sf, name).select(ident(*a).alias("source"), ident(*b).alias("target"), F.lit(kind).alias("type"))

    return (
        part("nation", ("n", "n_nationkey"), ("r", "n_regionkey"), "depends-on")
        .unionByName(part("customer", ("c", "c_custkey"), ("n", "c_nationkey"), "uses"))
        .unionByName(part("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"), "reads"))
    )


#: Line items that a task takes when they meet their orders and when the pairs of customers and suppliers are told apart.
ITEMS_OF_TASK = 250_000


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The foreign keys and who ordered from whom, once for each pair."""
    items = table(spark, sf, "lineitem")
    # Each task joins and tells apart a bounded number of items; their number is in the file's footer.
    tasks = -(-items.count() // ITEMS_OF_TASK) or 1
    ordered = table(spark, sf, "orders").repartition(tasks, "o_orderkey").join(items.repartition(tasks, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    bought = ordered.select("o_custkey", "l_suppkey").repartition(tasks, "o_custkey", "l_suppkey").distinct()
    return tree_edges(spark, sf).unionByName(bought.select(ident("c", "o_custkey").alias("source"), ident("s", "l_suppkey").alias("target"), F.lit("calls").alias("type")))


def modules(spark: SparkSession, sf: str) -> DataFrame:
    """Graph nodes as modules: metrics that follow from the number in the id, neighbours from the graph."""
    k, links = F.split("id", ":")[1].cast("long"), edges(spark, sf)
    pick = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (k % m + 1).cast("int"))
    base = nodes(spark, sf).select(
        "id", (k * 37 % 12000).alias("loc"), (k * 7 % 130).alias("cyclomatic"), F.when(k % 11 != 0, k * 3 % 100).alias("test_coverage"), (k * 5 % 100).alias("doc_coverage"), (k * 13 % 250).alias("debt_hours"),
        (k % 120).alias("business_rules"), (k % 25).alias("external_calls"), pick(("low", "medium", "high", "critical"), 4).alias("criticality"), pick(("cobol", "fortran", "vb6", "java", "mixed", "rpg"), 6).alias("language"), (k % 3).alias("owners"),
    )
    out = links.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("dependencies"))
    into = links.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("dependents"))
    return base.join(out, "id", "left").join(into, "id", "left").fillna(0, ["dependencies", "dependents"])


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as rules, labels as their reviews."""
    n = F.col("n_chars")
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("category"), F.col("source").alias("domain"), F.coalesce(n, F.lit(0)).alias("n_chars"),
        F.when(n >= 5000, "critical").when(n >= 2000, "high").when(n >= 800, "medium").otherwise("low").alias("criticality"),
        F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending").alias("review_status"),
        F.when(F.col("toxic") == 1, 0.3).when(F.col("toxic") == 0, 0.9).otherwise(0.6).alias("confidence"),
    )


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trace events, numbered within their user's session."""
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("type"), "value", "props",
        F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)").alias("seq"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as historical executions: inputs quantity, price, discount, tax; output net."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )


def legacy_modern(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line items and a deterministic variation: changed, missing and added rows."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")
    )
    k = F.col("k1")
    changed = items.where(k % 101 != 0).select(
        "k1", "k2",
        F.when(k % 97 == 0, F.col("price") + 0.5).when(k % 89 == 0, F.col("price") + 25).otherwise(F.col("price")).alias("price"),
        F.when(k % 83 != 0, F.col("quantity")).alias("quantity"),
        F.when(k % 79 == 0, F.concat(F.lower("flag"), F.lit(" "))).otherwise(F.col("flag")).alias("flag"),
    )
    added = items.where(k % 103 == 0).withColumn("k1", k + 1_000_000_000)
    return items, changed.unionByName(added)
