"""Queries of sources, scalar functions, mining, questions and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import graph as g
from tessera.operators import mining
from tessera.plans.graph_queries import DESCRIBED, described
from tessera.plans.model_queries import HYSTERESIS
from tessera.plans.registry import query
from tessera.plans.roles import edges, legacy_modern, nodes, rules, with_roles
from tessera.session import table
from tessera.sources import exports, schema
from tessera.streaming import streams

GRAPH, RULES = with_roles("nodes", "edges"), with_roles("rules")
LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents)"


def numbered(spark, sf):
    return mining.lines(table(spark, sf, "documents"), "doc_id", "text")


# --- schemas (E) ---

#: Tables whose own Parquet schemas are the catalogue, and how their types are called in it.
GIVEN = ("customer", "nation", "region", "supplier", "orders", "part", "lineitem")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP"}
# Definitions of tables that were never loaded: keys of other kinds, large objects, sized types, no key.
ARCHIVED = [(t, c, k, i) for t, cols in {
    "history": ["order_code:string", "part_code:bigint", "fk_region:int", "note:clob"], "employee": ["id:int", "Full Name:char(30)"],
    "archive": ["archive_id:bigint", "emp_id:bigint", "photo:blob", "amount:decimal(12,2)", "label:varchar(55)"],
}.items() for i, (c, k) in enumerate(x.split(":") for x in cols)]
CATALOG_SQL = (
    "cat(table_name, column_name, data_type, ordinal) AS (SELECT table_name, regexp_replace(regexp_replace(column_name, '^[a-z]+_', ''), 'key$', '_id'), CASE data_type "
    + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in KINDS.items()) + " END, ordinal_position - 1 FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in GIVEN)
    + ") UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in ARCHIVED) + ") v)"
)
# What the rules of names find: nation, region and part by plural, cust and emp by abbreviation, fk_region as it is; part_code names parts, and order_code is no number.
RELATIONS = [("customer", "nation_id", "nation", "nation_id", 0.7), ("nation", "region_id", "region", "region_id", 0.7), ("supplier", "nation_id", "nation", "nation_id", 0.7), ("orders", "cust_id", "customer", "cust_id", 0.5),
             ("lineitem", "part_id", "part", "part_id", 0.7), ("archive", "emp_id", "employee", "id", 0.5), ("history", "part_code", "part", "part_id", 0.6), ("history", "fk_region", "region", "region_id", 0.8)]
RELATIONS_SQL = "rel(table_name, column_name, target, target_column, confidence) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e}::DOUBLE)" for a, b, c, d, e in RELATIONS) + ")"


def profile(spark, sf, names=GIVEN):
    """(table_name, column_name, data_type, ordinal, filled) of the given tables' columns: Spark counts the values of each, which it holds as often as it is filled."""
    def one(name):
        df = table(spark, sf, name)
        rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString().replace("_ntz", "")).alias("data_type"), F.lit(k).alias("ordinal"), F.count(f.name).alias("filled")) for k, f in enumerate(df.schema)]
        return df.agg(F.array(*rows).alias("x")).select(F.lit(name).alias("table_name"), F.explode("x").alias("x")).select("table_name", "x.*")

    return g.checkpointed(g.union_all([one(name) for name in names]))


def catalog(spark, sf):
    """The given tables' own columns, with the prefix of their table left out and keys named as ids, and the archived definitions, which have no rows to fill them."""
    given = profile(spark, sf).withColumn("column_name", F.regexp_replace(F.regexp_replace("column_name", "^[a-z]+_", ""), "key$", "_id"))
    archived = spark.createDataFrame(ARCHIVED, "table_name string, column_name string, data_type string, ordinal int").withColumn("filled", F.lit(0).cast("long"))
    return given.unionByName(archived).withColumn("is_pk", (F.col("ordinal") == 0) & (F.col("table_name") != "history"))


def sizes(spark, sf):
    """Rows of the driver's tables that the catalogue names."""
    return g.union_all([table(spark, sf, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name in GIVEN])


SIZES_SQL = "sz AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in GIVEN) + ")"


COPYBOOK = """000100 01 CUSTOMER-RECORD.
000200     05 CUST-ID        PIC 9(8).
000300     05 CUST-NAME      PIC X(20).
      * a comment
000400     05 CUST-BALANCE   PIC S9(9)V99 COMP-3.
000500     05 CUST-FLAGS     PIC X OCCURS 3.
"""


@query("E1_copybook_records", "SELECT c_custkey AS cust_id, rtrim(left(c_name, 20)) AS cust_name, round(c_acctbal, 2) AS cust_balance, 'ABC' AS flags FROM customer")
def copybook_records(spark, sf):
    fields = schema.parse_copybook(COPYBOOK)
    cents = F.round(F.col("c_acctbal") * 100).cast("decimal(11,0)")
    key, name = F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.rpad("c_name", 20, " ")
    record = F.concat(key.cast("binary"), name.cast("binary"), scalar.pack_decimal(cents, 11), F.lit("ABC").cast("binary"))
    decoded = table(spark, sf, "customer").select(record.alias("record")).select(*schema.decode_record(fields, F.col("record")))
    return decoded.select("cust_id", "cust_name", F.col("cust_balance").cast("double").alias("cust_balance"), F.array_join("cust_flags", "").alias("flags"))


PICTURES = """pics AS (SELECT p_partkey, unnest([{'pic': 'X(' || length(p_name) || ')', 'digits': 0, 'characters': length(p_name), 'decimals': 0, 'kind': 'string'}, {'pic': 'S9(' || p_size || ')V99', 'digits': p_size + 2, 'characters': 0, 'decimals': 2, 'kind': 'decimal'},
{'pic': '9(' || p_size || ')', 'digits': p_size, 'characters': 0, 'decimals': 0, 'kind': 'integer'}, {'pic': 'XX9(' || p_size || ')', 'digits': p_size, 'characters': 2, 'decimals': 0, 'kind': 'string'}, {'pic': '99V9(' || p_size || ')', 'digits': p_size + 2, 'characters': 0, 'decimals': p_size, 'kind': 'decimal'}]) AS x FROM part)"""


def pictures(spark, sf):
    """PIC clauses that would hold what each part has: its name, its size with and without decimals."""
    size, name = F.col("p_size").cast("string"), F.length("p_name").cast("string")
    pics = F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, n, b in (("X(", name, ")"), ("S9(", size, ")V99"), ("9(", size, ")"), ("XX9(", size, ")"), ("99V9(", size, ")"))])
    return table(spark, sf, "part").select("p_partkey", F.explode(pics).alias("pic"))


@query("E2_picture", f"WITH {PICTURES} SELECT p_partkey, x.pic AS pic, x.digits AS digits, x.characters AS characters, x.decimals AS decimals, x.kind AS kind FROM pics")
def picture(spark, sf):
    parts = scalar.picture(F.col("pic"))
    return pictures(spark, sf).select("p_partkey", "pic", *[parts[k].alias(k) for k in ("digits", "characters", "decimals", "kind")])


def catalog_frames(spark, sf):
    """The catalogue as a database keeps it."""
    cat = catalog(spark, sf).withColumn("schema", F.when(F.col("table_name") == "employee", "HR").otherwise("SALES"))
    rel = spark.createDataFrame(RELATIONS, "table_name string, column_name string, target string, target_column string, confidence double")
    keys = cat.where("is_pk").select("schema", F.concat(F.lit("PK_"), "table_name").alias("constraint_name"), "table_name", "column_name", F.lit(1).alias("seq"))
    links = rel.select(F.lit("SALES").alias("schema"), F.concat(F.lit("FK_"), "table_name", F.lit("_"), "column_name").alias("constraint_name"), "table_name", "column_name", F.lit(1).alias("seq"))
    tables = cat.select("schema", F.col("table_name").alias("name"), F.when(F.col("table_name") == "history", "V").otherwise("T").alias("kind")).distinct().join(sizes(spark, sf).withColumnRenamed("table_name", "name"), "name", "left")
    return {
        "tables": tables, "columns": cat.drop("is_pk"), "constraints": keys.select("schema", F.col("constraint_name").alias("name"), "table_name", F.lit("P").alias("kind")).unionByName(links.select("schema", F.col("constraint_name").alias("name"), "table_name", F.lit("F").alias("kind"))),
        "key_columns": keys.unionByName(links), "indexes": links.select("schema", F.concat(F.lit("IX_"), "constraint_name").alias("name"), "table_name", F.lit(False).alias("is_unique")), "index_columns": links.select("schema", F.concat(F.lit("IX_"), "constraint_name").alias("name"), "column_name", "seq"),
        "references": rel.select(F.lit("SALES").alias("schema"), F.concat(F.lit("FK_"), "table_name", F.lit("_"), "column_name").alias("name"), "table_name", F.when(F.col("target") == "employee", "HR").otherwise("SALES").alias("ref_schema"), F.col("target").alias("ref_table"), F.concat(F.lit("PK_"), "target").alias("ref_key")),
    }


@query("E3_catalog_reads", f"""WITH {CATALOG_SQL}, {RELATIONS_SQL}, {SIZES_SQL}, c AS (SELECT * FROM cat WHERE table_name <> 'employee')
SELECT 'tables' AS read, table_name AS subject FROM c GROUP BY table_name UNION ALL SELECT 'columns', table_name || '.' || column_name FROM c UNION ALL SELECT 'primary_keys', table_name || '.' || column_name FROM c WHERE ordinal = 0 AND table_name <> 'history'
UNION ALL SELECT 'foreign_keys', table_name || '.' || column_name || '>' || target || '.' || target_column FROM rel UNION ALL SELECT 'indexes', table_name || '.' || column_name FROM rel UNION ALL SELECT 'sizes', concat_ws(':', table_name, any_value(rows)::VARCHAR) FROM c LEFT JOIN sz USING (table_name) WHERE table_name <> 'history' GROUP BY table_name""")
def catalog_reads(spark, sf):
    reads, of = schema.catalog_reads(catalog_frames(spark, sf), ["SALES"]), F.concat("table_name", F.lit("."), "column_name")
    subjects = {"tables": F.col("name"), "columns": of, "primary_keys": of, "foreign_keys": F.concat(of, F.lit(">"), "ref_table", F.lit("."), "ref_column"), "indexes": of, "sizes": F.concat_ws(":", "name", F.col("rows").cast("string"))}
    return g.union_all([reads[k].select(F.lit(k).alias("read"), v.alias("subject")) for k, v in subjects.items()])


@query("E4_key_assembly", f"WITH {CATALOG_SQL} SELECT table_name, 'all' AS key_name, string_agg(column_name, ',' ORDER BY ordinal) AS columns FROM cat GROUP BY 1")
def key_assembly(spark, sf):
    return schema.assemble_keys(catalog(spark, sf).select("table_name", F.lit("all").alias("key_name"), "column_name", F.col("ordinal").alias("seq")))


@query("E7_inferred_relations", f"WITH {RELATIONS_SQL} SELECT * FROM rel")
def relations(spark, sf):
    return schema.inferred_relations(catalog(spark, sf))


@query("E8_evidence_merge", """WITH r AS (SELECT o_custkey, o_totalprice / 600000 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS k FROM orders) SELECT o_custkey, round(least(1.0, sum(c / k) / sum(1.0::DOUBLE / k)), 6)::DOUBLE AS confidence, count(*) AS evidence FROM r GROUP BY 1""")
def evidence(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", (F.col("o_totalprice") / 600000).alias("confidence"))
    return schema.merged_evidence(df, ["o_custkey"]).withColumn("confidence", F.round("confidence", 6))


@query("E9_join_frequency", "SELECT l_partkey, count(*) AS frequency, CASE WHEN count(*) > 10 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM lineitem GROUP BY 1")
def join_frequency(spark, sf):
    return schema.join_relations(table(spark, sf, "lineitem"), ["l_partkey"])


ESTIMATES = f"""WITH {CATALOG_SQL}, {RELATIONS_SQL}, {SIZES_SQL}, p AS (SELECT table_name, sum(CASE WHEN regexp_matches(data_type, 'blob|clob') THEN 2 ELSE 0 END) + CASE WHEN table_name = 'history' THEN 1 ELSE 0 END AS points FROM cat GROUP BY 1),
te AS (SELECT table_name, coalesce(rows, 0) AS rows, points, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS complexity, ceil(coalesce(rows, 0) / 10000.0::DOUBLE * CASE WHEN points >= 4 THEN 2 WHEN points >= 2 THEN 1.5 ELSE 1 END)::BIGINT + 5 AS minutes FROM p LEFT JOIN sz USING (table_name))"""


@query("E10_table_estimates", ESTIMATES + " SELECT * FROM te")
def table_estimates(spark, sf):
    cat = catalog(spark, sf)
    return schema.table_estimates(cat, schema.inferred_relations(cat), sizes(spark, sf)).drop("has_key")


@query("E10_migration_estimate", ESTIMATES + """ SELECT sum(rows)::BIGINT AS rows, ceil(30 + sum(rows) / 10000.0::DOUBLE * (1 + (count(*) FILTER (complexity = 'high') * 0.3 + count(*) FILTER (complexity = 'medium') * 0.1) / count(*)))::BIGINT AS minutes,
round(sum(CASE complexity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) / (count(*) * 3.0) * 10)::BIGINT AS complexity_score, least(10, round(least(3, 8 * 0.2) + least(2, 3 * 0.3) + least(3, count(*) FILTER (complexity = 'high') * 0.5) + CASE WHEN sum(rows) > 10000000 THEN 1 ELSE 0 END + 0.5))::INT AS risk_score FROM te""")
def migration_estimate(spark, sf):
    cat = catalog(spark, sf)
    relations_ = schema.inferred_relations(cat)
    return schema.migration_estimate(schema.table_estimates(cat, relations_, sizes(spark, sf)), relations_)


def mapped(dialect):
    """The SQL of a type in a dialect."""
    t = schema.TYPES[dialect]
    known = " ".join(f"WHEN data_type = '{k}' THEN '{t[v]}'" for k, v in (("int", "integer"), ("bigint", "bigint"), ("timestamp", "timestamp"), ("string", "text"), ("double", "double"), ("blob", "blob"), ("clob", "clob")) if v in t)
    sized = " ".join(f"WHEN starts_with(data_type, '{k}(') THEN '{t[k]}' || substr(data_type, {len(k) + 1})" for k in ("decimal", "varchar", "char") if k in t)
    return f"CASE {known} {sized} ELSE '{t['varchar']}(255)' END"


CLEAN = "regexp_replace(lower(column_name), '[^a-z0-9]', '_', 'g')"


@query("E11_target_schema", f"WITH {CATALOG_SQL}" + " ".join(
    f"{' UNION ALL' if k else ''} SELECT '{d}' AS dialect, table_name, {CLEAN} AS target_name, {mapped(d)} AS target_type, true AS nullable FROM cat UNION ALL SELECT '{d}', table_name, a, '{schema.TYPES[d]['timestamp']}', false FROM (SELECT DISTINCT table_name FROM cat), (VALUES ('created_at'), ('updated_at')) x(a) UNION ALL SELECT '{d}', 'history', 'id', '{schema.TYPES[d]['bigint']}', false"
    for k, d in enumerate(schema.TYPES)))
def target_schema(spark, sf):
    cat = catalog(spark, sf)
    return g.union_all([schema.target_columns(cat, d, audit=True).select(F.lit(d).alias("dialect"), "table_name", "target_name", "target_type", "nullable") for d in schema.TYPES])


@query("E11_naming", """WITH w AS (SELECT DISTINCT p_name || '-' || p_type AS name, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part)
SELECT name, array_to_string(w, '_') AS snake, w[1] || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || x[2:]), '') AS camel, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM w""")
def naming(spark, sf):
    c = F.col("name")
    names = table(spark, sf, "part").select(F.concat_ws("-", "p_name", "p_type").alias("name")).distinct()
    return names.select("name", schema.target_name(c).alias("snake"), schema.target_name(c, "camelCase").alias("camel"), schema.target_name(c, "PascalCase").alias("pascal"))


LEVELS_SQL = "WITH RECURSIVE " + f"{CATALOG_SQL}, {RELATIONS_SQL}, lv AS (SELECT DISTINCT table_name AS id, 0 AS level FROM cat UNION SELECT rel.table_name, level + 1 FROM lv JOIN rel ON rel.target = lv.id WHERE level < 20), lev AS (SELECT id, max(level)::BIGINT AS level FROM lv GROUP BY 1)"


def needs(cat):
    return schema.inferred_relations(cat).select(F.col("table_name").alias("source"), "target")


@query("E12_load_order", LEVELS_SQL + " SELECT * FROM lev")
def load_order(spark, sf):
    cat = catalog(spark, sf)
    return g.longest_levels(needs(cat), cat.select(F.col("table_name").alias("id")).distinct())


@query("E13_cycle_test", LEVELS_SQL + " SELECT 'catalog' AS subject, max(level) >= 20 AS cyclic FROM lev UNION ALL SELECT 'with region needing customer', true")
def cycle_test(spark, sf):
    cat = catalog(spark, sf)
    names, links = cat.select(F.col("table_name").alias("id")).distinct(), needs(cat)
    back = spark.createDataFrame([("region", "customer")], "source string, target string")
    cyclic = lambda df, subject: g.longest_levels(df, names).agg((F.count_if(F.col("level").isNull()) > 0).alias("cyclic")).select(F.lit(subject).alias("subject"), "cyclic")
    return cyclic(links, "catalog").unionByName(cyclic(links.unionByName(back), "with region needing customer"))


DEFS = f"""defs AS (SELECT table_name, ordinal AS p, {CLEAN} || ' ' || {mapped('postgresql')} AS d FROM cat UNION ALL SELECT table_name, 1000 + k, a || ' TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP' FROM (SELECT DISTINCT table_name FROM cat), (VALUES ('created_at', 0), ('updated_at', 1)) x(a, k)
UNION ALL SELECT 'history', -1, 'id BIGINT NOT NULL GENERATED ALWAYS AS IDENTITY' UNION ALL SELECT table_name, 2000, 'PRIMARY KEY (' || column_name || ')' FROM cat WHERE ordinal = 0 AND table_name <> 'history' UNION ALL SELECT 'history', 2000, 'PRIMARY KEY (id)')"""


@query("E14_ddl", f"WITH {CATALOG_SQL}, {RELATIONS_SQL}, {DEFS} SELECT table_name, 'table' AS part, 'CREATE TABLE ' || table_name || ' (' || string_agg(d, ', ' ORDER BY p) || ')' AS statement FROM defs GROUP BY 1 UNION ALL SELECT table_name, 'foreign_key', 'ALTER TABLE ' || table_name || ' ADD CONSTRAINT fk_' || table_name || '_' || column_name || ' FOREIGN KEY (' || column_name || ') REFERENCES ' || target || ' (' || target_column || ')' FROM rel UNION ALL SELECT table_name, 'index', 'CREATE INDEX idx_' || table_name || '_' || column_name || ' ON ' || table_name || ' (' || column_name || ')' FROM rel")
def ddl(spark, sf):
    cat = catalog(spark, sf)
    return schema.ddl(cat, "postgresql", schema.inferred_relations(cat), audit=True)


STEPS = [
    {"kind": "rename", "column": "c_name", "to": "name"}, {"kind": "substring", "column": "name", "to": "short", "start": 10, "length": 5}, {"kind": "concat", "columns": ["c_mktsegment", "short"], "to": "tag", "by": "-"},
    {"kind": "cast", "column": "c_acctbal", "type": "int"}, {"kind": "filter", "condition": "c_acctbal > 0"},
]


@query("E15_etl_transforms", "SELECT c_custkey, c_mktsegment || '-' || substr(c_name, 10, 5) AS tag, trunc(c_acctbal)::INT AS c_acctbal FROM customer WHERE trunc(c_acctbal)::INT > 0")
def etl(spark, sf):
    return schema.transform(table(spark, sf, "customer"), STEPS).select("c_custkey", "tag", "c_acctbal")


@query("E18_compact_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def compact_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).cast("string").alias("day"))


@query("E18_packed_decimals", "SELECT s_suppkey, round(s_acctbal, 2) AS balance FROM supplier")
def packed(spark, sf):
    raw = scalar.pack_decimal(F.round(F.col("s_acctbal") * 100).cast("decimal(13,0)"), 13)
    return table(spark, sf, "supplier").select("s_suppkey", scalar.unpack_decimal(raw, 2).cast("double").alias("balance"))


# --- mining (P) ---


@query("P1_lines", f"WITH {LINES} SELECT doc_id, count(*) AS n, max(length(line))::BIGINT AS longest FROM l GROUP BY 1")
def line_counts(spark, sf):
    return numbered(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("line")).cast("long").alias("longest"))


@query("P2_rule_lines", f"WITH {LINES} " + " UNION ALL ".join(f"SELECT doc_id, line_no, '{c}' AS category FROM l WHERE regexp_matches(line, '{p['cobol']}')" for c, p in mining.RULE_LINES.items()))
def rule_lines(spark, sf):
    return mining.rule_lines(numbered(spark, sf), "cobol").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "category")


def language_lines(language):
    return f"WITH {LINES}, src AS (SELECT doc_id, line_no, '  TOTAL' || doc_id || ' = A + ' || left(line, 12) AS line FROM l) " + " UNION ALL ".join(f"SELECT '{x}' AS language, category, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS category FROM src WHERE regexp_matches(line, '{p[x]}')" for c, p in mining.RULE_LINES.items()) + ") GROUP BY category" for x in language)


@query("P2_languages", language_lines(("cobol", "fortran", "vb6", "java")))
def rule_languages(spark, sf):
    src = numbered(spark, sf).withColumn("line", F.concat(F.lit("  TOTAL"), F.col("doc_id").cast("string"), F.lit(" = A + "), F.left("line", F.lit(12))))
    return g.union_all([mining.rule_lines(src, x).groupBy("category").agg(F.count("*").alias("n")).select(F.lit(x).alias("language"), "category", "n") for x in ("cobol", "fortran", "vb6", "java")])


# Line items as COBOL: one of eight kinds of line each.
COBOL = {0: ("READ FILE", "l_partkey", " AT END"), 1: ("WRITE OUT", "l_suppkey", "."), 2: ("OPEN INPUT F", "l_partkey", "."), 3: ("EXEC SQL SELECT ", "l_partkey", " END-EXEC"), 4: ("CALL 'SUB", "l_suppkey", "' USING A"), 5: ("ACCEPT KEY-", "l_suppkey", "."), 6: ("DISPLAY VAL-", "l_partkey", "."), 7: ("EXEC SQL OPEN CUR", "l_suppkey", " END-EXEC")}
COBOL_SQL = "cob AS (SELECT l_orderkey AS program, l_linenumber AS line_no, (l_orderkey + l_linenumber) % 8 AS k, l_partkey, l_suppkey FROM lineitem)"


def cobol(spark, sf):
    k, line = (F.col("l_orderkey") + F.col("l_linenumber")) % 8, F.lit("")
    for n, (head, column, tail) in COBOL.items():
        line = F.when(k == n, F.concat(F.lit(head), F.col(column).cast("string"), F.lit(tail))).otherwise(line)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("program"), F.col("l_linenumber").alias("line_no"), line.alias("line"))


@query("P3_inputs_outputs", f"WITH {COBOL_SQL} SELECT DISTINCT program, CASE WHEN k IN (0, 5) THEN 'input' ELSE 'output' END AS direction, CASE k WHEN 0 THEN 'FILE' || l_partkey WHEN 1 THEN 'OUT' || l_suppkey WHEN 5 THEN 'KEY-' || l_suppkey ELSE 'VAL-' || l_partkey END AS name FROM cob WHERE k IN (0, 1, 5, 6)")
def inputs(spark, sf):
    return mining.inputs_outputs(cobol(spark, sf), "program")


@query("P4_moves", "SELECT l_orderkey AS program, l_linenumber AS line_no, 'F' || l_partkey AS source, 'T-' || l_suppkey AS target FROM lineitem")
def moves(spark, sf):
    line = F.concat(F.lit("    MOVE F"), F.col("l_partkey").cast("string"), F.lit(" TO T-"), F.col("l_suppkey").cast("string"), F.lit("."))
    return mining.moves(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("program"), F.col("l_linenumber").alias("line_no"), line.alias("line")), "program")


@query("P5_variable_uses", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'definition' WHEN 1 THEN 'modification' ELSE 'use' END AS kind, count(*) AS n FROM part GROUP BY 1")
def variable_uses(spark, sf):
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, "05 TOTAL PIC 9(4).").when(k == 1, "MOVE A TO TOTAL.").otherwise("DISPLAY TOTAL.")
    return mining.variable_uses(table(spark, sf, "part").select("p_partkey", line.alias("line")), "TOTAL").groupBy("kind").agg(F.count("*").alias("n"))


@query("P6_file_operations", f"WITH {COBOL_SQL} SELECT program, line_no, CASE k WHEN 0 THEN 'READ' WHEN 1 THEN 'WRITE' ELSE 'INPUT' END AS operation, CASE k WHEN 0 THEN 'FILE' || l_partkey WHEN 1 THEN 'OUT' || l_suppkey ELSE 'F' || l_partkey END AS file FROM cob WHERE k IN (0, 1, 2)")
def file_operations(spark, sf):
    return mining.file_operations(cobol(spark, sf), "program")


@query("P6_database_calls", f"WITH {COBOL_SQL} SELECT program, line_no, CASE k WHEN 3 THEN 'SELECT' ELSE 'SQL' END AS kind FROM cob WHERE k IN (3, 7)")
def database_calls(spark, sf):
    return mining.database_calls(cobol(spark, sf), "program")


@query("P6_external_calls", f"WITH {COBOL_SQL} SELECT program, line_no, 'SUB' || l_suppkey AS name FROM cob WHERE k = 4")
def calls(spark, sf):
    return mining.external_calls(cobol(spark, sf), "program")


@query("P7_text_metrics", """WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p, coalesce(text, '') AS t FROM documents) SELECT doc_id, len(list_filter(p, lambda l: trim(l) <> '' AND NOT starts_with(l, '#')))::BIGINT AS loc,
len(list_filter(p, lambda l: starts_with(l, '#')))::BIGINT AS comments, len(regexp_extract_all(t, 'des|the'))::BIGINT + 1 AS cyclomatic FROM x""")
def text_metrics(spark, sf):
    return mining.text_metrics(table(spark, sf, "documents"), "doc_id", "text", "des|the", r"\(", r"\)", "^#").drop("nesting")


@query("P8_output_compare", with_roles("pairs") + " SELECT a.k1, a.k2, b.price IS NULL OR abs(a.price - b.price) > 0.1 AS significant FROM legacy a LEFT JOIN modern b USING (k1, k2) WHERE b.price IS NULL OR abs(a.price - b.price) > 0.01")
def output_compare(spark, sf):
    return mining.compare_outputs(*legacy_modern(spark, sf), ["k1", "k2"], "price").select("k1", "k2", "significant")


@query("P9_rule_coverage", "WITH m AS (SELECT p_partkey AS id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) AS hit FROM part) SELECT count(*) AS rules, count(*) FILTER (hit) AS covered, round(100.0 * count(*) FILTER (hit) / count(*), 6)::DOUBLE AS percent, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM m WHERE NOT hit ORDER BY id LIMIT 10)) AS uncovered FROM m")
def rule_coverage(spark, sf):
    used = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id"))
    found = mining.covered(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), used, "id")
    return found.select("rules", "covered", F.round("percent", 6).alias("percent"), F.nullif(F.array_join(F.col("uncovered").cast("array<string>"), ","), F.lit("")).alias("uncovered"))


@query("P10_readiness", "SELECT p_brand, round(greatest(0.0, least(100.0, 0.6 * avg(p_size) * 2 + 0.4 * 90 - 10 * count(*) FILTER (p_size = 50))), 6)::DOUBLE AS readiness FROM part GROUP BY 1")
def readiness(spark, sf):
    value = mining.readiness(F.avg("p_size") * 2, F.lit(90.0), F.count_if(F.col("p_size") == 50))
    return table(spark, sf, "part").groupBy("p_brand").agg(F.round(value, 6).alias("readiness"))


@query("P11_rule_domains", "SELECT lower(split_part(p_name, ' ', 1)) AS domain, count(*) AS n FROM part GROUP BY 1")
def rule_domains(spark, sf):
    return mining.rule_domains(table(spark, sf, "part"), "p_name")


LANGUAGES = [("de", "\\bund\\b|\\bder\\b", 5), ("en", "\\bthe\\b|\\band\\b", 5), ("es", "\\blos\\b|\\bque\\b", 4), ("fr", "\\bles\\b|\\bdes\\b", 4)]


@query("P13_source_language", "WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS language, 10 * {w} * (contains(' ' || coalesce(text, '') || ' ', ' {a} ') OR contains(' ' || coalesce(text, '') || ' ', ' {b} '))::INT AS score FROM documents" for n, a, b, w in (("de", "und", "der", 5), ("en", "the", "and", 5), ("es", "los", "que", 4), ("fr", "les", "des", 4))) + "), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS k, sum(score) OVER (PARTITION BY doc_id) AS total FROM s) SELECT doc_id, CASE WHEN score > 0 THEN language ELSE 'cobol' END AS language, round(least(0.99, score / greatest(total, 50)), 6)::DOUBLE AS confidence FROM r WHERE k = 1")
def source_language(spark, sf):
    patterns = [(n, f" {a} | {b} ", w) for n, a, b, w in (("de", "und", "der", 5), ("en", "the", "and", 5), ("es", "los", "que", 4), ("fr", "les", "des", 4))]
    padded = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("text"))
    return mining.detect_source_language(padded, "doc_id", "text", patterns).withColumn("confidence", F.round("confidence", 6))


@query("P14_document_aggregates", RULES + """, pr AS (SELECT p_partkey AS id, p_size AS complexity FROM part), crit AS (SELECT doc_id FROM rules WHERE criticality = 'critical' ORDER BY confidence DESC, doc_id LIMIT 10), cx AS (SELECT id, complexity FROM pr WHERE complexity > 20 ORDER BY complexity DESC, id LIMIT 10)
SELECT 'categories' AS part, category AS subject, round(avg(confidence), 6) AS value FROM rules GROUP BY category UNION ALL SELECT 'critical', doc_id::VARCHAR, NULL FROM crit UNION ALL SELECT 'complex', id || ' ' || CASE WHEN complexity > 50 THEN 'high' WHEN complexity > 30 THEN 'medium' ELSE 'low' END, complexity FROM cx UNION ALL SELECT 'reviews', review_status, count(*) FROM rules GROUP BY review_status""")
def document_aggregates(spark, sf):
    parts = mining.document_aggregates(rules(spark, sf).withColumnRenamed("doc_id", "id"), table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("complexity")))
    none = F.lit(None).cast("double")
    columns = {"categories": ("category", F.round("mean_confidence", 6)), "critical": (F.col("id").cast("string"), none), "complex": (F.concat_ws(" ", F.col("id").cast("string"), "risk"), F.col("complexity").cast("double")), "reviews": ("review_status", F.col("n").cast("double"))}
    return g.union_all([parts[k].select(F.lit(k).alias("part"), (F.col(a) if isinstance(a, str) else a).alias("subject"), v.alias("value")) for k, (a, v) in columns.items()])


@query("P15_lineage", "SELECT s_name AS source, p_type AS target, count(*) AS flows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def lineage(spark, sf):
    flows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    return mining.lineage(flows, table(spark, sf, "supplier"), table(spark, sf, "part"), "s_suppkey", "p_partkey", "s_name", "p_type")


@query("P16_overall_risk", "WITH m AS (SELECT p_brand, avg(p_size) / 5 AS s FROM part GROUP BY 1) SELECT round(0.6 * avg(s) + 0.4 * max(s), 6) AS risk, CASE WHEN 0.6 * avg(s) + 0.4 * max(s) >= 7 THEN 'critical' WHEN 0.6 * avg(s) + 0.4 * max(s) >= 5 THEN 'high' WHEN 0.6 * avg(s) + 0.4 * max(s) >= 3 THEN 'medium' ELSE 'low' END AS level FROM m")
def overall_risk(spark, sf):
    risk = 0.6 * F.avg("s") + 0.4 * F.max("s")
    return table(spark, sf, "part").groupBy("p_brand").agg((F.avg("p_size") / 5).alias("s")).agg(F.round(risk, 6).alias("risk"), g.risk_level(risk).alias("level"))


@query("P17_assignment", "SELECT o_orderkey, coalesce(try_cast(left(o_orderpriority, 1) AS DOUBLE), 0.0) AS n, rpad(o_orderpriority, 12, ' ') AS fixed FROM orders")
def assignment(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.number_or_zero(F.left("o_orderpriority", F.lit(1))).alias("n"), scalar.fixed_text(F.col("o_orderpriority"), 12).alias("fixed"))


@query("P19_rule_list", RULES + " SELECT doc_id FROM rules WHERE category = 'en' AND confidence >= 0.5 AND review_status = 'pending'")
def rule_list(spark, sf):
    return rules(spark, sf).where("category = 'en' AND confidence >= 0.5 AND review_status = 'pending'").select("doc_id")


# --- scalar functions and conditions (F) ---


@query("F1_strings", "SELECT p_partkey, upper(trim(p_name)) AS up, rpad(p_brand, 10, ' ') AS padded, substr(p_name, 2, 3) AS part, replace(p_name, ' ', '_') AS joined FROM part")
def strings(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("up"), F.rpad("p_brand", 10, " ").alias("padded"), F.substring("p_name", 2, 3).alias("part"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"))


@query("F2_inspect_tally", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) / 3)::DOUBLE AS n FROM documents WHERE text IS NOT NULL")
def tally(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", scalar.tally(F.col("text"), "the").alias("n"))


@query("F4_safe_divide", "SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice / nullif(l_discount, 0), l_extendedprice), 4) AS v FROM lineitem")
def safe_divide(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalar.divide_or_keep(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("v"))


@query("F7_sorted_json", "SELECT o_orderkey, '{\"a\":\"' || o_orderstatus || '\",\"b\":\"' || o_custkey || '\"}' AS json FROM orders")
def sorted_json(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.sorted_json(F.struct(F.col("o_custkey").alias("b"), F.col("o_orderstatus").alias("a"))).alias("json"))


CONDITION = {"all": [{"field": "o_totalprice", "operator": "greater_or_equal", "value": 1000}, {"any": [{"field": "o_orderstatus", "operator": "in", "value": ["F", "O"]}, {"field": "o_orderpriority", "operator": "starts_with", "value": "1"}]}, {"not": {"field": "o_custkey", "operator": "less_than", "value": 10}}]}


@query("F9_compiled_rule", "SELECT count(*) AS n FROM orders WHERE o_totalprice >= 1000 AND (o_orderstatus IN ('F', 'O') OR starts_with(o_orderpriority, '1')) AND NOT o_custkey < 10")
def compiled(spark, sf):
    return table(spark, sf, "orders").where(mining.compile_condition(CONDITION)).agg(F.count("*").alias("n"))


# --- sinks (I) ---


@query("I1_dot_export", GRAPH + " SELECT 0 AS part, 'digraph g {' AS line UNION ALL SELECT 1, '  \"' || id || '\" [label=\"' || name || '\"];' FROM nodes UNION ALL SELECT 2, '  \"' || source || '\" -> \"' || target || '\" [label=\"' || type || '\"];' FROM edges UNION ALL SELECT 3, '}'")
def dot(spark, sf):
    return exports.graph_lines(nodes(spark, sf), edges(spark, sf), "dot")


SAFE = "regexp_replace({}, '[^A-Za-z0-9]', '_', 'g')"
XML = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
FORMATS = {
    "mermaid": ("graph TD", "'  ' || " + SAFE.format("id") + " || '[\"' || name || '\"]'", "'  ' || " + SAFE.format("source") + " || ' -->|' || type || '| ' || " + SAFE.format("target"), ""),
    "graphml": ('<graphml><graph edgedefault="directed">', "'<node id=\"' || " + XML.format("id") + " || '\"><data key=\"type\">' || " + XML.format("type") + " || '</data></node>'", "'<edge source=\"' || source || '\" target=\"' || target || '\"><data key=\"type\">' || type || '</data></edge>'", "</graph></graphml>"),
    "gexf": ('<gexf version="1.3"><graph defaultedgetype="directed">', "'<node id=\"' || id || '\" label=\"' || " + XML.format("name") + " || '\"/>'", "'<edge source=\"' || source || '\" target=\"' || target || '\" label=\"' || type || '\"/>'", "</graph></gexf>"),
    "json": ('{"format":"graph"}', "'{\"id\":\"' || id || '\",\"type\":\"' || type || '\",\"name\":\"' || name || '\"}'", "'{\"source\":\"' || source || '\",\"target\":\"' || target || '\",\"type\":\"' || type || '\"}'", '{"end":true}'),
    "cytoscape": ('{"elements":[', "'{\"data\":{\"id\":\"' || id || '\",\"label\":\"' || name || '\",\"type\":\"' || type || '\"}}'", "'{\"data\":{\"id\":\"' || source || '>' || target || '\",\"source\":\"' || source || '\",\"target\":\"' || target || '\",\"type\":\"' || type || '\"}}'", "]}"),
}


@query("I1_graph_formats", GRAPH + " " + " UNION ALL ".join(f"SELECT '{k}' AS format, 0 AS part, '{a}' AS line UNION ALL SELECT '{k}', 1, {b} FROM nodes UNION ALL SELECT '{k}', 2, {c} FROM edges UNION ALL SELECT '{k}', 3, '{d}'" for k, (a, b, c, d) in FORMATS.items()))
def graph_formats(spark, sf):
    return g.union_all([exports.graph_lines(nodes(spark, sf), edges(spark, sf), k).select(F.lit(k).alias("format"), "part", "line") for k in FORMATS])


@query("I2_csv_export", GRAPH + " SELECT 0 AS part, 'id,type,name|source,target,type' AS line UNION ALL SELECT 1, id || ',' || type || ',' || name FROM nodes UNION ALL SELECT 2, source || ',' || target || ',' || type FROM edges UNION ALL SELECT 3, ''")
def csv(spark, sf):
    return exports.graph_lines(nodes(spark, sf), edges(spark, sf), "csv")


@query("I3_audit_csv", "SELECT event_id, event_id || ',' || event_type || ',\"' || replace(props, '\"', '\"\"') || '\"' AS line FROM events")
def audit_csv(spark, sf):
    return table(spark, sf, "events").select("event_id", exports.csv_line(F.col("event_id"), F.col("event_type"), F.col("props")).alias("line"))


@query("I4_training_jsonl", """SELECT conv_id, '{"messages":[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || ']}' AS line FROM conversations GROUP BY 1""")
def training_jsonl(spark, sf):
    return exports.training_lines(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


# --- questions (N) ---

def quoted(text):
    return "'" + text.replace("'", "''") + "'"


# Users' turns are questions; their number asks for more, so that every intent occurs.
ASKED = ("Where is the code for ", "What uses the file and the data flow of ", "Show me the dependencies of ", "Hello, ", "What breaks if I change ", "Compare OLD with ", "Give me a summary of ", "How is premium calculated by the business rule? ")
ASKED_SQL = "asked AS (SELECT conv_id, turn, [" + ", ".join(map(quoted, ASKED)) + "][conv_id % 8 + 1] || text AS text FROM conversations WHERE role = 'user')"
INTENT_SQL = "scored AS (SELECT conv_id, turn, text, [" + ", ".join(
    f"{{'s': {' + '.join([f'10 * regexp_matches(lower(text), {quoted(x)})::INT' for x in patterns] + [f'5 * contains(lower(text), {quoted(w)})::INT' for w in words])}, 'k': {-k}, 'intent': '{intent}'}}" for k, (intent, (patterns, words)) in enumerate(mining.INTENTS.items())
) + "] AS r FROM asked), best AS (SELECT conv_id, turn, text, list_max(r) AS b, list_sum(list_transform(r, lambda x: x.s)) AS total FROM scored)"


def asked(spark, sf):
    """Users' turns as questions."""
    start = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("conv_id") % 8 + 1).cast("int"))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(start, "text").alias("text")).withColumn("question", F.struct("conv_id", "turn"))


@query("N1_intents", f"WITH {ASKED_SQL}, {INTENT_SQL} SELECT conv_id, turn, CASE WHEN b.s > 0 THEN b.intent ELSE 'unknown' END AS intent, CASE WHEN b.s > 0 THEN round(least(0.95::DOUBLE, b.s / total::DOUBLE + CASE WHEN b.s > 15 THEN 0.2::DOUBLE ELSE 0 END), 6) ELSE 0 END AS confidence FROM best")
def intents(spark, sf):
    return mining.classify(asked(spark, sf), "question", "text").select("question.*", "intent", "confidence")


NAMED = ("What does procedure PAY-CALC do in file ledger.cbl? ", "Which rule checks the Balance field of customer Smith? ", "How does the billing system use database DB2X and api v2? ", "", "Explain validation V17 and Rule V17. ")
ENTITY_SQL = ", ".join(f"{{'place': {k}, 'type': '{kind}', 'entity': regexp_extract(text, {quoted(x)}, 1)}}" for k, (kind, x) in enumerate((kind, x) for kind, some in mining.ENTITIES.items() for x in some))


@query("N2_entities", "WITH q AS (SELECT conv_id, turn, [" + ", ".join(map(quoted, NAMED)) + f"][conv_id % 5 + 1] || text AS text FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, turn, unnest([{ENTITY_SQL}]) AS x FROM q) SELECT conv_id, turn, arg_min(x.type, x.place) AS type, arg_min(x.entity, x.place) AS entity FROM f WHERE x.entity <> '' GROUP BY conv_id, turn, lower(x.entity)")
def question_entities(spark, sf):
    start = F.element_at(F.array(*map(F.lit, NAMED)), (F.col("conv_id") % 5 + 1).cast("int"))
    questions = table(spark, sf, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("question"), F.concat(start, "text").alias("text"))
    return mining.entities(questions, "question", "text").select("question.*", "type", "entity")


@query("N3_keywords", "SELECT conv_id, turn, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\-_.,;:!?()\\[\\]{}''\"]+'), lambda w: len(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was'))))::BIGINT AS n FROM conversations")
def keywords(spark, sf):
    from tessera.operators.catalog import tokens

    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query("N4_ranked_nodes", DESCRIBED + """, s AS (SELECT id, (20 * contains(lower(name), '00001')::INT + 10 * contains(lower(description), '00001')::INT + list_sum([5 * contains(lower(name), w)::INT + 3 * contains(lower(description), w)::INT + 2 * (len(list_filter(tags, lambda t: contains(lower(t), w))) > 0)::INT for w in ['supplier', '7', 't3']]))::INT AS score FROM dn)
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def ranked(spark, sf):
    return mining.ranked_nodes(described(spark, sf), ["00001"], ["supplier", "7", "T3"])


@query("N5_by_type_keyword", GRAPH + " SELECT id FROM nodes WHERE type = 'nation' AND (contains(lower(name), 'a') OR contains(lower(name), '1'))")
def by_type(spark, sf):
    return mining.by_keywords(nodes(spark, sf), ["name"], ["A", "1"], ["nation"]).select("id")


@query("N6_rule_match", RULES + " SELECT doc_id FROM rules WHERE contains(lower(text), 'license') OR contains(lower(text), 'keit') OR category = 'keit' ORDER BY doc_id LIMIT 10")
def rule_match(spark, sf):
    return mining.by_keywords(rules(spark, sf), ["text", "category"], ["license", "keit"]).select("doc_id").orderBy("doc_id").limit(10)


# Every customer is a question; whom they bought from is what was found, what was written under their number the rules.
EVIDENCE = GRAPH + """, q AS (SELECT c_custkey AS question_id, ['dependency', 'impact', 'search', 'code-location', 'explanation', 'summary', 'business-rule', 'unknown'][c_custkey % 8 + 1] AS intent FROM customer),
f AS (SELECT q.question_id, q.intent, n.id, n.name, CASE WHEN n.confidence < 0.5 THEN 'business-rule' WHEN ends_with(n.id, '1') THEN 'data-structure' ELSE n.type END AS type, CASE WHEN n.id LIKE '%2' THEN NULL ELSE 'Supplies ' || e.type END AS description, CASE WHEN n.id LIKE '%3' THEN n.id || '.cbl:1' END AS location,
  row_number() OVER (PARTITION BY q.question_id ORDER BY n.confidence DESC, n.id) AS k FROM q JOIN edges e ON e.source = 'c:' || q.question_id JOIN nodes n ON n.id = e.target WHERE e.type = 'calls'),
fr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY k) AS rk FROM f WHERE type = 'business-rule'),
r AS (SELECT doc_id AS question_id, source AS name, coalesce(lang, 'none') AS category, left(text, 100) AS description, CASE doc_id % 2 WHEN 0 THEN 'a + b' END AS formula, 0.875::DOUBLE AS confidence FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
fa AS (SELECT question_id, count(*) AS n, list('• **' || name || '** (' || type || ')' ORDER BY k) AS bullets, list(name ORDER BY k) AS names, list(id ORDER BY k) AS ids, list(type ORDER BY k) AS types, list(coalesce(description, '') ORDER BY k) AS ds, list(coalesce(' (' || location || ')', '') ORDER BY k) AS locs FROM f GROUP BY 1),
fk AS (SELECT question_id, list('• ' || n || ' ' || type || '(s)' ORDER BY k) AS kinds FROM (SELECT question_id, type, count(*) AS n, min(k) AS k FROM f GROUP BY 1, 2) GROUP BY 1),
fb AS (SELECT question_id, count(*) AS m, list('**' || name || '**: ' || coalesce(description, 'Business rule') ORDER BY rk) AS rl FROM fr GROUP BY 1),
a AS (SELECT q.question_id, q.intent, coalesce(fa.n, 0) AS n, coalesce(m, 0) AS m, bullets, names, ids, types, ds, locs, kinds, rl, r.name AS rn, r.category, r.description AS rd, r.formula, (r.name IS NOT NULL)::INT AS nr FROM q LEFT JOIN fa USING (question_id) LEFT JOIN fk USING (question_id) LEFT JOIN fb USING (question_id) LEFT JOIN r USING (question_id)),
ans AS (SELECT *, CASE WHEN n = 0 AND nr = 0 THEN 'I couldn''t find specific information matching your question. Try rephrasing or being more specific about what you''re looking for.'
 WHEN intent = 'business-rule' THEN CASE WHEN nr + m = 0 THEN 'No matching business rules found.' ELSE 'Found ' || (nr + m) || ' business rule(s):' || chr(10) || chr(10) || array_to_string(list_concat(CASE WHEN nr = 1 THEN ['**' || rn || '** (' || category || '):' || chr(10) || '  ' || rd || CASE WHEN formula IS NOT NULL THEN chr(10) || '  Formula: `' || formula || '`' ELSE '' END || chr(10) || '  Confidence: 88%'] ELSE [] END, coalesce(rl[1:5 - nr], [])), chr(10)) END
 WHEN intent = 'summary' THEN '**System Overview:**' || chr(10) || CASE WHEN n > 0 THEN chr(10) || array_to_string(kinds, chr(10)) ELSE '' END || CASE WHEN nr = 1 THEN chr(10) || chr(10) || '**Key Business Rules:**' || chr(10) || '• ' || rn || ': ' || left(rd, 80) ELSE '' END
 WHEN n = 0 THEN CASE intent WHEN 'dependency' THEN 'No dependencies found.' WHEN 'impact' THEN 'No downstream impact detected.' WHEN 'search' THEN 'No results found.' WHEN 'code-location' THEN 'No matching code locations found.' WHEN 'explanation' THEN 'No information found to explain.' ELSE 'No relevant information found.' END
 WHEN intent = 'dependency' THEN 'Found ' || n || ' dependencies:' || chr(10) || chr(10) || array_to_string(bullets[1:10], chr(10))
 WHEN intent = 'impact' THEN '**' || least(10, n) || ' components would be affected:**' || chr(10) || chr(10) || array_to_string([replace(b, '**', '') for b in bullets[1:10]], chr(10))
 WHEN intent = 'search' THEN 'Found ' || n || ' result(s):' || chr(10) || chr(10) || array_to_string(list_transform(range(1, least(15, n) + 1), lambda i: bullets[i] || CASE WHEN ds[i] <> '' THEN ': ' || left(ds[i], 60) ELSE '' END), chr(10))
 WHEN intent = 'code-location' THEN 'I found ' || n || ' relevant location(s):' || chr(10) || chr(10) || array_to_string(list_transform(range(1, least(5, n) + 1), lambda i: bullets[i] || locs[i] || ': ' || coalesce(nullif(ds[i], ''), 'No description')), chr(10))
 WHEN intent = 'explanation' THEN '**' || names[1] || '** is a ' || types[1] || '.' || CASE WHEN ds[1] <> '' THEN chr(10) || ds[1] ELSE '' END
 ELSE 'Here''s what I found:' || chr(10) || chr(10) || array_to_string(list_transform(range(1, least(10, n) + 1), lambda i: bullets[i] || ': ' || coalesce(nullif(ds[i], ''), 'No description')), chr(10)) END AS answer,
 list_filter([CASE WHEN n > 0 AND intent <> 'impact' THEN 'What would be affected if ' || names[1] || ' changes?' END, CASE WHEN n > 0 AND intent <> 'dependency' THEN 'What does ' || names[1] || ' depend on?' END, CASE WHEN n > 0 AND types[1] = 'data-structure' THEN 'Show me the data flow for ' || names[1] END,
  CASE WHEN n > 0 AND intent <> 'explanation' THEN 'Explain how ' || names[1] || ' works' END, CASE WHEN nr = 1 THEN 'What data does ' || rn || ' use?' END, CASE WHEN nr = 1 THEN 'Where is ' || rn || ' implemented?' END], lambda x: x IS NOT NULL)[1:4] AS fu FROM a)"""


def evidence_of_customers(spark, sf):
    """Questions, nodes and rules."""
    intents_ = ("dependency", "impact", "search", "code-location", "explanation", "summary", "business-rule", "unknown")
    k = F.col("c_custkey")
    questions = table(spark, sf, "customer").select(k.alias("question_id"), F.element_at(F.array(*map(F.lit, intents_)), (k % 8 + 1).cast("int")).alias("intent"))
    bought = edges(spark, sf).where("type = 'calls'").select(F.substring_index("source", ":", -1).cast("long").alias("question_id"), F.col("target").alias("id"), F.col("type").alias("kind"))
    kind = F.when(F.col("confidence") < 0.5, "business-rule").when(F.col("id").endswith("1"), "data-structure").otherwise(F.col("type"))
    found = bought.join(nodes(spark, sf), "id").select(
        "question_id", "id", "name", kind.alias("type"), F.col("confidence").alias("score"), F.when(~F.col("id").endswith("2"), F.concat(F.lit("Supplies "), "kind")).alias("description"), F.when(F.col("id").endswith("3"), F.concat("id", F.lit(".cbl:1"))).alias("location"),
    )
    written = table(spark, sf, "documents").where("text IS NOT NULL AND source IS NOT NULL").select(
        F.col("doc_id").alias("question_id"), F.col("source").alias("name"), F.coalesce("lang", F.lit("none")).alias("category"), F.substring("text", 1, 100).alias("description"), F.when(F.col("doc_id") % 2 == 0, "a + b").alias("formula"), F.lit(0.875).alias("confidence"),
    )
    return questions, found, written


@query("N12_answers", EVIDENCE + " SELECT question_id, answer, array_to_string(coalesce(ids[1:10], []), ' ') AS sources, array_to_string(fu, '|') AS follow_ups FROM ans")
def answers(spark, sf):
    questions, found, written = evidence_of_customers(spark, sf)
    return mining.answers(questions, found, written).select("question_id", "answer", F.array_join("sources", " ").alias("sources"), F.array_join("follow_ups", "|").alias("follow_ups"))


@query("N13_confidence", "SELECT user_id, round(greatest(0.1, least(0.95, 0.8 * CASE WHEN count(*) FILTER (value > 100) = 0 THEN 0.3 WHEN count(*) FILTER (value > 100) > 5 THEN 1.1 ELSE 1.0 END)), 6)::DOUBLE AS confidence FROM events GROUP BY 1")
def answer_confidence(spark, sf):
    value = mining.answer_confidence(F.lit(0.8), F.count_if(F.col("value") > 100))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(value, 6).alias("confidence"))


@query("N14_conversation_ring", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def ring(spark, sf):
    return mining.last_turns(table(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


@query("N15_suggestions", GRAPH + " SELECT type, 'What depends on ' || min(name) || '?' AS suggestion FROM nodes GROUP BY type ORDER BY type LIMIT 10")
def suggestions(spark, sf):
    first = nodes(spark, sf).groupBy("type").agg(F.min("name").alias("name")).orderBy("type").limit(10)
    return first.select("type", F.concat(F.lit("What depends on "), "name", F.lit("?")).alias("suggestion"))


# --- streams ---


@query("O10_stream_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_windows(spark, sf):
    out = streams.run_to_table(spark, streams.window_counts(streams.event_stream(spark, f"{sf}/events.parque[t]"), "1 hour"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "top")


@query("O9_stream_correlation", "SELECT e.user_id, count(*) AS pairs FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 6 HOUR GROUP BY 1")
def stream_correlation(spark, sf):
    source = lambda kind: streams.event_stream(spark, f"{sf}/events.parque[t]").where(F.col("event_type") == kind)
    out = streams.run_to_table(spark, streams.correlated(source("error"), source("purchase"), "6 HOURS"))
    return out.groupBy("user_id").agg(F.count("*").alias("pairs"))


@query("O15_stream_health", HYSTERESIS + " SELECT session_id, state, count(*) AS n FROM h GROUP BY 1, 2")
def stream_health(spark, sf):
    out = streams.run_to_table(spark, streams.health_states(streams.event_stream(spark, f"{sf}/events.parque[t]")))
    return out.groupBy("session_id", "state").agg(F.count("*").alias("n"))


@query("O1_stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    out = streams.run_to_table(spark, streams.deduplicated(streams.event_stream(spark, f"{sf}/events.parque[t]"), ["event_id"]))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("T7_stream_sessions", """WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf):
    out = streams.run_to_table(spark, streams.sessions(streams.event_stream(spark, f"{sf}/events.parque[t]"), "user_id", "4 hours"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
