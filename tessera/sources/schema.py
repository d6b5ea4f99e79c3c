"""Schemas of legacy sources: copybooks, DBDs, clusters, relations, target tables.

Definitions are small texts and are parsed on the driver; data they describe
are read by Spark with the resulting offsets.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import unpack_decimal


@dataclass(frozen=True)
class Field:
    level: int
    name: str
    picture: str | None
    usage: str
    start: int  # from 1
    length: int  # of one occurrence
    kind: str
    scale: int
    occurs: int
    redefines: str | None


def _counts(picture: str) -> tuple[int, int, int]:
    """Digits, characters and decimals of a PIC clause."""
    flat = re.sub(r"([9XA])\((\d+)\)", lambda m: m[1] * int(m[2]), picture.upper())
    whole, _, fraction = flat.partition("V")
    return flat.count("9"), flat.count("X") + flat.count("A"), fraction.count("9") if "V" in flat else 0


def storage_length(picture: str, usage: str) -> int:
    """Bytes by usage: packed (digits + 1) / 2 rounded up, binary 2, 4 or 8, else one a character."""
    digits, chars, _ = _counts(picture)
    if usage == "COMP-3":
        return (digits + 2) // 2
    if usage == "COMP":
        return 2 if digits <= 4 else 4 if digits <= 9 else 8
    return digits + chars


def parse_copybook(text: str) -> list[Field]:
    """Fields with offsets. Numbers in columns 1-6 and comment lines are dropped.

    A group's length is that of its members; REDEFINES starts where its object
    does and adds nothing; OCCURS multiplies.
    """
    body = []
    for line in text.splitlines():
        line = line[6:] if re.match(r"^\d{6}", line) else line
        if not line.lstrip().startswith("*") and not (len(line) > 0 and line[0] == "*"):
            body.append(line)
    items = []
    for statement in re.split(r"\.(?:\s|$)", " ".join(body)):
        m = re.match(r"\s*(\d{2})\s+([\w-]+)(.*)", statement, re.S)
        if not m or int(m[1]) in (66, 88):
            continue
        rest = m[3].upper()
        pic = re.search(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", rest)
        usage = re.search(r"\b(COMP(?:UTATIONAL)?-3|PACKED-DECIMAL|COMP(?:UTATIONAL)?(?:-4)?|BINARY)\b", rest)
        usage = "DISPLAY" if not usage else "COMP-3" if usage[1].endswith("-3") or usage[1].startswith("PACKED") else "COMP"
        occurs, redefines = re.search(r"\bOCCURS\s+(\d+)", rest), re.search(r"\bREDEFINES\s+([\w-]+)", rest)
        items.append((int(m[1]), m[2].upper(), pic[1] if pic else None, usage, int(occurs[1]) if occurs else 1, redefines[1] if redefines else None))

    def size(i: int) -> int:
        level, _, pic, usage, _, _ = items[i]
        if pic:
            return storage_length(pic, usage)
        total, j = 0, i + 1
        while j < len(items) and items[j][0] > level:
            if items[j][0] == items[i + 1][0]:
                total += 0 if items[j][5] else size(j) * items[j][4]
            j += 1
        return total

    out: list[Field] = []
    places: dict[str, int] = {}

    def place(i: int, start: int) -> int:
        """Place item i and its members; returns the index after them."""
        level, name, pic, usage, occurs, redefines = items[i]
        start = places.get(redefines, start) if redefines else start
        places[name] = start
        digits, chars, scale = _counts(pic or "")
        kind = "group" if not pic else "string" if chars else "decimal" if scale else "integer"
        out.append(Field(level, name, pic, usage, start, size(i), kind, scale, occurs, redefines))
        at, j = start, i + 1
        while j < len(items) and items[j][0] > level:
            here, member = at, items[j]
            after = place(j, here)
            if not member[5]:
                at += size(j) * member[4]
            j = after
        return j

    i, at = 0, 1
    while i < len(items):
        after = place(i, at)
        if not items[i][5]:
            at += size(i) * items[i][4]
        i = after
    return out


def decode_record(fields: Sequence[Field], record: Column) -> list[Column]:
    """A column for each elementary field of a binary record; OCCURS makes arrays."""
    def one(f: Field, start: int) -> Column:
        raw = F.substr(record, F.lit(start), F.lit(f.length))
        if f.usage == "COMP-3":
            return unpack_decimal(raw, f.scale)
        text = raw.cast("string")
        if f.kind == "integer":
            return F.trim(text).try_cast("bigint")
        return F.trim(text).try_cast("decimal(31,0)") / 10**f.scale if f.kind == "decimal" else F.rtrim(text)

    return [
        (one(f, f.start) if f.occurs == 1 else F.array(*[one(f, f.start + k * f.length) for k in range(f.occurs)])).alias(f.name.lower().replace("-", "_"))
        for f in fields if f.picture
    ]


def parse_dbd(text: str) -> list[dict]:
    """E5: segments with parent, bytes and fields; the root's sequence field is its key, children point to the parent."""
    segments: list[dict] = []
    for line in text.splitlines():
        args = {k: v.strip("()") for k, v in re.findall(r"(\w+)=(\([^)]*\)|[^,\s]+)", line)}
        if re.search(r"\bSEGM\b", line):
            parent = args.get("PARENT", "0").split(",")[0]
            segments.append({"name": args["NAME"].split(",")[0], "parent": None if parent == "0" else parent, "bytes": int(args.get("BYTES", "0").split(",")[0]), "fields": []})
        elif re.search(r"\bFIELD\b", line) and segments:
            segments[-1]["fields"].append({"name": args["NAME"].split(",")[0], "key": "SEQ" in args["NAME"], "start": int(args.get("START", 1)), "bytes": int(args.get("BYTES", 0)), "type": args.get("TYPE", "C")})
    for s in segments:
        s["primary_key"] = [f["name"] for f in s["fields"] if f["key"]] if s["parent"] is None else []
        s["foreign_key"] = f"{s['parent'].lower()}_id" if s["parent"] else None
    return segments


def parse_cluster(text: str) -> dict:
    """Kind, record length and key of a DEFINE CLUSTER statement."""
    name = re.search(r"NAME\s*\(\s*([\w.-]+)", text)
    kind = next((k for word, k in (("NONINDEXED", "ESDS"), ("NUMBERED", "RRDS"), ("LINEAR", "LDS"), ("INDEXED", "KSDS")) if re.search(rf"\b{word}\b", text)), "KSDS")
    key, record = re.search(r"KEYS\s*\(\s*(\d+)\s+(\d+)", text), re.search(r"RECORDSIZE\s*\(\s*(\d+)\s+(\d+)", text)
    columns = [("record", f"varchar({record[2] if record else 80})")]
    if kind == "KSDS" and key:
        columns.insert(0, ("record_key", f"char({key[1]})"))
    elif kind == "RRDS":
        columns.insert(0, ("rrn", "bigint"))
    return {"name": name[1] if name else None, "kind": kind, "key_length": int(key[1]) if key else None, "key_offset": int(key[2]) if key else None, "columns": columns}


def assemble_keys(columns: DataFrame) -> DataFrame:
    """(table_name, key_name, column_name, seq) to one row a key with its columns in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "column_name")))
    return columns.groupBy("table_name", "key_name").agg(F.array_join(F.transform(ordered, lambda x: x["column_name"]), ",").alias("columns"))


def catalog_reads(frames: dict[str, DataFrame], schemas: Sequence[str]) -> dict[str, DataFrame]:
    """The six reads of a database catalogue, each filtered by schema: tables, columns, primary keys, foreign keys, indexes and sizes.

    ``frames``: tables(schema, name, kind, rows), columns(schema, table_name, column_name, data_type, ordinal),
    constraints(schema, name, table_name, kind), key_columns(schema, constraint_name, table_name, column_name, seq),
    references(schema, name, table_name, ref_schema, ref_table, ref_key), indexes(schema, name, table_name, is_unique)
    and index_columns(schema, name, column_name, seq).
    """
    within = lambda df, column="schema": df.where(F.col(column).isin(*schemas))
    keys = frames["key_columns"]
    primary = within(keys).join(frames["constraints"].where("kind = 'P'").select("schema", F.col("name").alias("constraint_name")), ["schema", "constraint_name"])
    own = keys.select("schema", F.col("constraint_name").alias("name"), "column_name", "seq")
    other = keys.select(F.col("schema").alias("ref_schema"), F.col("constraint_name").alias("ref_key"), F.col("column_name").alias("ref_column"), "seq")
    foreign = within(frames["references"]).join(own, ["schema", "name"]).join(other, ["ref_schema", "ref_key", "seq"])
    return {
        "tables": within(frames["tables"]).where("kind IN ('T', 'V')").select("schema", "name", "kind"),
        "columns": within(frames["columns"]),
        "primary_keys": primary.select("schema", "table_name", "constraint_name", "column_name", "seq"),
        "foreign_keys": foreign.select("schema", "table_name", "name", "column_name", "ref_table", "ref_column", "seq"),
        "indexes": within(frames["indexes"]).join(frames["index_columns"], ["schema", "name"]).select("schema", "table_name", "name", "is_unique", "column_name", "seq"),
        "sizes": within(frames["tables"]).where("kind = 'T'").select("schema", "name", "rows"),
    }


# Patterns of foreign key names, (pattern, text put after the first group to name the table, column or group number that names the column, confidence), and abbreviations of tables.
KEY_NAMES = (
    (r"^(\w+)_id$", "s", "id", 0.7),
    (r"^(\w{3,4})_id$", "", "id", 0.5),
    (r"^fk_(\w+)$", "", "id", 0.8),
    (r"^(\w+)_(code|key|num|number)$", "s", 2, 0.6),
)
ABBREVIATIONS = {
    "cust": "customer", "cus": "customer", "emp": "employee", "prod": "product", "prd": "product", "ord": "order", "inv": "invoice", "acc": "account", "acct": "account",
    "trx": "transaction", "txn": "transaction", "dept": "department", "addr": "address", "cat": "category",
}
TYPE_GROUPS = {"number": ("integer", "int", "bigint", "smallint", "decimal", "numeric"), "text": ("varchar", "char", "text", "string")}


def _type_group(kind: Column) -> Column:
    base = F.lower(F.regexp_replace(kind, r"\(.*\)", ""))
    return F.when(base.isin(*TYPE_GROUPS["number"]), "number").when(base.isin(*TYPE_GROUPS["text"]), "text").otherwise(base)


def inferred_relations(columns: DataFrame, least: float = 0.5) -> DataFrame:
    """(table_name, column_name, target, target_column, confidence) of foreign keys by name.

    ``columns`` has table_name, column_name, data_type, ordinal and is_pk; key
    columns are not asked. A column's name is held against ``KEY_NAMES`` in
    turn; the table that a pattern names is sought as it is, without a last s,
    with one more, and in full for an abbreviation. The first hit counts that
    has the column named, one called id, or a primary key. Confidence is halved
    where types are of different groups.
    """
    name = F.lower("column_name")
    full = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    tries = []
    for k, (pattern, suffix, column, confidence) in enumerate(KEY_NAMES):
        stem = F.concat(F.regexp_extract(name, pattern, 1), F.lit(suffix))
        named = F.regexp_extract(name, pattern, column) if isinstance(column, int) else F.lit(column)
        variants = (stem, F.regexp_replace(stem, "s$", ""), F.concat(stem, F.lit("s")), F.coalesce(F.try_element_at(full, stem), stem))
        for v, variant in enumerate(variants):
            tries.append(F.when(name.rlike(pattern), F.struct(F.lit(10 * k + v).alias("place"), variant.alias("target_name"), named.alias("named"), F.lit(confidence).alias("confidence"))))
    asked = columns.where(~F.col("is_pk")).select("table_name", "column_name", "data_type", F.explode(F.filter(F.array(*tries), lambda x: x.isNotNull())).alias("t")).select("table_name", "column_name", "data_type", "t.*")
    offered = columns.select(F.lower("table_name").alias("target_name"), F.col("table_name").alias("target"), F.col("column_name").alias("target_column"), F.col("data_type").alias("target_type"), F.col("ordinal").alias("target_ordinal"), F.col("is_pk").alias("target_pk"))
    fits = (F.lower("target_column") == F.col("named")) | (F.lower("target_column") == "id") | F.col("target_pk")
    found = asked.join(offered, "target_name").where(fits)
    best = found.groupBy("table_name", "column_name").agg(F.min_by(F.struct("target", "target_column", "confidence", (_type_group(F.col("data_type")) == _type_group(F.col("target_type"))).alias("same")), F.struct("place", "target_ordinal")).alias("b"))
    out = best.select("table_name", "column_name", "b.target", "b.target_column", F.when(F.col("b.same"), F.col("b.confidence")).otherwise(F.col("b.confidence") * 0.5).alias("confidence"))
    return out.where(F.col("confidence") >= least)


def join_relations(joins: DataFrame, by: Sequence[str], often: int = 10) -> DataFrame:
    """How often code joins two columns, and the confidence that follows: 0.9 over ``often`` times, else 0.7."""
    counted = joins.groupBy(*by).agg(F.count("*").alias("frequency"))
    return counted.withColumn("confidence", F.when(F.col("frequency") > often, 0.9).otherwise(0.7))


def table_estimates(columns: DataFrame, relations: DataFrame, sizes: DataFrame, rows_per_minute: int = 10_000) -> DataFrame:
    """(table_name, rows, points, complexity, minutes, has_key) of every table.

    Points: 1 for a computed or packed column, 2 for a large object, 2 for more
    than five relations, 1 without a primary key. ``columns`` may have
    ``computed`` and ``native_type``; ``sizes`` has table_name and rows.
    """
    computed = F.coalesce(F.col("computed"), F.lit(False)) if "computed" in columns.columns else F.lit(False)
    packed = F.coalesce(F.upper("native_type").rlike("PACKED|COMP-3"), F.lit(False)) if "native_type" in columns.columns else F.lit(False)
    each = computed.cast("int") + 2 * F.lower("data_type").rlike("blob|clob").cast("int") + packed.cast("int")
    own = columns.groupBy("table_name").agg(F.sum(each).alias("p"), F.bool_or("is_pk").alias("has_key"))
    ends = relations.select("table_name").unionAll(relations.where("table_name <> target").select(F.col("target").alias("table_name"))).groupBy("table_name").agg(F.count("*").alias("relations"))
    joined = own.join(ends, "table_name", "left").join(sizes.select("table_name", "rows"), "table_name", "left").fillna(0, ["relations", "rows"])
    joined = joined.withColumn("points", F.col("p") + F.when(F.col("relations") > 5, 2).otherwise(0) + F.when(F.col("has_key"), 0).otherwise(1))
    level = F.when(F.col("points") >= 4, "high").when(F.col("points") >= 2, "medium").otherwise("low")
    factor = F.when(F.col("points") >= 4, 2.0).when(F.col("points") >= 2, 1.5).otherwise(1.0)
    return joined.select("table_name", "rows", "points", level.alias("complexity"), (F.ceil(F.col("rows") / rows_per_minute * factor) + 5).alias("minutes"), "has_key")


def migration_estimate(tables: DataFrame, relations: DataFrame, rows_per_minute: int = 10_000, overhead: int = 30) -> DataFrame:
    """One row of total rows, minutes, and complexity and risk from 0 to 10. Relations with ``suggested`` count as unconfirmed."""
    high, medium = F.count_if(F.col("complexity") == "high"), F.count_if(F.col("complexity") == "medium")
    n, rows = F.count("*"), F.sum("rows")
    weight = F.sum(F.when(F.col("complexity") == "high", 3).when(F.col("complexity") == "medium", 2).otherwise(1))
    suggested = F.count_if("suggested") if "suggested" in relations.columns else F.count("*")
    links = relations.agg(suggested.alias("open"), F.count_if(F.col("confidence") < 0.7).alias("weak"))
    of = tables.agg(
        rows.alias("rows"), F.ceil(overhead + rows / rows_per_minute * (1 + (high * 0.3 + medium * 0.1) / n)).alias("minutes"), F.floor(weight / (n * 3) * 10 + 0.5).alias("complexity_score"),
        high.alias("high"), F.count_if(~F.col("has_key")).alias("keyless"),
    )
    size = F.when(F.col("rows") > 100_000_000, 2).when(F.col("rows") > 10_000_000, 1).otherwise(0)
    most = lambda c, each, top: F.least(F.lit(float(top)), F.col(c) * each)
    points = most("open", 0.2, 3) + most("weak", 0.3, 2) + most("high", 0.5, 3) + size + most("keyless", 0.5, 2)
    return of.join(links).select("rows", "minutes", "complexity_score", F.least(F.lit(10), F.floor(points + 0.5)).cast("int").alias("risk_score"))


def merged_evidence(evidence: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confidences, strongest first, weigh 1 / place; the weighted mean, at most 1."""
    ranked = evidence.withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY confidence DESC)"))
    return ranked.groupBy(*by).agg(F.least(F.lit(1.0), F.sum(F.col("confidence") / F.col("_k")) / F.sum(1 / F.col("_k"))).alias("confidence"), F.count("*").alias("evidence"))


# Target types by dialect.
TYPES = {
    "postgresql": {"integer": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "decimal": "DECIMAL", "numeric": "NUMERIC", "float": "REAL", "double": "DOUBLE PRECISION", "char": "CHAR", "varchar": "VARCHAR", "text": "TEXT", "date": "DATE", "time": "TIME", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN", "bytea": "BYTEA", "blob": "BYTEA", "clob": "TEXT"},
    "mysql": {"integer": "INT", "bigint": "BIGINT", "smallint": "SMALLINT", "decimal": "DECIMAL", "numeric": "DECIMAL", "float": "FLOAT", "double": "DOUBLE", "char": "CHAR", "varchar": "VARCHAR", "text": "TEXT", "date": "DATE", "time": "TIME", "timestamp": "TIMESTAMP", "boolean": "TINYINT(1)", "bytea": "BLOB", "blob": "LONGBLOB", "clob": "LONGTEXT"},
    "oracle": {"integer": "NUMBER(10)", "bigint": "NUMBER(19)", "smallint": "NUMBER(5)", "decimal": "NUMBER", "numeric": "NUMBER", "float": "FLOAT", "double": "BINARY_DOUBLE", "char": "CHAR", "varchar": "VARCHAR2", "text": "CLOB", "date": "DATE", "time": "TIMESTAMP", "timestamp": "TIMESTAMP", "boolean": "NUMBER(1)", "bytea": "BLOB", "blob": "BLOB", "clob": "CLOB"},
    "sqlserver": {"integer": "INT", "bigint": "BIGINT", "smallint": "SMALLINT", "decimal": "DECIMAL", "numeric": "NUMERIC", "float": "REAL", "double": "FLOAT", "char": "CHAR", "varchar": "VARCHAR", "text": "NVARCHAR(MAX)", "date": "DATE", "time": "TIME", "timestamp": "DATETIME2", "boolean": "BIT", "bytea": "VARBINARY(MAX)", "blob": "VARBINARY(MAX)", "clob": "NVARCHAR(MAX)"},
    "mongodb": {"integer": "int", "bigint": "long", "decimal": "decimal", "varchar": "string", "text": "string", "date": "date", "timestamp": "date", "boolean": "bool", "bytea": "binData"},
    "dynamodb": {"integer": "N", "bigint": "N", "decimal": "N", "varchar": "S", "text": "S", "date": "S", "timestamp": "S", "boolean": "BOOL", "bytea": "B"},
}
#: Names that data frames have for types of the tables above.
SAME_TYPES = {"int": "integer", "string": "text", "binary": "bytea"}


def target_type(kind: Column, dialect: str) -> Column:
    """The dialect's type; length and precision are kept but for texts and large objects, unknown types become texts of 255."""
    raw = F.lower(F.trim(F.regexp_replace(kind, r"\(.*\)", "")))
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SAME_TYPES.items() for x in kv]), raw), raw)
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES[dialect].items() for x in kv]), base)
    size = F.regexp_extract(kind, r"\(([^)]+)\)", 1)
    sized = F.when((size != "") & ~base.isin("text", "blob", "clob"), F.concat(found, F.lit("("), size, F.lit(")"))).otherwise(found)
    return F.coalesce(sized, F.lit(TYPES[dialect]["varchar"] + "(255)"))


def target_name(name: Column, convention: str = "snake_case") -> Column:
    """Lower case with underscores, or camelCase or PascalCase."""
    clean = F.regexp_replace(F.lower(name), "[^a-z0-9]", "_")
    if convention == "snake_case":
        return clean
    parts = F.transform(F.split(clean, "_(?=[a-z])"), lambda w, i: F.when((i == 0) & F.lit(convention == "camelCase"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2), F.length(w)))))
    return F.array_join(parts, "")


def target_columns(columns: DataFrame, dialect: str, convention: str = "snake_case", audit: bool = False, preserve_nulls: bool = False) -> DataFrame:
    """(table_name, position, target_name, target_type, nullable, default, identity) of the target schema.

    ``audit`` adds created_at and updated_at. A table without primary key gets
    an identity column id. ``columns`` may have ``nullable``.
    """
    name = lambda c: target_name(c, convention)
    own_nulls = F.coalesce(F.col("nullable"), F.lit(True)) if preserve_nulls and "nullable" in columns.columns else F.lit(True)
    none = F.lit(None).cast("string")
    made = [columns.select(name(F.col("table_name")).alias("table_name"), F.col("ordinal").cast("long").alias("position"), name(F.col("column_name")).alias("target_name"), target_type(F.col("data_type"), dialect).alias("target_type"), own_nulls.alias("nullable"), none.alias("default"), F.lit(False).alias("identity"))]
    tables = columns.groupBy(name(F.col("table_name")).alias("table_name")).agg(F.bool_or("is_pk").alias("keyed"), F.max("ordinal").cast("long").alias("last"))
    if audit:
        for k, column in enumerate(("created_at", "updated_at")):
            made.append(tables.select("table_name", (F.col("last") + 1 + k).alias("position"), F.lit(column).alias("target_name"), target_type(F.lit("timestamp"), dialect).alias("target_type"), F.lit(False).alias("nullable"), F.lit("CURRENT_TIMESTAMP").alias("default"), F.lit(False).alias("identity")))
    made.append(tables.where("NOT keyed").select("table_name", F.lit(-1).cast("long").alias("position"), F.lit("id").alias("target_name"), target_type(F.lit("bigint"), dialect).alias("target_type"), F.lit(False).alias("nullable"), none.alias("default"), F.lit(True).alias("identity")))
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


def ddl(columns: DataFrame, dialect: str, relations: DataFrame | None = None, **options) -> DataFrame:
    """(table_name, part, statement): CREATE TABLE with keys first, then foreign keys and indexes of ``relations``."""
    convention = options.get("convention", "snake_case")
    name = lambda c: target_name(c, convention)
    cols = target_columns(columns, dialect, **options)
    define = F.concat("target_name", F.lit(" "), "target_type", F.when(~F.col("nullable"), " NOT NULL").otherwise(""), F.coalesce(F.concat(F.lit(" DEFAULT "), "default"), F.lit("")), F.when(F.col("identity"), " GENERATED ALWAYS AS IDENTITY").otherwise(""))
    body = cols.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("position", define.alias("text")))).alias("parts"))
    keys = columns.where("is_pk").groupBy(name(F.col("table_name")).alias("table_name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", name(F.col("column_name")).alias("k")))), lambda x: x["k"]), ", ").alias("keys"))
    joined = body.join(keys, "table_name", "left")
    lines = F.concat(F.transform("parts", lambda x: x["text"]), F.array(F.concat(F.lit("PRIMARY KEY ("), F.coalesce("keys", F.lit("id")), F.lit(")"))))
    out = joined.select("table_name", F.lit("table").alias("part"), F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" ("), F.array_join(lines, ", "), F.lit(")")).alias("statement"))
    if relations is None:
        return out
    r = relations.select(name(F.col("table_name")).alias("table_name"), name(F.col("column_name")).alias("c"), name(F.col("target")).alias("t"), name(F.col("target_column")).alias("tc"))
    foreign = r.select("table_name", F.lit("foreign_key").alias("part"), F.concat(F.lit("ALTER TABLE "), "table_name", F.lit(" ADD CONSTRAINT fk_"), "table_name", F.lit("_"), "c", F.lit(" FOREIGN KEY ("), "c", F.lit(") REFERENCES "), "t", F.lit(" ("), "tc", F.lit(")")).alias("statement"))
    index = r.select("table_name", F.lit("index").alias("part"), F.concat(F.lit("CREATE INDEX idx_"), "table_name", F.lit("_"), "c", F.lit(" ON "), "table_name", F.lit(" ("), "c", F.lit(")")).alias("statement"))
    return out.unionByName(foreign).unionByName(index)


def migration_plan(columns: DataFrame, sizes: DataFrame, dialect: str, **options) -> dict[str, DataFrame]:
    """From a catalogue to relations, estimates, target schema, statements, load phases and checks, each a frame that is computed when it is read."""
    from tessera.operators.graph import longest_levels

    relations = inferred_relations(columns)
    tables = table_estimates(columns, relations, sizes)
    names = columns.select(F.col("table_name").alias("id")).distinct()
    needs = relations.where("table_name <> target").select(F.col("table_name").alias("source"), "target")
    checks = columns.select("table_name", F.lit("row_count").alias("kind"), F.lit("").alias("subject")).distinct().unionByName(
        columns.where("is_pk").select("table_name", F.lit("null_check").alias("kind"), F.col("column_name").alias("subject"))
    ).unionByName(relations.select("table_name", F.lit("orphans").alias("kind"), F.col("column_name").alias("subject")))
    return {
        "relations": relations, "tables": tables, "estimate": migration_estimate(tables, relations), "target": target_columns(columns, dialect, **options), "statements": ddl(columns, dialect, relations, **options),
        "phases": longest_levels(needs, names).select(F.col("id").alias("table_name"), (F.col("level") + 1).alias("phase")), "checks": checks,
    }


def transform(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Run mapping steps: cast, substring (from 1), concat, rename, filter, order."""
    for s in steps:
        kind = s["kind"]
        if kind == "cast":
            df = df.withColumn(s["column"], F.col(s["column"]).try_cast(s["type"]))
        elif kind == "substring":
            df = df.withColumn(s["to"], F.substring(s["column"], s.get("start", 1), s["length"]))
        elif kind == "concat":
            df = df.withColumn(s["to"], F.concat_ws(s.get("by", ""), *s["columns"]))
        elif kind == "rename":
            df = df.withColumnRenamed(s["column"], s["to"])
        elif kind == "filter":
            df = df.where(s["condition"])
        elif kind == "order":
            df = df.orderBy(*s["columns"])
        else:
            raise ValueError(f"unknown step {kind}")
    return df
