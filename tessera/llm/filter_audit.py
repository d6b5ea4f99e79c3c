"""Operator 11, filter interaction audit: every order of the filters replayed over the documents' flags."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, UPPER, documents, join_by_key, materialize

#: Rows of null id are dealt into so many parts where labels are looked up.
SHARES = 1000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_conditions(text: Column, words: Column, distinct: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by filter."""
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, fails, good, toxic), a row for each document: ``fails`` has bit k set where the k-th filter of ABCDE fails.

    A to D are conditions of the text (too short, repetitive, capitals,
    symbols); E fails where a smaller id has the same text, told by SHA-256.
    The texts are read once; what is joined are narrow rows. Copies meet their
    smallest id in pieces, so that one text may be a large share of all rows.

    Null texts are empty texts, null sources the part ``''``. Rows of null id
    never fail E, make no other row fail it and carry no labels. Rows that
    share an id are documents of their own and never fail E by each other. An
    id is good or toxic if any of its labels says 1. Other columns are left
    out; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # Split at white space; only the ends can give empty words.
    split = read.withColumn("words", F.array_remove(F.split("text", f"[{_class(SPACES)}]+"), ""))
    sized = split.select("id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"))
    bits = [F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(text_conditions(F.col("text"), F.col("n"), F.col("distinct")).values())]
    salt = F.when(F.col("id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("int")).otherwise(0)
    rows = materialize(sized.select("id", salt.alias("salt"), "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("copy"), sum(bits, F.lit(0)).alias("bits")), "flags")
    copies = materialize(rows.groupBy("copy").agg(F.min("id").alias("least"), F.count("*").alias("weight")), "copies")
    marks = join_by_key(rows.withColumn("spread", F.monotonically_increasing_id()), copies, ["copy"], "weight", "spread")
    fails = F.col("bits") + F.when(F.col("id") > F.col("least"), 1 << 4).otherwise(0)
    said = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id"), F.lit(0).alias("salt"))
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = marks.select("id", "salt", "part", fails.alias("fails")).join(said, ["id", "salt"], "left")
    return joined.select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def _class(characters: str) -> str:
    return "".join(f"\\x{ord(c):02x}" for c in characters)


def orders(spark: SparkSession, filters: str) -> DataFrame:
    """(filter_order, bits): every order of the filters with the bit of each step's filter; so many rows as the factorial says."""
    rows = [("".join(p), [1 << filters.index(c) for c in p]) for p in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """What every step of every order of ``filters`` does to each part of ``flags`` (part, fails, good, toxic).

    Each document is crossed with the broadcast orders (120 rows for five
    filters; at most six are allowed), its first failing step found, its steps
    exploded and all counts taken in one aggregate, which combines on the map
    side to a row for each part, order and step. ``shapley`` sums a filter's
    removals over all orders.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. No documents give no rows.
    """
    if not 1 <= len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("one to six different filters")
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession, filters)))
    first = F.lit(len(filters) + 1)
    for k in reversed(range(len(filters))):
        first = F.when(F.col("fails").bitwiseAND(F.col("bits")[k]) != 0, k + 1).otherwise(first)
    steps = crossed.withColumn("first", first).select("part", "filter_order", "fails", "good", "toxic", "first", F.posexplode("bits").alias("place", "bit"))
    step, failing = F.col("place") + 1, F.col("fails").bitwiseAND(F.col("bit")) != 0
    removed = F.col("first") == step
    counts = (F.col("first") > step, removed, failing & (F.col("first") < step), F.col("fails") == F.col("bit"), removed & F.col("good"), removed & F.col("toxic"))
    counted = steps.groupBy("part", "filter_order", step.alias("step")).agg(*[F.count_if(c).alias(name) for name, c in zip(COUNTS, counts, strict=True)])
    own = counted.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    return own.withColumn("shapley", F.expr("sum(removed) OVER (PARTITION BY part, filter)")).drop("filter")


def op11_filter_audit(spark, sf_dir):
    """All 120 orders of five filters over all documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return replay(document_flags(documents(spark, sf_dir), labels))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
flags AS (
  SELECT part, doc_id,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM texts),
said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
classes AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
               || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM flags LEFT JOIN said USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
marked AS (
  SELECT part, filter_order, step, n, good, toxic, fails, filter_order[step] AS f,
         contains(fails, filter_order[step]) AS failing,
         len(list_filter(string_split(fails, ''), lambda x: x <> '' AND contains(filter_order[1:step - 1], x))) > 0 AS gone
  FROM classes, steps),
counted AS (
  SELECT part, filter_order, step, any_value(f) AS f,
         coalesce(sum(n) FILTER (WHERE NOT failing AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE failing AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE failing AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE failing AND NOT gone AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (WHERE failing AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM marked GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
