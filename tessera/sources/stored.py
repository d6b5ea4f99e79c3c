"""Stored look-up tables: adjacency and postings in bucketed tables that are read by key, not scanned.

A table is written once, bucketed by its key and sorted within the buckets, and
grows by appending. Looking up a checked number of keys reads only their
buckets, and in them only row groups that may hold them; more keys are joined,
without shuffling the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.catalog import SEPARATORS, STOP_WORDS, tokens
from tessera.operators.components import checkpointed
from tessera.session import shared_dir

#: So many keys are looked up by their values; more are joined.
LOOK_UPS = 5000
GRAM = 3
#: Steps that a task tells apart and sorts into its bucket.
STEPS_OF_BUCKET = 500_000


def store(df: DataFrame, by: str, buckets: int = 16, name: str | None = None) -> str:
    """Write ``df`` as a table bucketed by ``by`` in the shared folder; append to it where ``name`` is one already. Returns its name."""
    spark = df.sparkSession
    exists = name is not None and spark.catalog.tableExists(name)
    name = name or f"stored_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).format("parquet")
    if exists:
        writer.mode("append").saveAsTable(name)
    else:
        writer.option("path", f"{shared_dir(spark)}/stored/{name}").saveAsTable(name)
    return name


def look_up(spark: SparkSession, name: str, by: str, keys: DataFrame | Iterable) -> DataFrame:
    """Rows of a stored table whose ``by`` is among ``keys``: values, or a frame of one column of any size."""
    rows = spark.table(name)
    if isinstance(keys, DataFrame):
        found = [r[0] for r in keys.limit(LOOK_UPS + 1).collect()]
        if len(found) > LOOK_UPS:
            return rows.join(keys.select(F.col(keys.columns[0]).alias(by)).distinct(), by, "left_semi")
        keys = found
    keys = list(dict.fromkeys(keys))
    return rows.where(F.col(by).isin(keys)) if keys else rows.limit(0)


def store_adjacency(steps: DataFrame, buckets: int | None = None) -> str:
    """Steps (source, target) by source, each once; unless ``buckets`` says otherwise, one holds ``STEPS_OF_BUCKET`` of them on average, repeated ones too, and there are at least 16."""
    steps = checkpointed(steps.select("source", "target"))
    buckets = buckets or max(16, -(-steps.count() // STEPS_OF_BUCKET))
    # A bucket's steps meet in one task and are told apart there.
    return store(steps.repartition(buckets, "source").distinct(), "source", buckets)


def stored_reach(spark: SparkSession, adjacency: str, start: Sequence, depth: int) -> DataFrame:
    """(id, distance) of what ``start`` reaches over a stored adjacency within ``depth`` steps, by least distance.

    A hop looks up the frontier alone. What was reached is kept as values while
    there are no more than ``LOOK_UPS`` of them, beyond that as frames.
    """
    kind = spark.table(adjacency).schema["source"].dataType.simpleString()
    frame = lambda ids, k: spark.createDataFrame([(i, k) for i in ids], f"id {kind}, distance long")
    seen, frontier, out = set(start), list(dict.fromkeys(start)), frame(dict.fromkeys(start), 0)
    for k in range(1, depth + 1):
        if isinstance(frontier, list):
            if not frontier:
                break
            new = look_up(spark, adjacency, "source", frontier).select(F.col("target").alias("id")).distinct()
            found = [r["id"] for r in new.limit(LOOK_UPS + len(seen) + 1).collect()]
            if len(found) <= LOOK_UPS + len(seen):
                frontier = [i for i in found if i not in seen]
                seen.update(frontier)
                if len(frontier) <= LOOK_UPS:
                    out = out.unionByName(frame(frontier, k))
                    continue
        else:
            new = look_up(spark, adjacency, "source", frontier).select(F.col("target").alias("id")).distinct()
        frontier = new.join(out.select("id"), "id", "left_anti").withColumn("distance", F.lit(k).cast("long"))
        out = out.unionByName(frontier)
        frontier = frontier.select("id")
    return out


def store_postings(df: DataFrame, key: str, text: str, buckets: int = 16) -> dict[str, str]:
    """Two stored tables of ``df``: ``postings(term, key)`` by term, and ``grams(gram, term)``, the parts of three letters of every term, by gram."""
    # Terms keep what a search may ask for: any word of three letters or more, stop words too.
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda w: F.length(w) >= GRAM)
    postings = store(df.select(F.explode(F.array_distinct(words)).alias("term"), key), "term", buckets)
    terms = df.sparkSession.table(postings).select("term").distinct()
    parts = F.transform(F.sequence(F.lit(1), F.length("term") - (GRAM - 1)), lambda i: F.substr("term", i, F.lit(GRAM)))
    return {"postings": postings, "grams": store(terms.select(F.explode(F.array_distinct(parts)).alias("gram"), "term"), "gram", buckets)}


def append_postings(index: dict[str, str], df: DataFrame, key: str, text: str, buckets: int = 16) -> None:
    """New documents for an index of :func:`store_postings`; terms that it has already get no second grams."""
    spark = df.sparkSession
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda w: F.length(w) >= GRAM)
    new = df.select(F.explode(F.array_distinct(words)).alias("term"), key)
    known = spark.table(index["postings"]).select("term").distinct()
    fresh = new.select("term").distinct().join(known, "term", "left_anti")
    parts = F.transform(F.sequence(F.lit(1), F.length("term") - (GRAM - 1)), lambda i: F.substr("term", i, F.lit(GRAM)))
    store(fresh.select(F.explode(F.array_distinct(parts)).alias("gram"), "term"), "gram", buckets, index["grams"])
    store(new, "term", buckets, index["postings"])


def stored_search(spark: SparkSession, index: dict[str, str], question: str, key: str, least: float = 0.3, limit: int = 10) -> DataFrame:
    """R8 from a stored index: the share of the question's words that contain, or are contained in, some word of a text.

    Words that contain one have all its parts of three letters: those are
    looked up and checked. Words that one contains are looked up among its own
    parts. Texts are not read. Words with separators in them match nothing but
    their parts.
    """
    asked = [w for w in dict.fromkeys(question.lower().split()) if len(w) > 2 and w not in STOP_WORDS]
    if not asked:
        return spark.table(index["postings"]).select(key, F.lit(0.0).alias("score")).limit(0)
    grams = {a: [a[i : i + GRAM] for i in range(len(a) - GRAM + 1)] for a in asked}
    parts = {a: {a[i:j] for i in range(len(a)) for j in range(i + GRAM, len(a) + 1)} for a in asked}
    names = spark.createDataFrame([(a, g) for a in asked for g in set(grams[a])], "asked string, gram string")
    met = look_up(spark, index["grams"], "gram", [g for a in asked for g in grams[a]]).join(F.broadcast(names), "gram")  # the question's own grams
    longer = met.select("asked", "term").distinct().where(F.contains("term", "asked"))
    inside = spark.createDataFrame([(a, p) for a in asked for p in parts[a]], "asked string, term string")
    terms = longer.unionByName(inside).where(~F.col("term").isin(*STOP_WORDS)).distinct()
    hits = look_up(spark, index["postings"], "term", terms.select("term").distinct()).join(terms, "term")
    scored = hits.groupBy(key).agg((F.count_distinct("asked") / len(asked)).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(limit)
