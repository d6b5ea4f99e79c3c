"""The corpus pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode
from tessera.llm.common import WORD, documents, materialize, small_batches
from tessera.llm.jaccard import jaccard_components
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix
from tessera.llm.quality import fit_quality, labelled_documents, score_documents

#: Documents scored below this are rejected.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier, learnt from ``labels``, scores 0.3 or more."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(labelled_documents(docs, labels))
    return score_documents(docs, model).where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of 40 or more characters that stand in five documents, but for one of them."""
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component, that of the smallest id.

    Rows that share an id are decided each by its own text; equal rows are one.
    Rows of null id come after all others: one stays only where its component
    has no row with an id. Documents without words (emptied by the stage
    before) link with nothing and stay; those of null id each for itself.
    """
    keyed = docs.withColumn("near_row", F.xxhash64("doc_id", "text"))
    nameless = F.col("doc_id").isNull() & (F.col("text").isNull() | ~F.col("text").rlike(WORD))
    named = keyed.where(~nameless)
    sets = jaccard_components(named, id_col="near_row").select("near_row", F.col("component_id").alias("near_set")).distinct()
    ids = named.select("near_row", "doc_id").distinct()
    keep = ids.join(sets, "near_row").groupBy("near_set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "near_row")).alias("near_first")).select("near_first.near_row")
    kept = named.join(keep, "near_row", "left_semi")
    # Rows are equal if id and text are, whatever their hashes.
    place = F.expr("row_number() OVER (PARTITION BY near_row, doc_id, text ORDER BY near_row)")
    once = kept.withColumn("near_place", place).where("near_place = 1")
    return once.select(*docs.columns).unionByName(docs.where(nameless).select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their target weights.

    Rows of equal id, source and text share the copies that the mix gives them.
    """
    # Lengths before the values and a mark for nulls: no two rows of different values read alike.
    values = [F.col(c).cast("string") for c in ("doc_id", "source", "text")]
    parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    keyed = docs.withColumn("mix_key", F.md5(F.concat(*parts).cast("binary")))
    chosen = mix(keyed, id_col="mix_key").groupBy("mix_key").agg(F.sum("copies").alias("mix_copies"), F.count("*").alias("mix_rows")).where("mix_copies > 0")
    placed = keyed.join(chosen, "mix_key").withColumn("mix_place", F.expr("row_number() OVER (PARTITION BY mix_key ORDER BY mix_key)"))
    own = F.expr("mix_copies DIV mix_rows + CASE WHEN mix_place <= mix_copies % mix_rows THEN 1 ELSE 0 END")
    return placed.withColumn("mix_own", own).where("mix_own > 0").withColumn("mix_turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_own")))).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; the last stage's rows carry ids and the digest of the decoded text."""
    small_batches(spark)
    out = bpe_encode(docs.select("doc_id", "source", "text"), decoded_col="decoded")
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", encoding_stage),
]

#: The stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
