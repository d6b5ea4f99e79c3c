"""Operator 2, line dedup: lines that many documents repeat are kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, ascii_lower, documents, join_by_key, materialize


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines whose normalised form stands in ``min_docs`` documents or more.

    A line's key is the line without white space at both ends, A-Z lower-cased;
    keys shorter than ``min_chars`` code points never count. A repeated key
    keeps its lines only in the document of the largest id that holds it.

    Returns every input column, with the text replaced by what is left, plus
    ``n_lines`` and ``n_dropped``. Native throughout: lines are exploded with
    their positions, hashed (128 bits), counted by distinct document, and the
    kept positions are reassembled in order. The text itself is shuffled once;
    occurrences of a line that is a large share of all are dealt into pieces.

    Null and empty texts are one empty line. Rows of one id are one document
    when documents are counted; rows with equal id and text get equal results.
    Rows of null id neither count nor lose lines. An empty table stays empty.
    Input columns named ``n_lines`` or ``n_dropped`` are replaced; no other may
    begin with ``_ld_``.
    """
    docs = docs.drop(*{"n_lines", "n_dropped"} - {id_col, text_col})
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.split(text, "\n", -1)
    key = F.trim(F.col("_ld_line"), F.lit(SPACES))
    occurrences = (
        docs.where(F.col(f"`{id_col}`").isNotNull())
        .select(F.col(f"`{id_col}`").alias("_ld_id"), F.xxhash64(text).alias("_ld_text"), F.posexplode(lines).alias("_ld_pos", "_ld_line"))
        .where(F.length("_ld_line") >= min_chars)
        .select("_ld_id", "_ld_text", "_ld_pos", key.alias("_ld_key"))
        .where(F.length("_ld_key") >= min_chars)
        .select("_ld_id", "_ld_text", "_ld_pos", F.unhex(F.md5(ascii_lower(F.col("_ld_key")).cast("binary"))).alias("_ld_hash"))
    )
    occurrences = materialize(occurrences, "lines")
    repeated = (
        occurrences.groupBy("_ld_hash")
        .agg(F.count_distinct("_ld_id").alias("_ld_docs"), F.max("_ld_id").alias("_ld_keeper"), F.count("*").alias("_ld_rows"))
        .where(F.col("_ld_docs") >= min_docs)
        .select("_ld_hash", "_ld_keeper", "_ld_rows")
    )
    drops = (
        join_by_key(occurrences, materialize(repeated, "repeated-lines"), ["_ld_hash"], "_ld_rows", "_ld_id")
        .where(F.col("_ld_id") < F.col("_ld_keeper"))
        .groupBy("_ld_id", "_ld_text")
        .agg(F.collect_set("_ld_pos").alias("_ld_drops"))
    )
    # The lines are split below the join's exchange, so that no lambda splits the text anew.
    split = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text_col],
        F.col(f"`{id_col}`").alias("_ld_id"),
        F.xxhash64(text).alias("_ld_text"),
        lines.alias("_ld_lines"),
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), F.col("_ld_drops"))
    left = F.transform(kept, lambda p: F.element_at(F.col("_ld_lines"), p + 1))
    joined = split.join(drops, ["_ld_id", "_ld_text"], "left")
    return joined.select(
        *[
            F.array_join(F.when(F.col("_ld_drops").isNull(), F.col("_ld_lines")).otherwise(left), "\n").alias(c) if c == text_col else F.col(f"`{c}`")
            for c in docs.columns
        ],
        F.size("_ld_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_ld_drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark, sf_dir):
    """Digest of :func:`line_dedup` over all documents."""
    kept = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT y.*, r.k IS NOT NULL AND y.doc_id < r.keeper AS dropped
  FROM keyed y LEFT JOIN repeated r ON y.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
