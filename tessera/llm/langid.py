"""Operator 8, language ID: nearest of several clustered centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents, id_remainder, ship, small_batches

#: Hashed cells of the byte trigrams, a power of two.
CELLS = 4096


#: Bytes of letters (and of all characters beyond ASCII) stand for themselves, others for a space.
_LETTERS = np.array([k if k >= 128 or chr(k).isalpha() else 32 for k in range(256)], np.uint32)


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """A row of hashed byte-trigram counts for each lower-cased text; what parts words counts as one space."""
    out = np.zeros((len(texts), CELLS), np.float32)
    for k, text in enumerate(texts):
        b = _LETTERS[np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)]
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
        if b.size > 2:
            code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
            out[k] = np.bincount(code >> np.uint32(20), minlength=CELLS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (or 0)."""
    rows = np.log1p(counts) * idf
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # least cosine that a centroid accepts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether the text is nearer to no centroid than its limit."""
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = weighted(trigram_counts(texts), self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1) if len(texts) else np.empty(0, int)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        found = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        return found, np.where(lettered, score, 0.0), ~lettered | (score < self.limits[best])


def _clusters(rows: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest starting points; fewer centroids where rows are few."""
    centres = [rows.mean(axis=0)]
    for _ in range(min(k, len(rows)) - 1):
        centres.append(rows[(rows @ np.array(centres).T).max(axis=1).argmin()])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        kept = [rows[own == c].mean(axis=0) for c in range(len(centres)) if (own == c).any()]
        centres = np.array(kept)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


#: So many drawn texts at most are broadcast to find their rows.
MOST_BROADCAST = 200_000


def training_texts(rows: DataFrame, counts: dict[str, int], sample_rows: int, seed: int) -> DataFrame:
    """About ``sample_rows`` rows of each language as its distinct texts with ``weight``.

    ``counts`` has the rows of each language. A text with c copies among n rows
    gets weight c * sample_rows / n, rounded up or down by a seeded hash of the
    text, so that weights sum to about ``sample_rows``; texts of weight 0 are
    left out. A language of at most ``sample_rows`` rows gives all. Copies are
    counted by hash and meet as one row.
    """
    marked = rows.withColumn("mark", F.xxhash64("text"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "mark"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, sample_rows / n)))])
    copies = marked.groupBy("lang", "mark").agg(F.count("*").alias("copies"))
    drawn = copies.select("lang", "mark", F.floor(F.col("copies") * F.element_at(share, F.col("lang")) + draw).cast("int").alias("weight")).where("weight > 0")
    if sum(min(n, sample_rows) for n in counts.values()) <= MOST_BROADCAST:
        drawn = F.broadcast(drawn)
    return marked.join(drawn, ["lang", "mark"]).groupBy("lang", "text").agg(F.first("weight").alias("weight"))


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", clusters: int = 6, sample_rows: int = 1500, seed: int = 11) -> LanguageModel:
    """Learn from all rows with a language and a letter in the text.

    Document frequencies cover every such row. The centroids are fitted on
    about ``sample_rows`` rows of each language, drawn by a seeded hash of the
    text with copies in proportion (see ``training_texts``); a language with
    fewer gives all. Without rows the model knows no language and answers
    ``und``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel(np.zeros(CELLS, np.float32), [], np.zeros((0, CELLS), np.float32), np.zeros(0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for k in range(0, len(texts), 256):
                total += (trigram_counts(texts[k : k + 256]) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(total)], names=["cell", "n"])

    total = sum(counts.values())
    df = np.zeros(CELLS)
    for r in rows.select("text").mapInArrow(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        df[r["cell"]] = r["n"]
    idf = (np.log((1 + total) / (1 + df)) + 0.05).astype(np.float32)

    sample = training_texts(rows, counts, sample_rows, seed)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("text")
        vectors = np.repeat(weighted(trigram_counts(group["text"].tolist()), idf), group["weight"], axis=0)
        centres = _clusters(vectors, clusters, seed)
        cosine = vectors @ centres.T
        own = cosine.argmax(axis=1)
        limits = [0.6 * np.quantile(cosine[own == c, c], 0.01) if (own == c).any() else 0.0 for c in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c in centres], "bound": limits})

    fitted = sorted(sample.groupBy("lang").applyInPandas(fit, "lang string, centre binary, bound double").collect(), key=lambda r: (r["lang"], bytes(r["centre"])))
    centroids = np.array([np.frombuffer(r["centre"], np.float32) for r in fitted]).reshape(-1, CELLS)
    return LanguageModel(idf, [r["lang"] for r in fitted], centroids, np.array([r["bound"] for r in fitted]))


def detect_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (cosine of the nearest centroid) and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0. Texts
    farther from their centroid than its limit keep their nearest language and
    are marked ``rejected``. Input columns of the three names are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    at, names = docs.columns.index(text_col), [*docs.columns, "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lang, score, rejected = [], [], []
            for k in range(0, len(texts), 256):
                a, b, c = model.predict(texts[k : k + 256])
                lang += a
                score += b.tolist()
                rejected += c.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=names)

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]))


def op8_language_id(spark, sf_dir):
    """Predictions for all documents; learnt from those outside the held-out third.

    Rows of null id are never learnt from and count as held out. Repeated rows
    get equal predictions; an empty table gives an empty result.
    """
    small_batches(spark)
    docs = documents(spark, sf_dir)
    model = fit_languages(docs.where(id_remainder("doc_id", 3) != 1))
    out = detect_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")
