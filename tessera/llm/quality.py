"""Operator 5, quality classifier: random Fourier features, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents, id_remainder, materialize, ship, small_batches

STATISTICS = (
    "log_chars", "log_words", "log_lines", "upper", "lower", "digit", "space", "high_bytes", "exclaim", "pipe", "marks", "stops", "other_marks", "control",
    "word_bytes", "word_spread", "unique_words", "capital_words", "unique_lines", "line_words", "top_word", "entropy", "short_words", "long_words",
)
BINS = 2048


def document_statistics(text: str | None) -> list[float]:
    """Numbers about a text alone: sizes, shares of kinds of bytes, words and lines."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    m = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    share = hist[hist > 0] / n
    punctuation = hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()
    stops, marks = hist[[44, 46, 58, 59, 63]].sum(), hist[[35, 36, 37, 38, 42, 64, 94, 126]].sum()
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), hist[65:91].sum() / n, hist[97:123].sum() / n, hist[48:58].sum() / n,
        (hist[9:14].sum() + hist[32]) / n, hist[128:].sum() / n, hist[33] / n, hist[124] / n, marks / n, stops / n,
        (punctuation - stops - marks - hist[33] - hist[124]) / n, (hist[:9].sum() + hist[14:32].sum() + hist[127]) / n,
        sizes.mean(), sizes.std(), len(counts) / m, sum(w[:1].isupper() for w in words) / m, len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)),
        max(counts.values(), default=0) / m, float(-(share * np.log2(share)).sum()), (sizes <= 2).mean(), (sizes > 12).mean(),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row, one pass over the texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [document_statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`")).mapInArrow(run, "doc_id long, stats array<float>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    raw_points: np.ndarray | None = None
    scores: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random cosines whose products approximate a Gaussian kernel, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / self.frequencies.shape[1])
        return np.hstack([wave, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores in 0 to 1; 0.5 where nothing was learnt."""
        if self.weights is None or not len(stats):
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.raw_points, self.scores)


def isotonic(x: np.ndarray, positive: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted bins; block means at block centres, non-decreasing."""
    blocks: list[list[float]] = []
    for a, p, c in zip(x, positive, n, strict=True):
        blocks.append([a * c, p, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _stats(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(STATISTICS)).astype(np.float64)


def fit_quality(examples: DataFrame, features: int = 320, bandwidth: float = 4.0, ridge: float = 1e-3, sample_rows: int = 200_000, seed: int = 5) -> QualityModel:
    """Fit on ``examples(stats, label)``: about ``sample_rows`` of them, drawn by a seeded hash.

    Normal equations are summed within partitions and then in one more level,
    so the driver gets a few small matrices. Scores are calibrated on a
    histogram of raw predictions of the same examples. Null labels are left
    out; examples may repeat.
    """
    ship(examples.sparkSession)
    examples = examples.where("label IS NOT NULL AND stats IS NOT NULL")
    total = examples.count()
    rng = np.random.default_rng(seed)
    d = len(STATISTICS)
    model = QualityModel(np.zeros(d), np.ones(d), rng.standard_normal((d, features)) / bandwidth, rng.uniform(0, 2 * np.pi, features))
    if not total:
        return model
    draw = F.pmod(F.xxhash64(F.lit(seed), "stats"), F.lit(1 << 30)) / float(1 << 30)
    examples = materialize(examples.where(draw < min(1.0, sample_rows / total)).select("stats", F.col("label").cast("double").alias("label")).repartition(12), "examples")
    moments = examples.agg(*[f(F.element_at("stats", k + 1)).alias(f"{f.__name__}{k}") for k in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None:
        return model
    model.mean = np.array([moments[2 * k] for k in range(d)])
    model.scale = np.maximum(np.array([moments[2 * k + 1] for k in range(d)]), 1e-4)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if batch.num_rows:
                z, y = model.features(_stats(batch)), batch.column("label").to_numpy()
                a += z.T @ z
                b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((features + 1) ** 2), np.zeros(features + 1)
        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a += np.frombuffer(x)
                b += np.frombuffer(y)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    sums = examples.mapInArrow(equations, "a binary, b binary").repartition(2).mapInArrow(summed, "a binary, b binary").collect()
    a = sum(np.frombuffer(r["a"]) for r in sums).reshape(features + 1, features + 1)
    b = sum(np.frombuffer(r["b"]) for r in sums)
    penalty = np.full(features + 1, ridge * max(a[-1, -1], 1))
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(a + np.diag(penalty), b)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, positive = np.zeros(BINS, np.int64), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                at = np.clip(((model.raw(_stats(batch)) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
                np.add.at(n, at, 1)
                np.add.at(positive, at, batch.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n), pa.array(positive)], names=["bin", "n", "positive"])

    rows = sorted(examples.mapInArrow(histogram, "bin long, n long, positive double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).where("n > 0").collect())
    x = (np.array([r["bin"] for r in rows]) + 0.5) * 3 / BINS - 1
    points, scores = isotonic(x, np.array([r["positive"] for r in rows]), np.array([float(r["n"]) for r in rows]))
    # Ends beyond the blocks' centres keep scores apart where the blocks are flat.
    model.raw_points = np.concatenate([[-1.0], points, [2.0]])
    model.scores = np.clip(np.concatenate([[scores[0] * 0.9], scores, [min(1.0, scores[-1] * 1.001)]]), 0, 1)
    return model


def score_statistics(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of rows of :func:`with_statistics`."""
    ship(stats.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stats(batch)), pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """All columns and ``score`` (replacing one of that name), in one pass over the texts."""
    ship(docs.sparkSession)
    docs = docs.drop("score")
    at, names = docs.columns.index(text_col), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([document_statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(stats.astype(np.float32).astype(np.float64)), pa.float64())], names=names)

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Examples outside the held-out fifth of ids. Labels that repeat count as often as they stand."""
    train = labels.where(id_remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    return stats.join(train, "doc_id").select("stats", "label")


def labelled_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample_rows: int = 200_000, seed: int = 5) -> DataFrame:
    """:func:`labelled` for a frame of whole documents: statistics of about ``sample_rows`` labelled ids alone.

    The ids are drawn before any text is read, by a seeded hash, and broadcast;
    no text is shuffled. Labels that repeat with the same value count once.
    """
    train = labels.where((id_remainder("doc_id", 5) != 0) & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).distinct()
    train = materialize(train, "labels")
    total = train.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    train = F.broadcast(train.where(draw < min(1.0, sample_rows / max(total, 1))))  # about sample_rows rows
    chosen = docs.join(train.select("doc_id").distinct(), "doc_id", "left_semi")
    return with_statistics(chosen, text_col=text_col).join(train, "doc_id").select("stats", "label")


def op5_quality_classifier(spark, sf_dir):
    """Scores of all documents; labels of the held-out fifth are not learnt from.

    Null and empty texts are scored by their (zero) sizes. Rows of null id are
    scored, never learnt from, and count as held out; equal texts get equal scores.
    """
    small_batches(spark)
    stats = materialize(with_statistics(documents(spark, sf_dir)), "statistics")
    model = fit_quality(labelled(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score_statistics(stats, model)
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
