"""Operator 4, approximate nearest neighbours by an adaptive scan over dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, ship

#: Columns of one block, rows of one scanned piece of a list.
BLOCK, PIECE = 16, 4096
#: What rounding in single precision may add to a squared distance of unit vectors.
SLACK = 1e-5
#: Twice the largest squared distance of unit vectors: no radius yet.
OPEN = 8.0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, d): vectors that are finite, complete and not zero, with their length; in their own precision."""
    kind = vectors.select(F.col(f"`{vector_col}`")).schema[0].dataType.simpleString()
    kind, limit = ("array<float>", float(np.finfo(np.float32).max)) if kind == "array<float>" else ("array<double>", float(np.finfo(np.float64).max))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & F.abs(x).between(0, limit)) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("d", F.size("v"))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision times powers of two that bring their largest component near 1: exact, and safe to square."""
    v = vectors.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def rotation(dims: int, seed: int) -> np.ndarray:
    """A seeded orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))[0]


@dataclass
class Index:
    """Inverted lists over rotated unit vectors; ``wanted`` of them are probed."""

    rotation: np.ndarray
    centroids: np.ndarray
    wanted: int

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        return unit(vectors) @ self.rotation

    def nearest(self, rotated: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest lists of each row, nearest first."""
        near = rotated @ self.centroids.T
        return np.argsort(-near, axis=1, kind="stable")[:, :count]


def lists_needed(index: Index, x: np.ndarray, k: int, target: float, most_queries: int = 256) -> int:
    """So many nearest lists hold ``target`` of the k nearest rows of queries drawn evenly from the rotated rows ``x``."""
    if len(x) <= k:
        return len(index.centroids)
    asked = np.arange(0, len(x), -(-len(x) // most_queries))
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    top = np.argpartition(-near, k, axis=1)[:, :k]
    own = np.concatenate([index.nearest(x[i : i + 4096], 1)[:, 0] for i in range(0, len(x), 4096)])
    place = np.argsort(index.nearest(x[asked], len(index.centroids)), axis=1)
    need = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    return int(need[int(np.ceil(target * len(need))) - 1]) + 1


def fit_index(sample: np.ndarray, rows: int, k: int = 5, target: float = 0.97, seed: int = 3, most_lists: int = 1024, rounds: int = 8) -> Index:
    """About sqrt(rows) lists by spherical k-means, and how many of them to probe for a recall of ``target``."""
    turn = rotation(sample.shape[1], seed)
    x = unit(sample) @ turn
    lists = max(1, min(int(rows**0.5), most_lists, len(x)))
    centroids = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids)
    index = Index(turn, centroids, lists)
    index.wanted = lists_needed(index, x, k, target)
    return index


def adaptive_scan(x: np.ndarray, q: np.ndarray, k: int, radius: np.ndarray, epsilon: float = 2.1, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row of ``x``) that may be among the query's k nearest, ties and near ties included.

    ``radius`` is the squared distance of the k-th row that the query knows. A
    query without one measures all rows in full. For others rows are measured
    block by block; after d of D dimensions a row is abandoned when its partial
    distance, scaled by D / d, exceeds the radius by more than the error that a
    random rotation allows, (1 + epsilon / sqrt(d)) squared. ``work`` takes the
    numbers of components measured.
    """
    n, dims = x.shape
    blocks = [(s, min(s + BLOCK, dims)) for s in range(0, dims, BLOCK)]
    e = blocks[0][1]
    norms, head = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", x[:, :e], x[:, :e])
    found = []
    step = max(1, (1 << 20) // max(n, 1))
    for known in (False, True):
        asked = np.flatnonzero((radius < OPEN) == known)
        for i in range(0, len(asked), step):
            at = asked[i : i + step]
            part = q[at]
            if not known:
                full = np.einsum("ij,ij->i", part, part)[:, None] + norms[None, :] - 2 * part @ x.T
                bound = np.partition(full, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
                rows, columns = np.nonzero(full <= bound[:, None] + SLACK)
                found.append((at[rows], columns))
                continue
            dense = np.einsum("ij,ij->i", part[:, :e], part[:, :e])[:, None] + head[None, :] - 2 * part[:, :e] @ x[:, :e].T
            bound = radius[at]
            rows, columns = np.nonzero(dense * (dims / e) <= (bound * (1 + epsilon / e**0.5) ** 2 if e < dims else bound)[:, None] + SLACK * dims / e)
            partial = dense[rows, columns]
            for s, end in [(0, e), *blocks[1:]]:
                if work is not None:
                    work.append((end - s) * (dense.size if not s else len(rows)))
                if not s:
                    continue
                partial = partial + ((part[rows, s:end] - x[columns, s:end]) ** 2).sum(axis=1)
                allowed = bound[rows] * (1 + epsilon / end**0.5) ** 2 if end < dims else bound[rows]
                keep = partial * (dims / end) <= allowed + SLACK * dims / end
                rows, columns, partial = rows[keep], columns[keep], partial[keep]
            found.append((at[rows], columns))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Double-precision cosines of rows with rows; equal rows give equal values."""
    q, v = scaled(q), scaled(v)
    return (v * q).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def _matrix(parts, kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, target: float = 0.97, least: int = 64, near_lists: float = 2.0, sample_rows: int = 32_768, seed: int = 3
) -> DataFrame:
    """Each query's k nearest other rows by cosine: query_id, rank, vec_id, score.

    Queries are the rows whose id ``every`` divides; every usable row is
    indexed and a candidate of the queries of its length. Equal vectors are one
    entry of the index, with its k + 1 smallest ids (more can never be needed),
    so copies cost nothing. A length's index is fitted on about ``sample_rows``
    entries, and so is the number of lists to probe: as many as hold ``target``
    of the sample's own nearest neighbours (lists of vectors without clusters
    must mostly be probed, clustered ones hardly). Lengths of fewer than ``least``
    entries are one list, scanned in full. A query first scans its nearest
    lists in full, until they hold as many entries as ``near_lists`` lists do on
    average; the distance of its k-th entry there is the radius for the
    adaptive scan of the others. Lists are scanned in pieces of
    about 4096 entries and 4096 queries; nothing larger meets in one task. All
    rows that a scan does not abandon are ranked by exact cosines of the
    original vectors, ties by smaller id.

    Null ids and vectors that are null, empty, zero, incomplete or not finite
    take no part. Repeated rows count once; rows that share an id with other
    vectors are candidates of their own, but never for a query of that id, and
    each asks for itself. Ids are whole numbers; others become null. Other
    columns are left out. The lengths of ``least`` entries or more come to the
    driver with their indexes.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    number = np.float32 if rows.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(seed), "v").alias("k2")]
    first = rows.distinct().select(*key, "vec_id", "d", "v").withColumn("place", F.expr("row_number() OVER (PARTITION BY k1, k2 ORDER BY vec_id)")).where(F.col("place") <= k + 1)
    entries = materialize(first.groupBy("k1", "k2").agg(F.first("d").alias("d"), F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    counts = {r["d"]: r["n"] for r in entries.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "k1"), F.lit(1 << 30)) / float(1 << 30)
    indexes = {}
    for d, n in sorted(counts.items()):
        sample = entries.where((F.col("d") == d) & (draw < min(1.0, sample_rows / n))).orderBy("k1", "k2").select("v").toPandas()["v"]
        indexes[d] = fit_index(np.array(sample.tolist(), np.float64), n, k, target, seed)

    def index_of(d: int) -> Index:
        if d not in indexes:
            indexes[d] = Index(rotation(d, seed), np.zeros((1, d)), 1)
        return indexes[d]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == d))
                v = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, d)
                index = index_of(d)
                r = index.rotated(v)
                yield pa.RecordBatch.from_arrays([
                    some.column("k1"), some.column("k2"), some.column("rid"), some.column("lone"), some.column("d"), pa.array(index.nearest(r, 1)[:, 0].astype(np.int32)),
                    pa.array([x.tobytes() for x in r.astype(np.float32)], pa.binary()), pa.array([x.tobytes() for x in v.astype(number)], pa.binary()),
                ], names=["k1", "k2", "rid", "lone", "d", "list", "r", "v"])

    named = entries.select("k1", "k2", F.col("ids")[0].alias("rid"), (F.size("ids") == 1).alias("lone"), "d", "v")
    placed = materialize(named.mapInArrow(place, "k1 long, k2 long, rid long, lone boolean, d int, list int, r binary, v binary"), "placed")
    sizes = {d: np.zeros(len(i.centroids), np.int64) for d, i in indexes.items()}
    for row in placed.where(F.col("d").isin(list(counts))).groupBy("d", "list").count().collect():  # 1024 at most for each index
        sizes[row["d"]][row["list"]] = row["count"]
    enough = {d: max(k + 1, near_lists * n.sum() / len(n)) for d, n in sizes.items()}

    # An id with several vectors asks under its own name, so that its scans can leave its entries out.
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", *key).distinct()
    several = asked.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.lit(True).alias("several"))
    asked = materialize(asked.join(several, "vec_id", "left").withColumn("own", F.when(F.col("several"), F.col("vec_id").cast("string")).otherwise("")).drop("several"), "queries")
    queries = placed.join(asked.select("k1", "k2", "own").distinct(), ["k1", "k2"]).select("k1", "k2", "own", "d", "r", "v")

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("d").to_numpy()
            for d in np.unique(dims).tolist():
                some, index = batch.filter(pa.array(dims == d)), index_of(d)
                if d not in sizes:  # one list
                    row, list_, near = np.arange(some.num_rows), np.zeros(some.num_rows, np.int32), np.ones(some.num_rows, bool)
                else:
                    order = index.nearest(_matrix(some.column("r").to_pylist(), np.float32), len(index.centroids))
                    before = np.cumsum(sizes[d][order], axis=1) - sizes[d][order]
                    use = (np.arange(order.shape[1])[None, :] < index.wanted) | (before < enough[d])
                    row, at = np.nonzero(use & (sizes[d][order] > 0))
                    list_, near = order[row, at].astype(np.int32), before[row, at] < enough[d]
                chosen = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(list_), pa.array(near)], names=[*chosen.schema.names, "list", "near"])

    spread = materialize(queries.mapInArrow(probed, "k1 long, k2 long, own string, d int, r binary, v binary, list int, near boolean"), "probes")

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["q1", "q2", "own", "k1", "k2", "rid", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: np.empty(0, object if c == "own" else float if c == "score" else np.int64) for c in names})
        x, v = _matrix(a["r"].tolist(), np.float32), _matrix(a["v"].tolist(), number)
        rid, lone, out = a["rid"].to_numpy(), a["lone"].to_numpy(bool), []
        for own, some in b.groupby("own"):
            use = np.arange(len(a)) if own == "" else np.flatnonzero(~(lone & (rid == int(own))))
            if not len(use):
                continue
            q, w = _matrix(some["r"].tolist(), np.float32), _matrix(some["v"].tolist(), number)
            at, near = adaptive_scan(x[use], q, k + 1, some["radius"].to_numpy(np.float32))
            near = use[near]
            score = np.concatenate([cosine(w[at[i : i + 65_536]], v[near[i : i + 65_536]]) for i in range(0, len(at), 65_536)] or [np.empty(0)])
            order = np.lexsort((rid[near], -score, at))
            at, near, score = at[order], near[order], score[order]
            best = np.arange(len(at)) - np.searchsorted(at, at) <= k
            at, near = at[best], near[best]
            q1, q2 = some["k1"].to_numpy(), some["k2"].to_numpy()
            out.append(pd.DataFrame(dict(zip(names, (q1[at], q2[at], own, a["k1"].to_numpy()[near], a["k2"].to_numpy()[near], rid[near], score[best]), strict=True))))
        return pd.concat(out) if out else scan(a[:0], b[:0])

    def cuts(placed_or_asked: DataFrame):
        """Number of pieces of each list by ``d`` and ``list``: those of large lengths differ, the others are one piece."""
        rows = placed_or_asked.where(F.col("d").isin(list(counts))).groupBy("d", "list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("n")).where("n > 1").collect()
        many = F.create_map(*[F.lit(x) for r in rows for x in (r["d"] * 4096 + r["list"], r["n"])]) if rows else F.lit(None).cast("map<int,int>")
        return F.coalesce(F.element_at(many, F.col("d") * 4096 + F.col("list")), F.lit(1))

    pieces = cuts(placed)

    def scanned(probes: DataFrame) -> DataFrame:
        """Entries and queries of each list, in pieces that meet in pairs."""
        parts = cuts(probes)
        turn = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        share = lambda n: F.pmod(F.col("k1"), n).cast("int")
        here = placed.withColumn("piece", share(pieces)).withColumn("part", turn(parts))
        there = probes.withColumn("part", share(parts)).withColumn("piece", turn(pieces))
        by = ["d", "list", "piece", "part"]
        here, there = here.select(*by, "k1", "k2", "rid", "lone", "r", "v"), there.select(*by, "k1", "k2", "own", "r", "v", "radius")
        return here.groupBy(*by).cogroup(there.groupBy(*by)).applyInPandas(scan, "q1 long, q2 long, own string, k1 long, k2 long, rid long, score double")

    who = ["q1", "q2", "own"]
    best_entries = lambda df: df.withColumn("place", F.expr("row_number() OVER (PARTITION BY q1, q2, own ORDER BY score DESC, rid, k1, k2)")).where(F.col("place") <= k + 1)
    near = materialize(best_entries(scanned(spread.where("near").withColumn("radius", F.lit(OPEN)))), "near")
    reach = near.groupBy(*who).agg(F.when(F.count("*") > k, 2 - 2 * F.min("score")).otherwise(OPEN).alias("radius"))
    far = spread.where("NOT near").join(reach.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), "own", "radius"), ["k1", "k2", "own"], "left").fillna(OPEN, ["radius"])
    top = best_entries(near.drop("place").unionByName(scanned(far)))
    members = top.drop("place").join(entries.select("k1", "k2", "ids"), ["k1", "k2"]).select(*who, "score", F.explode("ids").alias("vec_id")).where(F.col("own") != F.col("vec_id").cast("string"))
    # Of one entry's candidates only the best k + 1 count; they are few enough to travel with its queries.
    best = members.withColumn("place", F.expr("row_number() OVER (PARTITION BY q1, q2, own ORDER BY score DESC, vec_id)")).where(F.col("place") <= k + 1)
    lists = best.groupBy(*who).agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    answers = asked.join(lists, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")) & (asked["own"] == lists["own"])).select(F.col("vec_id").alias("query_id"), "best")
    others = F.slice(F.filter("best", lambda z: z["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def op4_adaptive_scan(spark, sf_dir):
    """The five nearest others of every fiftieth vector among all embeddings."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
