"""Operator 9, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, documents, join_by_key, materialize, ship, small_batches
from tessera.llm.shingles import overlap_needed, prefix_length, shingle_sets
from tessera.operators.components import connected_components

#: Buckets of the frequency sketch (4 bytes each), and the pieces it is summed in.
SKETCH, PIECES = 1 << 22, 64
#: Bits of a signature.
BITS = 1024
#: Rows of a tile.
TILE = 512


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the number of elements in each of ``BITS`` hashed cells.

    Two sets' bitmaps differ in at most as many bits as the sets differ in
    elements, so the differing bits bound the overlap from above.
    """
    cells = (shingles & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _sketch_cells(shingles: np.ndarray) -> np.ndarray:
    """Cells by the upper bits: in order for a sorted set, which the memory caches like."""
    return (shingles >> np.uint64(64 - 22)).astype(np.int64)


def rare_prefix(shingles: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The first elements of a set in an order by estimated frequency, rare ones first.

    Elements are ordered by (sketch count, hash); all that tie with the last
    are taken, so any two sets that reach the similarity share one.
    """
    length = prefix_length(len(shingles), percent)
    order = (np.minimum(sketch[_sketch_cells(shingles)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (shingles & np.uint64((1 << 40) - 1))
    return shingles[order <= np.partition(order, length - 1)[length - 1]]


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """One pass over the texts: a row of (id, row key, set id, size) for each, and each task's pieces of the sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("piece", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, seen = np.zeros(SKETCH, np.uint32), set()
        for batch in batches:
            ids, sizes = [], []
            for s in shingle_sets(batch.column("text").to_pylist(), width):
                sid = set_id(s)
                ids.append(sid)
                sizes.append(len(s))
                if sid not in seen:
                    seen.add(sid)
                    np.add.at(total, _sketch_cells(s), 1)
            k = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        if seen:
            task = TaskContext.get().partitionId()
            for piece, part in enumerate(np.split(total, PIECES)):
                yield pa.RecordBatch.from_pylist([{"piece": piece, "task": task, "counts": zlib.compress(part.tobytes(), 1)}], schema=schema)

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, sid long, n int, piece int, task int, counts binary")


#: Sketches that are summed in one group.
FAN_IN = 64


def _sum_sketch(parts: DataFrame) -> np.ndarray:
    """Sum the tasks' pieces in as many levels as their number asks for; the driver gets 64 sums alone, 16 MB at any input size."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // PIECES, np.uint64)
        for x in group["counts"]:
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "task": group["task"].iloc[:1] // FAN_IN, "counts": [zlib.compress(total.tobytes(), 1)]})

    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy("piece", F.floor(F.col("task") / FAN_IN).alias("group")).applyInPandas(add, "piece int, task int, counts binary")
        tasks = -(-tasks // FAN_IN)
        if tasks == 1:
            break
    sketch = np.zeros(SKETCH, np.uint32)
    for r in parts.collect():
        at = r["piece"] * (SKETCH // PIECES)
        sketch[at : at + SKETCH // PIECES] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return sketch


#: A sketch cell with this share of all shingles is hot: the rows of its keys are dealt by set into runs of that size (``TILE`` at least).
HOT_CELLS = 20_000


def _prefixes(docs: DataFrame, sketch: np.ndarray, width: int, percent: int) -> DataFrame:
    """(key, place, sid) for the rare prefix of every set; a task emits equal sets once.

    ``place`` is the set's size and, in the upper half, its salt: 0, but for
    keys of hot cells a number from 1 on that follows from the set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(sketch.tobytes(), 1))
    share = max(int(sketch.sum(dtype=np.uint64)) // HOT_CELLS, TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.frombuffer(zlib.decompress(shared.value), np.uint32), set()
        for batch in batches:
            keys, sids, sizes = [], [], []
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                keys.append(rare_prefix(s, counts, percent).view(np.int64))
                sids.append(sid)
                sizes.append(len(s))
            if keys:
                lengths, key = [len(k) for k in keys], np.concatenate(keys)
                sid = np.repeat(np.array(sids, np.int64), lengths)
                runs = counts[_sketch_cells(key.view(np.uint64))] // np.uint32(min(share, 0xFFFFFFFF))
                salt = np.where(runs > 0, 1 + sid.view(np.uint64) % np.maximum(runs, 1).astype(np.uint64), 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt << 32 | np.repeat(np.array(sizes, np.int64), lengths)), pa.array(sid)], names=["key", "place", "sid"])

    return docs.select("text").mapInArrow(run, "key long, place long, sid long")


def _runs(prefixes: DataFrame, percent: int) -> DataFrame:
    """(key, salt, n, sid, centre, top) of rows whose key other sets share, each with the centre of its run.

    A run is the rows of a key and salt, and comes sorted by (place, sid). Its
    centre is its least set, and anew each set too large to be similar to the
    last centre; ``top`` marks rows that are their own centre. State is one
    row. Salted rows are all kept: other runs may share their key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, salt, n, sid, whether it was emitted
        centre = None  # sid, n
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            out = []
            for row in zip(*(c.tolist() for c in _shared_rows(batch)), strict=True):
                key, salt, n, sid = row
                if last is not None and last[0] == key and last[1] == salt:
                    if last[3] == sid:
                        continue
                    if not last[4]:
                        out.append((key, salt, last[2], last[3], last[3], True))
                    new = percent * n > 100 * centre[1]
                    if new:
                        centre = (sid, n)
                    out.append((key, salt, n, sid, centre[0], new))
                    last = (key, salt, n, sid, True)
                else:
                    last, centre = (key, salt, n, sid, salt > 0), (sid, n)
                    if salt:
                        out.append((key, salt, n, sid, sid, True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "salt", "n", "sid", "centre", "top"])

    return prefixes.repartition("key", F.shiftright("place", 32)).sortWithinPartitions("key", "place", "sid").mapInArrow(run, "key long, salt int, n int, sid long, centre long, top boolean")


def _first_pairs(runs: DataFrame, percent: int) -> DataFrame:
    """Each row with its centre, and the centres of a salted key's runs with centres of their own."""
    pair = lambda df: df.where("sid <> centre").select(F.least("sid", "centre").alias("a"), F.greatest("sid", "centre").alias("b"))
    tops = runs.where("top AND salt > 0").select("key", F.col("n").cast("long").alias("place"), "sid")
    return pair(runs).unionByName(pair(_runs(tops, percent))).distinct()


def _shared_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The batch's rows, without unsalted ones whose key surely stands alone."""
    key, place, sid = (batch.column(c).to_numpy() for c in ("key", "place", "sid"))
    salt, n = place >> 32, place & 0xFFFFFFFF
    if len(key) > 1:
        same = key[1:] == key[:-1]
        keep = np.append(same, True) | np.append(True, same) | (salt > 0)
        keep[0] = True  # it may continue the run of the batch before
        key, salt, n, sid = key[keep], salt[keep], n[keep], sid[keep]
    return key, salt, n, sid


def _tiles(rows: DataFrame, percent: int, some_long: bool) -> DataFrame:
    """Deal the rows of every key into tiles: (key, t, u, side) with the row's other columns.

    A key of up to ``TILE`` rows is one tile. The rows of others are cut in
    order of size, those in the key's largest component (``major``) apart from
    the rest; among equal sizes, by hash. Tiles meet in pairs, but for those too
    far apart in size and those that the largest component fills alone. So no
    task ever holds more than a few tiles of a key, and a key whose sets are
    mostly linked costs no more than its other sets times its rows.
    """
    columns = ["key", "n", "sid", "label", "sig"]
    zero = F.lit(0).cast("long")
    short = rows.where(F.col("m") <= TILE).select(*columns, zero.alias("t"), zero.alias("u"), F.lit(0).alias("side"))
    if not some_long:
        return short
    long = materialize(rows.where(F.col("m") > TILE).select(*columns, (F.col("label") != F.col("major")).alias("minor")), "long-keys")
    held = long.groupBy("key", "minor", "n").agg(F.count("*").alias("c"))
    before = "coalesce(sum(c) OVER (PARTITION BY key, minor ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    # Minor tiles have even numbers, the others odd ones.
    held = materialize(held.select("key", "minor", "n", F.floor(F.expr(before) / TILE).alias("base"), F.ceil(F.col("c") / TILE).alias("cuts"), "c"), "sizes-of-keys")
    dealt = join_by_key(long, held, ["key", "minor", "n"], "c", "sid")
    tile = (F.col("base") + F.pmod(F.xxhash64("sid"), F.col("cuts"))) * 2 + F.when(F.col("minor"), 0).otherwise(1)
    long = materialize(dealt.select(*columns, tile.alias("tile")), "long-runs")
    spans = long.groupBy("key", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = (spans.select("key", F.col("tile").alias(t), F.col("low").alias(f"low_{t}"), F.col("high").alias(f"high_{t}")) for t in ("t", "u"))
    near = (percent * F.col("low_u") <= 100 * F.col("high_t")) & (percent * F.col("low_t") <= 100 * F.col("high_u"))
    meet = a.join(b, "key").where((F.col("t") <= F.col("u")) & near & ((F.col("t") % 2 == 0) | (F.col("u") % 2 == 0))).select("key", "t", "u")
    left = long.withColumnRenamed("tile", "t").join(meet, ["key", "t"]).withColumn("side", F.lit(0))
    right = long.withColumnRenamed("tile", "u").join(meet.where("t < u"), ["key", "u"]).withColumn("side", F.lit(1))
    out = [*columns, "t", "u", "side"]
    return short.select(*out).unionByName(left.select(*out)).unionByName(right.select(*out))


def _tile_pairs(rows: DataFrame, percent: int, nearest: bool, some_long: bool = True) -> DataFrame:
    """Pairs of sets under one key and in different components that their signatures allow.

    ``rows`` has key, n, sid, label, sig, and of its key the number of rows m and
    the largest component, ``major``. Groups of
    up to eight rows are compared for a whole batch at once, by distance in the
    batch. ``nearest``: in larger tiles only each set's partner of the fewest
    differing bits. ``some_long``: some key has more than ``TILE`` rows.
    """
    few = 8

    def allowed(n, label, sig, x, y):
        """Of the pairs of places (x, y) those that labels, sizes and signatures allow."""
        ok = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        total = n[x] + n[y]
        differ = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1, dtype=np.int64)
        ok = (total - differ) // 2 >= overlap_needed(total, 0, percent)
        return x[ok], y[ok]

    def tile(n, label, sig, a, b):
        """Pairs of places between the tiles a and b (arrays of places), or within a."""
        within = b is None
        b = a if within else b
        ok = label[a][:, None] != label[b][None, :]
        if within:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        if not ok.any():
            return a[:0], a[:0]
        small, large = np.minimum(n[a][:, None], n[b][None, :]), np.maximum(n[a][:, None], n[b][None, :])
        total = small + large
        differ = np.bitwise_count(sig[a][:, None, :] ^ sig[b][None, :, :]).sum(axis=2, dtype=np.int64)
        ok &= ((total - differ) // 2 >= overlap_needed(total, 0, percent)) & (100 * small >= percent * large)
        if nearest:
            far = np.where(ok, differ, BITS + 1)
            best = np.zeros_like(ok)
            best[np.arange(len(a)), far.argmin(axis=1)] = True
            best[far.argmin(axis=0), np.arange(len(b))] = True
            if within:  # a set's partner may stand on either side of it
                both = np.minimum(far, far.T)
                partner = both.argmin(axis=1)
                low, high = np.minimum(np.arange(len(a)), partner), np.maximum(np.arange(len(a)), partner)
                best[low, high] = True
            ok &= best
        x, y = np.nonzero(ok)
        return a[x], b[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def emit(parts):
            key, t, u, side, n, sid, label, sig = (np.concatenate([p[k] for p in parts]) for k in range(8))
            change = np.append(True, (key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1]))
            starts = np.flatnonzero(change)
            sizes = np.diff(np.append(starts, len(key)))
            group, small = np.repeat(np.arange(len(starts)), sizes), np.repeat((sizes <= few) & (t[starts] == u[starts]), sizes)
            found = []
            for d in range(1, few):
                x = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
                found.append(allowed(n, label, sig, x, x + d))
            for k in np.flatnonzero(~((sizes <= few) & (t[starts] == u[starts]))):
                places = np.arange(starts[k], starts[k] + sizes[k])
                other = side[places] == 1
                if t[places[0]] == u[places[0]]:
                    found.append(tile(n, label, sig, places, None))
                elif other.any() and not other.all():
                    found.append(tile(n, label, sig, places[~other], places[other]))
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(x):
                both = np.unique(np.stack([np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            key, t, u, side, n, sid, label = (batch.column(c).to_numpy() for c in ("key", "t", "u", "side", "n", "sid", "label"))
            part = (key, t, u, side, n.astype(np.int64), sid, label, sig)
            last = int(np.flatnonzero((key != key[-1]) | (t != t[-1]) | (u != u[-1]))[-1] + 1) if ((key != key[-1]) | (t != t[-1]) | (u != u[-1])).any() else 0
            if last:  # the last group may go on in the next batch
                yield from emit([*held, tuple(c[:last] for c in part)])
                held = []
            held.append(tuple(c[last:] for c in part))
        if held:
            yield from emit(held)

    dealt = _tiles(rows, percent, some_long).repartition("key", "t", "u").sortWithinPartitions("key", "t", "u", "side")
    return dealt.select("key", "t", "u", "side", "n", "sid", "label", "sig").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose exact intersection of sorted arrays reaches the similarity."""
    a = sets.select(F.col("sid").alias("a"), F.col("text").alias("ta"))
    b = sets.select(F.col("sid").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, tx, ty = (c.to_pylist() for c in batch.columns)
            texts, keep = dict(zip(xs, tx, strict=True)) | dict(zip(ys, ty, strict=True)), []
            known = dict(zip(texts, shingle_sets(texts.values(), width), strict=True))
            for x, y in zip(xs, ys, strict=True):
                p, q = known[x], known[y]
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                keep.append(bool((q[at] == p).sum() >= overlap_needed(len(p), len(q), percent)))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(k).to_numpy()[keep]) for k in (0, 1)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _allowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that sizes and signatures allow."""
    a = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            differ = np.bitwise_count(sa ^ sb).sum(axis=1, dtype=np.int64)
            ok = ((na + nb - differ) // 2 >= overlap_needed(na, nb, percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[ok]) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def _grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, component)`` after further ``links(a, b)``: components of components, so that only new links are walked."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    known = labels.unionByName(ends.join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    side = lambda end, name: known.select(F.col("node").alias(end), F.col("component").alias(name))
    between = links.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = connected_components(between, cut=lambda df: materialize(df, "stars")).select(F.col("node").alias("component"), F.col("component").alias("new"))
    names = known.groupBy("component").agg(F.count("*").alias("weight")).join(merged, "component", "left").withColumn("new", F.coalesce("new", "component"))
    grown = join_by_key(known, materialize(names, "names"), ["component"], "weight", "node")
    return materialize(grown.select("node", F.col("new").alias("component")), "labels")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rounds: int = 1) -> DataFrame:
    """Components of the exact similarity join of documents' shingle sets.

    Returns a row per input row: id, ``n_shingles`` and ``component_id`` (the
    smallest id that links reach). Two documents link when their sets' Jaccard
    index is ``percent`` / 100 or more.

    1. One pass names each distinct set and sums a frequency sketch of fixed
       size. Copies are one set from here on.
    2. Every set is listed under its prefix: the elements, rarest first, of
       which similar sets must share one. Keys that stand alone fall away.
    3. Under each key, sets are linked to a centre; then, in tiles by size,
       each set is tried with its nearest by signature outside its component;
       at last all pairs across components that signatures allow are tried.
       Every trial is an exact intersection. Pairs inside a component add
       nothing and are never made, so groups of copies stay linear.

    Null or empty texts have empty sets and link with nothing: each is its own
    component. Repeated rows are copies. Rows of null id link like others; no
    component is named by them unless all its ids are null, and then its name
    is null. Ids are whole numbers; others become null. Other columns are left
    out. Sets and shingles are told apart by 64-bit hashes. The session keeps
    its own batch sizes.
    """
    ship(docs.sparkSession)
    with bounded_batches(docs.sparkSession):
        return _components(docs, id_col, text_col, width, percent, rounds)


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, rounds: int) -> DataFrame:
    """The work of :func:`jaccard_components`; all its Python runs while this is called."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").alias("text")
    doc = F.col(f"`{id_col}`").cast("long")
    docs = docs.select(doc.alias("doc_id"), text, F.coalesce(doc, F.xxhash64(F.col(f"`{text_col}`"))).alias("row"))
    scanned = materialize(_scan(docs, width), "shingles")
    named = scanned.where("piece IS NULL").select("doc_id", "row", "sid", "n")
    sketch = _sum_sketch(scanned.where("piece IS NOT NULL").select("piece", "task", "counts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    runs = materialize(_runs(_prefixes(docs, sketch, width, percent), percent), "runs")
    small_batches(spark)

    owners = named.where("n > 0").groupBy("sid").agg(F.min("row").alias("row"), F.first("n").alias("n"))
    wanted = runs.select("sid").distinct().join(owners, "sid")
    schema = "sid long, n int, sig binary, text string"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows, texts = [], batch.column(1).to_pylist()
            for sid, text, s in zip(batch.column(0).to_pylist(), texts, shingle_sets(texts, width), strict=True):
                if sid not in seen and set_id(s) == sid:  # row keys may repeat, with other texts too; a task has all rows of a key
                    seen.add(sid)
                    rows.append({"sid": sid, "n": len(s), "sig": bitmap(s), "text": text})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sid", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("text", pa.string())]))

    texts = docs.join(wanted, "row").select("sid", "text")
    sets = materialize(texts.mapInArrow(sign, schema), "sets")

    first = materialize(_first_pairs(runs, percent), "first-pairs")
    tried, runs = first, runs.select("key", "n", "sid")
    links = materialize(_verified(_allowed(first, sets, percent), sets, width, percent), "links")
    labels = materialize(connected_components(links, cut=lambda df: materialize(df, "stars")), "labels")
    for k in range(rounds + 1):
        labelled = runs.join(labels.select(F.col("node").alias("sid"), F.col("component").alias("label")), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        # A key whose sets are all in one component has no more to give; of others the largest component is known by name.
        shares = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
        mixed = shares.groupBy("key").agg(F.count("*").alias("labels"), F.sum("c").alias("m"), F.max_by("label", F.struct("c", "label")).alias("major")).where("labels > 1")
        mixed = materialize(mixed.select("key", "m", "major", F.col("m").alias("weight")), "mixed-keys")
        total, largest = mixed.agg(F.sum("m"), F.max("m")).first()
        if largest is None:
            break
        rows = join_by_key(labelled, mixed, ["key"], "weight", "sid", total).join(sets.select("sid", "sig"), "sid")
        pairs = materialize(_tile_pairs(rows, percent, nearest=k < rounds, some_long=largest > TILE), "pairs")
        # Components only grow, so a row without an allowed partner now has none later.
        runs = runs.join(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "sid", "left_semi")
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
        more = materialize(_verified(pairs, sets, width, percent), "links")
        tried = tried.union(pairs)
        if not more.isEmpty():
            labels = _grown(labels, more)
    labels = labels.select(F.col("node").alias("sid"), "component")

    all_owners = named.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    owned = all_owners.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = materialize(owned.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("weight")), "least")
    classes = join_by_key(owned, least, ["component"], "weight", "sid").select("sid", "component_id")
    return named.join(classes, "sid", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op9_ngram_jaccard(spark, sf_dir):
    """Components of all documents at a Jaccard index of 0.8 over five-word shingles."""
    return jaccard_components(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(c.r) AS component_id FROM n JOIN c ON n.doc_id = c.doc_id GROUP BY n.doc_id
"""
