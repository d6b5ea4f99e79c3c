"""Operator 3, mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import zlib
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, documents, materialize, ship

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of one (source, size) group that one rank window may hold.
BUCKET_ROWS = 256


def targets(sizes: dict, weights=WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2) -> dict:
    """Words wanted of each source; ``sizes`` maps source (or None) to its words.

    Sources stand in code-point order, None last, and take ``weights`` in turn.
    They share ``share`` of all words; a target stops at ``most`` times its
    source's words and the excess goes to the others by weight.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, out = Fraction(sum(sizes.values())) * share, list(order), {}
    while open_:
        unit = budget / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            budget -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit_counts(lengths: list[int], counts: list[int], budget: int, seed: str, window: int = 4096) -> list[int]:
    """How many documents of each length to take so that their words come nearest below ``budget``.

    An equal share of every length first; then single documents in a seeded
    order while more than ``window`` words are left; bounded-knapsack dynamic
    programming fits the rest. Reachable sums are bits of one integer.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [budget * c // total for c in counts]
    left = budget - sum(n * k for n, k in zip(lengths, taken, strict=True))
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: (zlib.crc32(f"{seed}:{lengths[i]}".encode()), lengths[i]))
    for i in order:
        if taken[i] < counts[i] and lengths[i] + window <= left:
            taken[i] += 1
            left -= lengths[i]
    mask, steps = (1 << (left + 1)) - 1, []
    reach = 1
    for i in order:
        rest, n, part = counts[i] - taken[i], lengths[i], 1
        rest = min(rest, left // n)
        while rest and not reach >> left & 1:
            use = min(part, rest)
            steps.append((i, use, reach))
            reach |= reach << (use * n) & mask
            rest, part = rest - use, part * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, use, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += use
            at -= use * lengths[i]
    return taken


def ranked_sources(totals: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``totals(source, words)`` with ``weight``: sources in code-point order, null last, take the weights in turn.

    A global sort numbers the rows of its partitions; the driver gets the
    number of rows of each partition alone.
    """
    placed = totals.orderBy(F.col("source").isNull(), "source").withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed, "sources")
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for k, n in sizes:
        offsets += [F.lit(k), F.lit(before)]
        before += n
    start = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    rank = start + F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))).drop("place")


def water_level(ranked: DataFrame, share: Fraction, most: int) -> Fraction | None:
    """Words per unit of weight for the sources that do not stop at ``most`` times their words; null if all do.

    Exact: each round sums words and weights of the sources that the level
    so far fills, which only grow in number, until it fills no more.
    """
    words, weight, count = F.sum(F.col("words").cast("decimal(38,0)")), F.sum(F.col("weight").cast("decimal(38,0)")), F.count("*")
    total = ranked.agg(words.alias("words"), weight.alias("weight"), count.alias("n")).first()
    if not total["n"]:
        return None
    budget, filled, seen = Fraction(int(total["words"])) * share, (0, 0), 0
    while True:
        if filled[1] == int(total["weight"]):
            return None
        unit = (budget - most * filled[0]) / (int(total["weight"]) - filled[1])
        full = ranked.where(is_full(unit, most)).agg(words.alias("words"), weight.alias("weight"), count.alias("n")).first()
        if full["n"] == seen:
            return unit
        seen, filled = full["n"], (int(full["words"]), int(full["weight"]))


def is_full(unit: Fraction, most: int):
    """Whether a source's part of the level exceeds ``most`` times its words, in whole numbers."""
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    return F.col("weight") * big(unit.numerator) > F.col("words").cast("decimal(19,0)") * big(most * unit.denominator).cast("decimal(19,0)")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: int = 7,
) -> DataFrame:
    """Choose how often each document enters a mix of sources.

    Returns id, source, ``size`` (words), ``source_size``, ``target`` and
    ``copies`` (0 to ``most``). Only ids, sources and sizes are kept from the
    texts. Sources share ``share`` of all words by their weights; a target
    stops at ``most`` times its source's words and the excess goes to the
    others by weight (see :func:`water_level`). A histogram by exact size is
    fitted per source; within one size the documents are picked by seeded hash.
    Groups of one source and size are ranked in buckets of about 256 rows, so
    that no task holds a large group.

    Sources may be as many as rows: their totals stay in a table. Null texts
    have size 0, null sources are a source of their own, the last. Documents of
    size 0 add no words and are taken as often as their source is taken whole.
    Rows of equal id, source and size are interchangeable. An empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    base = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    base = materialize(base, "sizes")
    histogram = base.groupBy("skey", "size").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    totals = histogram.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("words"))
    ranked = ranked_sources(totals, weights)
    unit = water_level(ranked, share, most)
    full = F.lit(True) if unit is None else is_full(unit, most)
    goals = ranked.select("skey", "words", "weight", full.alias("full"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        skey, words = group["skey"].iloc[0], int(group["words"].iloc[0])
        target = Fraction(most * words) if group["full"].iloc[0] else unit * int(group["weight"].iloc[0])
        whole = min(most, int(target // words)) if words else 0
        extra = fit_counts(group["size"].tolist(), group["n"].tolist(), round(target - whole * words), f"{seed}:{skey}") if words and whole < most else [0] * len(group)
        return pd.DataFrame({"skey": skey, "size": group["size"], "n": group["n"], "whole": whole, "extra": extra, "source_size": words, "target": float(target)})

    plan = histogram.select("skey", "size", "n").join(goals, "skey").groupBy("skey").applyInPandas(fit, "skey string, size long, n long, whole int, extra long, source_size long, target double")
    plan = materialize(plan, "mix-plan")

    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    dealt = base.join(plan, ["skey", "size"]).withColumn("draw", F.xxhash64(F.lit(seed), F.col("id"), F.col("skey")))
    dealt = dealt.withColumn("bucket", F.when((F.col("extra") > 0) & (F.col("extra") < F.col("n")), F.pmod(F.col("draw"), buckets)))
    settled = dealt.where(F.col("bucket").isNull()).withColumn("more", F.when(F.col("extra") > 0, 1).otherwise(0))
    open_ = dealt.where(F.col("bucket").isNotNull())
    # Buckets are filled in order: those before the last are taken whole.
    held = open_.groupBy("skey", "size", "bucket").agg(F.count("*").alias("held"), F.first("extra").alias("quota"))
    before = "sum(held) OVER (PARTITION BY skey, size ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    held = held.select("skey", "size", "bucket", (F.col("quota") - F.coalesce(F.expr(before), F.lit(0))).alias("room"))
    ranked = open_.join(held, ["skey", "size", "bucket"]).withColumn("place", F.expr("row_number() OVER (PARTITION BY skey, size, bucket ORDER BY draw, id)"))
    ranked = ranked.withColumn("more", F.when(F.col("place") <= F.col("room"), 1).otherwise(0))
    columns = ["id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).cast("int").alias("copies")]
    return settled.select(*columns).unionByName(ranked.select(*columns)).withColumnRenamed("id", id_col)


def op3_source_mix(spark, sf_dir):
    """Digest of :func:`mix` over all documents."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
