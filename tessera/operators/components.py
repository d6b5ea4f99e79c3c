"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that ``spark.checkpoint.dir`` names (see :func:`tessera.session.shared_dir`).

    The rows are computed once: an eager checkpoint counts them before it
    computes them again for the folder. What was shuffled for them is removed
    from disk, as nothing reads it after the cut; a loop would keep all rounds'.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    # A plan of its own, whose shuffles no other frame reads.
    out = df.select("*").checkpoint(eager=False)
    rows = _stored_rows(out)
    shuffles = _shuffles(rows)
    rows.doCheckpoint()
    for shuffle in shuffles:
        context._jsc.sc().shuffleDriverComponents().removeShuffle(shuffle, False)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that :func:`checkpointed` gave and that no frame needs any more; of others nothing."""
    for df in frames:
        rows = _stored_rows(df)
        if rows is not None and rows.getCheckpointFile().isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(rows.getCheckpointFile().get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _stored_rows(df: DataFrame):
    """The JVM's rows of a frame that stands for given rows, else nothing."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.rdd() if plan.getClass().getSimpleName() == "LogicalRDD" else None


def _shuffles(rows) -> list[int]:
    """Numbers of the shuffles that the JVM's rows follow from, back to what is stored."""
    found, seen, left = [], set(), [rows]
    while left:
        at = left.pop()
        if at.id() in seen:
            continue
        seen.add(at.id())
        needs = at.dependencies()
        for k in range(needs.size()):
            need = needs.apply(k)
            if need.getClass().getSimpleName() == "ShuffleDependency":
                found.append(need.shuffleId())
            left.append(need.rdd())
    return found


#: Edges that a task of a round takes; rounds over fewer edges use fewer tasks than the session's shuffles have.
EDGES_OF_TASK = 200_000


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``(node, component)`` for every end of ``edges(a, b)``; a component is named by its least node.

    Each round hangs every neighbour on the least of its surroundings and then
    flattens the trees, until nothing changes; a few rounds suffice for any
    diameter (logarithmic). The sides are aggregated before each join, no
    neighbourhood is collected, and every round is cut with ``cut``. Edges with
    a null end and loops contribute their non-null ends as nodes.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node IS NOT NULL").distinct()
    tree = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(tree)
    while seen[0]:
        tasks = max(8, -(-2 * seen[0] // EDGES_OF_TASK))
        both = tree.union(tree.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        tree = cut(small.union(low.select("a", F.col("low").alias("b"))).where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        now = state(tree)
        if now == seen:
            break
        seen = now
    return nodes.join(tree.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
