"""Cycles of any length and exact reachability: strong components, their graph without cycles, interval labels over it.

Used by A14, A17, A19 to A21, D2 to D4. Edges have ``source`` and ``target``, nodes ``id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed
from tessera.operators.graph import by_source, longest_levels, numbered, reach, tasks_of
from tessera.operators.quality import union_all

#: Trimming goes on while a round takes at least this part of the edges away.
TRIM = 0.1


def trimmed(steps: DataFrame, cut=checkpointed) -> tuple[DataFrame, int]:
    """Edges between nodes that have edges both in and out, and their number: no other node is on a cycle.

    Rounds that take little are left to the colours.
    """
    count = steps.count()
    while count:
        both = steps.select(F.col("source").alias("id")).intersect(steps.select("target"))
        left = cut(steps.join(both.withColumnRenamed("id", "source"), "source", "left_semi").join(both.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target"))
        before, count = count, left.count()
        steps = left
        if before - count < TRIM * before:
            break
    return steps, count


def least_origins(steps: DataFrame, cut=checkpointed) -> DataFrame:
    """(id, colour): the least node that reaches each end of an edge, itself included. A round passes on the colours that changed."""
    colours = cut(steps.select(F.col("source").alias("id")).union(steps.select("target")).distinct().withColumn("colour", F.col("id")))
    moved = colours
    while True:
        offers = steps.join(moved, F.col("source") == F.col("id")).groupBy(F.col("target").alias("id")).agg(F.min("colour").alias("offer"))
        state = cut(colours.join(offers, "id", "left").select("id", F.least("colour", "offer").alias("colour"), (F.col("offer") < F.col("colour")).alias("moved")))
        colours, moved = state.select("id", "colour"), state.where("moved").select("id", "colour")
        if moved.isEmpty():
            return colours


def strong_components(edges: DataFrame, nodes: DataFrame, cut=checkpointed) -> DataFrame:
    """(id, component, size, cyclic) of every node, cycles of any length; a component is named by its least node.

    Nodes that cannot be on a cycle are trimmed. Then every node takes the
    colour of the least node that reaches it; the nodes of a colour that reach
    its origin in turn are one component, and all colours are searched at once.
    What is found leaves the graph, as do edges between colours, until none is
    left. Every step is a join on the edges; no node's neighbourhood or
    component is collected. Rounds follow the longest shortest path.
    ``cyclic`` nodes are in a component of two nodes or more, or have a loop.
    Ends of edges that are no nodes take part but get no row.
    """
    pairs = cut(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct())
    loops = pairs.where("source = target").select(F.col("source").alias("id"), F.lit(True).alias("loop"))
    steps, count = trimmed(pairs.where("source <> target"), cut)
    found = []
    while count:
        colours = least_origins(steps, cut)
        a, b = colours.select(F.col("id").alias("source"), "colour"), colours.select(F.col("id").alias("target"), F.col("colour").alias("own"))
        inner = cut(steps.join(a, "source").join(b, "target").where("colour = own").select("source", "target"))
        origins = colours.where("id = colour").select(F.col("id").alias("origin"), "id")
        members = cut(reach(inner.select(F.col("target").alias("source"), F.col("source").alias("target")), origins, cut=cut).select("id", F.col("origin").alias("component")))
        found.append(members)
        gone = members.select("id")
        rest = inner.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
        steps, count = trimmed(cut(rest.select("source", "target")), cut)
    ids = nodes.select("id").distinct()
    named = ids.join(union_all(found), "id", "left").select("id", F.coalesce("component", "id").alias("component")) if found else ids.withColumn("component", F.col("id"))
    sizes = named.groupBy("component").agg(F.count("*").alias("size"))
    return named.join(sizes, "component").join(loops, "id", "left").select("id", "component", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def condensation(edges: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of components, which has no cycle: nodes (id, weight) and distinct edges."""
    names = components.select("id", "component")
    a, b = (names.withColumnsRenamed({"id": s, "component": f"c{s}"}) for s in ("source", "target"))
    steps = edges.select("source", "target").join(a, "source").join(b, "target").where("csource <> ctarget").select(F.col("csource").alias("source"), F.col("ctarget").alias("target")).distinct()
    return components.groupBy(F.col("component").alias("id")).agg(F.count("*").alias("weight")), steps


def running_sums(rows: DataFrame, by: str, order: str, value: str, cut=checkpointed) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same ``by`` with a smaller ``order``; groups of any size stay spread.

    A global sort, sums within its partitions, and the partitions' totals,
    which go through the driver.
    """
    rows = cut(rows.orderBy(by, order).withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33)))
    totals, before, offsets = rows.groupBy("_part").agg(F.sum(value).alias("n")).collect(), 0, []
    for r in sorted(totals):
        offsets += [F.lit(r["_part"]), F.lit(before).cast("long")]
        before += r["n"]
    if not offsets:
        return rows.drop("_place", "_part").withColumn("before", F.lit(0).cast("long"))
    own = F.expr(f"sum({value}) OVER (PARTITION BY _part ORDER BY _place) - {value}")
    summed = cut(rows.withColumn("_sum", own + F.element_at(F.create_map(*offsets), F.col("_part"))).drop("_place", "_part"))
    firsts = summed.groupBy(by).agg(F.min("_sum").alias("_first"))
    return summed.join(firsts, by).withColumn("before", F.col("_sum") - F.col("_first")).drop("_sum", "_first")


def spanning_forest(steps: DataFrame, nodes: DataFrame, levels: DataFrame, cut=checkpointed) -> DataFrame:
    """(id, level, lo, hi): intervals of a forest within an acyclic graph; a node's holds those of its tree.

    Every node hangs on the predecessor of the least level above its own, of
    equals the smaller. Weights are summed upward and places dealt downward, a
    level a round.
    """
    ranked = steps.join(levels.withColumnRenamed("id", "source"), "source")
    parents = ranked.groupBy(F.col("target").alias("id")).agg(F.min_by("source", F.struct("level", "source")).alias("parent"))
    tree = cut(nodes.join(levels, "id").join(parents, "id", "left").select("id", "level", "parent", "weight"))
    depth = tree.agg(F.max("level")).first()[0]
    sums, sized = None, []
    for level in range((-1 if depth is None else depth) + 1):
        here = tree.where(F.col("level") == level)
        here = here.withColumn("size", F.col("weight")) if sums is None else here.join(sums, "id", "left").withColumn("size", F.col("weight") + F.coalesce("below", F.lit(0))).drop("below")
        sized.append(cut(here))
        # A parent may be of any higher level, so what its children weigh waits for it.
        got = sized[-1].where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("below"))
        sums = cut(got if sums is None else sums.unionByName(got).groupBy("id").agg(F.sum("below").alias("below")))
    if not sized:
        return tree.select("id", "level", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")).limit(0)
    # Roots share the group of null parents.
    placed = running_sums(union_all(sized).withColumn("group", F.coalesce(F.concat(F.lit("p"), F.col("parent").cast("string")), F.lit(""))), "group", "id", "size", cut)
    placed = cut(placed.select("id", "level", "parent", "weight", "size", "before"))
    done = placed.where("parent IS NULL").select("id", "level", F.col("before").alias("lo"), "size", "weight")
    starts, rest = done, placed.where("parent IS NOT NULL")
    while True:
        above = starts.select(F.col("id").alias("parent"), (F.col("lo") + F.col("weight")).alias("from"))
        starts = cut(rest.join(above, "parent").select("id", "level", (F.col("from") + F.col("before")).alias("lo"), "size", "weight"))
        if starts.isEmpty():
            break
        done = done.unionByName(starts)
    return cut(done.select("id", "level", "lo", (F.col("lo") + F.col("size")).alias("hi")))


#: Places whose intervals of one node meet in a group.
PLACES = 250_000


def merged(intervals: DataFrame, cut=checkpointed) -> DataFrame:
    """(id, lo, hi) with the overlapping and touching intervals of each id made one within every ``PLACES`` places.

    Intervals are cut where such a part ends, and of equal starts the longest is
    kept, so a group holds at most ``PLACES`` rows however many an id has; a
    task takes a bounded number of them.
    """
    longest = intervals.groupBy("id", "lo").agg(F.max("hi").alias("hi"))
    part = F.explode(F.sequence(F.expr(f"lo DIV {PLACES}"), F.expr(f"(hi - 1) DIV {PLACES}"))).alias("part")
    cuts = longest.select("id", "lo", "hi", part).select("id", "part", F.greatest("lo", F.col("part") * PLACES).alias("lo"), F.least("hi", (F.col("part") + 1) * PLACES).alias("hi"))
    cuts = cut(cuts)
    cuts = cuts.repartition(tasks_of(cuts.count()), "id", "part")
    reach_ = "max(hi) OVER (PARTITION BY id, part ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = cuts.withColumn("new", F.expr(f"CASE WHEN lo <= {reach_} THEN 0 ELSE 1 END")).withColumn("island", F.expr("sum(new) OVER (PARTITION BY id, part ORDER BY lo, hi)"))
    return starts.groupBy("id", "part", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island", "part")


def reach_labels(steps: DataFrame, nodes: DataFrame, cut=checkpointed) -> tuple[DataFrame, DataFrame]:
    """Interval labels of an acyclic graph: (id, lo, hi) of what each node reaches, itself included, and (id, lo) of its own place.

    From the sinks up, a node joins the labels of its targets to the interval
    of its own tree. Labels hold intervals, not nodes: what a whole tree below
    reaches is one row, so the rows in flight are those where the graph departs
    from its forest, not all pairs.
    """
    # Kept by source, in tasks of a bounded number of steps, through all levels.
    steps = cut(by_source(steps, cut).distinct())
    levels = cut(longest_levels(steps, nodes, cut))
    forest = spanning_forest(steps, nodes, levels, cut)
    labels, sizes, held, depth = [], [], 0, forest.agg(F.max("level")).first()[0]
    for level in range((-1 if depth is None else depth) + 1):
        own = forest.where(F.col("level") == level).select("id", "lo", "hi")
        if labels:
            here = cut(steps.join(own.select(F.col("id").alias("source")), "source").select("source", "target"))
            # Tasks follow the rows that the steps bring and the labels that they meet.
            brought = here.join(union_all(sizes).withColumnRenamed("id", "target"), "target").agg(F.sum("n")).first()[0] or 0
            tasks = tasks_of(brought + held)
            below = here.repartition(tasks, "target").join(union_all(labels).withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id"), "lo", "hi")
            # What steps bring is told apart in as many tasks before it is merged.
            own = merged(own.unionByName(below).repartition(tasks, "id", "lo"), cut)
        labels.append(cut(own))
        sizes.append(cut(labels[-1].groupBy("id").agg(F.count("*").alias("n"))))
        held += sizes[-1].agg(F.sum("n")).first()[0] or 0
        if len(sizes) == 16:
            sizes = [cut(union_all(sizes))]
        if len(labels) == 16:
            labels = [cut(union_all(labels))]
    return union_all(labels) if labels else forest.select("id", "lo", "hi"), forest.select("id", "lo")


def reach_counts(edges: DataFrame, nodes: DataFrame, cut=checkpointed) -> DataFrame:
    """(id, reachable), exactly how many other nodes each node reaches, cycles or not.

    Strong components are condensed; the labels of the acyclic graph weigh a
    component by its nodes, so the lengths of a node's intervals add up to what
    it reaches. For dependents turn the edges round. All rounds run on numbers.
    """
    edges, ids = numbered(edges, nodes, cut)
    nodes = cut(nodes.select("id").distinct().join(ids, "id").select(F.col("number").alias("id")))
    components = cut(strong_components(edges, nodes, cut))
    if components.where("size > 1").isEmpty() and ids.count() == nodes.count():
        # No cycles but loops, and no ends that are no nodes: the graph is its own condensation.
        heavy, steps = nodes.withColumn("weight", F.lit(1).cast("long")), edges.where("source <> target")
    else:
        heavy, steps = condensation(edges, components)
    labels, _ = reach_labels(steps, cut(heavy), cut)
    counts = labels.groupBy(F.col("id").alias("component")).agg((F.sum(F.col("hi") - F.col("lo")) - 1).alias("reachable"))
    return components.join(counts, "component").select(F.col("id").alias("number"), "reachable").join(ids, "number").select("id", "reachable")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
