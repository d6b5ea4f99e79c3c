"""Property graphs: build, filter, traverse (G) and measure (A).

Nodes have ``id`` and ``type``; edges ``source``, ``target`` and ``type``.
Traversals keep the least distance of every node, so a depth limit never hides
a node that a shorter way reaches. Top lists end their order with the id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed, connected_components, release
from tessera.operators.quality import union_all


# --- building -----------------------------------------------------------------------------


def upsert(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The last version of each key; of equal versions the one of the larger values."""
    rest = [c for c in rows.columns if c not in (*keys, version)]
    last = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}") for c in (version, *rest)])


def rules_graph(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rules(id, inputs, outputs)`` as nodes and edges data -> rule (uses), rule -> data (modifies)."""
    rule = F.concat(F.lit("rule_"), "id")
    used = rules.select(F.explode("inputs").alias("x"), rule.alias("target")).select(F.concat(F.lit("data_"), "x").alias("source"), "target", F.lit("uses").alias("type"))
    made = rules.select(rule.alias("source"), F.explode("outputs").alias("x")).select("source", F.concat(F.lit("data_"), "x").alias("target"), F.lit("modifies").alias("type"))
    data = used.select("source").union(made.select("target")).distinct().select(F.col("source").alias("id"), F.lit("data").alias("type"))
    return rules.select(rule.alias("id"), F.lit("rule").alias("type")).unionByName(data), used.unionByName(made).distinct()


def procedures_graph(procedures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``procedures(program, name, calls)`` as nodes, ``contains`` and ``calls`` edges."""
    own = F.concat_ws("_", F.lit("proc"), "program", "name")
    held = procedures.select(F.concat(F.lit("prog_"), "program").alias("source"), own.alias("target"), F.lit("contains").alias("type"))
    calls = procedures.select(own.alias("source"), "program", F.explode("calls").alias("callee")).select("source", F.concat_ws("_", F.lit("proc"), "program", "callee").alias("target"), F.lit("calls").alias("type"))
    return procedures.select(own.alias("id"), F.lit("procedure").alias("type")).distinct(), held.unionByName(calls).distinct()


def regulation_edges(regulation: str, affected: DataFrame, nodes: DataFrame) -> DataFrame:
    """``affected-by`` edges from a regulation to those ids that are nodes."""
    return affected.join(nodes.select("id"), "id", "left_semi").select(F.lit(f"reg_{regulation}").alias("source"), F.col("id").alias("target"), F.lit("affected-by").alias("type"))


# --- filters and look-ups -----------------------------------------------------------------


def filter_nodes(nodes: DataFrame, types: Sequence[str] = (), tags: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Type, any tag, and a case-insensitive pattern of the name."""
    if types:
        nodes = nodes.where(F.col("type").isin(*types))
    if tags:
        nodes = nodes.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return nodes.where(F.col("name").rlike(f"(?i){name}")) if name else nodes


def filter_edges(edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """G8."""
    return edges.where(F.col("type").isin(*types))


def contains_text(text: str, columns: Sequence[str]) -> Column:
    """Whether any of the columns contains the text, in lower case; nulls contain nothing."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return out


def view_filter(nodes: DataFrame, types: Sequence[str] = (), text: str | None = None, low: float = 0.0, high: float = 1.0, tags: Sequence[str] = (), columns: Sequence[str] = ("name", "type")) -> DataFrame:
    """Types, any tag, substring of one of ``columns``, confidence within bounds (missing counts as 1)."""
    if types:
        nodes = nodes.where(F.col("type").isin(*types))
    if tags:
        nodes = nodes.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if text:
        nodes = nodes.where(contains_text(text, columns))
    return nodes.where(F.coalesce("confidence", F.lit(1.0)).between(low, high))


def induced_edges(edges: DataFrame, nodes: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Edges with both ends among the nodes."""
    if types:
        edges = filter_edges(edges, types)
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def search(nodes: DataFrame, text: str, limit: int = 50, types: Sequence[str] = ()) -> DataFrame:
    """Nodes of the types whose name, else description, else a tag contains the text, with what matched.

    ``description`` and ``tags`` may be missing.
    """
    low = text.lower()
    if types:
        nodes = nodes.where(F.col("type").isin(*types))
    kind = F.when(F.lower("name").contains(low), "name")
    if "description" in nodes.columns:
        kind = kind.when(F.lower("description").contains(low), "description")
    if "tags" in nodes.columns:
        kind = kind.when(F.exists("tags", lambda t: F.lower(t).contains(low)), "tag")
    place = F.array_position(F.array(*map(F.lit, ("name", "description", "tag"))), F.col("match_type"))
    hits = nodes.withColumn("match_type", kind).where("match_type IS NOT NULL")
    return hits.orderBy(place, "id").limit(limit).select("id", "match_type")


def neighbours(edges: DataFrame, node: Column | str) -> DataFrame:
    """Edges of one node with their direction."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), "type", F.col("target").alias("other"))
    return out.unionByName(edges.where(F.col("target") == node).select(F.lit("in").alias("direction"), "type", F.col("source").alias("other")))


def data_flow(edges: DataFrame, node: str, makes: Sequence[str] = ("modifies", "writes"), takes: Sequence[str] = ("uses", "reads")) -> DataFrame:
    """Producers by incoming, consumers by outgoing edges; no types mean all."""
    into, out = edges.where(F.col("target") == node), edges.where(F.col("source") == node)
    if makes:
        into, out = filter_edges(into, makes), filter_edges(out, takes)
    return into.select(F.lit("producer").alias("role"), F.col("source").alias("id")).unionByName(out.select(F.lit("consumer").alias("role"), F.col("target").alias("id"))).distinct()


# --- traversal ----------------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """A1: neighbour pairs both ways, each once, without loops. Pairs are told apart before they are turned round, so half of them are held."""
    once = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))
    return once.select(F.explode(both).alias("x")).select("x.source", "x.target")


def numbered(edges: DataFrame, nodes: DataFrame | None = None, cut=checkpointed) -> tuple[DataFrame, DataFrame]:
    """Distinct edges between numbers and (id, number) of the nodes and of all ends; numbers have the order of the ids.

    Loops over many rounds sort, hash and shuffle numbers instead of texts, and
    the least number is that of the least id. Edges with a null end are left
    out. Ids that are of type long are their own numbers.
    """
    pairs = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target")
    own = {f.dataType.simpleString() for df in (pairs, nodes.select("id") if nodes is not None else pairs) for f in df.schema} == {"bigint"}
    pairs = cut(pairs.distinct() if own else pairs)
    ids = ends(pairs, nodes)
    if own:
        return pairs, cut(ids.select("id", F.col("id").alias("number")))
    ids = cut(placed(ids, [], ["id"], cut).select("id", F.col("place").cast("long").alias("number")))
    side = lambda s: ids.select(F.col("id").alias(s), F.col("number").alias(f"_{s}"))
    # Each join, and telling edges apart, takes a bounded number of them in a task.
    tasks = tasks_of(pairs.count())
    half = pairs.repartition(tasks, "source").join(side("source"), "source").select(F.col("_source").alias("source"), "target")
    both = half.repartition(tasks, "target").join(side("target"), "target").select("source", F.col("_target").alias("target"))
    found = cut(both.repartition(tasks, "source").distinct())
    release(pairs)
    return found, ids


def ends(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id) of the nodes and of all ends, each once, without null."""
    both = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    return (both if nodes is None else both.union(nodes.select("id"))).where("id IS NOT NULL").distinct()


def renumbered(edges: DataFrame, nodes: DataFrame, cut=checkpointed) -> tuple[DataFrame, DataFrame]:
    """The graph with numbers in the order of the ids in place of ids, for several measures of it.

    Edges and nodes stand as often as before and keep their other columns;
    null ids stay null.
    """
    texts, nodes = cut(edges), cut(nodes)
    ids = cut(placed(ends(texts, nodes), [], ["id"], cut).select("id", F.col("place").cast("long").alias("number")))
    edges, tasks = texts, tasks_of(texts.count())
    for s in ("source", "target"):
        edges = edges.repartition(tasks, s).join(ids.select(F.col("id").alias(s), "number"), s, "left").drop(s).withColumnRenamed("number", s)
    edges = cut(edges)
    release(texts)
    return edges, cut(nodes.join(ids, "id", "left").drop("id").withColumnRenamed("number", "id"))


#: Steps of a graph that a task of a search holds.
STEPS_OF_TASK = 250_000


def tasks_of(rows: int) -> int:
    """Tasks for so many steps."""
    return -(-rows // STEPS_OF_TASK) or 1


def both_ways(edges: DataFrame) -> DataFrame:
    """Steps along edges and against them, as often as they stand: for searches, which tell what they reach apart."""
    ways = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    return edges.where("source <> target").select(F.explode(ways).alias("x")).select("x.source", "x.target")


def by_source(steps: DataFrame, cut=checkpointed) -> DataFrame:
    """Steps stored by their source, in tasks of a bounded number of them that joins on the source keep."""
    stored = cut(steps.select("source", "target").where("source IS NOT NULL"))
    kept = cut_in_place(stored.repartition(tasks_of(stored.count()), "source"), cut)
    release(stored)
    return kept


def cut_in_place(df: DataFrame, cut=checkpointed) -> DataFrame:
    """``cut`` with the partitioning of ``df`` known afterwards.

    An adaptive plan does not say how its result is partitioned, so that a join
    would shuffle all of it again, into as many tasks as the session has.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut(df)
    finally:
        conf.set(key, before)


def reach(steps: DataFrame, start: DataFrame, depth: int | None = None, cut=checkpointed) -> DataFrame:
    """(origin, id, distance) of everything that ``steps(source, target)`` reaches.

    ``start`` has ``origin`` and ``id`` at distance 0. A frontier moves on by
    one join a round; nodes already seen are left out. Without ``depth`` it
    runs until the frontier is empty, with the lineage cut each round. Steps
    may repeat: what a round reaches is told apart, not they.
    """
    return reach_along(by_source(steps, cut), start, depth, cut)


def reach_along(steps: DataFrame, start: DataFrame, depth: int | None = None, cut=checkpointed) -> DataFrame:
    """:func:`reach` over ``steps`` that are stored already, for several searches of one graph."""
    seen = frontier = start.select("origin", "id", F.lit(0).cast("long").alias("distance")).distinct()
    k = 0
    while depth is None or k < depth:
        k += 1
        new = frontier.join(steps, F.col("id") == F.col("source")).select("origin", F.col("target").alias("id")).distinct()
        new = new.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").withColumn("distance", F.lit(k).cast("long"))
        if depth is None or depth > 3:
            new = cut(new)
            if new.isEmpty():
                break
        seen, frontier = seen.unionByName(new), new
    return seen


def impact(edges: DataFrame, start: DataFrame, depth: int = 3, back: Sequence[str] = ("uses", "depends-on", "reads")) -> DataFrame:
    """Along edges, and against those by which others lean on a node."""
    steps = edges.select("source", "target").union(filter_edges(edges, back).select("target", "source"))
    return reach(steps, start, depth)


def subgraph(edges: DataFrame, nodes: DataFrame, start: DataFrame, depth: int = 2, node_types: Sequence[str] = (), edge_types: Sequence[str] = ()) -> DataFrame:
    """Both directions; a node of another type is reached but not left."""
    if edge_types:
        edges = filter_edges(edges, edge_types)
    steps = both_ways(edges)
    if node_types:
        steps = steps.join(nodes.where(F.col("type").isin(*node_types)).select(F.col("id").alias("source")), "source", "left_semi").select("source", "target")
    return reach(steps, start, depth)


def simple_paths(edges: DataFrame, source: str, target: str, max_nodes: int = 5) -> DataFrame:
    """Paths without repeated node, at most ``max_nodes`` nodes before the target."""
    steps = edges.select("source", "target").distinct()
    paths = steps.where(F.col("source") == source).select(F.array("source").alias("path"), F.col("target").alias("at")).where(~F.array_contains("path", F.col("at")))
    found = []
    for k in range(max_nodes):
        found.append(paths.where(F.col("at") == target).select(F.concat("path", F.array("at")).alias("path")))
        if k < max_nodes - 1:
            paths = (
                paths.where(F.col("at") != target).join(steps, F.col("at") == F.col("source"))
                .select(F.concat("path", F.array("at")).alias("path"), F.col("target").alias("at")).where(~F.array_contains("path", F.col("at")))
            )
    return union_all(found)


def path_nodes(paths: DataFrame) -> DataFrame:
    """Nodes of paths with their first place."""
    return paths.select(F.posexplode("path").alias("pos", "id")).groupBy("id").agg(F.min("pos").cast("long").alias("first_pos"))


def simple_cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """Simple cycles of up to ``longest`` nodes, each once, turned so that its least node comes first.

    Longer ones are not listed, as their number may be exponential; whether a
    node is on a cycle of any length is said by ``condensation.strong_components``.
    """
    steps = edges.where("source <> target").select("source", "target").distinct()
    # Only paths whose start is their least node are extended: every cycle is found once.
    paths = steps.where("target > source").select(F.array("source", "target").alias("path"), F.col("source").alias("start"), F.col("target").alias("at"))
    found = []
    for k in range(2, longest + 1):
        found.append(paths.join(steps.select(F.col("source").alias("at"), F.col("target").alias("start")), ["at", "start"], "left_semi").select("path"))
        if k < longest:
            paths = (
                paths.join(steps, (F.col("at") == F.col("source")) & (F.col("target") > F.col("start"))).where(~F.array_contains("path", F.col("target")))
                .select(F.concat("path", F.array("target")).alias("path"), "start", F.col("target").alias("at"))
            )
    return union_all(found)


def longest_levels(edges: DataFrame, nodes: DataFrame, cut=checkpointed) -> DataFrame:
    """Level of each node = longest chain of dependencies below it (edge: source needs target).

    Runs until no node is ready, however long the chains are. Nodes on or
    behind a cycle keep a null level.
    """
    # Kept by target: a round shuffles nodes alone.
    open_ = cut(edges.select("source", "target"))
    open_ = cut(open_.repartition(tasks_of(open_.count()), "target").distinct())
    done, rest, k = [], cut(nodes.select("id")), 0
    while True:
        ready = cut(rest.join(open_.select(F.col("source").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(k).cast("long").alias("level")))
        if ready.isEmpty():
            break
        done.append(ready)
        if len(done) == 16:
            done = [cut(union_all(done))]
        rest = cut(rest.join(ready, "id", "left_anti"))
        open_ = cut(open_.join(ready.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target"))
        k += 1
    return union_all([*done, rest.select("id", F.lit(None).cast("long").alias("level"))])


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], cut=checkpointed) -> DataFrame:
    """``df`` with ``place``, 0 and on in ``order`` within each group ``by``; groups of any size stay spread.

    A global sort numbers the rows of its partitions; the driver gets the
    number of rows of each partition, and groups their first number.
    """
    rows = cut(df.orderBy(*by, *order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts, before, offsets = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), 0, []
    for r in sorted(counts):
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["n"]
    start = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    rows = rows.withColumn("place", start + F.col("place").bitwiseAND((1 << 33) - 1))
    firsts = rows.groupBy(*by).agg(F.min("place").alias("first_place"))
    if not by:
        return rows
    return rows.join(firsts, list(by)).withColumn("place", F.col("place") - F.col("first_place")).drop("first_place")


# --- metrics ------------------------------------------------------------------------------


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In, out and total degree; multiple edges count."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("target", F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").join(sums, "id", "left").select("id", zero("in_degree"), zero("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A2: m / (n (n - 1)), 0 for fewer than two nodes."""
    m, n = edges.agg(F.count("*").alias("m")), nodes.agg(F.count("*").alias("n"))
    return m.join(n).select("n", "m", F.coalesce(F.try_divide(F.col("m"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("density"))


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 20, damping: float = 0.85, cut=checkpointed) -> DataFrame:
    """Rank over out-degree, without redistribution from sinks; the lineage is cut every five rounds."""
    n = nodes.count()
    out = edges.groupBy("source").agg(F.count("*").alias("out"))
    # Both stay partitioned by their key through all rounds: a round shuffles ranks alone.
    links = cut(edges.join(out, "source").select("source", "target", "out").repartition("source"))
    ids = cut(nodes.select("id").repartition("id"))
    ranks = ids.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(iterations):
        given = links.join(ranks, F.col("source") == F.col("id")).groupBy("target").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = ids.join(given.withColumnRenamed("target", "id"), "id", "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 5 == 4 and k < iterations - 1:
            ranks = cut(ranks)
    return ranks


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A4: (id, component), isolated nodes too; a component is named by its least id."""
    pairs, ids = numbered(edges, nodes)
    found = connected_components(pairs.select(F.col("source").alias("a"), F.col("target").alias("b")))
    names = ids.select(F.col("id").alias("name"), F.col("number").alias("component"))
    named = ids.join(found.withColumnRenamed("node", "number"), "number").join(names, "component").select("id", F.col("name").alias("component"))
    return nodes.select("id").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def first_nodes(nodes: DataFrame, count: int) -> DataFrame:
    """The first nodes by id, each an origin of its own (A5: 100, A12: 50)."""
    return nodes.orderBy("id").limit(count).select(F.col("id").alias("origin"), "id")


def path_lengths(edges: DataFrame, nodes: DataFrame, sources: int = 100) -> DataFrame:
    """A5: longest and mean of the positive distances from the first nodes."""
    counts = distance_counts(both_ways(edges), first_nodes(nodes, sources))[1:]
    n = sum(counts)
    row = (len(counts), sum(k * c for k, c in enumerate(counts, 1)) / n) if n else (None, None)
    return edges.sparkSession.createDataFrame([row], "diameter long, mean_length double")


#: Origins whose bits a column of a search holds.
BITS = 62


def distance_counts(steps: DataFrame, start: DataFrame, cut=checkpointed) -> list[int]:
    """How many pairs of an origin and a node are at distance 0, 1 and on, for up to some hundred origins ``start(id)``.

    A node has a bit for each origin that has reached it, so a round costs one
    join on the steps whatever the number of origins.
    """
    origins = sorted(r["id"] for r in start.select("id").distinct().collect() if r["id"] is not None)
    words = [f"w{k}" for k in range(-(-len(origins) // BITS))]
    if not origins:
        return []
    kind = start.schema["id"].dataType.simpleString()
    rows = [(x, *(1 << k % BITS if k // BITS == w else 0 for w in range(len(words)))) for k, x in enumerate(origins)]
    seen = frontier = start.sparkSession.createDataFrame(rows, f"id {kind}, " + ", ".join(f"{w} long" for w in words))
    steps, counts = by_source(steps, cut), [len(origins)]
    while True:
        got = frontier.join(steps, F.col("id") == F.col("source")).groupBy(F.col("target").alias("id")).agg(*[F.bit_or(w).alias(f"_{w}") for w in words])
        state = cut(seen.join(got, "id", "full").select("id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for w in words for c in (w, f"_{w}")]))
        frontier = state.select("id", *[F.col(f"_{w}").bitwiseAND(F.bitwise_not(w)).alias(w) for w in words]).where(" OR ".join(f"{w} <> 0" for w in words))
        n = frontier.agg(F.sum(sum(F.bit_count(w) for w in words))).first()[0]
        if not n:
            return counts
        counts.append(n)
        seen = state.select("id", *[F.col(w).bitwiseOR(F.col(f"_{w}")).alias(w) for w in words])


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles per node. Every pair points from its node of fewer neighbours, so hubs make no wedges."""
    pairs, ids = numbered(edges)
    return numbered_triangles(checkpointed(undirected(pairs))).join(ids, F.col("id_") == F.col("number")).select("id", "triangles")


def numbered_triangles(pairs: DataFrame, cut=checkpointed) -> DataFrame:
    """(id_, triangles) of ``pairs`` as :func:`undirected` gives them."""
    size = pairs.groupBy("source").agg(F.count("*").alias("k"))
    ranked = pairs.join(size, "source").join(size.select(F.col("source").alias("target"), F.col("k").alias("k2")), "target")
    forward = cut(ranked.where("k < k2 OR (k = k2 AND source < target)").select("source", "target", "k2"))
    # The third side starts at a target and ends at one that two steps reach; other steps make no wedge.
    third = cut(forward.join(forward.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target"))
    a = forward.join(third.select(F.col("source").alias("target")).distinct(), "target", "left_semi").alias("a")
    b = forward.join(third.select("target").distinct(), "target", "left_semi").alias("b")
    wedges = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.struct("a.k2", "a.target") < F.struct("b.k2", "b.target")))
    closed = wedges.select(F.col("a.source").alias("x"), F.col("a.target").alias("y"), F.col("b.target").alias("z")).join(
        third.select(F.col("source").alias("y"), F.col("target").alias("z")), ["y", "z"]
    )
    return closed.select(F.explode(F.array("x", "y", "z")).alias("id_")).groupBy("id_").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """Mean over nodes of two neighbours or more of triangles over pairs of neighbours."""
    pairs = checkpointed(undirected(numbered(edges)[0]))
    size = pairs.groupBy(F.col("source").alias("id_")).agg(F.count("*").alias("k")).where("k >= 2")
    each = size.join(numbered_triangles(pairs), "id_", "left").select((F.coalesce("triangles", F.lit(0)) * 2 / (F.col("k") * (F.col("k") - 1))).alias("c"))
    return each.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("clustering"))


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 10, cut=checkpointed) -> DataFrame:
    """Synchronous label propagation; the most frequent label of the neighbours, ties to the smaller.

    Deterministic: no random order, and all nodes move at once.
    """
    links, ids = numbered(edges, nodes, cut)
    own = cut(nodes.select("id").distinct().join(ids, "id").select("number").repartition("number"))
    # Stored by target and sorted: a round shuffles labels and votes alone. Ends that are no nodes have no label.
    pairs = sorted_steps(undirected(links), "target", cut)
    release(links)
    tasks = tasks_of(pairs.count())
    crowds = cut(pairs.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > STEPS_OF_TASK).select("source"))
    crowded = not crowds.isEmpty()
    labels, before, earlier = own.select("number", F.col("number").alias("label")), None, None
    for k in range(rounds):
        votes = pairs.join(labels, F.col("target") == F.col("number")).select("source", "label")
        if k == 0:
            # Every label stands once, so that the least has it.
            best = votes.groupBy("source").agg(F.min("label").alias("new"))
        elif crowded:
            best = most_voted(votes.join(crowds, "source", "left_anti"), tasks).unionByName(most_voted(votes.join(crowds, "source", "left_semi")))
        else:
            best = most_voted(votes, tasks)
        new = cut(labels.join(best.withColumnRenamed("source", "number"), "number", "left").select("number", F.coalesce("new", "label").alias("label")))
        labels, before, earlier = new, labels, before
        # Labels follow from those of the round before: if they are those of two rounds before, they alternate.
        if earlier is not None and k < rounds - 1 and new.join(earlier.withColumnRenamed("label", "old"), "number").where("label <> old").isEmpty():
            labels = labels if (rounds - 1 - k) % 2 == 0 else before
            break
    names = ids.select(F.col("id").alias("name"), F.col("number").alias("label"))
    named = ids.join(labels, "number").join(names, "label").select("id", "name")
    return cut(nodes.select("id").join(named, "id", "left").select("id", F.coalesce("name", "id").alias("label")))


def sorted_steps(steps: DataFrame, by: str, cut=checkpointed) -> DataFrame:
    """Steps stored by one end, in sorted tasks of a bounded number of them that joins on it keep."""
    steps = cut(steps)
    stored = cut_in_place(steps.repartition(tasks_of(steps.count()), by).sortWithinPartitions(by), cut)
    release(steps)
    return stored


def most_voted(votes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(source, new): the most frequent label of each source, ties to the smaller. Votes meet in one shuffle into so many tasks; without it they are counted before."""
    votes = votes.repartition(tasks, "source") if tasks else votes
    counts = votes.groupBy("source", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.max(F.struct("n", -F.col("label"))).alias("x")).select("source", (-F.col("x.col2")).alias("new"))


def edge_modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Over edges only, (same - k k / 2m) / 2m."""
    both = edges.select("source", "target")
    size = both.select(F.col("source").alias("id")).union(both.select("target")).groupBy("id").agg(F.count("*").alias("k"))
    info = labels.join(size, "id")
    side = lambda s: info.select(F.col("id").alias(s), F.col("label").alias(f"l{s}"), F.col("k").alias(f"k{s}"))
    joined = both.join(side("source"), "source").join(side("target"), "target")
    m2 = 2 * F.count("*").cast("double")
    same = F.sum(F.when(F.col("lsource") == F.col("ltarget"), 1.0).otherwise(0.0))
    return joined.agg(F.coalesce(F.try_divide(same - F.try_divide(F.sum((F.col("ksource") * F.col("ktarget")).cast("double")), m2), m2), F.lit(0.0)).alias("modularity"))


def cluster_measures(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, inner and outer edges, cohesion and coupling of each cluster."""
    a, b = (labels.select(F.col("id").alias(s), F.col("label").alias(f"l{s}")) for s in ("source", "target"))
    ends = edges.join(a, "source").join(b, "target").select(
        F.explode(F.when(F.col("lsource") == F.col("ltarget"), F.array(F.struct(F.col("lsource").alias("label"), F.lit(1).alias("inner")))).otherwise(
            F.array(F.struct(F.col("lsource").alias("label"), F.lit(0).alias("inner")), F.struct(F.col("ltarget").alias("label"), F.lit(0).alias("inner"))))).alias("x")
    ).select("x.*")
    counts = ends.groupBy("label").agg(F.sum("inner").alias("internal"), F.sum(1 - F.col("inner")).alias("external"))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    joined = size.join(counts, "label", "left").fillna(0, ["internal", "external"])
    return joined.select(
        "label", "size", "internal", "external", F.coalesce(F.try_divide(F.col("internal") * 2, F.col("size") * (F.col("size") - 1)), F.lit(0.0)).alias("cohesion"),
        F.coalesce(F.try_divide("external", F.col("internal") + F.col("external")), F.lit(0.0)).alias("coupling"),
    )


def dominant_type(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """A10: the most frequent node type of each cluster, ties to the smaller name."""
    counts = nodes.select("id", "type").join(labels, "id").groupBy("label", "type").agg(F.count("*").alias("n"))
    return counts.groupBy("label").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"))


def betweenness(edges: DataFrame, nodes: DataFrame, sources: int = 50, cut=checkpointed) -> DataFrame:
    """Brandes' sums from the first nodes, undirected, scaled by the largest. A round costs one join on the steps whatever the number of origins."""
    origins = sorted(r["id"] for r in first_nodes(nodes, sources).select("id").distinct().collect() if r["id"] is not None)
    ids, m = nodes.select("id"), len(origins)
    if not m:
        return ids.withColumn("betweenness", F.lit(0.0))
    steps = by_source(undirected(edges), cut)
    kind = nodes.schema["id"].dataType.simpleString()
    # A row has a place for each origin: the number of shortest ways, 0 where the node is not of that level.
    start = [(x, [1.0 if i == k else 0.0 for i in range(m)]) for k, x in enumerate(origins)]
    level = cut(nodes.sparkSession.createDataFrame(start, f"id {kind}, ways array<double>"))
    some = lambda c: F.exists(c, lambda x: x > 0)

    def given(rows, name):
        """What the steps carry from ``name`` of the rows, summed by target and place."""
        sums = rows.join(steps, F.col("id") == F.col("source")).groupBy(F.col("target").alias("id")).agg(*[F.sum(F.col(name)[k]).alias(f"s{k}") for k in range(m)])
        return sums.select("id", F.array(*[f"s{k}" for k in range(m)]).alias("given"))

    levels, seen = [level], level.select("id", F.transform("ways", lambda x: x > 0).alias("seen"))
    while True:
        got = given(level, "ways").join(seen, "id", "left")
        new = got.select("id", F.when(F.col("seen").isNull(), F.col("given")).otherwise(F.zip_with("given", "seen", lambda x, s: F.when(s, 0.0).otherwise(x))).alias("ways"))
        level = cut(new.where(some("ways")))
        if level.isEmpty():
            break
        levels.append(level)
        now = level.select("id", F.transform("ways", lambda x: x > 0).alias("now"))
        both = seen.join(now, "id", "full")
        seen = cut(both.select("id", F.when(F.col("seen").isNull(), F.col("now")).when(F.col("now").isNull(), F.col("seen")).otherwise(F.zip_with("seen", "now", lambda a, b: a | b)).alias("seen")))
    totals, shares = [], None
    for k in range(len(levels) - 1, 0, -1):
        zero = F.transform("ways", lambda x: F.lit(0.0))
        here = levels[k].withColumn("share", zero) if shares is None else levels[k].join(shares, "id", "left").select("id", "ways", F.coalesce(F.zip_with("ways", "given", lambda w, g: w * g), zero).alias("share"))
        here = cut(here)
        totals.append(here.select("id", F.aggregate("share", F.lit(0.0), lambda a, x: a + x).alias("share")))
        if k > 1:
            shares = given(here.select("id", F.zip_with("ways", "share", lambda w, s: F.when(w > 0, (1 + s) / w).otherwise(0.0)).alias("back")), "back")
    if not totals:
        return ids.withColumn("betweenness", F.lit(0.0))
    summed = union_all(totals).groupBy("id").agg(F.sum("share").alias("share"))
    top = summed.agg(F.max("share").alias("top"))
    return ids.join(summed, "id", "left").join(F.broadcast(top)).select("id", F.coalesce(F.try_divide("share", "top"), F.lit(0.0)).alias("betweenness"))


def critical_nodes(scores: DataFrame, degree: DataFrame, limit: int = 10) -> DataFrame:
    """The highest scores with a reason from the degrees."""
    i, o = F.col("in_degree"), F.col("out_degree")
    reason = F.when(o > 2 * i, "high-fan-out").when(i > 2 * o, "high-fan-in").when((i > 5) & (o > 5), "hub").otherwise("bridge")
    return scores.join(degree, "id").select("id", "betweenness", reason.alias("reason")).orderBy(F.desc("betweenness"), "id").limit(limit)


def transitive_dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exactly how many other nodes reach each node, cycles or not."""
    from tessera.operators.condensation import reach_counts, reversed_edges

    return reach_counts(reversed_edges(edges), nodes).withColumnRenamed("reachable", "dependents")


def reachable_estimates(edges: DataFrame, nodes: DataFrame, precision: int = 12, cut=checkpointed) -> DataFrame:
    """A14, D2 on large graphs: about how many other nodes each node reaches, by sketches (error about 1.04 / 2**(precision / 2)).

    Every node holds a sketch of fixed size of what it reaches and takes in
    those of its targets until no estimate grows, so a round costs one join on
    the edges whatever is reachable. For dependents turn the edges round.
    """
    steps = cut(edges.select("source", "target").distinct())
    state = cut(nodes.groupBy("id").agg(F.hll_sketch_agg("id", precision).alias("sketch")))
    before = None
    while True:
        size = state.agg(F.sum(F.hll_sketch_estimate("sketch"))).first()[0]
        if size == before:
            break
        before = size
        got = steps.join(state, F.col("target") == F.col("id")).select(F.col("source").alias("id"), "sketch")
        state = cut(state.unionByName(got).groupBy("id").agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch")))
    return nodes.select("id").distinct().join(state, "id").select("id", (F.hll_sketch_estimate("sketch") - 1).alias("reachable"))


def bottlenecks(edges: DataFrame, nodes: DataFrame, limit: int = 10, least: float = 0.3, cut=checkpointed) -> DataFrame:
    """In > 3 and in > 1.5 out; the fewer other providers of its targets, the heavier, over ``least`` alone."""
    edges = cut(edges.select("source", "target"))
    d = degrees(edges, nodes).where((F.col("in_degree") > 3) & (F.col("in_degree") > 1.5 * F.col("out_degree")))
    mine = edges.select("source", "target").distinct()
    # A target of n providers leaves each of them n - 1 others: beyond that impact it needs no pairs.
    crowd = mine.groupBy("target").agg(F.count("source").alias("n"))
    lost = mine.join(d.select(F.col("id").alias("source")), "source", "left_semi").join(crowd, "target").where(1 / F.col("n") <= least).select(F.col("source").alias("id")).distinct()
    d = cut(d.join(lost, "id", "left_anti"))
    others = mine.join(d.select(F.col("id").alias("source")), "source", "left_semi").alias("a").join(mine.alias("b"), (F.col("a.target") == F.col("b.target")) & (F.col("a.source") != F.col("b.source")))
    n = others.groupBy(F.col("a.source").alias("id")).agg(F.count_distinct("b.source").alias("alternatives"))
    out = d.join(n, "id", "left").withColumn("alternatives", F.coalesce("alternatives", F.lit(0)))
    return out.withColumn("impact", 1 / (F.col("alternatives") + 1)).where(F.col("impact") > least).select("id", "in_degree", "alternatives", "impact").orderBy(F.desc("impact"), F.desc("in_degree"), "id").limit(limit)


def high_risk(degree: DataFrame, nodes: DataFrame, rule_type: str = "rule", limit: int = 20) -> DataFrame:
    """Points for many edges, low confidence, rules much used, and sinks much used."""
    factors = F.array(
        F.when(F.col("degree") > 10, 0.3), F.when(F.coalesce("confidence", F.lit(1.0)) < 0.5, 0.3),
        F.when((F.col("type") == rule_type) & (F.col("in_degree") > 5), 0.2), F.when((F.col("out_degree") == 0) & (F.col("in_degree") > 3), 0.2),
    )
    score = F.aggregate(F.filter(factors, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return nodes.join(degree, "id").select("id", F.round(score, 4).alias("risk")).where("risk > 0.3").orderBy(F.desc("risk"), "id").limit(limit)


def single_points(dependents: DataFrame, degree: DataFrame, share: float = 0.1, most_out: int = 2, limit: int = 10) -> DataFrame:
    """More than a share of all nodes depend on it and it has few outgoing edges."""
    n = degree.agg(F.count("*").alias("n"))
    hits = dependents.join(degree, "id").join(F.broadcast(n)).where((F.col("dependents") > share * F.col("n")) & (F.col("out_degree") <= most_out))
    return hits.select("id", "dependents").orderBy(F.desc("dependents"), "id").limit(limit)


def type_clusters(nodes: DataFrame, columns: int = 100, step: int = 50, margin: int = 20) -> DataFrame:
    """Bounding box of each type with two nodes or more in the grid layout; its corners follow from the count."""
    n = F.col("n")
    boxes = nodes.groupBy("type").agg(F.count("*").alias("n")).where("n >= 2")
    right, bottom = (F.least(n, F.lit(columns)) - 1) * step + margin, F.floor((n - 1) / columns) * step + margin
    return boxes.select("type", "n", F.lit(-margin).cast("long").alias("left"), right.cast("long").alias("right"), bottom.cast("long").alias("bottom"))


# --- dependencies, risk and effort (D) ----------------------------------------------------

DEPENDS = ("calls", "uses", "depends-on", "reads", "imports")


def coupling(edges: DataFrame, nodes: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Afferent and efferent neighbours, instability, number of cycles, and score (at most 10).

    ``cycles`` are those of :func:`simple_cycles` or the rows of strong
    components (see :func:`cycle_members`); each counts for all its nodes.
    """
    pairs = filter_edges(edges, DEPENDS).select("source", "target").distinct()
    ca = pairs.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("ca"))
    ce = pairs.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("ce"))
    both = nodes.select("id").join(ca, "id", "left").join(ce, "id", "left").fillna(0, ["ca", "ce"])
    if cycles is None:
        both = both.withColumn("cycles", F.lit(0).cast("long"))
    else:
        on = cycle_members(cycles).groupBy("id").agg(F.count("*").alias("cycles"))
        both = both.join(on, "id", "left").fillna(0, ["cycles"])
    instability = F.coalesce(F.try_divide("ce", F.col("ca") + F.col("ce")), F.lit(0.0))
    both = both.withColumn("instability", instability)
    extreme = (F.col("instability") > 0.7) | (F.col("instability") < 0.3)
    return both.withColumn("score", F.least(F.lit(10.0), ((F.col("ca") + F.col("ce")) / 2 + 2 * F.col("cycles")) * F.when(extreme, 1.5).otherwise(1.0)))


def cycle_members(cycles: DataFrame) -> DataFrame:
    """(cycle, id) of cycles that are paths, or of the cyclic ones among strong components, which are cycles of any length."""
    if "path" in cycles.columns:
        return cycles.select(F.array_join("path", ">").alias("cycle"), F.explode("path").alias("id"))
    return cycles.where("cyclic").select(F.col("component").alias("cycle"), "id")


def risk_level(score: Column) -> Column:
    """Critical from 7, high from 5, medium from 3."""
    return F.when(score >= 7, "critical").when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def factor_score(probability: Column, impact_: Column, weight: Column) -> Column:
    """D14."""
    return F.least(F.lit(10.0), probability * impact_ * weight * 2.5)


def effort_days(loc: Column, per_hour: float, *factors: Column) -> Column:
    """Lines at a base rate, in days of eight hours, times every factor."""
    return F.aggregate(F.array(*factors), loc * per_hour / 8, lambda a, f: a * f)


# --- dispatch, layouts, bundle ------------------------------------------------------------


def run_query(nodes: DataFrame, edges: DataFrame, request: dict) -> dict[str, DataFrame]:
    """``type`` nodes, edges, path, subgraph or impact, with filters, source, target, depth and limit.

    Nodes are counted before the limit, which trims nodes alone and follows the id.
    """
    kind, start = request["type"], None
    if "source" in request:
        s = request["source"]
        start = nodes.sparkSession.createDataFrame([(s, s)], "origin string, id string")
    if kind == "edges":
        return {"edges": filter_edges(edges, request["types"]) if request.get("types") else edges}
    if kind == "path":
        return {"paths": simple_paths(edges, request["source"], request["target"], request.get("depth", 5))}
    if kind == "nodes":
        found = filter_nodes(nodes, request.get("types", ()), request.get("tags", ()), request.get("name"))
    else:
        reached = subgraph(edges, nodes, start, request.get("depth", 2)) if kind == "subgraph" else impact(edges, start, request.get("depth", 3))
        found = nodes.join(reached.select("id"), "id", "left_semi")
    out = {"nodes": found.orderBy("id").limit(request["limit"]) if request.get("limit") else found, "found": found.agg(F.count("*").alias("found"))}
    return out | ({} if kind == "nodes" else {"edges": induced_edges(edges, found)})


def layout(nodes: DataFrame, kind: str, step: float = 100.0, columns: int = 10, levels: DataFrame | None = None) -> DataFrame:
    """X and y by place in order of the id: grid and circular within the type, hierarchical and radial within the level.

    ``levels(id, level)`` come from :func:`longest_levels` or, for a radial
    layout, from the distances of :func:`reach`; nodes without one are left
    out. A ring's radius grows with its level. For forces see :func:`force_layout`.
    """
    if kind in ("grid", "circular"):
        rows, by = nodes.select("id", "type"), ["type"]
    else:
        rows, by = nodes.select("id").join(levels.where("level IS NOT NULL").select("id", "level"), "id"), ["level"]
    rows = placed(rows, by, ["id"])
    k = F.col("place")
    if kind == "grid":
        return rows.select("id", (k % columns * step).alias("x"), (F.floor(k / columns) * step).cast("double").alias("y"))
    if kind == "hierarchical":
        return rows.select("id", (k * step).alias("x"), (F.col("level") * step).alias("y"))
    rows = rows.join(rows.groupBy(*by).agg(F.count("*").alias("n")), by)
    angle, radius = F.lit(6.283185307179586) * k / F.col("n"), F.lit(step) if kind == "circular" else F.col("level") * step
    return rows.select("id", (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))


def force_layout(nodes: DataFrame, edges: DataFrame, iterations: int | None = None, repulsion: float = 100.0, edge_length: float = 150.0, gravity: float = 0.1, grid: int = 16, cut=checkpointed) -> DataFrame:
    """(id, x, y) after so many rounds of forces (300 or twice the nodes, if fewer): nodes repel, edges attract, gravity pulls to the middle; all cool down.

    Nodes start on a circle in order of their ids. Each repels as a member of
    its cell of a ``grid`` by ``grid`` raster over all nodes: a node feels every
    other cell at its centroid with its number of nodes, and its own cell
    without itself. Where each node is alone in its cell that is every pair. A
    round brings one row of at most ``grid`` squared cells to every task and
    joins the edges with both their ends; no two nodes meet otherwise. Loops
    and repeated edges pull as often as they stand; edges to other nodes don't.
    """
    ids = placed(nodes.select("id").distinct(), [], ["id"], cut)
    n = ids.count()
    rounds = min(300, 2 * n) if iterations is None else iterations
    angle, radius = F.lit(6.283185307179586) * F.col("place") / max(n, 1), n**0.5 * 50
    at = cut(ids.select("id", (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy")))
    links = cut(edges.select("source", "target"))
    for k in range(rounds):
        alpha = 1 - k / rounds
        box = at.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        cell = lambda c: F.least(F.lit(grid - 1), F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(f"{c}0")) * grid, F.col(f"{c}1") - F.col(f"{c}0")), F.lit(0.0)))).cast("int")
        here = at.crossJoin(F.broadcast(box)).select("id", "x", "y", "vx", "vy", (cell("x") * grid + cell("y")).alias("cell"))  # one row
        cells = here.groupBy("cell").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        cells = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "n", "sx", "sy"))).alias("cells"))  # grid * grid at most
        own = lambda z: (z["cell"] == F.col("cell")).cast("int")

        def push(z, axis):
            count = z["n"] - own(z)
            dx, dy = (z["sx"] - own(z) * F.col("x")) / count - F.col("x"), (z["sy"] - own(z) * F.col("y")) / count - F.col("y")
            distance = F.sqrt(dx * dx + dy * dy)
            distance = F.when(distance == 0, 1.0).otherwise(distance)
            return F.when(count > 0, -(dx if axis == "x" else dy) / distance * repulsion * alpha / (distance * distance) * count).otherwise(0.0)  # noqa: B023

        total = lambda axis: F.aggregate("cells", F.lit(0.0), lambda a, z: a + push(z, axis))  # noqa: B023, E731
        pushed = here.crossJoin(F.broadcast(cells)).select("id", "x", "y", (F.col("vx") + total("x")).alias("vx"), (F.col("vy") + total("y")).alias("vy"))  # one row
        ends = links.join(at.select(F.col("id").alias("source"), F.col("x").alias("ax"), F.col("y").alias("ay")), "source").join(at.select(F.col("id").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by")), "target")
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        distance = F.sqrt(dx * dx + dy * dy)
        distance = F.when(distance == 0, 1.0).otherwise(distance)
        force = (distance - edge_length) / distance * alpha * 0.5
        drawn = ends.select("source", "target", (dx * force).alias("fx"), (dy * force).alias("fy"))
        both = drawn.select(F.col("source").alias("id"), "fx", "fy").unionAll(drawn.select("target", -F.col("fx"), -F.col("fy"))).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        speed = lambda c: F.col(f"v{c}") + F.coalesce(f"f{c}", F.lit(0.0)) - F.col(c) * gravity * alpha  # noqa: B023, E731
        moved = pushed.join(both, "id", "left").select("id", "x", "y", speed("x").alias("vx"), speed("y").alias("vy"))
        at = cut(moved.select("id", (F.col("x") + F.col("vx")).alias("x"), (F.col("y") + F.col("vy")).alias("y"), (F.col("vx") * 0.6).alias("vx"), (F.col("vy") * 0.6).alias("vy")))
    return at.select("id", "x", "y")


def recommendations(nodes: DataFrame, degree: DataFrame, cycles: DataFrame, rule_type: str = "business-rule") -> DataFrame:
    """(advice, severity, n, first_nodes) of each rule that holds; ``first_nodes`` are up to five affected ids.

    ``cycles`` as :func:`cycle_members` takes them.
    """
    d = nodes.select("id", "type", "confidence").join(degree, "id")
    rule = F.col("type") == rule_type
    rows = (
        ("high-coupling", "high", d.where("degree > 15"), 0), ("orphans", "medium", d.where("degree = 0"), 0), ("low-confidence-rules", "high", d.where(rule & (F.col("confidence") < 0.5)), 0),
        ("test-coverage", "medium", d.where(rule), 10),
    )
    out = []
    for advice, severity, found, least in rows:
        first = found.orderBy("id").limit(5).select("id")
        one = found.agg(F.count("*").alias("n")).join(first.agg(F.array_sort(F.collect_list("id")).alias("first_nodes"))).where(F.col("n") > least)
        out.append(one.select(F.lit(advice).alias("advice"), F.lit(severity).alias("severity"), "n", "first_nodes"))
    members = cycle_members(cycles)
    on = members.select("id").distinct().orderBy("id").limit(5).agg(F.array_sort(F.collect_list("id")).alias("first_nodes"))
    out.append(members.agg(F.count_distinct("cycle").alias("n")).join(on).where("n > 0").select(F.lit("circular-dependencies").alias("advice"), F.lit("high").alias("severity"), "n", "first_nodes"))
    return union_all(out)


def analysis(edges: DataFrame, nodes: DataFrame, rule_type: str = "business-rule") -> dict[str, Callable[[], DataFrame]]:
    """The measures of A2 to A20 by name; a measure is computed when it is called, and those that others need once."""
    from tessera.operators.condensation import strong_components

    communities = cache(lambda: checkpointed(label_propagation(edges, nodes)))
    strong = cache(lambda: checkpointed(strong_components(edges, nodes)))
    dependents = cache(lambda: checkpointed(transitive_dependents(edges, nodes)))
    scores = cache(lambda: checkpointed(betweenness(edges, nodes)))
    return {
        "density": lambda: density(edges, nodes),
        "degrees": lambda: degrees(edges, nodes),
        "components": lambda: components(edges, nodes),
        "path_lengths": lambda: path_lengths(edges, nodes),
        "clustering": lambda: clustering(edges),
        "communities": communities,
        "modularity": lambda: edge_modularity(edges, communities()),
        "cohesion": lambda: cluster_measures(edges, communities()),
        "betweenness": scores,
        "critical_nodes": lambda: critical_nodes(scores(), degrees(edges, nodes)),
        "dependents": dependents,
        "bottlenecks": lambda: bottlenecks(edges, nodes),
        "high_risk": lambda: high_risk(degrees(edges, nodes), nodes, rule_type),
        "single_points": lambda: single_points(dependents(), degrees(edges, nodes)),
        "orphans": lambda: orphans(edges, nodes),
        "cycles": strong,
        "recommendations": lambda: recommendations(nodes, degrees(edges, nodes), strong(), rule_type),
    }


def structure(edges: DataFrame, nodes: DataFrame, rule_type: str = "business-rule") -> DataFrame:
    """The structural measures as rows (measure, value). ``cycles`` are cyclic components."""
    long = lambda df, **names: df.select(F.explode(F.create_map(*[x for n, c in names.items() for x in (F.lit(n), F.col(c).cast("double"))])).alias("measure", "value"))
    counted = lambda name: long(found[name]().agg(F.count("*").alias("a")), **{name: "a"})
    found = analysis(*renumbered(edges, nodes), rule_type)
    return union_all([
        long(found["density"](), nodes="n", edges="m", density="density"),
        long(found["degrees"]().agg(F.avg("degree").alias("a"), F.max("degree").alias("b")), mean_degree="a", max_degree="b"),
        long(found["components"]().agg(F.count_distinct("component").alias("a")), components="a"),
        long(found["path_lengths"](), diameter="diameter", mean_length="mean_length"),
        long(found["clustering"](), clustering="clustering"),
        long(found["modularity"](), modularity="modularity"),
        long(found["cohesion"]().agg(F.count("*").alias("a"), F.avg("cohesion").alias("b"), F.avg("coupling").alias("c")), communities="a", mean_cohesion="b", mean_coupling="c"),
        *map(counted, ("high_risk", "bottlenecks", "orphans", "critical_nodes", "single_points")),
        long(found["cycles"]().agg(F.count_distinct(F.when(F.col("cyclic"), F.col("component"))).alias("a")), cycles="a"),
    ])


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes at neither end of any edge."""
    return nodes.select("id").join(edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct(), "id", "left_anti")
