"""Graph traversal: level by level, each level one checkpointed join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONTAINMENT_TYPES, IMPACT_DEPTH, IMPACT_TYPES, PATH_DEPTH, PATH_EXPANSIONS, REPORT_LIMIT, Graph, metadata_key
from ..session import checkpoint, few, forget, stored
from . import lookup
from .order import first_within, positions, positions_within

STEP = ("rank", "relationship_type", "path", "name", "kind", "to_id", "detail", "edge_id")


def adjacency(graph: Graph, direction: str = "both", types=IMPACT_TYPES, first: str = "incoming", at: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, confidence and ``step``, a struct whose order is the order of preference.

    ``first`` names the direction that is preferred: incoming for impact, outgoing for paths. ``at`` (node) limits the rows to what
    leads on from these nodes, before anything is looked up for the other ends.
    """
    ends = graph.vertices().select(F.col("id").alias("to_id"), F.coalesce("path", F.lit("")).alias("path"), "name", "kind")
    edges = graph.edges if types is None else graph.edges.where(F.col("relationship_type").isin(*types))
    common = ["relationship_type", "confidence", F.col("id").alias("edge_id"), metadata_key(F.col("metadata")).alias("detail")]
    way = lambda a, b, name: F.struct(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(name).alias("direction"))
    ways = {"outgoing": way("source_id", "target_id", "outgoing"), "incoming": way("target_id", "source_id", "incoming")}
    if direction != "both" and direction not in ways:
        raise ValueError(f"unknown direction {direction}")
    # Both ways come from one pass over the edges.
    wanted = list(ways.values()) if direction == "both" else [ways[direction]]
    both = edges.select(F.explode(F.array(*wanted)).alias("w"), *common).select("w.*", "relationship_type", "confidence", "edge_id", "detail")
    if at is not None:
        both = both.join(at, F.col("from_id") == F.col("node"), "left_semi")
    named = both.join(ends, "to_id", "left").withColumns({"rank": F.when(F.col("direction") == first, 0).otherwise(1), "path": F.coalesce("path", F.lit("")), "name": F.coalesce("name", F.lit("")), "kind": F.coalesce("kind", F.lit("unknown"))})
    return named.select("from_id", "to_id", "direction", "confidence", F.struct(*STEP).alias("step"))


def ways_from(graph: Graph, direction: str = "both", types=IMPACT_TYPES, first: str = "incoming") -> Callable[[DataFrame], DataFrame]:
    """``adjacency`` of given nodes (node) alone, for walks that ask for it level by level: other edges are neither shuffled nor looked up."""

    def of(nodes: DataFrame) -> DataFrame:
        nodes = checkpoint(nodes.distinct())
        return adjacency(graph, direction, types, first, few(nodes, nodes.count()))

    return of


def _leading(adjacent: DataFrame | Callable[[DataFrame], DataFrame], level: DataFrame, node: str) -> DataFrame:
    return adjacent(level.select(F.col(node).alias("node"))) if callable(adjacent) else adjacent


def shortest_paths(adjacent: DataFrame | Callable[[DataFrame], DataFrame], roots: DataFrame, max_depth: int) -> DataFrame:
    """root, node, depth and the least shortest ``path`` (array of steps) of all nodes within ``max_depth``.

    A level extends the best path of each node of the one before, which makes the least path of
    every node exact. Roots themselves are not listed. Frontier and visited nodes stay tables. ``adjacent`` may be ``ways_from``.
    """
    seen = roots.select("root", F.col("root").alias("node")).distinct()
    step = _leading(adjacent, seen.limit(0), "node").schema["step"].dataType.simpleString()
    frontier = seen.withColumn("path", F.array().cast(f"array<{step}>"))
    found = None
    for depth in range(1, max_depth + 1):
        reached = frontier.join(_leading(adjacent, frontier, "node"), F.col("node") == F.col("from_id")).select("root", F.col("to_id").alias("node"), F.concat("path", F.array("step")).alias("path"))
        level = checkpoint(reached.join(seen, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("path").alias("path")).withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        seen = checkpoint(seen.unionByName(level.select("root", "node")))
        frontier = level.select("root", "node", "path")
    if found is None:
        found = frontier.withColumn("depth", F.lit(0)).where("false")
    return found.select("root", "node", "depth", "path")


def traverse(edges: DataFrame, roots: DataFrame, max_depth: int = 1, types=None, direction: str = "both") -> DataFrame:
    """(root, node, depth) within ``max_depth`` hops, roots left out."""
    edges = edges if types is None else edges.where(F.col("relationship_type").isin(*types))
    out = edges.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"))
    back = edges.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"))
    pairs = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction].distinct()
    seen = roots.select("root", F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0))
    level, found = seen, seen.where("false")
    for depth in range(1, max_depth + 1):
        level = level.join(pairs, F.col("node") == F.col("from_id")).select("root", F.col("to_id").alias("node")).distinct()
        level = checkpoint(level.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        found = found.unionByName(level)
        seen = checkpoint(seen.unionByName(level))
    return found


def bfs_tree(adjacent: DataFrame | Callable[[DataFrame], DataFrame], starts: DataFrame, max_depth: int, by_id: bool = False) -> DataFrame:
    """The edge by which each node is first found from the ``starts`` (root, node): root, node, depth, from_id, relationship_type, edge_id, confidence, place.

    A predecessor for each (root, node) and no paths; ``walk`` rebuilds these. The nodes of a level are taken in the order in which they were found
    (``place``), what each leads to by id; with ``by_id`` they are taken by id, and edges by type and id. Starts themselves have no row.
    """
    seen = checkpoint(starts.select("root", "node").distinct())
    level, found = seen.withColumn("place", F.lit(1)), None
    order = F.struct(*(["from_id"] if by_id else ["place", "from_id"]), "relationship_type", "edge_id", "confidence")
    for depth in range(1, max_depth + 1):
        ways = _leading(adjacent, level, "node").select("from_id", "to_id", F.col("step.relationship_type").alias("relationship_type"), F.col("step.edge_id").alias("edge_id"), "confidence")
        met = level.join(ways, F.col("node") == F.col("from_id")).select("root", F.col("to_id").alias("node"), order.alias("e"))
        fresh = met.join(seen, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("e").alias("e"))
        fresh = fresh.select("root", "node", F.lit(depth).alias("depth"), *(F.col(f"e.{c}").alias(c) for c in ("from_id", "relationship_type", "edge_id", "confidence")), *((F.lit(None).cast("int").alias("parent_place"),) if by_id else (F.col("e.place").alias("parent_place"),)))
        fresh = checkpoint(positions_within(checkpoint(fresh), "root", *(("node",) if by_id else ("parent_place", "node")), column="place").drop("parent_place"))
        if fresh.isEmpty():
            break
        found = fresh if found is None else found.unionByName(fresh)
        seen = checkpoint(seen.unionByName(fresh.select("root", "node")))
        level = fresh.select("root", "node", "place")
    if found is None:
        text = F.lit(None).cast("string")
        found = level.select("root", "node", F.lit(0).alias("depth"), text.alias("from_id"), text.alias("relationship_type"), text.alias("edge_id"), F.lit(0.0).alias("confidence"), "place").where("false")
    return found


def walk(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tree's edges on the way to the ``wanted`` (root, node): root, node, hop (1 at the root), from_id, to_id, relationship_type, edge_id."""
    edges = tree.select("root", F.col("node").alias("to_id"), F.col("depth").alias("hop"), "from_id", "relationship_type", "edge_id")
    now, out = wanted.select("root", "node", F.col("node").alias("to_id")), None
    while True:
        step = checkpoint(now.join(edges, ["root", "to_id"]).select("root", "node", "hop", "from_id", "to_id", "relationship_type", "edge_id"))
        if out is not None and step.isEmpty():
            return out
        out = step if out is None else out.unionByName(step)
        now = step.select("root", "node", F.col("from_id").alias("to_id"))


def store_adjacency(graph: Graph, folder: str, buckets: int = 64) -> str:
    """Writes the adjacency of all edges by ``BUCKET`` of the node that they lead from, sorted by it, for queries of few nodes; returns the folder."""
    rows = adjacency(graph, "both", None, first="outgoing").withColumn("bucket", F.pmod(F.xxhash64("from_id"), F.lit(buckets)).cast("int"))
    rows.withColumn("buckets", F.lit(buckets)).repartition("bucket").sortWithinPartitions("bucket", "from_id").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    return folder


def stored_ways(graph: Graph, folder: str, direction: str, types) -> Callable[[list[str]], DataFrame]:
    """What leads on from a list of nodes, read from ``store_adjacency``: their buckets alone, and of these the row groups that can hold them."""
    spark = graph.edges.sparkSession
    rows = spark.read.parquet(folder)
    one = rows.select("buckets").first()
    if direction != "both":
        rows = rows.where(F.col("direction") == direction)
    if types is not None:
        rows = rows.where(F.col("step.relationship_type").isin(*types))

    def of(nodes: list[str]) -> DataFrame:
        if one is None or not nodes:
            return rows.where("false").select("from_id", "to_id", "step")
        asked = spark.createDataFrame([(n,) for n in nodes], "node string").select(F.pmod(F.xxhash64("node"), F.lit(one[0])).cast("int").alias("b")).distinct()
        return rows.where(F.col("bucket").isin(*(r.b for r in asked.collect())) & F.col("from_id").isin(*nodes)).select("from_id", "to_id", "step")

    return of


def direct_impact(graph: Graph, targets: DataFrame, direction: str = "both", types=IMPACT_TYPES, kinds=None) -> DataFrame:
    """Edges at the targets (entity_id) with the vertex at their other end and its position."""
    hits = lookup.edges_of(graph.edges, targets, direction, types)
    ends = graph.vertices().select(F.col("id").alias("other_id"), "kind", "name", "path")
    rows = hits.join(ends, "other_id", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(*kinds))
    order = ("direction", "relationship_type", F.coalesce("path", F.lit("")), "name", "kind", "other_id", metadata_key(F.col("metadata")), "id")
    return positions_within(rows, "entity_id", *order)


def impact(graph: Graph, targets: DataFrame, max_depth: int = IMPACT_DEPTH, direction: str = "both", types=IMPACT_TYPES, kinds=None) -> DataFrame:
    """Transitive impact of each target (root): node, kind, name, depth, classification, path.

    ``kinds`` filters what is listed; the walk goes through all.
    """
    found = shortest_paths(ways_from(graph, direction, types), targets, max_depth)
    ends = graph.vertices().select(F.col("id").alias("node"), "kind", "name", F.col("path").alias("node_path"), "qualified_name")
    rows = found.join(ends, "node", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(*kinds))
    return rows.withColumn("classification", F.when(F.col("depth") == 1, "direct").otherwise("indirect"))


def impact_summary(items: DataFrame) -> DataFrame:
    """Totals for each root."""
    return items.groupBy("root").agg(F.count("*").alias("total"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.max("depth").alias("depth_reached"))


def change_impact(graph: Graph, roots: DataFrame, max_depth: int = IMPACT_DEPTH, direction: str = "both", types=IMPACT_TYPES) -> DataFrame:
    """Impact of several roots merged: node, min_depth, roots, path and class root, direct or downstream."""
    every = roots.select(F.col("root").alias("node")).distinct()
    found = shortest_paths(ways_from(graph, direction, types), roots, max_depth)
    merged = found.groupBy("node").agg(F.min("depth").alias("min_depth"), F.array_sort(F.collect_set("root")).alias("roots"), F.min(F.struct("depth", "path", "root")).alias("best"))
    own = every.withColumn("is_root", F.lit(True))
    kind = F.when(F.coalesce("is_root", F.lit(False)), "root").when(F.col("min_depth") == 1, "direct").otherwise("downstream")
    return merged.join(own, "node", "left").select("node", "min_depth", "roots", F.col("best.path").alias("path"), kind.alias("classification"))


def find_path(graph: Graph, start: str, end: str, *, direction: str = "both", types=None, max_depth: int = PATH_DEPTH, max_expansions: int | None = PATH_EXPANSIONS, stored_in: str | None = None) -> dict:
    """First path that a breadth-first queue with ordered neighbours finds.

    With ``stored_in``, a folder of ``store_adjacency``, each level reads the buckets of its own nodes (no more than the budget) and no other edges.

    Returns status (resolved, no_path_found, depth_limited, expansion_limited), the steps
    and the number of expansions. A level of the queue is ranked by its parents' ranks and the step
    order; what lies past the budget isn't expanded, so a level never holds more than the budget. Without one (None) every
    level is expanded whole and ranked over all partitions.
    """
    if max_expansions is None and stored_in is not None:
        raise ValueError("stored_in reads a level's nodes on the driver and needs max_expansions")
    if start == end:
        return {"status": "resolved", "path": [], "expansions": 0, "exhaustive": True}
    types = types or None
    spark = graph.edges.sparkSession
    if stored_in is None:
        every = checkpoint(adjacency(graph, direction, types, first="outgoing").select("from_id", "to_id", "step"))
        ways = lambda _: every
    else:
        of = stored_ways(graph, stored_in, direction, types)
        ways = lambda level: of([r.node for r in level.select("node").collect()])
        every = of([])
    step = every.schema["step"].dataType.simpleString()
    level = spark.range(1).select(F.lit(start).alias("node"), F.lit(1).alias("place"), F.array().cast(f"array<{step}>").alias("path"))
    seen = level.select("node")
    spent, limited = 0, False
    for depth in range(max_depth + 1):
        size = level.count()
        if size == 0:
            return {"status": "no_path_found", "path": [], "expansions": spent, "exhaustive": not limited}
        left = size if max_expansions is None else max_expansions - spent
        if size > left:
            level, limited = level.where(F.col("place") <= left), True
        spent += min(size, left)
        adjacent = ways(level)
        if depth == max_depth:
            more = level.join(adjacent, F.col("node") == F.col("from_id")).join(seen.select(F.col("node").alias("to_id")), "to_id", "left_anti")
            status = "expansion_limited" if limited else "no_path_found" if more.isEmpty() else "depth_limited"
            return {"status": status, "path": [], "expansions": spent, "exhaustive": status == "no_path_found"}
        reached = level.join(adjacent, F.col("node") == F.col("from_id")).join(seen.select(F.col("node").alias("to_id")), "to_id", "left_anti")
        first = reached.groupBy("to_id").agg(F.min(F.struct("place", "step", "path")).alias("f"))
        goal = first.where(F.col("to_id") == end).select("f").collect()
        if goal:
            f = goal[0]["f"]
            return {"status": "resolved", "path": [*(s.asDict() for s in f["path"]), f["step"].asDict()], "expansions": spent, "exhaustive": True}
        if limited:
            return {"status": "expansion_limited", "path": [], "expansions": spent, "exhaustive": False}
        if max_expansions is None:
            level = positions(first, "f.place", "f.step", column="place")
        else:
            # At most the budget's nodes of a level matter, and one more to tell that it ran out.
            ranked = first.orderBy("f.place", "f.step").limit(max_expansions - spent + 1)
            level = ranked.withColumn("place", F.row_number().over(Window.orderBy("f.place", "f.step")))
        level = checkpoint(level.select(F.col("to_id").alias("node"), "place", F.concat("f.path", F.array("f.step")).alias("path")))
        seen = checkpoint(seen.unionByName(first.select(F.col("to_id").alias("node"))))
    raise AssertionError


def _without_chains(edges: DataFrame, cut) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(edges, chained, rings): ``edges`` (src, dst) with every chain of nodes of one way in and one way out drawn together to one edge.

    ``chained`` (node, a, b) has the ends of the chain that each such node stood on; ``rings`` (node, component)
    those that have no ends. Pointers to both ends double their reach each round. None where there is no such node.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.min("dst").alias("b"))
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"), F.min("src").alias("a"))
    inner = cut(out.join(back, "node").where("outs = 1 and ins = 1 and a <> node").select("node", "a", "b"))
    n = inner.count()
    if not n:
        return None
    ids = inner.select(F.col("node").alias("other"))
    open_at = lambda df, end: df.join(ids.select(F.col("other").alias(end), F.lit(True).alias(f"{end}_open")), end, "left")
    now = cut(open_at(open_at(inner, "a"), "b").select("node", "a", "b", F.coalesce("a_open", F.lit(False)).alias("a_open"), F.coalesce("b_open", F.lit(False)).alias("b_open"), F.col("node").alias("low")))
    reach = 1
    while reach < n and not now.where("a_open or b_open").isEmpty():
        ahead = now.select(F.col("node").alias("b"), F.col("b").alias("b2"), F.col("b_open").alias("b2_open"), F.col("low").alias("low2"))
        behind = now.select(F.col("node").alias("a"), F.col("a").alias("a2"), F.col("a_open").alias("a2_open"))
        both, last = now.join(ahead, "b", "left").join(behind, "a", "left"), now
        now = cut(
            both.select(
                "node", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"),
                F.coalesce("a2_open", F.lit(False)).alias("a_open"), F.coalesce("b2_open", F.lit(False)).alias("b_open"), F.least("low", F.coalesce("low2", "low")).alias("low"),
            )
        )
        forget(last)
        reach *= 2
    whole = now.where("not a_open and not b_open").select("node", "a", "b")
    inside = ids.withColumnRenamed("other", "src"), ids.withColumnRenamed("other", "dst")
    kept = edges.join(inside[0], "src", "left_anti").join(inside[1], "dst", "left_anti").select("src", "dst")
    drawn = kept.unionByName(whole.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()
    return cut(drawn), whole, now.where("a_open or b_open").select("node", F.col("low").alias("component"))


def _least_reaching(pairs: DataFrame, cut) -> DataFrame:
    """(node, colour): the least node from which a node can be reached, itself included.

    Each round takes the least colour of the nodes one step back, then that of the node it is named
    after: what reaches a colour's node reaches the node too, so colours leap.
    """
    colour = cut(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().withColumn("colour", F.col("node")))
    while True:
        offered = pairs.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
        after = cut(colour.join(offered, "node", "left").select("node", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") < F.col("colour")).alias("moved")))
        if after.where("moved").isEmpty():
            forget(after)
            return colour
        forget(colour)
        leap = after.select(F.col("node").alias("colour"), F.col("colour").alias("onward"))
        colour = cut(after.select("node", "colour").join(leap, "colour").select("node", F.col("onward").alias("colour")))
        forget(after)


def components(pairs: DataFrame, rounds: list | None = None) -> DataFrame:
    """(node, component) of the strongly connected components of (src, dst); a component's name is its least node.

    Nodes without a way in or out are trimmed and chains drawn together, as long as that takes a tenth of the
    edges; ends of a chain that turn out to be of one component take the chain with them. In what is left each
    node gets the least node that reaches it as colour, and within a colour the least node that it reaches: where that is the
    colour's own node, the node belongs to it. ``rounds`` gets an entry for each table that is written on the way.
    """

    def cut(df: DataFrame) -> DataFrame:
        if rounds is not None:
            rounds.append(1)
        return stored(df)

    edges = cut(pairs.select("src", "dst").where("src is not null and dst is not null").distinct())
    every = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    found, chains = [], []
    size = edges.count()
    while size:
        live = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        edges = cut(edges.join(live.select(F.col("node").alias("src")), "src", "left_semi").join(live.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
        drawn = _without_chains(edges, cut)
        if drawn is not None:
            edges, chained, rings = drawn
            chains.append(chained)
            found.append(rings)
        before, size = size, edges.count()
        if not size or size * 10 <= before * 9:
            continue
        colour = _least_reaching(edges, cut)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023, E731
        within = cut(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = _least_reaching(within, cut).select("node", F.col("colour").alias("low"))
        member = cut(colour.join(back, "node", "left").where(F.coalesce("low", "node") == F.col("colour")).select("node", F.col("colour").alias("component")))
        found.append(member)
        edges = cut(edges.join(member.select(F.col("node").alias("src")), "src", "left_anti").join(member.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        size = edges.count()
    known = every.limit(0).select("node", F.col("node").alias("component"))
    for part in found:
        known = known.unionByName(part)
    for chained in reversed(chains):
        of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))  # noqa: B023, E731
        a, b = F.coalesce("a_component", "a"), F.coalesce("b_component", "b")
        known = cut(known.unionByName(chained.join(of("a"), "a", "left").join(of("b"), "b", "left").where(a == b).select("node", a.alias("component"))))
    named = every.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("node").alias("least"))
    return named.join(least, "component").select("node", F.col("least").alias("component"))


def cycles(pairs: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """Dependency cycles: component, size, members (the first ``limit``), internal_edges. Single nodes count where they point at themselves."""
    nodes = components(pairs)
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    inner = pairs.select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst").where("src_component = dst_component").groupBy(F.col("src_component").alias("component")).agg(F.count("*").alias("internal_edges"))
    first = first_within(nodes.join(inner, "component", "left_semi"), "component", "node", limit=limit)
    groups = first.groupBy("component").agg(F.max("total").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    return groups.join(inner, "component").select("component", "size", "members", "internal_edges")


def degrees(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """fan_in and fan_out (distinct partners) of every node."""
    pairs = pairs.select("src", "dst").distinct()
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    back = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    return nodes.select("node").join(back, "node", "left").join(out, "node", "left").na.fill(0, ["fan_in", "fan_out"])


def relevant_tests(graph: Graph, affected: DataFrame, is_test: Column) -> DataFrame:
    """(test_id, target_id, relationship_type) of edges between test files and affected nodes (node)."""
    tests = graph.files.where(is_test).select(F.col("id").alias("test_id"))
    e = graph.edges.where(~F.col("relationship_type").isin(*CONTAINMENT_TYPES)).select("source_id", "target_id", "relationship_type")
    both = e.select(F.col("source_id").alias("test_id"), F.col("target_id").alias("node"), "relationship_type").unionByName(e.select(F.col("target_id").alias("test_id"), F.col("source_id").alias("node"), "relationship_type"))
    return both.join(tests, "test_id", "left_semi").join(affected.select("node"), "node", "left_semi").select("test_id", F.col("node").alias("target_id"), "relationship_type").distinct()


def expand(adjacent: DataFrame | Callable[[DataFrame], DataFrame], candidates: DataFrame, max_depth: int, max_candidates: int | None = None) -> DataFrame:
    """Candidates (entity_id, score) spread along edges, breadth first: entity_id, score, level, depth, from_id, relationship_type, confidence, candidate_confidence.

    A queue takes the candidates by falling score, then id, and what a node leads to by type, id and edge. A
    node's score is the lesser of its finder's score and the edge's confidence. The evidence (all
    columns from ``depth`` on) is the strongest that any expanded node gives it, at whatever level it turns up: by candidate
    confidence, then fewest hops, then the greater finder. ``max_candidates`` ends the walk, in the
    queue's order, once so many are known, candidates among them; evidence found by then counts. Candidates are level 0 and need no evidence.
    """
    step = F.struct(F.lit(0.0).alias("score"), F.col("step.relationship_type").alias("type"), F.col("to_id").alias("node"), F.col("step.edge_id").alias("edge"))

    def leading(level: DataFrame) -> DataFrame:
        rows = _leading(adjacent, level, "entity_id").where(F.col("step.kind") != "unknown")
        rows = rows.select("from_id", "to_id", F.col("confidence").cast("double").alias("confidence"), F.col("step.relationship_type").alias("relationship_type"), step.alias("place"))
        return checkpoint(rows) if callable(adjacent) else rows

    own = candidates.groupBy("entity_id").agg(F.max(F.col("score").cast("double")).alias("score"))
    start = F.array(F.struct((-F.col("score")).alias("score"), F.lit("").alias("type"), F.col("entity_id").alias("node"), F.lit("").alias("edge")))
    known = own.select("entity_id", "score", F.lit(0).alias("level"), start.alias("queue"))
    if max_candidates is not None:
        known = known.orderBy("queue").limit(max_candidates)
    known = frontier = checkpoint(known)
    room = None if max_candidates is None else max_candidates - known.count()
    stop, last, used = None, 0, []
    for level in range(1, max_depth + 1):
        if room == 0:
            break
        used.append((frontier, leading(frontier)))
        met = frontier.join(used[-1][1], F.col("entity_id") == F.col("from_id")).select(F.col("to_id").alias("entity_id"), F.least("score", "confidence").alias("score"), F.concat("queue", F.array("place")).alias("queue"))
        fresh = met.join(known.select("entity_id"), "entity_id", "left_anti").groupBy("entity_id").agg(F.min(F.struct("queue", "score")).alias("f"))
        fresh = fresh.select("entity_id", "f.score", F.lit(level).alias("level"), "f.queue")
        if room is not None:
            fresh = fresh.orderBy("queue").limit(room)
        frontier, last = checkpoint(fresh), level
        found = frontier.count()
        if not found:
            break
        known = checkpoint(known.unionByName(frontier))
        if room is not None:
            room -= found
            if room == 0:
                stop = frontier.agg(F.max("queue").alias("stop"))
    # Every level but the last has been expanded; its edges are read again.
    used = used or [(known, leading(known.limit(0)))]
    given = None
    for part, ways in used:
        met = part.join(ways, F.col("entity_id") == F.col("from_id"))
        given = met if given is None else given.unionByName(met)
    given = given.select(F.col("to_id").alias("entity_id"), "from_id", (F.col("level") + 1).alias("depth"), "relationship_type", "confidence", F.least("score", "confidence").alias("candidate_confidence"), F.concat("queue", F.array("place")).alias("queue"))
    if stop is not None:
        given = given.crossJoin(F.broadcast(stop)).where((F.col("depth") < last) | (F.col("queue") <= F.col("stop")))
    first = given.groupBy("entity_id", "from_id", "depth", "candidate_confidence").agg(F.min_by(F.struct("relationship_type", "confidence"), "queue").alias("e"))
    strength = F.struct(F.col("candidate_confidence"), -F.col("depth"), F.col("from_id"))
    best = first.groupBy("entity_id").agg(F.max_by(F.struct("depth", "from_id", "e", "candidate_confidence"), strength).alias("b"))
    best = best.select("entity_id", "b.depth", "b.from_id", "b.e.relationship_type", "b.e.confidence", "b.candidate_confidence")
    originals = known.where("level = 0").select("entity_id", "score", "level")
    null = lambda kind: F.lit(None).cast(kind)
    originals = originals.select("*", F.lit(0).alias("depth"), null("string").alias("from_id"), null("string").alias("relationship_type"), null("double").alias("confidence"), null("double").alias("candidate_confidence"))
    return originals.unionByName(known.where("level > 0").select("entity_id", "score", "level").join(best, "entity_id"))
