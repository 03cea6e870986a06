"""Graphs as edge tables: degrees, components, walks and matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import stored


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def node_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every ``node`` and its role."""
    e = undirected(edges)
    degree = e.select(F.col("a").alias("node")).union(e.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").join(degree, "node", "left").selectExpr("node", "coalesce(degree, 0) AS degree", "CASE WHEN coalesce(degree, 0) = 0 THEN 'isolated' WHEN degree = 1 THEN 'dimension' WHEN degree = 2 THEN 'bridge' ELSE 'hub' END AS role")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reached.  Labels flow both ways and halve their paths; each round is
    written to the shared folder, so a lost executor costs one round at most."""
    return _components(nodes, undirected(edges))


def _components(nodes: DataFrame, e: DataFrame) -> DataFrame:
    both = stored(e.union(e.select("b", "a")))
    # Labels start with the smallest neighbour.
    first = both.groupBy("a").agg(F.min("b").alias("c"))
    labels = stored(nodes.select("node").distinct().join(first, F.col("node") == F.col("a"), "left").select("node", F.least("node", F.coalesce("c", "node")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("component"))
        up = lower.select(F.col("node").alias("up"), F.col("component").alias("up_component"))
        new = stored(lower.join(up, F.col("component") == F.col("up"), "left").select("node", "old", F.least("component", F.coalesce("up_component", "component")).alias("component")))
        labels = new.select("node", "component")
        if not new.where("old <> component").take(1):
            return labels


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, components, circuit rank and density."""
    links = stored(undirected(edges))
    sizes = _components(nodes, links).agg(F.count("*").alias("v"), F.count_distinct("component").alias("c"))
    return sizes.crossJoin(F.broadcast(links.agg(F.count("*").alias("e")))).selectExpr("v", "e", "c", "e - v + c AS circuit_rank", "try_divide(2D * e, v * (v - 1)) AS density")


def hop(vertices_a: DataFrame, edges: DataFrame, vertices_b: DataFrame) -> DataFrame:
    """Edges between two filtered sets of ``node``."""
    return edges.join(vertices_a.select(F.col("node").alias("a")), "a", "left_semi").join(vertices_b.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")


def bounded_walk(edges: DataFrame, depth: int = 4) -> DataFrame:
    """Least number of steps, up to ``depth``, between each node and what it reaches, without cycles.

    Each step joins the frontier only, and pairs that were reached before are left out.
    """
    e = edges.where("a <> b").select("a", "b").distinct()
    seen = e.withColumn("steps", F.lit(1))
    front = e
    for n in range(2, depth + 1):
        nxt = front.select("a", F.col("b").alias("mid")).join(e.select(F.col("a").alias("mid"), "b"), "mid").where("a <> b").select("a", "b").distinct()
        front = nxt.join(seen, ["a", "b"], "left_anti")
        seen = seen.union(front.withColumn("steps", F.lit(n)))
    return seen.groupBy("a", "b").agg(F.min("steps").alias("steps"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those from a node that none enters or to one that none leaves, as long as a tenth of them goes."""
    n = edges.count()
    while n:
        entered, left = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = stored(edges.join(entered, "a", "left_semi").join(left, "b", "left_semi").select("a", "b"))
        n, before = edges.count(), n
        if n > 0.9 * before:
            break
    return edges


def _chains(edges: DataFrame, start: str, end: str) -> DataFrame:
    """``node, to, low, ring`` of every node: its way from ``start`` to ``end`` as long as each node on it has one way only.

    to: where the way ends.  low: the smallest node on it.  ring: whether the node lies on a ring of such nodes, of which low is
    the smallest.  Ways double each round, so rounds grow with the logarithm of the longest one.
    """
    one = edges.groupBy(F.col(start).alias("from")).agg(F.min(end).alias("next"), F.count("*").alias("n")).where("n = 1")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    at = stored(nodes.join(one, F.col("node") == F.col("from"), "left").selectExpr("node", "coalesce(next, node) AS to", "least(node, coalesce(next, node)) AS low", "next IS NOT NULL AS on"))
    reached = None
    while True:
        further = at.selectExpr("node AS at", "to AS next", "low AS next_low")
        new = stored(at.join(further, F.col("to") == F.col("at")).selectExpr("node", "next AS to", "least(low, next_low) AS low", "on", "low AS old_low"))
        n, lower = new.agg(F.count_distinct("to"), F.count_if(F.expr("low <> old_low"))).first()
        at = new.drop("old_low")
        # Once the nodes where ways end are no fewer than before, only rings and ends are left of them.
        if n == reached and not lower:
            break
        reached = n
    ends = at.select(F.col("to").alias("end")).distinct()
    return stored(at.join(ends, F.col("node") == F.col("end"), "left").selectExpr("node", "to", "low", "on AND end IS NOT NULL AS ring"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, grp`` of every node that lies on a cycle of two nodes or more, by the smallest node of its component.

    Rings whose nodes have one way on, or one way in, are settled at once.  In what is left each node learns the smallest node that
    reaches it and the smallest it reaches, until nothing changes.  Labels start with the smallest on the node's chain and pass
    whole chains, so a round is one step between nodes that fork or meet.  Where both agree the component is settled, and only
    edges between nodes of equal labels are looked at again.
    """
    left = _trimmed(stored(edges.where("a <> b").select("a", "b").distinct()))
    parts = []
    while left.take(1):
        chains = {}
        for way in (("a", "b"), ("b", "a")):
            chains[way[0]] = _chains(left, *way)
            rings = chains[way[0]].where("ring").select("node", F.col("low").alias("grp"))
            if rings.take(1):
                break
        else:
            rings = None
        if rings is not None:
            parts.append(rings)
            left = _trimmed(stored(left.join(rings.select(F.col("node").alias("a")), "a", "left_anti").join(rings.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")))
            continue
        ahead, behind = chains["a"], chains["b"]
        state = stored(behind.select("node", F.col("low").alias("lo")).join(ahead.select("node", F.col("low").alias("hi")), "node"))
        near = stored(left.union(ahead.where("node <> to").select("node", "to")).union(behind.where("node <> to").select("to", "node")).distinct())
        moved = True
        while moved:
            at = lambda key, label: state.select(F.col("node").alias(key), F.col(label).alias("label"))  # noqa: E731, B023
            none = lambda c: F.lit(None).cast(state.schema["node"].dataType).alias(c)  # noqa: E731, B023
            lower = near.join(at("a", "lo"), "a").select(F.col("b").alias("node"), "label").union(state.select("node", "lo").join(at("lo", "lo"), "lo").select("node", "label"))
            higher = near.join(at("b", "hi"), "b").select(F.col("a").alias("node"), "label").union(state.select("node", "hi").join(at("hi", "hi"), "hi").select("node", "label"))
            every = state.selectExpr("node", "lo", "hi", "lo AS old_lo", "hi AS old_hi").union(lower.select("node", F.col("label").alias("lo"), none("hi"), none("old_lo"), none("old_hi"))).union(higher.select("node", none("lo"), F.col("label").alias("hi"), none("old_lo"), none("old_hi")))
            new = stored(every.groupBy("node").agg(*[F.min(c).alias(c) for c in ("lo", "hi", "old_lo", "old_hi")]))
            moved = bool(new.where("lo <> old_lo OR hi <> old_hi").take(1))
            state = new.select("node", "lo", "hi")
        parts.append(state.where("lo = hi").select("node", F.col("lo").alias("grp")))
        open_nodes = state.where("lo <> hi")
        ends = lambda key: open_nodes.select(F.col("node").alias(key), F.struct("lo", "hi").alias(f"of_{key}"))  # noqa: E731, B023
        left = _trimmed(stored(left.join(ends("a"), "a").join(ends("b"), "b").where("of_a = of_b").select("a", "b")))
    if not parts:
        return left.select(F.col("a").alias("node"), F.col("b").alias("grp"))
    found = reduce(DataFrame.union, parts)
    return found.join(found.groupBy("grp").count().where("count > 1").select("grp"), "grp", "left_semi").select("node", "grp")


def reachable(edges: DataFrame) -> DataFrame:
    """``a, b``: every pair with a path from ``a`` to ``b``, of any length; walks double until none is new."""
    seen = stored(edges.where("a <> b").select("a", "b").distinct())
    n, before = seen.count(), -1
    while n > before:
        longer = seen.select("a", F.col("b").alias("mid")).join(seen.select(F.col("a").alias("mid"), "b"), "mid").where("a <> b").select("a", "b")
        seen = stored(seen.union(longer).distinct())
        n, before = seen.count(), n
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """``a, b, steps``: every pair with a path, of any length, and the fewest steps it takes.

    Frontier by frontier until nothing new is reached; rounds grow with the longest shortest path.
    """
    e = stored(edges.where("a <> b").select("a", "b").distinct())
    front = seen = e.withColumn("steps", F.lit(1))
    n = 1
    while front.take(1):
        n += 1
        nxt = front.select("a", F.col("b").alias("mid")).join(e.select(F.col("a").alias("mid"), "b"), "mid").where("a <> b").select("a", "b").distinct()
        front = stored(nxt.join(seen, ["a", "b"], "left_anti").withColumn("steps", F.lit(n)))
        seen = seen.unionByName(front)
    return seen


def time_axes(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """The time axis of each ``key``: the first of its declared JSON list ``axes`` of ``column, joined``, its own columns
    before joined ones; without a declaration the first observed one of ``key, column, joined, place``."""
    listed = declared.select("key", F.posexplode(F.from_json("axes", "array<struct<column: string, joined: boolean>>")).alias("place", "axis")).select("key", "axis.column", "axis.joined", "place", F.lit("declared").alias("origin"))
    rest = observed.join(listed.select("key").distinct(), "key", "left_anti").select("key", "column", "joined", F.col("place").cast("int").alias("place"), F.lit("observed").alias("origin"))
    order = F.struct("joined", "place", "column")
    return listed.unionByName(rest).groupBy("key").agg(F.min_by(F.struct("column", "joined", "origin"), order).alias("x")).select("key", "x.*")


def typed_matches(vertices: DataFrame, edges: DataFrame, kind: str, from_kind: str, to_kind: str) -> DataFrame:
    """``a, a_name, b, b_name`` of the ``kind, a, b`` edges of one kind between ``node, kind, name`` vertices of two kinds."""
    side = lambda k, c: vertices.where(F.col("kind") == k).select(F.col("node").alias(c), F.col("name").alias(f"{c}_name"))
    return edges.where(F.col("kind") == kind).select("a", "b").distinct().join(side(from_kind, "a"), "a").join(side(to_kind, "b"), "b").select("a", "a_name", "b", "b_name")


def _degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, graph, degree`` of ``graph, node`` rows and of all ends of ``graph, a, b`` pairs, without a join."""
    end = lambda df, c, n: df.select(F.col(c).alias("node"), "graph", F.lit(n).alias("n"))
    return end(pairs, "a", 1).union(end(pairs, "b", 1)).union(end(nodes, "node", 0)).groupBy("node", "graph").agg(F.sum("n").alias("degree"))


def _cores(ends: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of ``ends`` and ``pairs`` once leaves are cut off, as long as a tenth of the pairs goes, and ``graph, n`` rows that add up to the components cut off.

    A component with a node of two neighbours or more stays one without its leaves.  The others are single nodes and pairs of leaves;
    of these there are as many as leaves, less all pairs, plus those between other nodes.
    """
    whole, n = [], pairs.count()
    while n:
        inner = ends.where("degree > 1").select("node", "graph")
        core = stored(pairs.join(inner.withColumnRenamed("node", "b"), ["b", "graph"], "left_semi").join(inner.withColumnRenamed("node", "a"), ["a", "graph"], "left_semi").select(*pairs.columns))
        whole += [ends.groupBy("graph").agg(F.expr("count_if(degree < 2) - sum(degree) DIV 2 AS n")), core.groupBy("graph").agg(F.count("*").alias("n"))]
        ends, pairs = stored(_degrees(inner, core)), core
        n, before = pairs.count(), n
        if n > 0.9 * before:
            break
    whole.append(ends.where("degree = 0").groupBy("graph").agg(F.count("*").alias("n")))
    return ends.where("degree > 0"), pairs, reduce(DataFrame.union, whole)


def pattern_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, v, e, c, hubs, leaves, isolated, cycles, density, pattern`` of many graphs at once.

    nodes: ``graph, node``; ends of edges are nodes as well.  edges: ``graph, a, b``, directed.  Hubs have three neighbours or more,
    leaves one; cycles are groups of nodes that reach each other.  All graphs are taken as one whose parts do not touch, so rounds grow
    with the longest path of any of them and not with their number.  Only what is left without leaves, and pairs linked
    both ways, goes through rounds.
    """
    ordered = edges.where("graph IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "graph", F.expr("a < b AS ahead"))
    pairs = stored(ordered.groupBy("a", "b", "graph").agg(F.bool_or("ahead").alias("ahead"), F.bool_or(~F.col("ahead")).alias("back")))
    ends = stored(_degrees(nodes.where("graph IS NOT NULL"), pairs))
    sizes = ends.groupBy("graph").agg(F.count("*").alias("v"), F.expr("sum(degree) DIV 2 AS e"), F.count_if(F.col("degree") >= 3).alias("hubs"), F.count_if(F.col("degree") == 1).alias("leaves"), F.count_if(F.col("degree") == 0).alias("isolated"))
    rest, core, cut = _cores(ends, pairs)
    key = lambda c: F.struct(F.col(c).alias("node"), "graph").alias(c)
    joined = _components(rest.select(key("node")), core.select(key("a"), key("b"))).groupBy("component.graph").agg(F.count_distinct("component").alias("n"))
    parts = cut.union(joined).groupBy(F.col("graph").alias("g_c")).agg(F.sum("n").alias("c"))
    # A cycle of three nodes or more lies in the core, one of two is a pair linked both ways.
    able = core.union(pairs.where("ahead AND back"))
    ways = able.where("ahead").select(key("a"), key("b")).union(able.where("back").select(key("b"), key("a")))
    rings = strong_components(ways).groupBy(F.col("grp.graph").alias("g_r")).agg(F.count_distinct("grp").alias("cycles"))
    every = sizes.join(parts, F.col("graph") == F.col("g_c")).join(rings, F.col("graph") == F.col("g_r"), "left").withColumns({"cycles": F.coalesce("cycles", F.lit(0).cast("long")), "density": F.expr("coalesce(try_divide(2D * e, v * (v - 1)), 0D)")})
    # The first that holds: a complete graph is no structure, and one in parts has none as a whole.
    pattern = (
        F.when(F.col("v") == 1, "single_table").when(F.col("e") == 0, "disconnected").when(F.col("density") >= 1, "complete").when(F.col("c") > 1, "disconnected").when(F.expr("isolated > v / 2"), "sparse")
        .when(F.expr("cycles = 0 AND hubs = 1 AND leaves >= 2"), "star_schema").when(F.expr("cycles = 0 AND hubs >= 1 AND leaves >= 1"), "hub_and_spoke")
        .when(F.expr("cycles > 0 AND hubs >= 1"), "mesh_with_cycles").when(F.col("cycles") > 0, "cyclic").when(F.expr("hubs = 0 AND e = v - 1"), "chain").otherwise("mesh")
    )
    return every.select("graph", "v", "e", "c", "hubs", "leaves", "isolated", "cycles", "density", pattern.alias("pattern"))
