"""Graph queries over trade between nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import graph as g
from siltstone.operators import model_graph as mg
from siltstone.plans.base import query, rounded

_E = "(SELECT DISTINCT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders)"
_U = f"(SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM {_E})"


def _edges(table):
    return table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))


def _nodes(table, e):
    return e.select(F.col("a").alias("node")).union(e.select("b")).union(table("customer").select(F.concat(F.lit("c"), "c_custkey"))).distinct()


_N = f"(SELECT a AS node FROM {_E} UNION SELECT b FROM {_E} UNION SELECT 'c' || c_custkey FROM customer)"


@query("g01_node_roles", f"SELECT node, coalesce(d, 0) AS degree, CASE WHEN coalesce(d, 0) = 0 THEN 'isolated' WHEN d = 1 THEN 'dimension' WHEN d = 2 THEN 'bridge' ELSE 'hub' END AS role FROM {_N} LEFT JOIN (SELECT node, count(*) AS d FROM (SELECT a AS node FROM {_U} UNION ALL SELECT b FROM {_U}) GROUP BY 1) USING (node)")
def _(table):
    e = _edges(table)
    return g.node_roles(_nodes(table, e), e)


@query("g02_topology", f"SELECT v, e, c, e - v + c AS circuit_rank, round(2.0 * e / (v * (v - 1)), 9) AS density FROM (SELECT (SELECT count(*) FROM {_N}) AS v, (SELECT count(*) FROM {_U}) AS e, (SELECT count(*) FROM {_N} WHERE node LIKE 'c%') AS c)")
def _(table):
    # Every order belongs to one customer, so a component is a customer with its orders.
    e = _edges(table)
    return rounded(g.topology(_nodes(table, e), e), 9)


@query("g05_hop", f"SELECT a, b FROM {_E} WHERE b IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0)")
def _(table):
    return _rich_hops(table, _edges(table))


def _rich_hops(table, e):
    rich = table("customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return g.hop(e.select(F.col("a").alias("node")).distinct(), e, rich)


_L = "(SELECT DISTINCT 'n' || s_nationkey AS a, 'r' || n_regionkey AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT DISTINCT 'r' || r_regionkey, 'world' FROM region)"


@query("g08_bounded_walk", f"WITH RECURSIVE w(a, b, steps) AS (SELECT a, b, 1 FROM {_L} UNION SELECT w.a, e.b, steps + 1 FROM w JOIN {_L} e ON w.b = e.a WHERE steps < 4 AND w.a <> e.b) SELECT a, b, min(steps) AS steps FROM w GROUP BY 1, 2")
def _(table):
    s = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    edges = s.select(F.concat(F.lit("n"), "s_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")).union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"))).union(table("region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("world")))
    return g.bounded_walk(edges)


@query("g06_roll_up", "SELECT n_name AS member, r_name AS parent, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(table):
    up = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return up.join(table("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("member"), F.col("r_name").alias("parent")).agg(F.count("c_custkey").alias("customers"))


_UP = "(SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m') FROM orders UNION SELECT strftime(o_orderdate, '%Y-%m'), year(o_orderdate) || 'q' || quarter(o_orderdate) FROM orders UNION SELECT year(o_orderdate) || 'q' || quarter(o_orderdate), 'y' || year(o_orderdate) FROM orders)"


@query("g06_closure", f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_UP}), w(a, b, steps) AS (SELECT a, b, 1 FROM e UNION SELECT w.a, e.b, steps + 1 FROM w JOIN e ON w.b = e.a) SELECT a, b, min(steps) AS steps FROM w GROUP BY 1, 2")
def _(table):
    cut = table("orders").selectExpr("date_format(o_orderdate, 'yyyy-MM-dd') AS d", "date_format(o_orderdate, 'yyyy-MM') AS m", "concat(year(o_orderdate), 'q', quarter(o_orderdate)) AS q", "concat('y', year(o_orderdate)) AS y")
    places = table("customer").selectExpr("concat('c', c_custkey) AS a", "concat('n', c_nationkey) AS b").union(table("nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    times = cut.selectExpr("d AS a", "m AS b").union(cut.select("m", "q")).union(cut.select("q", "y")).distinct()
    return rounded(g.closure(places.union(times)))


@query("g07_time_axes", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'o_orderdate' WHEN o_orderkey % 3 = 1 THEN 'l_shipdate' ELSE 'first_seen' END AS \"column\", o_orderkey % 3 = 1 AS joined, CASE WHEN o_orderkey % 3 = 2 THEN 'observed' ELSE 'declared' END AS origin FROM orders")
def _(table):
    both = """'[{"column": "l_shipdate", "joined": true}, {"column": "o_orderdate", "joined": false}]'"""
    one = """'[{"column": "l_shipdate", "joined": true}]'"""
    orders = table("orders").selectExpr("o_orderkey AS key", f"CASE o_orderkey % 3 WHEN 0 THEN {both} WHEN 1 THEN {one} END AS axes")
    seen = table("orders").selectExpr("o_orderkey AS key", "explode(array(struct('last_seen' AS column, false AS joined, 1 AS place), struct('first_seen' AS column, false AS joined, 0 AS place), struct('l_shipdate' AS column, true AS joined, -1 AS place))) AS x").select("key", "x.*")
    return g.time_axes(orders.where("axes IS NOT NULL"), seen)


@query("g09_typed_matches", "SELECT DISTINCT o_custkey AS a, c_name AS a_name, o_orderpriority AS b, upper(o_orderpriority) AS b_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(table):
    edges = table("orders").selectExpr("'places' AS kind", "concat('c', o_custkey) AS a", "concat('p', o_orderpriority) AS b").union(table("orders").selectExpr("'has'", "concat('o', o_orderkey)", "concat('p', o_orderpriority)"))
    vertices = table("customer").selectExpr("concat('c', c_custkey) AS node", "'customer' AS kind", "c_name AS name").union(table("orders").selectExpr("concat('p', o_orderpriority)", "'priority'", "upper(o_orderpriority)").distinct())
    return g.typed_matches(vertices, edges, "places", "customer", "priority").selectExpr("cast(substr(a, 2) AS bigint) AS a", "a_name", "substr(b, 2) AS b", "b_name")


# Graphs of known shape made of the tables: edges, number of components, and number of groups that lie on cycles.
_SHAPES = {
    "star": ("SELECT 'c' || c_custkey AS a, 'all' AS b FROM customer", "1", 0),
    "spokes": ("SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT DISTINCT 'n' || c_nationkey, 'world' FROM customer", "1", 0),
    "apart": ("SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders", "count(*) FILTER (WHERE node LIKE 'c%')", 0),
    "line": ("SELECT 'r' || r_regionkey AS a, 'r' || (r_regionkey + 1) AS b FROM region", "1", 0),
    "ring": ("SELECT 'r' || r_regionkey AS a, 'r' || ((r_regionkey + 1) % 5) AS b FROM region", "1", 1),
    "pairs": ("SELECT 'r' || x.r_regionkey AS a, 'r' || y.r_regionkey AS b FROM region x JOIN region y ON x.r_regionkey < y.r_regionkey", "1", 0),
    "woven": ("SELECT 'r' || r_regionkey AS a, 'r' || ((r_regionkey + 1) % 5) AS b FROM region UNION ALL SELECT 'c' || c_custkey, 'r' || (c_nationkey % 5) FROM customer", "1", 1),
    "loop": ("SELECT 'r' || least(r_regionkey, (r_regionkey + 1) % 5) AS a, 'r' || greatest(r_regionkey, (r_regionkey + 1) % 5) AS b FROM region", "1", 0),
}
_DEGREES = "(SELECT node, count(DISTINCT o) AS degree FROM (SELECT a AS node, b AS o FROM ({q}) WHERE a <> b UNION ALL SELECT b, a FROM ({q}) WHERE a <> b) GROUP BY 1)"
_ONE = "SELECT '{g}' AS graph, count(*) AS v, CAST(sum(degree) / 2 AS BIGINT) AS e, {c} AS c, count(*) FILTER (WHERE degree >= 3) AS hubs, count(*) FILTER (WHERE degree = 1) AS leaves, 0 AS isolated, {r} AS cycles FROM " + _DEGREES
_CLASSES = "SELECT *, round(2.0 * e / (v * (v - 1)), 9) AS density, CASE WHEN 2 * e = v * (v - 1) THEN 'complete' WHEN c > 1 THEN 'disconnected' WHEN cycles = 0 AND hubs = 1 AND leaves >= 2 THEN 'star_schema' WHEN cycles = 0 AND hubs >= 1 AND leaves >= 1 THEN 'hub_and_spoke' WHEN cycles > 0 AND hubs >= 1 THEN 'mesh_with_cycles' WHEN cycles > 0 THEN 'cyclic' WHEN hubs = 0 AND e = v - 1 THEN 'chain' ELSE 'mesh' END AS pattern FROM (" + " UNION ALL ".join(_ONE.format(g=g_, q=q, c=c, r=r) for g_, (q, c, r) in _SHAPES.items()) + ")"


@query("g04_pattern_classes", _CLASSES)
def _(table):
    c, o, r = table("customer"), table("orders"), table("region")
    link = lambda df, graph, a, b: df.selectExpr(f"'{graph}' AS graph", f"{a} AS a", f"{b} AS b")
    of = lambda letter, e: f"concat('{letter}', {e})"
    after = "(r_regionkey + 1) % 5"
    edges = [
        link(c, "star", of("c", "c_custkey"), "'all'"), link(c, "spokes", of("c", "c_custkey"), of("n", "c_nationkey")), link(c, "spokes", of("n", "c_nationkey"), "'world'"),
        link(o, "apart", of("o", "o_orderkey"), of("c", "o_custkey")), link(r, "line", of("r", "r_regionkey"), of("r", "r_regionkey + 1")), link(r, "ring", of("r", "r_regionkey"), of("r", after)),
        link(r.join(r.select(F.col("r_regionkey").alias("other")), F.col("r_regionkey") < F.col("other")), "pairs", of("r", "r_regionkey"), of("r", "other")),
        link(r, "woven", of("r", "r_regionkey"), of("r", after)), link(c, "woven", of("c", "c_custkey"), of("r", "c_nationkey % 5")),
        link(r, "loop", of("r", f"least(r_regionkey, {after})"), of("r", f"greatest(r_regionkey, {after})")),
    ]
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    nodes = every.select("graph", F.col("a").alias("node")).union(every.select("graph", "b"))
    return rounded(g.pattern_classes(nodes, every), 9)


# A model graph in which parts and brands are concepts, lines ground them, suppliers are tables and what they ship are their columns.
_VERTICES = (
    "SELECT 'p' || p_partkey AS node, 'concept' AS kind, p_name AS name FROM part UNION ALL SELECT DISTINCT 'b' || p_brand, 'concept', p_brand FROM part UNION ALL SELECT 'g' || o_orderkey, 'grounding', 'order ' || o_orderkey FROM orders "
    "UNION ALL SELECT DISTINCT 'c' || l_suppkey || '.' || l_linenumber, 'column', 'line ' || l_linenumber FROM lineitem UNION ALL SELECT 't' || s_suppkey, 'table', s_name FROM supplier"
)
_MODEL_EDGES = [
    # kind, a, b, property and its value, table, condition
    ("part_of", "'p' || p_partkey", "'b' || p_brand", "tolerance", "CAST(p_size AS VARCHAR)", "part", "true"),
    ("reconciles_with", "'b' || p_brand", "'p' || p_partkey", "tolerance", "'none'", "part", "p_size = 1"),
    ("grounded_by", "'p' || l_partkey", "'g' || l_orderkey", "by", "l_returnflag", "lineitem", "l_linenumber = 1"),
    ("uses", "'g' || l_orderkey", "'c' || l_suppkey || '.' || l_linenumber", "role", "l_linestatus", "lineitem", "l_linenumber <= 2"),
    ("belongs_to", "'c' || l_suppkey || '.' || l_linenumber", "'t' || l_suppkey", "by", "'supplier'", "lineitem", "true"),
    ("references", "'c' || l_suppkey || '.' || l_linenumber", "'c' || (l_suppkey + 1) || '.' || l_linenumber", "introduces_duplicates", "CASE WHEN l_linenumber % 2 = 0 THEN 'true' ELSE 'false' END", "lineitem", "true"),
    ("conforms", "'t' || s_suppkey", "'t' || (s_suppkey + 1)", "dimension", "CAST(s_nationkey AS VARCHAR)", "supplier", "true"),
    ("conforms", "'t' || (s_suppkey + 1)", "'t' || s_suppkey", "dimension", "CAST(s_nationkey AS VARCHAR)", "supplier", "true"),
    ("derived_from", "'t' || s_suppkey", "'t' || (s_suppkey // 7 + 1)", "base_role", "CASE WHEN s_nationkey % 3 = 0 THEN 'fact' ELSE 'dimension' END", "supplier", "true"),
]
_EDGE_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS kind, {a} AS a, {b} AS b, {v} AS v FROM {t} WHERE {c}" for k, a, b, _, v, t, c in _MODEL_EDGES)
_GRAPH = f"WITH x AS ({_VERTICES}), e AS ({_EDGE_SQL}), ends AS (SELECT * FROM (VALUES ('part_of', 'concept', 'concept'), ('reconciles_with', 'concept', 'concept'), ('grounded_by', 'concept', 'grounding'), ('uses', 'grounding', 'column'), ('belongs_to', 'column', 'table'), ('references', 'column', 'column'), ('conforms', 'table', 'table'), ('derived_from', 'table', 'table')) y(kind, ka, kb)), m AS (SELECT e.kind, e.a, xa.name AS a_name, e.b, xb.name AS b_name, v FROM e JOIN ends USING (kind) JOIN x xa ON xa.node = a AND xa.kind = ka JOIN x xb ON xb.node = b AND xb.kind = kb)"


def _model(table):
    spark_of = lambda e: e.replace(" // ", " DIV ").replace("VARCHAR", "STRING")
    part, line, supplier = table("part"), table("lineitem"), table("supplier")
    vertices = part.selectExpr("'p' || p_partkey AS node", "'concept' AS kind", "p_name AS name").union(part.selectExpr("'b' || p_brand", "'concept'", "p_brand").distinct()).union(table("orders").selectExpr("'g' || o_orderkey", "'grounding'", "'order ' || o_orderkey"))
    vertices = vertices.union(line.selectExpr("'c' || l_suppkey || '.' || l_linenumber", "'column'", "'line ' || l_linenumber").distinct()).union(supplier.selectExpr("'t' || s_suppkey", "'table'", "s_name"))
    edges = None
    for kind, a, b, name, value, t, cond in _MODEL_EDGES:
        one = table(t).where(cond).selectExpr(f"'{kind}' AS kind", f"{spark_of(a)} AS a", f"{spark_of(b)} AS b", f"{spark_of(value)} AS v").distinct().select("kind", "a", "b", F.create_map(F.lit(name), F.col("v")).alias("props"))
        edges = one if edges is None else edges.unionByName(one)
    return vertices, edges


@query("g09_concept_edges", f"{_GRAPH} SELECT a_name AS from_name, kind AS predicate, TRY_CAST(v AS DOUBLE) AS tolerance, b_name AS to_name FROM m WHERE kind IN ('part_of', 'reconciles_with')")
def _(table):
    return mg.concept_edges(*_model(table))


@query("g09_column_uses", f"{_GRAPH} SELECT c.a_name AS concept, u.a_name AS grounding, u.v AS role, u.b_name AS \"column\", t.b_name AS \"table\" FROM (SELECT * FROM m WHERE kind = 'uses') u LEFT JOIN (SELECT DISTINCT b, a_name FROM m WHERE kind = 'grounded_by') c ON c.b = u.a LEFT JOIN (SELECT DISTINCT a, b_name FROM m WHERE kind = 'belongs_to') t ON t.a = u.b")
def _(table):
    return mg.column_uses(*_model(table))


@query("g09_table_references", f"{_GRAPH}, h AS (SELECT DISTINCT a, b_name FROM m WHERE kind = 'belongs_to') SELECT p.b_name AS from_table, r.a_name AS from_column, q.b_name AS to_table, r.b_name AS to_column, NULL::VARCHAR AS cardinality, v::BOOLEAN AS introduces_duplicates FROM m r JOIN h p ON p.a = r.a JOIN h q ON q.a = r.b WHERE r.kind = 'references'")
def _(table):
    return mg.table_references(*_model(table))


@query("g09_conformed_dimensions", f"{_GRAPH} SELECT DISTINCT least(a_name, b_name) AS table_a, greatest(a_name, b_name) AS table_b, v AS dimension, NULL::VARCHAR AS attribute FROM m WHERE kind = 'conforms' AND a <> b")
def _(table):
    return mg.conformed_dimensions(*_model(table))


@query("g09_derivations", f"{_GRAPH} SELECT a_name AS view, string_agg(DISTINCT b_name, '>' ORDER BY b_name) AS bases FROM m WHERE kind = 'derived_from' AND v = 'dimension' GROUP BY 1")
def _(table):
    return mg.derivations(*_model(table)).withColumn("bases", F.array_join("bases", ">"))


@query("g09_unresolved", f"{_GRAPH} SELECT kind, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.kind = e.kind AND m.a = e.a AND m.b = e.b) GROUP BY 1")
def _(table):
    return mg.unresolved(*_model(table))
