"""Driver and hierarchy queries.  Random draws have no SQL; tests hold them against planted cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import crosscol as x
from siltstone.operators import drivers as d
from siltstone.operators import evidence as e
from siltstone.operators import hierarchies as h
from siltstone.operators.permutations import pair_tables
from siltstone.plans.base import query, rounded


def _line(table):
    return table("lineitem").selectExpr("*", "l_extendedprice * l_discount AS rebate")


@query("d03_weighted_reduction", "WITH g AS (SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) AS w, sum(l_extendedprice * l_discount) AS s, sum(l_extendedprice * l_discount * l_discount) AS ss FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice > 0 GROUP BY 1 HAVING count(*) >= 200) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, round((sum(s * s / w) - sum(s) * sum(s) / sum(w)) / (sum(ss) - sum(s) * sum(s) / sum(w)), 6) AS gain FROM g")
def _(table):
    return rounded(d.weighted_reduction(_line(table), "rebate", "l_extendedprice", "l_returnflag"))


_T = "SELECT '{k}' AS kind, count(*) AS n, round({v}, 4) AS v FROM ({t}) WHERE value IS NOT NULL"
_TARGETS = [
    ("flow", "sum(value)", "SELECT l_quantity AS value, 1 AS weight FROM lineitem"),
    ("stock", "sum(value * weight) / sum(weight)", "SELECT l_quantity AS value, 1 AS weight FROM lineitem"),
    ("ratio", "sum(value * weight) / sum(weight)", "SELECT l_discount AS value, l_extendedprice AS weight FROM lineitem"),
    ("entity_mean", "sum(value * weight) / sum(weight)", "SELECT avg(l_quantity) AS value, count(l_quantity) AS weight FROM lineitem GROUP BY l_suppkey"),
    ("residual_ratio", "sum(value * weight * weight) / sum(weight)", "SELECT l_discount - sum(l_extendedprice * l_discount) OVER (PARTITION BY l_suppkey) / sum(l_extendedprice) OVER (PARTITION BY l_suppkey) AS value, l_extendedprice AS weight FROM lineitem"),
]


@query("d05_targets", " UNION ALL ".join(_T.format(k=k, v=v, t=t) for k, v, t in _TARGETS))
def _(table):
    rows = _line(table)
    made = {"flow": ("l_quantity",), "stock": ("l_quantity",), "ratio": ("rebate", "l_extendedprice"), "entity_mean": ("l_quantity", None, "l_suppkey"), "residual_ratio": ("rebate", "l_extendedprice", "l_suppkey")}
    out = None
    for kind, args in made.items():
        t = d.target(rows, kind, *args)
        # The weighted mean of a residual is zero; weighted once more it tells large rows from small ones.
        one = t.agg(F.count("*").alias("n"), F.expr("sum(value * weight * weight) / sum(weight)").alias("v")) if kind == "residual_ratio" else d.target_statistic(t, kind)
        one = one.select(F.lit(kind).alias("kind"), "n", "v")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


@query("d07_permutation_gate")
def _(table):
    return d.permutation_gate(d.target(table("lineitem"), "flow", "l_extendedprice"), ["l_returnflag", "l_linestatus", "l_linenumber"])


_GAIN = (
    "SELECT '{d}' AS dim, round(sum(n * (m - mu) ** 2) / (sum(n * (m - mu) ** 2) + sum(n * q)), 6) AS gain FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS mu FROM "
    "(SELECT {d}, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS q FROM lineitem GROUP BY 1 HAVING count(*) >= 200))"
)


@query("d07_gains", " UNION ALL ".join(_GAIN.format(d=d) for d in ("l_returnflag", "l_linestatus", "l_linenumber")))
def _(table):
    return rounded(d.driver_gains(d.target(table("lineitem"), "flow", "l_extendedprice"), ["l_returnflag", "l_linestatus", "l_linenumber"]))


@query("d08_driver_tree")
def _(table):
    line = _line(table).withColumn("level", F.col("l_discount").cast("string"))
    return d.driver_tree(d.target(line, "flow", "rebate"), ["level", "l_returnflag", "l_linestatus", "l_linenumber"], permutations=200)


_PLACE = "(SELECT c_custkey, c_nationkey, c_mktsegment, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_PLACE_COLUMNS = ["c_mktsegment", "c_nationkey", "n_name", "n_regionkey"]
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, 1 - count(DISTINCT {a}) / count(DISTINCT ({a}, {b})) AS error_ab, 1 - count(DISTINCT {b}) / count(DISTINCT ({a}, {b})) AS error_ba FROM {_PLACE}"
    for i, a in enumerate(_PLACE_COLUMNS) for b in _PLACE_COLUMNS[i + 1 :]
)


def _place(table):
    return table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", *_PLACE_COLUMNS)


@query("h02_pair_errors", f"SELECT a, b, round(error_ab, 6) AS error_ab, round(error_ba, 6) AS error_ba, greatest(error_ab, error_ba) <= 0.01 AS alias FROM ({_PAIRS})")
def _(table):
    return rounded(h.pair_errors(_place(table), _PLACE_COLUMNS))


@query("d09_collapse_aliases", f"WITH p AS (SELECT a, b FROM ({_PAIRS}) WHERE greatest(error_ab, error_ba) <= 0.01), g AS (SELECT c AS name, least(c, min(o)) AS head FROM (SELECT a AS c, b AS o FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1), k(c, rank) AS (VALUES ('n_name', 2), ('c_nationkey', 1), ('n_regionkey', 3), ('c_mktsegment', 4)) SELECT coalesce(head, c) AS name, arg_min(c, rank) AS \"column\", min(rank) AS rank, count(*) AS members FROM k LEFT JOIN g ON g.name = k.c GROUP BY 1")
def _(table):
    groups = h.alias_groups(h.pair_errors(_place(table), _PLACE_COLUMNS).where("alias"))
    ranked = groups.sparkSession.createDataFrame([("n_name", 2), ("c_nationkey", 1), ("n_regionkey", 3), ("c_mktsegment", 4)], "column string, rank long")
    return d.collapse_aliases(ranked, groups)


@query("d13_hash_sample")
def _(table):
    return d.hash_sample(table("lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], 10_000)


@query("d14_rank_drivers")
def _(table):
    both = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    both = both.withColumn("maker", F.col("p_brand"))
    aliases = both.sparkSession.createDataFrame([("maker", "p_brand"), ("p_brand", "p_brand")], "column string, representative string")
    return d.rank_drivers(both, "l_extendedprice", ["p_brand", "maker", "p_type", "l_returnflag", "l_linestatus"], "l_partkey", ["l_orderkey", "l_linenumber"], permutations=200, aliases=aliases)


_TABLE_PAIRS = [("l_returnflag", "l_linestatus"), ("l_suppkey", "l_returnflag"), ("l_suppkey", "l_linenumber")]
_PAIR_TABLE = (
    "SELECT '{a}' AS a, '{b}' AS b, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT x) AS d_a, count(DISTINCT y) AS d_b, count(*) AS d_ab, CAST(sum(n) FILTER (WHERE px = 1) AS BIGINT) AS kept_ab, CAST(sum(n) FILTER (WHERE py = 1) AS BIGINT) AS kept_ba, "
    "CAST(max(nx) AS BIGINT) AS mode_a, CAST(max(ny) AS BIGINT) AS mode_b, round(sum(n * ln(n)), 4) AS information, round(sum(n / nx * n / ny), 6) AS association FROM ("
    "SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, row_number() OVER (PARTITION BY x ORDER BY n DESC) AS px, row_number() OVER (PARTITION BY y ORDER BY n DESC) AS py FROM "
    "(SELECT {a} AS x, {b} AS y, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2))"
)


@query("h06_pair_tables", " UNION ALL ".join(_PAIR_TABLE.format(a=a, b=b) for a, b in _TABLE_PAIRS))
def _(table):
    out = pair_tables(table("lineitem"), _TABLE_PAIRS).drop("a_counts", "b_counts")
    return rounded(out.withColumn("information", F.round("information", 4)))


@query("h06_dependency_p")
def _(table):
    return h.dependency_p_values(_place(table), [("c_nationkey", "n_regionkey"), ("c_mktsegment", "n_regionkey"), ("n_name", "c_mktsegment")], 299)


@query("h08_column_guards", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 1 AS is_constant, count(DISTINCT {c}) >= 3 AND count(DISTINCT {c}) < 0.9 * count(*) AS can_determine, count({c}) < 100 AS low_support FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def _(table):
    return h.column_guards(e.profile_counts(table("orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))


@query("h09_near_copy")
def _(table):
    # The flag as it stands and one that differs on a few returned lines.
    line = table("lineitem").withColumn("copy", F.expr("CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 AND l_orderkey % 3 = 0 THEN 'N' ELSE l_returnflag END"))
    return h.near_copy(line, "l_returnflag", "copy", ["l_linenumber", "l_linestatus"], draws=199)


@query("h10_alias_groups", "SELECT 'c' || o_custkey AS \"column\", min('c' || o_custkey) AS representative FROM orders GROUP BY 1 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders")
def _(table):
    return h.alias_groups(table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b")))


@query("h12_find_hierarchies")
def _(table):
    place = _place(table).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("home", F.expr("CASE WHEN c_custkey % 50 = 0 AND c_mktsegment = 'BUILDING' THEN 'ELSEWHERE' ELSE n_name END"))
    # A key and its name are known to be one dimension; nobody said so of regions.
    return h.find_hierarchies(place, [*_PLACE_COLUMNS, "r_name", "home"], identities={("c_nationkey", "n_name"): 0.95})


_MEMBERS = "SELECT 'drilldown' AS kind, [c_name, n_name] AS members FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _members(table):
    both = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(F.lit("drilldown").alias("kind"), F.array("c_name", "n_name").alias("members")), both


@query("h13_override_hierarchies", f"SELECT kind, array_to_string(members, '>') AS members FROM ({_MEMBERS} WHERE c_custkey % 5 > 0 UNION ALL SELECT 'alias', [c_name, c_mktsegment] FROM customer)")
def _(table):
    found, both = _members(table)
    rejected = both.where("c_custkey % 5 = 0").select(F.lit("drilldown").alias("kind"), F.array("n_name", "c_name").alias("members"))
    added = table("customer").select(F.lit("alias").alias("kind"), F.array("c_name", "c_mktsegment").alias("members"))
    return h.override_hierarchies(found, rejected, added).select("kind", F.array_join("members", ">").alias("members"))


_UP = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("h14_rollup_edges", f"SELECT 'h' || c_custkey AS name, c_name AS child, n_name AS parent, 0 AS level FROM {_UP} UNION ALL SELECT 'h' || c_custkey, n_name, r_name, 1 FROM {_UP}")
def _(table):
    up = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(h.rollup_edges(up.select(F.concat(F.lit("h"), "c_custkey").alias("name"), F.array("c_name", "n_name", "r_name").alias("members"))))


_REFS = "SELECT DISTINCT l_returnflag AS fact, n_name AS dimension, l_linestatus AS role FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
_FOLD = "SELECT DISTINCT c_mktsegment AS fact, 'm' || n_nationkey AS a, 'r' || n_regionkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey"
_BUS = f"WITH refs AS ({_REFS}), fold AS (SELECT fact, min(a) AS dimension FROM ({_FOLD}) GROUP BY fact, b), cells AS (SELECT fact, dimension, role, 'referenced' AS kind FROM refs UNION ALL SELECT fact, dimension, dimension, 'folded' FROM fold), n AS (SELECT dimension, role, count(DISTINCT fact) AS facts FROM cells GROUP BY 1, 2)"


def _matrix(table):
    up = table("nation").select("n_nationkey", "n_name", "n_regionkey")
    refs = table("lineitem").join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(up, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_returnflag").alias("fact"), F.col("n_name").alias("dimension"), F.col("l_linestatus").alias("role"))
    fold = table("customer").join(up, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("fact"), F.concat(F.lit("m"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")).distinct()
    return h.bus_matrix(refs, fold)


@query("h15_bus_matrix", f"{_BUS} SELECT fact, dimension, role, kind, facts, facts > 1 AS conformed FROM cells JOIN n USING (dimension, role)")
def _(table):
    return _matrix(table)


@query("l09_shared_groupings", f"{_BUS}, u AS (SELECT DISTINCT fact, dimension, role FROM cells) SELECT a.fact AS fact_a, b.fact AS fact_b, a.dimension, a.role FROM u a JOIN u b ON a.dimension = b.dimension AND a.role = b.role AND a.fact < b.fact")
def _(table):
    return h.shared_groupings(_matrix(table))


@query("h16_propagated_slices", f"SELECT DISTINCT fact, dimension, role, c AS \"column\" FROM ({_REFS}) JOIN (SELECT n_name AS dimension, 'segment_' || c_mktsegment AS c FROM customer JOIN nation ON c_nationkey = n_nationkey) USING (dimension)")
def _(table):
    refs = table("lineitem").join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_returnflag").alias("fact"), F.col("n_name").alias("dimension"), F.col("l_linestatus").alias("role"))
    slices = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("dimension"), F.concat(F.lit("segment_"), "c_mktsegment").alias("column"))
    return h.propagate_slices(slices.distinct(), refs.distinct())


@query("d06_guarded_effects", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders) - 1, 4) AS effect FROM orders WHERE (SELECT abs(avg(o_totalprice)) >= 0.05 * stddev_pop(o_totalprice) FROM orders) GROUP BY 1 HAVING count(*) >= 200")
def _(table):
    return rounded(x.guarded_effects(table("orders"), "o_totalprice", "o_orderpriority"), 4)


@query("d10_entity_rows", "SELECT o_custkey, round(sum(o_totalprice), 4) AS total, count(o_totalprice) AS weight, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS dim FROM orders GROUP BY 1")
def _(table):
    rows = table("orders").withColumn("dim", F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END"))
    return rounded(x.entity_rows(rows, "o_custkey", "o_totalprice", "dim", "o_orderkey"), 4)


_WIDE = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_FIT = "SELECT '{d}' AS dim, '{e}' AS entity, count(*) AS size, max(n) AS most, count(DISTINCT v) AS distinct_values FROM (SELECT {e}, count(DISTINCT {d}) AS n, max({d}) AS v FROM " + _WIDE + " GROUP BY 1)"
_FITS = " UNION ALL ".join(_FIT.format(d=dim, e=entity) for dim in ("c_mktsegment", "n_name", "o_orderpriority", "c_name") for entity in ("o_orderkey", "o_custkey"))


@query("d11_home_entities", f"SELECT dim, arg_min(entity, size) FILTER (WHERE most <= 1 AND distinct_values < size) AS home FROM ({_FITS}) GROUP BY 1 HAVING NOT bool_or(most <= 1 AND distinct_values = size)")
def _(table):
    rows = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # A customer's name only renames the customer.
    return x.home_entities(rows, ["o_orderkey", "o_custkey"], ["c_mktsegment", "n_name", "o_orderpriority", "c_name"])
