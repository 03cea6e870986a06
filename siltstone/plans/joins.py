"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import joins as j
from siltstone.plans.base import query, rounded


@query("j01_join_statistics", "SELECT 'customer' AS \"table\", 'c_custkey' AS \"column\", 'numeric' AS family, count(DISTINCT c_custkey) AS distinct_values, count(c_custkey) AS non_null, round(count(DISTINCT c_custkey) / count(c_custkey), 6) AS uniqueness FROM customer UNION ALL SELECT 'customer', 'c_nationkey', 'numeric', count(DISTINCT c_nationkey), count(c_nationkey), round(count(DISTINCT c_nationkey) / count(c_nationkey), 6) FROM customer UNION ALL SELECT 'customer', 'c_mktsegment', 'string', count(DISTINCT c_mktsegment), count(c_mktsegment), round(count(DISTINCT c_mktsegment) / count(c_mktsegment), 6) FROM customer")
def _(table):
    return rounded(j.join_statistics(j.join_cells({"customer": table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")})))


_J5 = """WITH v AS (SELECT 'nation' AS t, 'n_nationkey' AS c, n_nationkey AS v FROM nation UNION ALL SELECT 'nation', 'n_regionkey', n_regionkey FROM nation UNION ALL SELECT 'region', 'r_regionkey', r_regionkey FROM region UNION ALL SELECT 'supplier', 's_suppkey', s_suppkey FROM supplier UNION ALL SELECT 'supplier', 's_nationkey', s_nationkey FROM supplier UNION ALL SELECT 'customer', 'c_custkey', c_custkey FROM customer UNION ALL SELECT 'customer', 'c_nationkey', c_nationkey FROM customer),
s AS (SELECT t, c, count(DISTINCT v) AS d, count(DISTINCT v) / count(v) AS u FROM v WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT v) > 1), x AS (SELECT DISTINCT t, c, v FROM v WHERE v IS NOT NULL),
p AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) AS shared FROM x a JOIN x b ON a.v = b.v AND (a.t < b.t OR (a.t = b.t AND a.c < b.c)) GROUP BY ALL),
q AS (SELECT p.*, a.d AS da, a.u AS ua, b.d AS db, b.u AS ub, greatest(shared / (a.d + b.d - shared), CASE WHEN b.u >= 0.95 AND shared / a.d >= 0.95 THEN shared / a.d ELSE 0 END, CASE WHEN a.u >= 0.95 AND shared / b.d >= 0.95 THEN shared / b.d ELSE 0 END) AS score FROM p JOIN s a ON a.t = ta AND a.c = ca JOIN s b ON b.t = tb AND b.c = cb)
SELECT ta AS table_a, ca AS column_a, tb AS table_b, cb AS column_b, shared, round(score, 6) AS score, (CASE WHEN ua >= 0.95 THEN '1' ELSE 'n' END) || ':' || (CASE WHEN ub >= 0.95 THEN '1' WHEN ua >= 0.95 THEN 'n' ELSE 'm' END) AS cardinality FROM q WHERE score >= 0.5 AND (greatest(da, db) / least(da, db) <= 100 OR (CASE WHEN da >= db THEN ua ELSE ub END) >= 0.95)"""


def _keys(table):
    return {"nation": table("nation").select("n_nationkey", "n_regionkey"), "region": table("region").select("r_regionkey"), "supplier": table("supplier").select("s_suppkey", "s_nationkey"), "customer": table("customer").select("c_custkey", "c_nationkey")}


#: All columns of six tables by the family of their type.
_FAMILIES = {
    "nation": {"n_nationkey": "numeric", "n_name": "string", "n_regionkey": "numeric"}, "region": {"r_regionkey": "numeric", "r_name": "string"},
    "supplier": {"s_suppkey": "numeric", "s_name": "string", "s_nationkey": "numeric", "s_acctbal": "numeric"}, "part": {"p_partkey": "numeric", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "numeric", "p_retailprice": "numeric"},
    "customer": {"c_custkey": "numeric", "c_name": "string", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "string"},
    "orders": {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "string", "o_totalprice": "numeric", "o_orderdate": "temporal", "o_orderpriority": "string"},
}
_AS_TEXT = {"numeric": "CAST(CAST({} AS DECIMAL(38, 6)) AS VARCHAR)", "string": "{}", "temporal": "CAST({} AS VARCHAR)"}
_CELLS = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, '{f}:' || {_AS_TEXT[f].format(c)} AS v FROM {t}" for t, cs in _FAMILIES.items() for c, f in cs.items())
_J5_ALL = _J5.replace(_J5[_J5.index("v AS (") : _J5.index("),\ns AS")], f"v AS ({_CELLS}")


@query("j05_all_columns", _J5_ALL)
def _(table):
    return rounded(j.find_joins({t: table(t) for t in _FAMILIES}))


@query("j05_find_joins", _J5)
def _(table):
    return rounded(j.find_joins(_keys(table)))


_J5_PAIRS = _J5_ALL[: _J5_ALL.index("\nSELECT ta AS table_a")]
_J5_ENDS = _J5_ALL[_J5_ALL.index("(CASE WHEN ua") : _J5_ALL.index(" FROM q WHERE")]
_J5_NEAR = _J5_ALL[_J5_ALL.rindex("(greatest(da, db)") :]
_LARGE = "greatest(da, db) >= 1000000"
# From a million distinct values on a column is estimated, by the same 128 hashes of the same digest.
_J5_ADAPTIVE = f"""{_J5_PAIRS},
f AS (SELECT t, c, split_part(any_value(v), ':', 1) AS f FROM x GROUP BY 1, 2), l AS (SELECT DISTINCT f FROM f JOIN s USING (t, c) WHERE d >= 1000000),
h AS (SELECT t, c, f, ('0x' || md5(v)[1:7])::BIGINT AS hx, ('0x' || md5(v)[8:14])::BIGINT AS hy FROM x JOIN s USING (t, c) JOIN f USING (t, c) JOIN l USING (f)),
m AS (SELECT t, c, f, unnest(mins) AS least, unnest(range(128)) AS place FROM (SELECT t, c, f, [{', '.join(f'min({e})' for e in j.permuted('hx', 'hy', 128))}] AS mins FROM h GROUP BY ALL)),
e AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) / 128 AS score FROM m a JOIN m b ON a.f = b.f AND a.place = b.place AND a.least = b.least AND (a.t < b.t OR (a.t = b.t AND a.c < b.c)) GROUP BY ALL),
r AS (SELECT e.*, a.d AS da, a.u AS ua, b.d AS db, b.u AS ub FROM e JOIN s a ON a.t = ta AND a.c = ca JOIN s b ON b.t = tb AND b.c = cb)
SELECT ta AS table_a, ca AS column_a, tb AS table_b, cb AS column_b, round(score, 6) AS score, {_J5_ENDS}, 'exact' AS algorithm, CAST(1 AS DOUBLE) AS confidence FROM q WHERE NOT {_LARGE} AND score >= 0.5 AND {_J5_NEAR}
UNION ALL SELECT ta, ca, tb, cb, round(score, 6), {_J5_ENDS}, 'minhash', round(1 - CASE WHEN score < 1 THEN sqrt(score * (1 - score) / 128) ELSE 1 / sqrt(128) END, 6) FROM r WHERE {_LARGE} AND score >= 0.5 AND {_J5_NEAR}"""


@query("j05_adaptive", _J5_ADAPTIVE)
def _(table):
    return rounded(j.find_joins_adaptive({t: table(t) for t in _FAMILIES}))


@query("j05_estimated")
def _(table):
    """Every pair with a column of more than twenty distinct values by its minima."""
    return rounded(j.find_joins_adaptive({t: table(t) for t in _FAMILIES}, estimate_from=20))


@query("j04_minhash")
def _(table):
    return j.estimated_jaccard(j.min_hashes(table("orders"), "o_custkey"), j.min_hashes(table("customer"), "c_custkey"))


@query("j07_direction_metrics", "SELECT count(o_custkey) AS total, count(*) FILTER (WHERE o_custkey IS NOT NULL AND NOT hit) AS orphans, round(100.0 * count(*) FILTER (WHERE hit) / count(o_custkey), 6) AS integrity_pct, round(100.0 * count(DISTINCT o_custkey) FILTER (WHERE hit) / count(DISTINCT o_custkey), 6) AS coverage_pct FROM (SELECT o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS hit FROM orders)")
def _(table):
    return rounded(j.direction_metrics(table("orders"), table("customer").where("c_acctbal > 0"), "o_custkey", "c_custkey"))


@query("j08_cardinality", "SELECT max(a) AS max_left, max(b) AS max_right, (CASE WHEN max(a) = 1 THEN '1' ELSE 'n' END) || ':' || (CASE WHEN max(b) = 1 THEN '1' WHEN max(a) = 1 THEN 'n' ELSE 'm' END) AS cardinality FROM (SELECT l_orderkey AS k, count(*) AS a FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey AS k, count(*) AS b FROM orders GROUP BY 1) USING (k)")
def _(table):
    return j.measured_cardinality(table("lineitem"), table("orders"), ["l_orderkey"], ["o_orderkey"])


@query("j09_coverage", "SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS covered, round(count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) / count(*), 6) AS coverage FROM customer")
def _(table):
    return rounded(j.join_coverage(table("customer"), table("orders"), "c_custkey", "o_custkey"))


@query("j10_fan_trap", "SELECT (SELECT count(*) FROM orders) AS before, count(*) AS after, count(*) > (SELECT count(*) FROM orders) AS multiplies FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def _(table):
    return j.fan_trap(table("orders"), table("lineitem"), "o_orderkey", "l_orderkey")


@query("j13_surrogate_key", "SELECT l_orderkey, l_linenumber, md5(l_orderkey || '|' || l_linenumber) AS _sk__l_orderkey__l_linenumber FROM lineitem")
def _(table):
    return j.surrogate_key(table("lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "_sk__l_orderkey__l_linenumber")


@query("j14_enrich", "SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice, c_name AS o_custkey__c_name, c_mktsegment AS o_custkey__c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(table):
    dims = {"o_custkey": (table("customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")}
    return rounded(j.enrich(table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), dims), 4)


@query("j15_grain_probe", "SELECT k, fact_rows, dim_rows FROM (SELECT c_custkey AS k, count(*) AS fact_rows FROM customer GROUP BY 1) JOIN (SELECT o_custkey AS k, count(*) AS dim_rows FROM orders GROUP BY 1 HAVING count(*) > 1) USING (k)")
def _(table):
    return j.repeated_keys(table("customer"), table("orders"), "c_custkey", "o_custkey")


@query("j16_grain_assertion", "SELECT (SELECT count(*) FROM orders) AS fact_rows, count(*) AS view_rows, count(*) = (SELECT count(*) FROM orders) AS same_grain FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(table):
    fact = table("orders").select("o_orderkey", "o_custkey")
    view = j.enrich(fact, {"o_custkey": (table("customer").select("c_custkey", "c_name"), "c_custkey")})
    return fact.agg(F.count("*").alias("fact_rows")).crossJoin(F.broadcast(view.agg(F.count("*").alias("view_rows")))).selectExpr("*", "fact_rows = view_rows AS same_grain")


@query("j17_conditioned_values", "SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")
def _(table):
    return rounded(j.value_shares(j.riding(table("customer"), table("orders"), "c_custkey", "o_custkey"), "c_mktsegment"))


@query("j18_conditioned_range", "SELECT round(min(c_acctbal), 4) AS lo, round(max(c_acctbal), 4) AS hi FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(table):
    return rounded(j.riding(table("customer"), table("orders"), "c_custkey", "o_custkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")), 4)


@query("j19_overrides", f"SELECT table_a || '.' || column_a AS a, table_b || '.' || column_b AS b FROM ({_J5}) WHERE NOT (table_a = 'nation' AND table_b = 'region') UNION ALL SELECT 'orders.o_custkey', 'customer.c_custkey'")
def _(table):
    return _overridden(j.find_joins(_keys(table)))


def _overridden(joins):
    found = joins.select(F.concat_ws(".", "table_a", "column_a").alias("a"), F.concat_ws(".", "table_b", "column_b").alias("b"))
    rejected = found.where("a LIKE 'nation.%' AND b LIKE 'region.%'").select(F.col("b").alias("a"), F.col("a").alias("b"))
    added = found.limit(1).select(F.lit("orders.o_custkey").alias("a"), F.lit("customer.c_custkey").alias("b"))
    return j.override_relationships(found, rejected, added)


@query("j20_ambiguous_paths", f"SELECT least(table_a, table_b) AS one, greatest(table_a, table_b) AS other, count(DISTINCT (column_a, column_b)) AS paths FROM ({_J5}) GROUP BY 1, 2 HAVING count(DISTINCT (column_a, column_b)) > 1")
def _(table):
    return j.ambiguous_paths(j.find_joins(_keys(table)))


@query("j21_null_safe_full_join", "SELECT coalesce(a.k, b.k) AS k, customers, suppliers FROM (SELECT CASE WHEN c_nationkey < 20 THEN c_nationkey END AS k, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT CASE WHEN s_nationkey > 3 THEN s_nationkey END AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
def _(table):
    a = table("customer").groupBy(F.expr("CASE WHEN c_nationkey < 20 THEN c_nationkey END").alias("k")).agg(F.count("*").alias("customers"))
    b = table("supplier").groupBy(F.expr("CASE WHEN s_nationkey > 3 THEN s_nationkey END").alias("k")).agg(F.count("*").alias("suppliers"))
    return j.full_join_null_safe([a, b], ["k"])


def _way(direction, a, x, b, y):
    return f"SELECT '{direction}' AS direction, count({x}) AS total, count({x}) FILTER (WHERE NOT hit) AS orphans, round(100.0 * count({x}) FILTER (WHERE hit) / count({x}), 6) AS integrity_pct, round(100.0 * count(DISTINCT {x}) FILTER (WHERE hit) / count(DISTINCT {x}), 6) AS coverage_pct FROM (SELECT {x}, {x} IN (SELECT {y} FROM {b} WHERE {y} IS NOT NULL) AS hit FROM {a})"


@query("j07_both_directions", f"{_way('forward', 'orders', 'o_custkey', 'customer', 'c_custkey')} UNION ALL {_way('backward', 'customer', 'c_custkey', 'orders', 'o_custkey')}")
def _(table):
    return rounded(j.both_directions(table("orders"), table("customer"), "o_custkey", "c_custkey"))


_EVAL = [("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_orderkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]


def _evaluated(a, x, b, y):
    there, back = _way("x", a, x, b, y), _way("x", b, y, a, x)
    shape = f"SELECT (CASE WHEN max(n) = 1 THEN '1' ELSE 'n' END) || ':' || (CASE WHEN max(m) = 1 THEN '1' WHEN max(n) = 1 THEN 'n' ELSE 'm' END) AS cardinality FROM (SELECT {x} AS k, count(*) AS n FROM {a} WHERE {x} IS NOT NULL GROUP BY 1) JOIN (SELECT {y} AS k, count(*) AS m FROM {b} WHERE {y} IS NOT NULL GROUP BY 1) USING (k)"
    trap = f"SELECT count(*) > (SELECT count(*) FROM {a}) AS multiplies FROM {a} LEFT JOIN {b} ON {x} = {y}"
    return f"SELECT '{a}' AS table_a, '{x}' AS column_a, '{b}' AS table_b, '{y}' AS column_b, t.integrity_pct, t.orphans, t.coverage_pct, r.integrity_pct AS back_integrity_pct, r.orphans AS back_orphans, cardinality, multiplies FROM ({there}) t, ({back}) r, ({shape}), ({trap})"


@query("j11_evaluate_candidates", f"SELECT *, row_number() OVER (PARTITION BY least(table_a, table_b), greatest(table_a, table_b) ORDER BY integrity_pct DESC NULLS LAST, coverage_pct DESC NULLS LAST, column_a, column_b) = 1 AS best FROM ({' UNION ALL '.join(_evaluated(*e) for e in _EVAL)})")
def _(table):
    return rounded(j.evaluate_candidates({n: table(n) for n in ("orders", "customer", "lineitem")}, _EVAL))


_HASHES = "SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))) / (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)) AS jaccard"


@query("j04_minhash_within_error", f"SELECT round(jaccard, 6) AS jaccard, true AS close FROM ({_HASHES})")
def _(table):
    # The exact share, and whether the estimate is within four of its standard errors.
    found = j.estimated_jaccard(j.min_hashes(table("orders"), "o_custkey"), j.min_hashes(table("customer"), "c_custkey")).withColumnRenamed("jaccard", "estimate")
    a, b = table("orders").select(F.col("o_custkey").alias("k")).distinct(), table("customer").select(F.col("c_custkey").alias("k")).distinct()
    exact = a.join(b, "k").agg(F.count("*").alias("shared")).crossJoin(F.broadcast(a.union(b).distinct().agg(F.count("*").alias("every")))).selectExpr("shared / every AS jaccard")
    return rounded(found.crossJoin(F.broadcast(exact)).selectExpr("jaccard", "abs(estimate - jaccard) <= 4 * sqrt(jaccard * (1 - jaccard) / 128) + 1e-9 AS close"))


@query("j12_composite_coverage", "SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS covered, round(count(*) FILTER (WHERE hit) / count(*), 6) AS coverage FROM (SELECT (l_suppkey, l_linenumber) IN (SELECT (l_suppkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45) AS hit FROM lineitem WHERE l_suppkey IS NOT NULL AND l_linenumber IS NOT NULL)")
def _(table):
    right = table("lineitem").where("l_returnflag = 'N' AND l_quantity > 45").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"))
    return rounded(j.composite_coverage(table("lineitem"), right, [("l_suppkey", "s"), ("l_linenumber", "n")]))


@query("j13_mint_both", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON md5(a.l_orderkey || '|' || a.l_linenumber) = md5(b.l_orderkey || '|' || b.l_linenumber) WHERE b.l_returnflag = 'R'")
def _(table):
    right = table("lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_quantity")
    left, right = j.mint_both(table("lineitem").select("l_orderkey", "l_linenumber"), right, [("l_orderkey", "o"), ("l_linenumber", "n")])
    return rounded(left.join(right, "_sk__l_orderkey__l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity"))


@query("j15_grain_safe", "SELECT 'c_custkey' AS fk, count(*) AS repeated, count(*) = 0 AS kept FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'c_nationkey', count(*), count(*) = 0 FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1)")
def _(table):
    return j.grain_safe(table("customer"), {"c_custkey": (table("orders"), "o_custkey"), "c_nationkey": (table("nation"), "n_nationkey")})


@query("j20_resolved_paths", f"SELECT one, other, paths, coalesce(confirmed, 0) AS confirmed, coalesce(confirmed = 1, false) AS resolved FROM (SELECT least(table_a, table_b) AS one, greatest(table_a, table_b) AS other, count(DISTINCT (column_a, column_b)) AS paths FROM ({_J5}) GROUP BY 1, 2 HAVING count(DISTINCT (column_a, column_b)) > 1) LEFT JOIN (SELECT least(table_a, table_b) AS one, greatest(table_a, table_b) AS other, count(*) AS confirmed FROM ({_J5}) WHERE column_a LIKE '%nationkey' AND column_b LIKE '%nationkey' GROUP BY 1, 2) USING (one, other)")
def _(table):
    found = j.find_joins(_keys(table))
    return j.resolved_paths(found, found.where("column_a LIKE '%nationkey' AND column_b LIKE '%nationkey'"))


@query("j19_measured_additions", f"SELECT table_a || '.' || column_a AS a, table_b || '.' || column_b AS b, integrity_pct, back_integrity_pct, cardinality FROM ({_evaluated(*_EVAL[0])} UNION ALL {_evaluated(*_EVAL[2])})")
def _(table):
    added = [("orders.o_custkey", "customer.c_custkey"), ("lineitem.l_orderkey", "orders.o_orderkey")]
    return rounded(j.measured_additions({n: table(n) for n in ("orders", "customer", "lineitem")}, added))
