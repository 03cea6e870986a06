"""Queries that weigh evidence: nulls, orphans, cycles, lineage, hierarchy shape, and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import evidence as e
from siltstone.operators import graph as g
from siltstone.operators import joins as j
from siltstone.operators import typing as t
from siltstone.plans.base import query, rounded
from siltstone.plans.typed import _RAW, _raw
from siltstone.sources import readers as r
from siltstone.sources.scratch import scratch

_IMPACT = "CASE WHEN score = 0 THEN 'none' WHEN score < 0.05 THEN 'minimal' WHEN score < 0.2 THEN 'moderate' WHEN score < 0.5 THEN 'significant' ELSE 'critical' END"
_GAPPY = "(SELECT l_returnflag, l_linestatus, l_linenumber, CASE WHEN l_linenumber > 3 AND l_quantity < 20 THEN NULL ELSE l_tax END AS tax FROM lineitem)"


def _gappy(table):
    return table("lineitem").selectExpr("l_returnflag", "l_linestatus", "l_linenumber", "CASE WHEN l_linenumber > 3 AND l_quantity < 20 THEN NULL ELSE l_tax END AS tax")


@query("v07_null_impact", f"SELECT *, {_IMPACT} AS impact FROM (SELECT 'tax' AS \"column\", round(avg(CASE WHEN tax IS NULL THEN 1.0 ELSE 0 END), 6) AS score FROM {_GAPPY} UNION ALL SELECT 'l_linenumber', round(avg(CASE WHEN l_linenumber IS NULL THEN 1.0 ELSE 0 END), 6) FROM {_GAPPY})")
def _(table):
    return rounded(e.null_impact(_gappy(table), ["tax", "l_linenumber"]))


@query("v13_orphan_rate", "SELECT count(*) AS present, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS orphans, round(count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) / count(*), 6) AS score FROM orders WHERE o_custkey IS NOT NULL")
def _(table):
    return rounded(e.orphan_rate(table("orders"), table("customer").where("c_acctbal > 0"), "o_custkey", "c_custkey"))


@query("v14_type_fidelity", f"SELECT 'price' AS \"column\", round(greatest(count(*) FILTER (WHERE price IS NOT NULL AND TRY_CAST(price AS BIGINT) IS NULL) / count(price), count(*) FILTER (WHERE price IS NOT NULL AND TRY_CAST(price AS BIGINT) IS NULL) / count(*)), 6) AS score FROM {_RAW}")
def _(table):
    raw = _raw(table)
    report = t.cast_report(raw, {"price": "integer"}).selectExpr("column", "failed", "failed + succeeded AS total")
    sizes = raw.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(t.build_quarantine(raw, {"price": "integer"}).agg(F.count("*").alias("quarantined"))))
    return rounded(e.type_fidelity(report.crossJoin(F.broadcast(sizes))))


def _v_sql(s):
    return f"SELECT '{s}' AS slice, CASE WHEN k >= 2 AND g > 0 AND g < t AND ln * least(g, t - g) / t >= 5 THEN round(sqrt(greatest(0, chi / t - (k - 1) / (t - 1)) / least(1 - 1 / (t - 1), k - (k - 1) * (k - 1) / (t - 1) - 1)), 6) END AS v FROM (SELECT t, g, count(*) AS k, min(n) AS ln, sum(power(m - g * n / t, 2) / (g * n / t) + power(n - m - (t - g) * n / t, 2) / ((t - g) * n / t)) AS chi FROM (SELECT {s} AS s, count(*) AS n, count(*) - count(tax) AS m FROM {_GAPPY} GROUP BY 1), (SELECT count(*) AS t, count(*) - count(tax) AS g FROM {_GAPPY}) GROUP BY t, g)"


@query("a06_null_by_slice", " UNION ALL ".join(map(_v_sql, ("l_returnflag", "l_linestatus", "l_linenumber"))))
def _(table):
    return rounded(e.null_by_slice(_gappy(table), "tax", ["l_returnflag", "l_linestatus", "l_linenumber"]))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a08_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def _(table):
    return rounded(e.correlations(table("lineitem"), _CORR))


@query("a08_multicollinearity")
def _(table):
    return e.multicollinearity(table("lineitem").selectExpr("*", "l_extendedprice * (1 - l_discount) AS net"), [*_CORR, "net"])


@query("a04_graded_formula", "SELECT count(*) FILTER (WHERE n_chars <> 0 AND length(text) IS NOT NULL) AS total, count(*) FILTER (WHERE n_chars <> 0 AND length(text) IS NOT NULL AND abs(n_chars - length(text)) < 0.01) AS matched, round(count(*) FILTER (WHERE n_chars <> 0 AND length(text) IS NOT NULL AND abs(n_chars - length(text)) < 0.01) / nullif(count(*) FILTER (WHERE n_chars <> 0 AND length(text) IS NOT NULL), 0), 6) AS rate FROM documents")
def _(table):
    from siltstone.operators.crosscol import formula_match

    return rounded(formula_match(table("documents"), "n_chars", "length(text)"))


@query("j12_composite_key", "SELECT 'l_orderkey,l_linenumber' AS columns, CASE WHEN max(n) = 1 THEN '1:1' ELSE 'n:m' END AS cardinality FROM (SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey, l_linenumber)")
def _(table):
    keys = ["l_orderkey", "l_linenumber"]
    line = table("lineitem").select(*keys, "l_returnflag")
    left = j.spread(line, keys, line.count()).groupBy(*keys).agg(F.max("l_returnflag").alias("l_returnflag"))
    pairs, cardinality = j.composite_key(left, left, ("l_orderkey", "l_orderkey"), [("l_returnflag", "l_returnflag"), ("l_linenumber", "l_linenumber")])
    return left.sparkSession.createDataFrame([(",".join(a for a, _ in pairs), cardinality)], "columns string, cardinality string")


_HEALTH = "SELECT o_orderpriority AS cycle, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS completion, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE count(*) FILTER (WHERE o_totalprice > 1000) / count(*) END AS pass_rate FROM orders GROUP BY 1"


@query("m17_cycle_health", f"SELECT cycle, round(completion, 6) AS completion, round(pass_rate, 6) AS pass_rate, round(CASE WHEN pass_rate IS NULL THEN completion ELSE 0.6 * completion + 0.4 * pass_rate END, 6) AS health FROM ({_HEALTH})")
def _(table):
    run = "CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE count(*) END"
    cycles = table("orders").groupBy(F.col("o_orderpriority").alias("cycle"), "o_orderpriority").agg(F.avg(F.expr("CASE WHEN o_orderstatus = 'F' THEN 1D ELSE 0D END")).alias("completion"), F.count_if(F.expr("o_totalprice > 1000")).alias("passed"), F.expr(run).alias("run"))
    return rounded(e.cycle_health(cycles.selectExpr("cycle", "completion", "passed", "run", "cast(NULL AS double) AS confidence")))


@query("m18_cited_values", "SELECT value, count(o_orderkey) AS n, count(o_orderkey) > 0 AS present FROM (SELECT DISTINCT l_linestatus AS value FROM lineitem UNION SELECT DISTINCT l_returnflag FROM lineitem) LEFT JOIN orders ON o_orderstatus = value GROUP BY 1")
def _(table):
    line = table("lineitem")
    return e.cited_values(table("orders"), "o_orderstatus", line.select(F.col("l_linestatus").alias("value")).union(line.select("l_returnflag")))


_EV = "SELECT l_returnflag || l_linestatus AS entity, date_trunc('year', l_shipdate) AS period, sum(l_extendedprice) AS price, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2"
_FORMS = {"price": "price", "qty": "qty", "price - qty": "price - qty", "qty - price": "qty - price"}
_CONV = f"WITH s AS ({_EV}), c AS (" + " UNION ALL ".join(f"SELECT entity, period, '{n}' AS convention, {x} AS m FROM s" for n, x in _FORMS.items()) + ")"


def _candidates(table):
    named = table("lineitem").selectExpr("*", "l_extendedprice AS price", "l_quantity AS qty")
    return e.convention_candidates(named, "concat(l_returnflag, l_linestatus)", "date_trunc('year', l_shipdate)", ["price", "qty"])


@query("l02_conventions", f"{_CONV} SELECT entity, period::TIMESTAMP AS period, convention, round(m, 2) AS m FROM c")
def _(table):
    return rounded(_candidates(table), 2)


# The measure adds up the price year by year, so the price reconciles as its yearly step.
_ALIGNED = f"{_CONV}, y AS (SELECT entity, period, sum(price) OVER (PARTITION BY entity ORDER BY period) AS y FROM s), a AS (SELECT * FROM c JOIN y USING (entity, period)), d AS (SELECT *, y - lag(y) OVER (PARTITION BY convention, entity ORDER BY period) AS dy FROM a), f AS (SELECT convention, entity, count(*) AS periods, sum(abs(y)) AS sy, sum(abs(m)) AS sm, sum(abs(y - m)) / nullif(sum(abs(m)), 0) AS r_flow, sum(abs(dy - m)) / nullif(sum(abs(m)) FILTER (WHERE dy IS NOT NULL), 0) AS r_stock FROM d GROUP BY 1, 2), w AS (SELECT *, CASE WHEN periods >= 4 AND sy > 0 AND sm > 0 AND least(r_flow, r_stock) <= 0.5 THEN CASE WHEN r_flow IS NULL OR r_stock < r_flow THEN 'cumulative' ELSE 'per_period' END END AS vote FROM f)"


def _voted(table):
    from pyspark.sql import Window

    all_ = _candidates(table)
    y = all_.where("convention = 'price'").select("entity", "period", F.sum("m").over(Window.partitionBy("entity").orderBy("period")).alias("y"))
    return e.votes(all_.join(y, ["entity", "period"]))


@query("l06_votes", f"{_ALIGNED} SELECT convention, entity, periods, round(r_flow, 4) AS r_flow, round(r_stock, 4) AS r_stock, vote FROM w")
def _(table):
    return rounded(_voted(table), 4)


_WIN = f"{_ALIGNED}, q AS (SELECT convention, count(*) AS entities, count(vote) AS voters, count(*) FILTER (WHERE vote = 'per_period') AS flow, count(*) FILTER (WHERE vote = 'cumulative') AS stock, (SELECT count(DISTINCT entity) FROM w) AS n FROM w GROUP BY 1), z AS (SELECT *, greatest(flow, stock) AS hits, greatest(flow, stock) / n AS p, 1.96 * 1.96 AS zz FROM q)"


@query("l07_support", f"{_WIN} SELECT convention, entities, voters, CASE WHEN voters >= 2 AND hits / voters >= 0.8 THEN CASE WHEN flow >= stock THEN 'per_period' ELSE 'cumulative' END END AS pattern, round(CASE WHEN voters >= 2 AND hits / voters >= 0.8 THEN hits / entities END, 6) AS match_rate, round(greatest(0, (p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)), 6) AS lower FROM z")
def _(table):
    return rounded(e.support(_voted(table)))


_DIMS = ["c_name", "c_nationkey", "c_mktsegment", "c_custkey"]


@query("h16_slice_candidates", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS nulls FROM customer HAVING count(DISTINCT {c}) >= 2 AND count(DISTINCT {c}) < 0.9 * count(*)" for c in _DIMS if c != "c_custkey"))
def _(table):
    return e.slice_candidates(e.profile_counts(table("customer"), _DIMS), ["c_custkey"])


@query("h11_chain_edges", "SELECT DISTINCT 'c' || c_custkey AS a, 'n' || n_nationkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation")
def _(table):
    # Customer to region is given as well; the path over the nation implies it.
    both = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = both.selectExpr("concat('c', c_custkey) AS a", "concat('n', n_nationkey) AS b").union(both.selectExpr("concat('c', c_custkey)", "concat('r', n_regionkey)"))
    return e.chain_edges(edges.union(table("nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)")))


@query("g03_cyclic_groups", "SELECT 'n' || n_nationkey AS node, min('n' || n_nationkey) OVER (PARTITION BY n_regionkey) AS grp FROM nation")
def _(table):
    # Each nation points at the next one of its region, and the last one at the first.
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    ring = table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("n"), F.coalesce(F.lead("n_nationkey").over(w), F.min("n_nationkey").over(Window.partitionBy("n_regionkey")))).alias("b"))
    return e.cyclic_groups(ring)


_OC = "(SELECT DISTINCT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders)"
_DEG = f"(SELECT node, count(*) AS degree FROM (SELECT a AS node FROM {_OC} UNION ALL SELECT b FROM {_OC}) GROUP BY 1)"
# Orders touch one customer each, so the components are the customers that have any.
_SHAPE = f"SELECT count(*) AS v, (SELECT count(*) FROM {_OC}) AS e, count(*) FILTER (WHERE node LIKE 'c%') AS c, count(*) FILTER (WHERE degree = 1) AS ends, max(degree) AS top FROM {_DEG}"


@query("g04_pattern_class", f"SELECT v, e, c, ends, top, CASE WHEN e - v + c = 0 THEN CASE WHEN c > 1 THEN 'forest' WHEN top = v - 1 THEN 'star' ELSE 'tree' END ELSE 'nets' END AS shape FROM ({_SHAPE})")
def _(table):
    edges = table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return rounded(e.graph_shape(g.node_roles(nodes, edges), g.topology(nodes, edges)))


@query("s01_csv_text", "SELECT CAST(c_custkey AS VARCHAR) AS cust_key, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name, c_nationkey::VARCHAR AS c_2024_nation, c_mktsegment AS name_2, 'x' AS name_3, 'y' AS column_6 FROM customer")
def _(table):
    # Three columns have the same safe name, one has none, and every fifth name is a placeholder.
    df = table("customer").selectExpr("c_custkey AS `Cust Key`", "CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE 'n/a' END AS ` Name`", "c_nationkey AS `2024 Nation`", "c_mktsegment AS `Näme!`", "1 AS `Unnamed: 0`", "'x' AS `name`", "'y' AS `??`")
    path = scratch(df.sparkSession)
    df.write.option("header", True).csv(path)
    return r.read_csv_text(df.sparkSession, path, df.columns)


@query("s03_json_text", "SELECT CAST(n_nationkey AS VARCHAR) AS key, '{\"name\":\"' || n_name || '\"}' AS inner FROM nation")
def _(table):
    df = table("nation").selectExpr("n_nationkey AS Key", "struct(n_name AS name) AS Inner")
    path = scratch(df.sparkSession)
    df.write.json(path)
    return r.read_json_text(df.sparkSession, path)


@query("s11_layer_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey % 2 = 0")
def _(table):
    # A second write of a table takes the place of the first.
    root = scratch(table("orders").sparkSession)
    rows = table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    r.write_layer(rows, root, "typed", "orders")
    return r.write_layer(rows.where("o_custkey % 2 = 0"), root, "typed", "orders")


# Edges from a part to another of its brand and back by a third: rings of one brand's parts by size.
@query("g03_rings_of_parts", "SELECT 'p' || p_partkey AS node, min('p' || p_partkey) OVER (PARTITION BY p_brand, p_size) AS grp FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_size) > 1")
def _(table):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand", "p_size")
    key = F.concat(F.lit("p"), "p_partkey")
    ring = table("part").select(key.alias("a"), F.first(key).over(w.orderBy("p_partkey")).alias("first"), F.lead(key).over(w.orderBy("p_partkey")).alias("next"))
    return e.cyclic_groups(ring.select("a", F.coalesce("next", "first").alias("b")))


@query("s03_json_values", """SELECT CAST(c_custkey AS VARCHAR) AS key, '"' || c_name || '"' AS name, CASE WHEN c_acctbal > 0 THEN 'true' WHEN c_acctbal < 0 THEN 'false' END AS owed, '[' || c_nationkey || ',' || c_custkey || ']' AS both_2, '{"segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS both FROM customer""")
def _(table):
    df = table("customer").selectExpr(
        "c_custkey AS Key", "c_name AS Name", "CASE WHEN c_acctbal > 0 THEN true WHEN c_acctbal < 0 THEN false END AS Owed",
        "from_json(concat('{\"segment\":', CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE concat('\"', c_mktsegment, '\"') END, '}'), 'segment string') AS `Both`", "concat('[', c_nationkey, ',', c_custkey, ']') AS raw",
    )
    path = scratch(df.sparkSession)
    # Lines as they stand in files: a list, and a name that differs by case only.
    quoted = "to_json(struct(Key, Name, Owed, `Both`), map('ignoreNullFields', 'false'))"
    df.selectExpr(f"concat(left({quoted}, length({quoted}) - 1), ',\"both!\":', raw, '}}') AS value").write.text(path)
    return r.read_json_text(df.sparkSession, path)


@query("s11_layer", "SELECT n_nationkey, n_name FROM nation")
def _(table):
    return rounded(r.write_layer(table("nation").select("n_nationkey", "n_name"), scratch(table("nation").sparkSession), "typed", "nation"))


@query("s08_blank_nulls", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN '#n/a' ELSE o_orderstatus END AS status FROM orders")
def _(table):
    return r.blank_nulls(table("orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 1 THEN ' missing ' WHEN 2 THEN '--' WHEN 3 THEN '#n/a' ELSE o_orderstatus END AS status"))


# True values that are written like a placeholder are blanked as well: nothing tells them apart.
@query("s08_sentinels", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND CAST(o_custkey AS VARCHAR) NOT IN ('-999', '-9999', '9999') THEN CAST(o_custkey AS VARCHAR) END AS customer, CASE WHEN o_orderkey % 5 > 0 AND strftime(o_orderdate, '%Y-%m-%d') NOT IN ('0000-00-00', '1900-01-01', '1970-01-01') THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def _(table):
    soiled = table("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN '-9999' ELSE cast(o_custkey AS string) END AS customer", "CASE WHEN o_orderkey % 5 = 0 THEN '0000-00-00' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS day")
    return r.blank_sentinels(soiled, ["customer"], ["day"])


@query("s04_parquet_typed", "SELECT o_orderkey AS order_key, round(o_totalprice, 4) AS total_price_2 FROM orders")
def _(table):
    df = table("orders").selectExpr("o_orderkey AS `Order Key`", "o_totalprice AS `Total  Price (2)`")
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return rounded(r.read_parquet_typed(df.sparkSession, path), 4)


@query("s09_load_many", "SELECT 'lines' AS name, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def _(table):
    spark, root = table("orders").sparkSession, scratch(table("orders").sparkSession)
    table("orders").select("o_orderkey").write.parquet(f"{root}/orders.parquet")
    table("lineitem").select("l_orderkey").write.option("header", True).csv(f"{root}/Lines.csv")
    out = r.load_many(spark, [f"{root}/orders.parquet", f"{root}/Lines.csv"])
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in out.items()]
    return parts[0].unionByName(parts[1])


@query("s02_peek", "SELECT 'o_orderstatus' AS \"column\", array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS samples FROM (SELECT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10)")
def _(table):
    return r.peek(table("orders").orderBy("o_orderkey").select("o_orderstatus"), 10).select("column", F.array_join("samples", ",").alias("samples"))


@query("s12_preview", "SELECT o_orderkey, true AS more FROM orders ORDER BY o_orderkey LIMIT 50")
def _(table):
    rows, more = r.preview(table("orders").orderBy("o_orderkey").select("o_orderkey"), 50)
    return rows.withColumn("more", F.lit(more))


def _worst_sql(s):
    return f"SELECT '{s}' AS slice, CAST(arg_max({s}, (share, n, CAST({s} AS VARCHAR))) AS VARCHAR) AS value, max(share) AS share, arg_max(n, (share, n, CAST({s} AS VARCHAR))) AS n FROM (SELECT {s}, count(*) AS n, 1 - count(tax) / count(*) AS share FROM {_GAPPY} GROUP BY 1)"


_SLICES = ("l_returnflag", "l_linestatus", "l_linenumber")


@query("a06_worst_slices", f"SELECT slice, v, value, round(share, 6) AS share, n FROM ({' UNION ALL '.join(map(_v_sql, _SLICES))}) JOIN ({' UNION ALL '.join(map(_worst_sql, _SLICES))}) USING (slice) WHERE v IS NOT NULL ORDER BY v DESC, slice LIMIT 2")
def _(table):
    return rounded(e.worst_slices(_gappy(table), "tax", list(_SLICES), 2))
