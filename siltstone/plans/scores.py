"""Validation and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import scores as v
from siltstone.plans.base import query, rounded

_BAL = "SELECT l_linestatus AS leg, sum(l_extendedprice) - sum(l_extendedprice * (1 + l_tax)) AS deviation, abs(sum(l_extendedprice)) AS magnitude FROM lineitem GROUP BY 1"


def _balance(table):
    return v.balance(table("lineitem").withColumn("taxed", F.expr("l_extendedprice * (1 + l_tax)")), "l_linestatus", "l_extendedprice", "taxed")


@query("v01_verdict", f"SELECT CASE WHEN abs(deviation) <= 0.01 THEN 'passed' ELSE 'failed' END AS status, leg, round(deviation, 2) AS deviation, round(magnitude, 2) AS magnitude FROM ({_BAL}) ORDER BY abs(deviation) DESC LIMIT 1")
def _(table):
    return rounded(v.verdict(_balance(table)), 2)


@query("v02_balance", f"SELECT leg, round(deviation, 2) AS deviation, round(magnitude, 2) AS magnitude FROM ({_BAL})")
def _(table):
    return rounded(_balance(table), 2)


@query("v02_constraint", "SELECT 'positive balance' AS leg, sum(CASE WHEN c_acctbal >= 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS deviation, count(*)::DOUBLE AS magnitude FROM customer")
def _(table):
    return v.constraint(table("customer"), "positive balance", "c_acctbal >= 0")


@query("v03_run_summary", "SELECT count(*) FILTER (WHERE s = 'passed') AS passed, count(*) FILTER (WHERE s = 'failed') AS failed, 0 AS skipped, 0 AS error, bool_or(k % 2 = 0 AND s = 'failed') AS critical_failure, CASE WHEN count(*) FILTER (WHERE s = 'failed') > 0 THEN 'failed' ELSE 'passed' END AS overall FROM (SELECT c_nationkey AS k, CASE WHEN min(c_acctbal) < -900 THEN 'failed' ELSE 'passed' END AS s FROM customer GROUP BY 1)")
def _(table):
    checks = table("customer").groupBy("c_nationkey").agg(F.expr("CASE WHEN min(c_acctbal) < -900 THEN 'failed' ELSE 'passed' END").alias("status")).withColumn("critical", F.expr("c_nationkey % 2 = 0"))
    return v.run_summary(checks)


@query("v04_severity", f"SELECT leg, round(least(1.0, abs(deviation) / magnitude), 6) AS score FROM ({_BAL})")
def _(table):
    return rounded(v.severity(_balance(table)))


@query("v06_kl_surprise", "WITH s AS (SELECT count(*) / sum(count(*)) OVER () AS p, 1.0 / count(*) OVER () AS q FROM customer GROUP BY c_mktsegment), k AS (SELECT sum(p * log2(p / q)) AS kl FROM s) SELECT round(kl, 6) AS kl, round(1 - pow(2, -kl), 6) AS score FROM k")
def _(table):
    shares = table("customer").groupBy("c_mktsegment").count().selectExpr("count / sum(count) OVER () AS p", "1D / count(*) OVER () AS q")
    return rounded(v.kl_surprise(shares))


_SC = "(SELECT c_mktsegment AS target, 'nulls' AS dimension, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END) AS score FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'outliers', avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0 END) FROM customer GROUP BY 1)"
_W = "(VALUES ('nulls', 'query', 0.5), ('nulls', 'reporting', 1.0), ('outliers', 'query', 0.9), ('outliers', 'reporting', 0.2)) w(dimension, intent, weight)"
_LOSS = f"SELECT target, intent, least(sum(weight * score), 1.0) AS risk FROM {_SC} JOIN {_W} USING (dimension) GROUP BY 1, 2"


def _scores(table):
    c = table("customer")
    part = lambda name, cond: c.groupBy(F.col("c_mktsegment").alias("target")).agg(F.lit(name).alias("dimension"), F.expr(f"avg(CASE WHEN {cond} THEN 1D ELSE 0D END)").alias("score"))
    return part("nulls", "c_acctbal < 0").unionByName(part("outliers", "c_acctbal > 5000"))


def _losses(table):
    scores = _scores(table)
    weights = scores.sparkSession.createDataFrame([("nulls", "query", 0.5), ("nulls", "reporting", 1.0), ("outliers", "query", 0.9), ("outliers", "reporting", 0.2)], "dimension string, intent string, weight double")
    return v.expected_loss(scores, weights)


_BAND = "CASE WHEN risk >= 0.6 THEN 'blocked' WHEN risk >= 0.3 THEN 'investigate' ELSE 'ready' END AS band"


@query("v16_expected_loss", f"SELECT target, intent, round(risk, 6) AS risk, {_BAND.replace('risk', 'l.risk')} FROM ({_LOSS}) l")
def _(table):
    return rounded(_losses(table))


@query("v17_readiness", f"SELECT target, round(max(risk), 6) AS risk, arg_max(intent, risk) AS worst_intent, {_BAND.replace('risk', 'max(l.risk)')} FROM ({_LOSS}) l GROUP BY 1")
def _(table):
    return rounded(v.readiness(_losses(table)))


@query("v18_contract", f"SELECT dimension, round(avg(score), 6) AS mean, 0.3::DOUBLE AS threshold, CASE WHEN avg(score) > 0.3 * 1.4 THEN 'blocking' WHEN avg(score) > 0.3 * 0.8 THEN 'warning' ELSE 'ok' END AS status FROM {_SC} GROUP BY 1")
def _(table):
    scores = _scores(table)
    limits = scores.sparkSession.createDataFrame([("nulls", 0.3), ("outliers", 0.3)], "dimension string, threshold double")
    return rounded(v.contract(scores, limits))


@query("v08_opinion_pool")
def _(table):
    rows = table("customer").groupBy(F.col("c_mktsegment").alias("target")).agg(F.expr("avg(CASE WHEN c_acctbal > 0 THEN 1D ELSE 0D END)").alias("x"))
    rows = rows.withColumn("w", F.explode(F.array(F.struct(F.lit("balance").alias("witness"), F.lit(0.7).alias("reliability"), F.array("x", 1 - F.col("x")).alias("p")), F.struct(F.lit("prior").alias("witness"), F.lit(0.9).alias("reliability"), F.array(F.lit(0.5), F.lit(0.5)).alias("p")))))
    return v.opinion_pool(rows.select("target", "w.*"))


# Three states of a balance: what each segment shows, a common prior, and an uncertain witness.
_STATES = "SELECT c_mktsegment AS t, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0 END) AS c FROM customer GROUP BY 1"
_WITNESS = " UNION ALL ".join(f"SELECT t, {r} AS r, unnest([0, 1, 2]) AS s, unnest([{p}]) AS p FROM x" for r, p in ((0.7, "a, b, c"), (0.9, "0.2, 0.3, 0.5"), (0.2, "1.0, 0.0, 0.0")))


@query("v08_many_states", f"""WITH x AS ({_STATES}), w AS (SELECT t, r, s, greatest(p::DOUBLE, 1e-9) AS p FROM ({_WITNESS})), l AS (SELECT t, s, exp(sum(r * ln(p))) AS z, sum(r * p) / sum(r) AS mean FROM w GROUP BY 1, 2),
h AS (SELECT t, sum(-r * p * log2(p)) / (sum(r) / 3) AS own FROM w GROUP BY 1), m AS (SELECT t, sum(-mean * log2(mean)) AS mean_h, sum(z) AS total, max(z) FILTER (WHERE s = 0) AS z0, max(z) FILTER (WHERE s = 1) AS z1, max(z) FILTER (WHERE s = 2) AS z2 FROM l GROUP BY 1)
SELECT t AS target, round(z0 / total, 6) AS p0, round(z1 / total, 6) AS p1, round(z2 / total, 6) AS p2, round(greatest(mean_h - own, 0) / log2(3), 6) AS conflict, round(own / log2(3), 6) AS ignorance FROM m JOIN h USING (t)""")
def _(table):
    share = lambda cond: F.expr(f"avg(CASE WHEN {cond} THEN 1D ELSE 0D END)")
    x = table("customer").groupBy(F.col("c_mktsegment").alias("target")).agg(share("c_acctbal < 0").alias("a"), share("c_acctbal BETWEEN 0 AND 5000").alias("b"), share("c_acctbal > 5000").alias("c"))
    said = [("shown", 0.7, "array(a, b, c)"), ("prior", 0.9, "array(0.2D, 0.3D, 0.5D)"), ("unsure", 0.2, "array(1D, 0D, 0D)")]
    rows = None
    for name, reliability, p in said:
        one = x.selectExpr("target", f"'{name}' AS witness", f"{reliability}D AS reliability", f"{p} AS p")
        rows = one if rows is None else rows.unionByName(one)
    out = v.opinion_pool(rows)
    return rounded(out.select("target", *[F.col("posterior")[i].alias(f"p{i}") for i in range(3)], "conflict", "ignorance"))


@query("v19_upsert", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def _(table):
    old = table("nation").select("n_nationkey", "n_name")
    new = table("nation").where("n_regionkey = 1").selectExpr("n_nationkey", "concat(upper(n_name), '!') AS n_name")
    return v.upsert(old, new, ["n_nationkey"])


@query("v19_upsert_orders", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders UNION ALL SELECT -1 - o_orderkey, 'N', 0.0 FROM orders WHERE o_custkey % 5 = 0")
def _(table):
    old = table("orders").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice AS price")
    new = table("orders").where("o_custkey % 3 = 0").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice + 1 AS price").union(table("orders").where("o_custkey % 5 = 0").selectExpr("-1 - o_orderkey", "'N'", "0D"))
    return v.upsert(old, new, ["o_orderkey"])


@query("v02_comparison", "SELECT l_returnflag AS leg, round(sum(abs(l_extendedprice - l_extendedprice * (1 - l_discount))), 2) AS deviation, round(sum(abs(l_extendedprice)), 2) AS magnitude FROM lineitem GROUP BY 1")
def _(table):
    return rounded(v.comparison(table("lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)")), "l_returnflag", "l_extendedprice", "net"), 2)


@query("v02_aggregate", "SELECT 'orders' AS leg, count(*)::DOUBLE - 1500 AS deviation, 1500.0::DOUBLE AS magnitude FROM orders")
def _(table):
    return v.aggregate_check(table("orders"), "orders", "count(*)", 1500)


@query("v04_graded_severity", f"SELECT leg, round(CASE WHEN leg = 'F' AND abs(deviation) > 0.01 THEN 1 ELSE least(1, abs(deviation) / magnitude) END, 6) AS score FROM ({_BAL})")
def _(table):
    return rounded(v.graded_severity(_balance(table).withColumn("critical", F.col("leg") == "F")))


_EXPECTED = "(SELECT DISTINCT c_mktsegment AS target, d AS dimension FROM customer, (VALUES ('nulls'), ('outliers'), ('age')) x(d) WHERE c_mktsegment <> 'BUILDING' OR d <> 'age')"
_DIRECT = f"(SELECT * FROM {_SC} UNION ALL SELECT c_mktsegment, 'spread', avg(CASE WHEN c_acctbal > 9000 THEN 1.0 ELSE 0 END) FROM customer GROUP BY 1)"


@query("v17_readiness_report", f"WITH s AS {_DIRECT}, w AS (SELECT * FROM {_W}), l AS ({_LOSS}), r AS (SELECT target, max(risk) AS risk, arg_max(intent, risk) AS worst_intent FROM l GROUP BY 1), i AS (SELECT target, dimension, max(weight * score) AS impact FROM s JOIN w USING (dimension) GROUP BY 1, 2), d AS (SELECT target, string_agg(dimension || ':' || CASE WHEN impact >= 0.6 THEN 'high' WHEN impact >= 0.3 THEN 'medium' ELSE 'low' END, ',' ORDER BY impact DESC) AS drivers FROM i GROUP BY 1), e AS (SELECT target, CASE WHEN count(score) = 0 THEN 'unmeasured' WHEN count(score) < count(*) THEN 'partial' ELSE 'measured' END AS coverage FROM {_EXPECTED} LEFT JOIN s USING (target, dimension) GROUP BY 1), x AS (SELECT target, max(score) AS direct FROM s WHERE dimension NOT IN (SELECT dimension FROM w) GROUP BY 1) SELECT target, round(risk, 6) AS risk, worst_intent, {_BAND}, drivers, coverage, round(direct, 6) AS direct FROM e JOIN r USING (target) JOIN d USING (target) LEFT JOIN x USING (target)")
def _(table):
    c = table("customer")
    scores = _scores(table).unionByName(c.groupBy(F.col("c_mktsegment").alias("target")).agg(F.lit("spread").alias("dimension"), F.expr("avg(CASE WHEN c_acctbal > 9000 THEN 1D ELSE 0D END)").alias("score")))
    weights = scores.sparkSession.createDataFrame([("nulls", "query", 0.5), ("nulls", "reporting", 1.0), ("outliers", "query", 0.9), ("outliers", "reporting", 0.2)], "dimension string, intent string, weight double")
    expected = c.select(F.col("c_mktsegment").alias("target")).distinct().select("target", F.explode(F.array(*map(F.lit, ("nulls", "outliers", "age")))).alias("dimension")).where("target <> 'BUILDING' OR dimension <> 'age'")
    return rounded(v.readiness_report(scores, weights, expected))


_LIMITS = [
    ("strict", 0.2, {"nulls": 0.02, "outliers": 0.1, "spread": 0.01}),
    ("usual", 0.5, {"nulls": 0.12, "outliers": 0.6}),
    ("lax", 0.9, {"nulls": 0.5, "outliers": 0.9}),
    ("uneven", 0.35, {"nulls": 0.12, "outliers": 0.3, "age": 0.1}),
]
_CONTRACTS = "(VALUES " + ", ".join(f"('{n}', '{d}', {t}, {o})" for n, o, ts in _LIMITS for d, t in ts.items()) + ") k(contract, dimension, threshold, overall)"
_COLOURS = f"""WITH m AS (SELECT contract, dimension, threshold::DOUBLE AS threshold, overall::DOUBLE AS overall, coalesce(avg(score), 0) AS mean FROM {_CONTRACTS} LEFT JOIN {_DIRECT} USING (dimension) GROUP BY ALL),
x AS (SELECT {{blocked}} AS stopped), s AS (SELECT contract, avg(mean) AS mean, count(*) FILTER (WHERE mean > threshold * 1.4) AS bad, count(*) FILTER (WHERE mean > threshold * 0.8 AND mean <= threshold * 1.4) AS warnings, avg(CASE WHEN mean > threshold THEN 0 ELSE 1 END) AS compliance, max(overall) AS overall FROM m GROUP BY 1),
o AS (SELECT *, bad + (mean > overall)::INT + stopped::INT AS blocking, CASE WHEN bad + (mean > overall)::INT + stopped::INT >= 3 OR stopped THEN 'red' WHEN bad + (mean > overall)::INT > 0 THEN 'orange' WHEN warnings > 0 THEN 'yellow' ELSE 'green' END AS colour FROM s, x)
SELECT contract, round(mean, 6) AS mean, CAST(blocking AS BIGINT) AS blocking, warnings, round(compliance, 6) AS compliance, colour, coalesce(contract = (SELECT arg_min(contract, overall) FROM o WHERE blocking = 0), false) AS strictest FROM o"""


def _contracts(table):
    """Scores of two dotted dimensions and the contracts that limit them, their parent, or nothing that is measured."""
    c = table("customer")
    scores = _scores(table).unionByName(c.groupBy(F.col("c_mktsegment").alias("target")).agg(F.lit("spread").alias("dimension"), F.expr("avg(CASE WHEN c_acctbal > 9000 THEN 1D ELSE 0D END)").alias("score")))
    listed = [(n, d, t, o) for n, o, ts in _LIMITS for d, t in ts.items()]
    return scores.withColumnRenamed("target", "column"), scores.sparkSession.createDataFrame(listed, "contract string, dimension string, threshold double, overall double")


@query("v18_contracts", _COLOURS.replace("{blocked}", "false"))
def _(table):
    return rounded(v.evaluate_contracts(*_contracts(table)))


@query("v18_blocked_columns", _COLOURS.replace("{blocked}", f"(SELECT count(*) > 0 FROM (SELECT target, max(risk) AS risk FROM ({_LOSS}) GROUP BY 1) WHERE risk >= 0.4)"))
def _(table):
    risky = v.readiness(_losses(table)).where("risk >= 0.4").select(F.col("target").alias("column"))
    return rounded(v.evaluate_contracts(*_contracts(table), blocked=risky))


# A table's dimension is measured as the mean of the dotted ones below it.
_PARENT = "WITH t AS (SELECT target, avg(score) AS score FROM {sc} GROUP BY 1) SELECT 'whole' AS contract, round(avg(score), 6) AS mean, CAST((avg(score) > 0.05 * 1.4)::INT + (avg(score) > 0.3)::INT AS BIGINT) AS blocking, CAST((avg(score) > 0.05 * 0.8 AND avg(score) <= 0.05 * 1.4)::INT AS BIGINT) AS warnings, CASE WHEN avg(score) > 0.05 THEN 0.0 ELSE 1 END::DOUBLE AS compliance, CASE WHEN avg(score) > 0.05 * 1.4 OR avg(score) > 0.3 THEN 'orange' WHEN avg(score) > 0.05 * 0.8 THEN 'yellow' ELSE 'green' END AS colour, avg(score) <= 0.05 * 1.4 AND avg(score) <= 0.3 AS strictest FROM t"


@query("v18_parent_dimension", _PARENT.format(sc=_SC))
def _(table):
    scores = _scores(table).withColumnRenamed("target", "column").withColumn("dimension", F.concat(F.lit("value."), "dimension"))
    return rounded(v.evaluate_contracts(scores, scores.sparkSession.createDataFrame([("whole", "value", 0.05, 0.3)], "contract string, dimension string, threshold double, overall double")))


@query("v19_current_runs", "SELECT o_orderkey AS target, o_custkey AS run_id FROM orders WHERE o_custkey % 2 = 0")
def _(table):
    heads = table("orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("run_id"))
    return v.current_runs(table("orders").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("run_id")), heads)
