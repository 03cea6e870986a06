"""Adjudication and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.operators import adjudicate as a
from siltstone.operators import lineage as l
from siltstone.operators import joins as j
from siltstone.operators import metrics as m
from siltstone.operators import typing as t
from siltstone.plans.base import query, rounded
from siltstone.plans.evidence import _CONV, _candidates
from siltstone.plans.joins import _J5, _keys
from siltstone.plans.typed import _RAW, _raw

_H = "-({x} * log2({x}) + (1 - {x}) * log2(1 - {x}))"


def _pool(witnesses: str) -> str:
    """SQL of the binary pool over ``target, reliability, p`` rows."""
    return f"(SELECT target, 1 / (1 + exp(-coalesce(sum(reliability * ln(p / (1 - p))), 0))) AS belief, coalesce(greatest({_H.format(x='(sum(reliability * p) / sum(reliability) FILTER (WHERE p IS NOT NULL))')} - sum(reliability * {_H.format(x='p')}) / sum(reliability) FILTER (WHERE p IS NOT NULL), 0), 0) AS conflict, count(p) AS witnesses FROM (SELECT target, reliability, CASE WHEN p IS NOT NULL THEN greatest(least(p::DOUBLE, 1 - 1e-9), 1e-9) END AS p FROM ({witnesses})) GROUP BY 1)"


_SEG = "(SELECT c_mktsegment AS target, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END) AS x FROM customer GROUP BY 1)"


@query("v08_binary_pool", f"SELECT target, round(belief, 6) AS belief, round(conflict, 6) AS conflict, witnesses FROM {_pool(f'SELECT target, 0.7 AS reliability, x AS p FROM {_SEG} UNION ALL SELECT target, 0.9, 0.25 FROM {_SEG}')}")
def _(table):
    rows = table("customer").groupBy(F.col("c_mktsegment").alias("target")).agg(F.expr("avg(CASE WHEN c_acctbal > 0 THEN 1D ELSE 0D END)").alias("p"))
    return rounded(a.binary_pool(rows.selectExpr("target", "0.7D AS reliability", "p").unionByName(rows.selectExpr("target", "0.9D AS reliability", "0.25D AS p"))))


_EVIDENCE = "SELECT c_nationkey AS target, CASE WHEN c_mktsegment = 'BUILDING' THEN 'seed' ELSE 'generated' END AS tier, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.1 ELSE 0.3 + 0.05 * (c_custkey % 5) END AS reliability FROM customer WHERE c_acctbal < 0"


@query("v05_tier_capped", f"SELECT target, round(seed::DOUBLE, 6) AS seed, round(other::DOUBLE, 6) AS other, round(least(1, seed + other)::DOUBLE, 6) AS score FROM (SELECT target, coalesce(sum(reliability) FILTER (WHERE tier = 'seed'), 0) AS seed, coalesce(max(reliability) FILTER (WHERE tier <> 'seed'), 0) AS other FROM ({_EVIDENCE}) GROUP BY 1)")
def _(table):
    rows = table("customer").where("c_acctbal < 0").selectExpr("cast(c_nationkey AS bigint) AS target", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'seed' ELSE 'generated' END AS tier", "CASE WHEN c_mktsegment = 'BUILDING' THEN 0.1D ELSE 0.3D + 0.05D * (c_custkey % 5) END AS reliability")
    return rounded(a.tier_capped(rows))


# A tenth of the prices is a placeholder; some others carry a stray letter.
_SOILED = f"(SELECT CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN price || 'x' ELSE price END AS price FROM {_RAW})"
_TOKENS = f"SELECT price AS target, count(*) AS n, sum(count(*)) OVER () AS rejected, regexp_matches(price, '^[0-9]') AS looks_typed, price IN ('n/a', '-') AS known FROM {_SOILED} WHERE TRY_CAST(price AS BIGINT) IS NULL GROUP BY 1"


@query("v09_null_tokens", f"WITH t AS ({_TOKENS}) SELECT target, round(belief, 6) AS belief, round(conflict, 6) AS conflict, witnesses, belief > 0.5 AS is_null FROM {_pool('SELECT target, 0.5 AS reliability, 0.5 + 0.5 * n / rejected AS p FROM t UNION ALL SELECT target, 0.6, CASE WHEN looks_typed THEN 0.2 ELSE 0.7 END FROM t UNION ALL SELECT target, 0.9, CASE WHEN known THEN 0.95 ELSE 0.3 END FROM t')}")
def _(table):
    soiled = _raw(table).withColumn("price", F.expr("CASE WHEN cast(id AS bigint) % 7 = 0 THEN concat(price, 'x') ELSE price END"))
    tokens = t.rejected_tokens(soiled, "price", "integer")
    total = tokens.agg(F.sum("n").alias("rejected"))
    rows = tokens.crossJoin(F.broadcast(total)).selectExpr("token AS target", "n", "rejected", "token RLIKE '^[0-9]' AS looks_typed", "token IN ('n/a', '-') AS known")
    return rounded(a.null_tokens(rows))


_MEASURES = f"{_CONV}, y AS (SELECT 'running_price' AS measure, entity, period, sum(price) OVER (PARTITION BY entity ORDER BY period) AS y FROM s UNION ALL SELECT 'yearly_qty', entity, period, qty FROM s), a AS (SELECT * FROM c JOIN y USING (entity, period)), d AS (SELECT *, y - lag(y) OVER (PARTITION BY measure, convention, entity ORDER BY period) AS dy FROM a), f AS (SELECT measure, convention, entity, count(*) AS periods, sum(abs(y)) AS sy, sum(abs(m)) AS sm, sum(abs(y - m)) / nullif(sum(abs(m)), 0) AS r_flow, sum(abs(dy - m)) / nullif(sum(abs(m)) FILTER (WHERE dy IS NOT NULL), 0) AS r_stock FROM d GROUP BY 1, 2, 3), w AS (SELECT *, CASE WHEN periods >= 4 AND sy > 0 AND sm > 0 AND least(r_flow, r_stock) <= 0.5 THEN CASE WHEN r_flow IS NULL OR r_stock < r_flow THEN 'cumulative' ELSE 'per_period' END END AS vote FROM f), q AS (SELECT measure, convention, count(vote) AS voters, count(*) FILTER (WHERE vote = 'per_period') AS flow, count(*) FILTER (WHERE vote = 'cumulative') AS stock, (SELECT count(DISTINCT entity) FROM w) AS n, avg(least(r_flow, r_stock)) FILTER (WHERE vote IS NOT NULL) AS residual FROM w GROUP BY 1, 2), z AS (SELECT *, greatest(flow, stock) AS hits, greatest(flow, stock) / n AS p, 1.96 * 1.96 AS zz, CASE WHEN convention LIKE '% - %' THEN 2 ELSE 1 END AS terms FROM q WHERE voters >= 2 AND greatest(flow, stock) / voters >= 0.8), b AS (SELECT measure, convention, terms, CASE WHEN flow >= stock THEN 'per_period' ELSE 'cumulative' END AS pattern, greatest(0, (p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)) AS lower, residual FROM z)"
_BEST = f"{_MEASURES}, v AS (SELECT measure, convention, terms, pattern, lower FROM b QUALIFY row_number() OVER (PARTITION BY measure ORDER BY lower DESC, terms, residual) = 1)"


def _reconciled(table):
    made = _candidates(table)
    of = lambda name: made.where(F.col("convention") == name)
    running = of("price").select(F.lit("running_price").alias("measure"), "entity", "period", F.sum("m").over(Window.partitionBy("entity").orderBy("period")).alias("y"))
    yearly = of("qty").select(F.lit("yearly_qty").alias("measure"), "entity", "period", F.col("m").alias("y"))
    return l.reconcile_measures(running.unionByName(yearly), made.withColumn("terms", F.when(F.col("convention").contains(" - "), 2).otherwise(1)))


@query("l10_reconcile_measures", f"{_BEST} SELECT measure, convention, terms, pattern, round(lower, 6) AS lower FROM v")
def _(table):
    return rounded(_reconciled(table))


@query("l10_reconcile_facts")
def _(table):
    # Monthly summaries per supplier, one of them running, and the lines that they sum up; years of shipping say nothing.
    line = table("lineitem").withColumns({"month": F.date_trunc("month", "l_shipdate"), "net": F.expr("l_extendedprice * (1 - l_discount)"), "rebate": F.expr("l_extendedprice * l_discount")})
    sums = line.groupBy("l_suppkey", "month").agg(F.sum("l_quantity").alias("moved"), F.sum("net").alias("sold"))
    running = sums.withColumn("total", F.sum("sold").over(Window.partitionBy("l_suppkey").orderBy("month")))
    facts = {
        "summary": l.Fact(running, {("supplier", "seller"): "l_suppkey"}, ["month"], ["moved", "total"]),
        "lines": l.Fact(line, {("supplier", "seller"): "l_suppkey"}, ["l_shipdate"], ["l_quantity", "l_extendedprice", "rebate"]),
    }
    matrix = line.sparkSession.createDataFrame([("summary", "supplier", "seller"), ("lines", "supplier", "seller"), ("lines", "part", "item")], "fact string, dimension string, role string")
    return rounded(l.reconcile_facts(facts, matrix))


@query("v10_stock_or_flow", f"{_BEST}, k(target, claim, confidence) AS (VALUES ('running_price', 'flow', 0.6), ('yearly_qty', 'flow', 0.8), ('unseen', 'stock', 0.4)) SELECT target, round(belief, 6) AS belief, round(conflict, 6) AS conflict, coalesce(CASE pattern WHEN 'per_period' THEN 'flow' WHEN 'cumulative' THEN 'stock' END, claim) AS behaviour, coalesce(CASE pattern WHEN 'per_period' THEN 'flow' WHEN 'cumulative' THEN 'stock' END <> claim, false) AS overruled FROM {_pool(chr(32).join(['SELECT target, 0.6 AS reliability, CASE claim WHEN', chr(39) + 'flow' + chr(39), 'THEN 0.5 + confidence / 2 ELSE 0.5 - confidence / 2 END AS p FROM k UNION ALL SELECT measure, 0.9, CASE pattern WHEN', chr(39) + 'per_period' + chr(39), 'THEN 0.5 + lower / 2 ELSE 0.5 - lower / 2 END FROM v']))} JOIN k USING (target) LEFT JOIN v ON measure = target")
def _(table):
    found = _reconciled(table).select(F.col("measure").alias("target"), "pattern", "lower")
    claims = found.sparkSession.createDataFrame([("running_price", "flow", 0.6), ("yearly_qty", "flow", 0.8), ("unseen", "stock", 0.4)], "target string, claim string, confidence double")
    return rounded(a.stock_or_flow(claims, found))


_RATE = "(SELECT count(*) FILTER (WHERE {t} <> 0 AND abs({t} - ({f})) < 0.01) / count(*) FILTER (WHERE {t} <> 0) FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_discount AS rebate FROM lineitem))"
_FORMULAS = f"SELECT 'net' AS col, 'price less rebate' AS formula, {_RATE.format(t='net', f='l_extendedprice - rebate')} AS rate, 0.8 AS hypothesis, true AS declared UNION ALL SELECT 'net', 'price', {_RATE.format(t='net', f='l_extendedprice')}, NULL, false UNION ALL SELECT 'rebate', 'price', {_RATE.format(t='rebate', f='l_extendedprice')}, 0.4, false"


@query("v11_derived_formulas", f"WITH f AS ({_FORMULAS}), p AS (SELECT * FROM {_pool('SELECT col || chr(9) || formula AS target, 0.9 AS reliability, rate AS p FROM f UNION ALL SELECT col || chr(9) || formula, 0.6, hypothesis FROM f UNION ALL SELECT col || chr(9) || formula, 0.875, CASE WHEN declared THEN 0.95 END FROM f')}) SELECT col AS \"column\", formula, round(belief, 6) AS belief, round(greatest(1 - rate, conflict), 6) AS score FROM f JOIN p ON target = col || chr(9) || formula QUALIFY row_number() OVER (PARTITION BY col ORDER BY belief DESC, formula DESC) = 1")
def _(table):
    from siltstone.operators.crosscol import formula_match

    line = table("lineitem").selectExpr("*", "l_extendedprice * (1 - l_discount) AS net", "l_extendedprice * l_discount AS rebate")
    asked = [("net", "price less rebate", "l_extendedprice - rebate", "0.8D", "true"), ("net", "price", "l_extendedprice", "NULL", "false"), ("rebate", "price", "l_extendedprice", "0.4D", "false")]
    out = None
    for column, name, formula, hypothesis, declared in asked:
        one = formula_match(line, column, formula).selectExpr(f"'{column}' AS column", f"'{name}' AS formula", "rate", f"cast({hypothesis} AS double) AS hypothesis", f"{declared} AS declared")
        out = one if out is None else out.unionByName(one)
    return rounded(a.derived_formulas(out))


_JOINED = f"(SELECT table_a || '.' || column_a || '=' || table_b || '.' || column_b AS target, score, CASE WHEN shared > 5 THEN 0.9 END AS confidence, CASE WHEN split_part(column_a, '_', 2) = split_part(column_b, '_', 2) THEN 0.9 ELSE 0.3 END AS judgement, CASE WHEN table_a = 'nation' AND table_b = 'region' THEN true END AS manual, column_a LIKE '%nationkey' AS kept FROM ({_J5}))"


@query("v12_relationships", f"WITH r AS {_JOINED} SELECT target, round(belief, 6) AS belief, round(conflict, 6) AS conflict, witnesses, belief >= 0.5 AS genuine FROM {_pool('SELECT target, 0.7 AS reliability, 0.5 + (score - 0.5) * confidence AS p FROM r UNION ALL SELECT target, 0.7, judgement FROM r UNION ALL SELECT target, 0.9, CASE WHEN manual THEN 0.98 WHEN NOT manual THEN 0.02 END FROM r UNION ALL SELECT target, 0.5, CASE WHEN kept THEN 0.8 END FROM r')}")
def _(table):
    found = j.find_joins(_keys(table))
    rows = found.selectExpr(
        "concat(table_a, '.', column_a, '=', table_b, '.', column_b) AS target", "score", "CASE WHEN shared > 5 THEN 0.9D END AS confidence", "CASE WHEN split_part(column_a, '_', 2) = split_part(column_b, '_', 2) THEN 0.9D ELSE 0.3D END AS judgement",
        "CASE WHEN table_a = 'nation' AND table_b = 'region' THEN true END AS manual", "column_a LIKE '%nationkey' AS kept",
    )
    return rounded(a.relationships(rows))


_DECLARED = "SELECT c_name AS col, CASE WHEN c_custkey % 2 = 0 THEN 'DATE' ELSE 'VARCHAR' END AS type, CASE c_custkey % 3 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'measure' ELSE 'dimension' END AS role, CASE WHEN c_custkey % 5 = 0 THEN 'EUR' END AS unit, CASE WHEN c_custkey % 5 = 0 THEN 0.75 END AS unit_confidence, CASE WHEN c_custkey % 7 = 0 THEN 'currency' END AS unit_source, CASE WHEN c_custkey % 11 > 0 THEN 0.9 END AS name_confidence FROM customer"


@query("v15_declaration_scores", f"WITH d AS ({_DECLARED}) SELECT col AS \"column\", 'time' AS dimension, CASE WHEN role = 'timestamp' AND type NOT IN ('DATE', 'TIMESTAMP') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM d UNION ALL SELECT col, 'unit', coalesce(1 - unit_confidence, 0) FROM d UNION ALL SELECT col, 'unit_source', CASE WHEN role = 'measure' AND unit IS NULL AND unit_source IS NULL THEN 1.0 ELSE 0.0 END FROM d UNION ALL SELECT col, 'naming', 1 - coalesce(name_confidence, 0) FROM d")
def _(table):
    rows = table("customer").selectExpr(
        "c_name AS column", "CASE WHEN c_custkey % 2 = 0 THEN 'DATE' ELSE 'VARCHAR' END AS type", "CASE c_custkey % 3 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'measure' ELSE 'dimension' END AS role", "CASE WHEN c_custkey % 5 = 0 THEN 'EUR' END AS unit",
        "CASE WHEN c_custkey % 5 = 0 THEN 0.75D END AS unit_confidence", "CASE WHEN c_custkey % 7 = 0 THEN 'currency' END AS unit_source", "CASE WHEN c_custkey % 11 > 0 THEN 0.9D END AS name_confidence",
    )
    return rounded(a.declaration_scores(rows))


# Orders of some segments have no lines on record, and one segment has lines only.
_SERIES = "SELECT c_mktsegment AS entity, date_trunc('month', o_orderdate) AS period, sum(o_totalprice) AS total, count(*) AS rows FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1, 2"
_EVENTS = "SELECT c_mktsegment AS entity, date_trunc('month', o_orderdate) AS period, sum(l_extendedprice) AS event, count(*) AS event_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' AND month(o_orderdate) <> 2 GROUP BY 1, 2"
_CELLS = f"(SELECT entity, period, total, coalesce(event, 0) AS event, rows, coalesce(event_rows, 0) AS event_rows FROM ({_SERIES}) LEFT JOIN ({_EVENTS}) USING (entity, period) WHERE entity IN (SELECT entity FROM ({_EVENTS})))"


def _cells(table):
    orders = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("c_mktsegment <> 'BUILDING' AND month(o_orderdate) <> 2")
    return l.shared_cells(m.slice_series(orders.where("c_mktsegment <> 'MACHINERY'"), "c_mktsegment", "o_orderdate", "o_totalprice"), m.slice_series(lines, "c_mktsegment", "o_orderdate", "l_extendedprice"))


@query("l03_shared_cells", f"SELECT entity, period::TIMESTAMP AS period, round(total, 2) AS total, round(event, 2) AS event, rows, event_rows FROM {_CELLS}")
def _(table):
    return rounded(_cells(table), 2)


@query("l04_direction_gate", f"SELECT CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(event_rows) AS BIGINT) AS event_rows, sum(event_rows) > sum(rows) AS finer FROM {_CELLS}")
def _(table):
    return l.direction_gate(_cells(table))


_CAND = "SELECT l_returnflag AS measure, 'c' || l_linenumber AS convention, CASE WHEN l_linenumber > 4 THEN 2 ELSE 1 END AS terms, CASE WHEN l_linenumber IN (2, 3, 5) THEN 0.8::DOUBLE ELSE 0.5 END AS lower, avg(l_discount) AS residual, count(*) AS n, sum(l_discount * l_discount) * CASE WHEN l_linenumber > 4 AND l_returnflag = 'R' THEN 0.5 ELSE 1 END AS rss FROM lineitem GROUP BY 1, 2, l_linenumber"


@query("l08_best_candidate", f"WITH c AS (SELECT *, n * ln(greatest(rss, 1e-12) / n) + terms * ln(n) AS bic FROM ({_CAND})), t AS (SELECT * FROM c QUALIFY lower = max(lower) OVER (PARTITION BY measure)), o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY measure, terms ORDER BY residual, convention) = 1), x AS (SELECT measure, max(bic) FILTER (WHERE terms = 1) - max(bic) FILTER (WHERE terms = 2) AS worth FROM o GROUP BY 1) SELECT measure, convention, terms, lower, round(residual, 6) AS residual FROM o JOIN x USING (measure) WHERE terms = CASE WHEN worth > 10 THEN 2 ELSE 1 END")
def _(table):
    rows = table("lineitem").groupBy(F.col("l_returnflag").alias("measure"), "l_linenumber").agg(F.avg("l_discount").alias("residual"), F.count("*").alias("n"), F.sum(F.expr("l_discount * l_discount")).alias("ss"))
    rows = rows.selectExpr("measure", "concat('c', l_linenumber) AS convention", "CASE WHEN l_linenumber > 4 THEN 2 ELSE 1 END AS terms", "CASE WHEN l_linenumber IN (2, 3, 5) THEN 0.8D ELSE 0.5D END AS lower", "residual", "n", "ss * CASE WHEN l_linenumber > 4 AND measure = 'R' THEN 0.5D ELSE 1D END AS rss")
    return rounded(l.best_candidate(rows))
