"""Metric, drill and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import metrics as m
from siltstone.plans.base import query, rounded


@query("m01_extract", "SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10")
def _(table):
    return rounded(m.extract(table("lineitem"), "sum(l_extendedprice)", ["l_returnflag = 'R'", "l_quantity > 10"]), 2)


@query("m04_metric", "SELECT *, round(net / nullif(gross, 0) * days, 6) AS intensity, round((gross - net) / nullif(gross, 0), 6) AS margin FROM (SELECT round(sum(l_extendedprice), 2) AS gross, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, 365.0::DOUBLE AS days FROM lineitem)")
def _(table):
    line = table("lineitem")
    out = m.evaluate_metric({"gross": m.extract(line, "round(sum(l_extendedprice), 2)"), "net": m.extract(line, "round(sum(l_extendedprice * (1 - l_discount)), 2)")}, {"days": 365.0}, {"intensity": "net / gross * days", "margin": "(gross - net) / gross"})
    return rounded(out)


@query("m06_support", "SELECT round(avg(l_discount) * 100, 4) AS value, CASE WHEN avg(l_discount) IS NULL THEN 'inconclusive' WHEN avg(l_discount) * 100 BETWEEN 0 AND 365 THEN 'supported' ELSE 'out_of_range' END AS status FROM lineitem")
def _(table):
    return rounded(m.support_check(m.extract(table("lineitem"), "avg(l_discount) * 100"), "value", "0 <= value AND value <= 365"), 4)


@query("m07_range_label", "SELECT round(avg(l_discount), 6) AS value, CASE WHEN avg(l_discount) >= 0 AND avg(l_discount) < 0.04 THEN 'low' WHEN avg(l_discount) < 0.08 THEN 'usual' END AS label FROM lineitem")
def _(table):
    return rounded(m.range_label(m.extract(table("lineitem"), "avg(l_discount)"), "value", [("low", 0, 0.04), ("usual", 0.04, 0.08)]))


@query("m08_scope", "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def _(table):
    return rounded(m.extract(m.scoped(table("orders"), ["o_totalprice > 1000"], "o_orderstatus", "F"), "sum(o_totalprice)"), 2)


@query("m09_additivity", "SELECT r_name AS metric, CASE max(CASE r_regionkey WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END) WHEN 0 THEN 'additive' WHEN 1 THEN 'semi_additive' ELSE 'non_additive' END AS verdict FROM region GROUP BY 1")
def _(table):
    declared = table("region").selectExpr("r_name AS metric", "element_at(array('sum', 'sum', 'avg', 'count', 'count'), r_regionkey + 1) AS aggregate", "element_at(array('flow', 'stock', 'flow', 'flow', 'stock'), r_regionkey + 1) AS behaviour")
    return m.additivity(declared)


@query("m10_drill", "SELECT l_returnflag, count(*) AS rows, round(sum(l_quantity), 2) AS l_quantity FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def _(table):
    return rounded(m.drill(table("lineitem"), ["l_returnflag"], ["l_quantity"], {"l_linestatus": "O"}), 2)


@query("m11_drill_difference", "SELECT l_returnflag, round(sum(l_extendedprice) - sum(l_extendedprice * l_discount), 2) AS value FROM lineitem GROUP BY 1")
def _(table):
    line, dims = table("lineitem"), ["l_returnflag"]
    return rounded(m.drill_difference(m.extract(line, "sum(l_extendedprice)", dims=dims), m.extract(line, "sum(l_extendedprice * l_discount)", dims=dims), dims), 2)


@query("m11_drill_ratio", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice) FILTER (WHERE l_quantity > 49) / sum(l_extendedprice), 6) AS value FROM lineitem GROUP BY 1, 2")
def _(table):
    line, dims = table("lineitem"), ["l_returnflag", "l_linestatus"]
    return rounded(m.drill_ratio(m.extract(line, "sum(l_extendedprice)", ["l_quantity > 49"], dims), m.extract(line, "sum(l_extendedprice)", dims=dims), dims))


@query("m12_month_buckets", "SELECT time_bucket(INTERVAL '5 months', o_orderdate::DATE)::DATE AS bucket, count(*) AS rows FROM orders GROUP BY 1")
def _(table):
    return table("orders").groupBy(F.expr(m.month_bucket("o_orderdate", 5)).alias("bucket")).agg(F.count("*").alias("rows"))


@query("m12_week_buckets", "SELECT time_bucket(INTERVAL '2 weeks', o_orderdate::TIMESTAMP) AS bucket, count(*) AS rows FROM orders GROUP BY 1")
def _(table):
    # Two-week buckets count from Monday, 3 January 2000.
    days = "datediff(o_orderdate, date'2000-01-03')"
    return table("orders").groupBy(F.expr(f"cast(date_add(date'2000-01-03', {days} - pmod({days}, 14)) AS timestamp_ntz)").alias("bucket")).agg(F.count("*").alias("rows"))


@query("m13_grid", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%9%' AND c_acctbal > 0 ORDER BY c_mktsegment DESC, c_custkey LIMIT 21 OFFSET 20")
def _(table):
    return m.grid(table("customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment"), ["c_name ILIKE '%9%'"], [("c_mktsegment", True)], 20, 20)


@query("m14_chart", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median, min(l_quantity) AS min, max(l_quantity) AS max, count(l_quantity) AS count FROM lineitem GROUP BY 1, 2")
def _(table):
    return rounded(m.chart(table("lineitem"), "l_returnflag", "l_quantity", "l_linestatus"), 4)


@query("m15_fingerprint", "SELECT sha256(string_agg(r, chr(10) ORDER BY r)) AS sha256, count(*) AS rows FROM (SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_acctbal': printf('%.' || (11 - floor(log10(abs(c_acctbal)))::INT)::VARCHAR || 'f', c_acctbal), 'c_mktsegment': c_mktsegment})::VARCHAR AS r FROM customer ORDER BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment LIMIT 200)")
def _(table):
    return m.fingerprint(table("customer"))


@query("m16_bounded_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 200")
def _(table):
    return m.bounded_sample(table("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


_SERIES = "SELECT c_mktsegment AS entity, date_trunc('month', o_orderdate) AS period, sum(o_totalprice) AS total, count(*) AS rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
_EVENTS = "SELECT c_mktsegment AS entity, date_trunc('month', o_orderdate) AS period, sum(l_extendedprice) AS event, count(*) AS event_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
_RECON = f"WITH a AS (SELECT entity, period, total, coalesce(event, 0) AS event FROM ({_SERIES}) LEFT JOIN ({_EVENTS}) USING (entity, period)), s AS (SELECT *, total - lag(total) OVER (PARTITION BY entity ORDER BY period) AS change FROM a), r AS (SELECT entity, count(*) AS periods, sum(abs(total - event)) / sum(abs(event)) AS r_flow, sum(abs(change - event)) / sum(CASE WHEN change IS NOT NULL THEN abs(event) END) AS r_stock FROM s GROUP BY 1), v AS (SELECT *, CASE WHEN periods < 4 OR least(r_flow, r_stock) > 0.5 THEN 'abstain' WHEN r_flow <= r_stock THEN 'flow' ELSE 'stock' END AS vote FROM r)"


def _aligned(table):
    orders = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    events = table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return m.align(m.slice_series(orders, "c_mktsegment", "o_orderdate", "o_totalprice"), m.slice_series(events, "c_mktsegment", "o_orderdate", "l_extendedprice"))


@query("l01_slice_series", f"SELECT entity, period::TIMESTAMP AS period, round(total, 2) AS total, rows FROM ({_SERIES})")
def _(table):
    return rounded(m.slice_series(table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", "o_orderdate", "o_totalprice"), 2)


@query("l05_residuals", f"{_RECON} SELECT entity, periods, round(r_flow, 4) AS r_flow, round(r_stock, 4) AS r_stock, vote FROM v")
def _(table):
    return rounded(m.reconcile(_aligned(table)), 4)


@query("l10_reconcile", f"{_RECON}, t AS (SELECT count(*) FILTER (WHERE vote = 'flow') AS flow, count(*) FILTER (WHERE vote = 'stock') AS stock FROM v), w AS (SELECT *, flow + stock AS n, greatest(flow, stock) AS k FROM t) SELECT flow, stock, round(CASE WHEN n > 0 THEN (k / n + 1.9208 / n - 1.96 * sqrt((k / n * (1 - k / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n) END, 6) AS support, CASE WHEN n < 2 THEN 'abstain' WHEN flow >= 0.8 * n THEN 'flow' WHEN stock >= 0.8 * n THEN 'stock' ELSE 'undecided' END AS verdict FROM w")
def _(table):
    return rounded(m.reconcile_verdict(m.reconcile(_aligned(table))))


_NET = "sum(l_extendedprice * (1 - l_discount))"
#: Metrics over the shipped tables: what each needs, how it is computed, and where its value is usual.
LIBRARY = {
    "net_margin": {"steps": {"gross": ("lineitem", "sum(l_extendedprice)"), "net": ("lineitem", _NET)}, "formula": "net / gross", "range": (0.8, 1.0)},
    "effective_tax": {"steps": {"net": ("lineitem", _NET), "taxed": ("lineitem", "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))")}, "formula": "(taxed - net) / net", "range": (0, 0.1)},
    "return_rate": {"steps": {"returned": ("lineitem", "count_if(l_returnflag = 'R')"), "lines": ("lineitem", "count(*)")}, "formula": "returned / lines", "range": (0, 0.1)},
    "lines_per_order": {"steps": {"lines": ("lineitem", "count(*)"), "orders": ("orders", "count(*)")}, "formula": "lines / orders", "range": (1, 10)},
    "orders_per_customer": {"steps": {"orders": ("orders", "count(*)"), "customers": ("customer", "count(*)")}, "formula": "orders / customers", "range": (1, 50)},
    "debtor_share": {"steps": {"owing": ("customer", "count_if(c_acctbal < 0)"), "customers": ("customer", "count(*)")}, "formula": "owing / customers", "range": (0, 0.05)},
    "price_to_balance": {"steps": {"sold": ("orders", "sum(o_totalprice)"), "owed": ("supplier", "sum(s_acctbal)")}, "formula": "sold / -owed", "range": (0, 1000000)},
    "none_left": {"steps": {"sold": ("orders", "sum(o_totalprice)"), "none": ("orders", "sum(0)")}, "formula": "sold / (none * (2 + none))", "range": (0, 1)},
}


def _metric_sql(name, spec):
    steps = ", ".join(f"(SELECT {x.replace('count_if', 'countif')} AS {step} FROM {t})" for step, (t, x) in spec["steps"].items())
    top, _, bottom = spec["formula"].partition(" / ")
    lo, hi = spec["range"]
    value = f"({top}) / nullif({bottom}, 0)"
    return f"SELECT '{name}' AS metric, round({value}, 6) AS value, CASE WHEN {value} IS NULL THEN 'inconclusive' WHEN {value} BETWEEN {lo} AND {hi} THEN 'supported' ELSE 'out_of_range' END AS status FROM {steps}"


@query("m05_metric_library", " UNION ALL ".join(_metric_sql(n, s) for n, s in LIBRARY.items()))
def _(table):
    return rounded(m.metric_library({t: table(t) for t in ("lineitem", "orders", "customer", "supplier")}, LIBRARY))


@query("m19_must_reconcile", "SELECT c AS concept, healthy, coalesce(lineage, 0) AS lineage FROM (SELECT p_brand AS c, count(DISTINCT p_type) AS healthy FROM (SELECT p_brand, p_type FROM part GROUP BY 1, 2 HAVING avg(p_size) > 20) GROUP BY 1 HAVING count(DISTINCT p_type) >= 2) LEFT JOIN (SELECT p_brand AS c, count(*) AS lineage FROM part WHERE p_size > 45 GROUP BY 1) USING (c)")
def _(table):
    made = table("part").groupBy(F.col("p_brand").alias("concept"), F.col("p_type").alias("computation")).agg(F.expr("CASE WHEN avg(p_size) > 20 THEN 'healthy' ELSE 'doubtful' END").alias("health"))
    return m.must_reconcile(made, table("part").where("p_size > 45").select(F.col("p_brand").alias("concept")))


@query("m09_formula_additivity", "SELECT p_brand AS formula, CASE max(l) WHEN 0 THEN 'additive' WHEN 1 THEN 'semi_additive' ELSE 'non_additive' END AS verdict, CASE max(l) WHEN 0 THEN 'all' WHEN 1 THEN 'all but time' ELSE 'none' END AS axes FROM (SELECT p_brand, CASE WHEN p_size > 48 THEN 2 WHEN p_type LIKE '%ECONOMY%' THEN 1 ELSE 0 END AS l FROM part) GROUP BY 1")
def _(table):
    parts = table("part").selectExpr("p_brand AS formula", "p_type AS metric", "CASE WHEN p_size > 48 THEN '/' ELSE '+' END AS operation")
    declared = table("part").selectExpr("p_type AS metric", "'sum' AS aggregate", "CASE WHEN p_type LIKE '%ECONOMY%' THEN 'stock' ELSE 'flow' END AS behaviour").distinct()
    return m.formula_additivity(declared, parts)


_BUCKETS = [(7, "second", "2000-01-01"), (15, "minute", "2000-01-01"), (7, "minute", "2000-01-01"), (6, "hour", "2000-01-01"), (10, "day", "2000-01-01"), (3, "week", "2000-01-03"), (2, "quarter", "2000-01-01"), (2, "year", "2000-01-01")]


@query("m12_buckets", " UNION ALL ".join(f"SELECT '{n} {u}' AS size, time_bucket(INTERVAL '{n * (3 if u == 'quarter' else 1)} {'months' if u == 'quarter' else u + 's'}', ts::TIMESTAMP, TIMESTAMP '{o} 00:00:00')::TIMESTAMP AS bucket, count(*) AS rows FROM events GROUP BY 2" for n, u, o in _BUCKETS))
def _(table):
    out = None
    for n, unit, _ in _BUCKETS:
        one = table("events").groupBy(F.expr(f"cast({m.bucket_start('ts', n, unit)} AS timestamp_ntz)").alias("bucket")).agg(F.count("*").alias("rows")).select(F.lit(f"{n} {unit}").alias("size"), "bucket", "rows")
        out = one if out is None else out.unionByName(one)
    return out


# A ledger made of the tables: what each row of a table posts to which concept.  Stocks are balances at the date of the last order of a customer's or supplier's rows.
_POSTED = {
    "lineitem": [("revenue", "l_extendedprice * (1 - l_discount)"), ("tax", "l_extendedprice * (1 - l_discount) * l_tax * 0.1"), ("operating_expense", "l_quantity * 20")],
    "costs": [("cost_of_goods_sold", "l_quantity * p_retailprice * 0.6"), ("depreciation", "p_size * 1.0")],
    "customer": [("accounts_receivable", "greatest(c_acctbal, 0)"), ("current_assets", "greatest(c_acctbal, 0) * 2")],
    "supplier": [("accounts_payable", "greatest(s_acctbal, 0)"), ("current_liabilities", "greatest(s_acctbal, 0) * 1.5")],
    "part": [("inventory", "p_retailprice * p_size")],
}
_FROM = {"lineitem": ("lineitem", "l_shipdate", "l_suppkey", "flow"), "costs": ("lineitem JOIN part ON l_partkey = p_partkey", "l_shipdate", "l_suppkey", "flow"), "customer": ("customer JOIN orders ON c_custkey = o_custkey", "o_orderdate", "c_custkey", "stock"), "supplier": ("supplier JOIN lineitem ON s_suppkey = l_suppkey", "l_shipdate", "s_suppkey", "stock"), "part": ("part JOIN lineitem ON p_partkey = l_partkey", "l_shipdate", "p_partkey", "stock")}
_LEDGER = " UNION ALL ".join(f"SELECT '{c}' AS concept, CAST({x} AS DOUBLE) AS amount, '{_FROM[k][3]}' AS behaviour, {_FROM[k][1]} AS ts, {_FROM[k][2]} AS account FROM {_FROM[k][0]}" for k, posted in _POSTED.items() for c, x in posted)


def _finance_sql():
    from siltstone.operators.finance import CONCEPTS, METRICS

    steps, last = [], "w0"
    for i, (name, _, formula, _, _) in enumerate(METRICS):
        if formula != name:
            for part in ("revenue", "cost_of_goods_sold", "current_liabilities"):
                formula = formula.replace(f"/ {part}", f"/ nullif({part}, 0)")
            steps.append(f"w{i + 1} AS (SELECT *, {formula} AS {name} FROM {last})")
            last = f"w{i + 1}"
    rows = []
    for name, unit, _, usual, labels in METRICS:
        check = "true" if usual is None else f"{name} BETWEEN {usual[0]} AND {usual[1]}"
        label = "CASE " + " ".join(f"WHEN {name} >= {least} THEN '{text}'" for least, text in reversed(labels)) + " END"
        rows.append(f"SELECT '{name}' AS metric, round({name}, 4)::DOUBLE AS value, '{unit}' AS unit, CASE WHEN {name} IS NULL THEN 'inconclusive' WHEN {check} THEN 'supported' ELSE 'out_of_range' END AS status, {label} AS label FROM {last}")
    concepts = ", ".join(f"max(value) FILTER (WHERE concept = '{c}') AS {c}" for c in CONCEPTS)
    days = "max((epoch(hi) - epoch(lo)) / 86400.0 * n / (n - 1)) FILTER (WHERE concept = 'revenue')"
    return f"""WITH l AS ({_LEDGER}), m AS (SELECT concept, behaviour, date_trunc('month', ts) AS month, sum(amount) AS amount, min(ts) AS lo, max(ts) AS hi FROM l GROUP BY 1, 2, 3),
v AS (SELECT concept, CASE WHEN max(behaviour) = 'stock' THEN arg_max(amount, month) ELSE sum(amount) END AS value, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM m GROUP BY 1),
w0 AS (SELECT {concepts}, {days} AS days_in_period, (SELECT count(*)::DOUBLE FROM l WHERE behaviour = 'flow') AS transaction_count, (SELECT count(DISTINCT account)::DOUBLE FROM l WHERE behaviour = 'flow') AS active_accounts, (SELECT avg(amount) FROM l WHERE behaviour = 'flow') AS average_transaction_value FROM v), {', '.join(steps)} {' UNION ALL '.join(rows)}"""


@query("m05_finance_metrics", _finance_sql())
def _(table):
    from siltstone.operators.finance import finance_metrics

    line, part = table("lineitem"), table("part")
    frames = {
        "lineitem": line, "costs": line.join(part, F.col("l_partkey") == F.col("p_partkey")), "customer": table("customer").join(table("orders"), F.col("c_custkey") == F.col("o_custkey")),
        "supplier": table("supplier").join(line, F.col("s_suppkey") == F.col("l_suppkey")), "part": part.join(line, F.col("p_partkey") == F.col("l_partkey")),
    }
    ledger = None
    for k, posted in _POSTED.items():
        _, ts, account, behaviour = _FROM[k]
        rows = ", ".join(f"'{c}', CAST({x} AS DOUBLE)" for c, x in posted)
        one = frames[k].selectExpr(f"stack({len(posted)}, {rows}) AS (concept, amount)", f"'{behaviour}' AS behaviour", f"{ts} AS ts", f"{account} AS account")
        ledger = one if ledger is None else ledger.unionByName(one)
    return finance_metrics(ledger).withColumn("value", F.round("value", 4))
