"""Profiling and temporal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import profile as p
from siltstone.operators import temporal as t
from siltstone.plans.base import query, rounded

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXT = ["l_returnflag", "l_linestatus"]


def _union(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


_BASIC = _union("SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, round((count(*) - count({c})) / count(*), 6) AS null_ratio, round(count(DISTINCT {c}) / count({c}), 6) AS cardinality_ratio, count(DISTINCT {c}) = count({c}) AS is_unique FROM customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query("p01_basic_counts", _BASIC)
def _(table):
    return rounded(p.basic_counts(table("customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))


# Sums of doubles hang on the order of the rows, and a mean may lie on a tie of its sixth digit: sums of decimals, and four digits.
_MEAN = "CAST(sum(CAST({c} AS DECIMAL(18, 9))) AS DOUBLE) / count({c})"
_MOMENTS = f"round(min({{c}}), 6) AS min, round(max({{c}}), 6) AS max, round({_MEAN}, 4) AS mean,"
_MOMENTS += " round(stddev_samp({c}), 6) AS stddev, round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS kurtosis"
_PERCENTILES = ", ".join(f"round(quantile_cont({{c}}, {q}), 6) AS {n}" for n, q in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99)))


@query("p02_moments", _union(f"SELECT '{{c}}' AS \"column\", {_MOMENTS}, round(stddev_samp({{c}}) / abs({_MEAN}), 6) AS cv FROM lineitem", NUM))
def _(table):
    out = rounded(p.numeric_moments(table("lineitem"), NUM).withColumn("mean", F.round("mean", 4)))
    return out.withColumns({c: F.round(c, 5) for c in ("skewness", "kurtosis")})


@query("p03_percentiles", _union(f"SELECT '{{c}}' AS \"column\", {_PERCENTILES} FROM lineitem", NUM))
def _(table):
    return rounded(p.percentiles(table("lineitem"), NUM))


_MAD = "WITH m AS (SELECT median({c}) AS m FROM lineitem), d AS (SELECT abs({c} - m) AS d, m FROM lineitem, m) SELECT '{c}' AS \"column\", round(median(d), 6) AS mad, round(median(d) / abs(any_value(m)), 6) AS robust_cv FROM d"


@query("p04_mad", " UNION ALL ".join(f"SELECT * FROM ({_MAD.replace('{c}', c)})" for c in NUM))
def _(table):
    return rounded(p.robust_spread(table("lineitem"), NUM))


@query("p05_text_lengths", _union("SELECT '{c}' AS \"column\", min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length FROM part", ["p_name", "p_brand", "p_type"]))
def _(table):
    return rounded(p.text_lengths(table("part"), ["p_name", "p_brand", "p_type"]))


_TOP = "SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c} AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 10"


@query("p06_top_values", " UNION ALL ".join(f"SELECT * FROM ({_TOP.replace('{c}', c)})" for c in ("p_brand", "p_type")))
def _(table):
    return rounded(p.top_values(table("part"), ["p_brand", "p_type"], 10))


_HIST = "SELECT '{c}' AS \"column\", bin, round(lo + (bin - 1) * width, 4) AS bucket_min, round(lo + bin * width, 4) AS bucket_max, count(*) AS n FROM (SELECT greatest(1, least(20, CAST(floor(({c} - lo) / width) AS INT) + 1)) AS bin, lo, width FROM lineitem, (SELECT min({c}) AS lo, (max({c}) - min({c})) / 20 AS width FROM lineitem)) GROUP BY bin, lo, width"


@query("p07_histogram", " UNION ALL ".join(_HIST.replace("{c}", c) for c in ("l_quantity", "l_extendedprice")))
def _(table):
    return rounded(p.histogram(table("lineitem"), ["l_quantity", "l_extendedprice"]), 4)


@query("p08_profile", _union(f"SELECT '{{c}}' AS \"column\", count(*) AS total, count(*) - count({{c}}) AS nulls, count(DISTINCT {{c}}) AS distinct_values, {_MOMENTS}, {_PERCENTILES} FROM lineitem", NUM))
def _(table):
    out = rounded(p.profile(table("lineitem"), NUM).withColumn("mean", F.round("mean", 4)))
    return out.withColumns({c: F.round(c, 5) for c in ("skewness", "kurtosis")})


def _full_sql(c, numeric):
    moments = f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(favg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, round(median({c}), 4) AS p50, (SELECT round(median(abs(y.{c} - m)), 4) FROM lineitem y, (SELECT median({c}) AS m FROM lineitem)) AS mad"
    if not numeric:
        moments = "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS stddev, NULL::DOUBLE AS p50, NULL::DOUBLE AS mad"
    return f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, min(length({c}::VARCHAR)) AS min_length, max(length({c}::VARCHAR)) AS max_length, round(avg(length({c}::VARCHAR)), 6) AS avg_length, (SELECT {c}::VARCHAR FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1) AS top_value, (SELECT count(*) FROM lineitem GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS top_count, {moments} FROM lineitem"


_FULL = {"l_returnflag": False, "l_linestatus": False, "l_linenumber": True, "l_quantity": True, "l_discount": True}


@query("p08_full_profile", " UNION ALL ".join(f"({_full_sql(c, n)})" for c, n in _FULL.items()))
def _(table):
    out = rounded(p.full_profile(table("lineitem"), list(_FULL), [c for c, n in _FULL.items() if n]))
    return out.select("column", "total", "nulls", "distinct_values", "min_length", "max_length", "avg_length", "top_value", "top_count", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "p50", "mad")])


_LISTED = "SELECT '{c}' AS \"column\", (SELECT string_agg(v || ':' || n, ',' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) AS top, {h} AS histogram"
_BINS = "(SELECT string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY b) FROM range(1, 6) r(b) LEFT JOIN (SELECT greatest(1, least(5, CAST(floor(({c} - lo) / ((hi - lo) / 5)) AS INT) + 1)) AS bin, count(*) AS n FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1) ON bin = b)"


@query("p08_lists", " UNION ALL ".join(_LISTED.format(c=c, h=_BINS.format(c=c) if n else "NULL") for c, n in _FULL.items()))
def _(table):
    out = p.full_profile(table("lineitem"), list(_FULL), [c for c, n in _FULL.items() if n], k=3, bins=5)
    return out.select("column", F.array_join(F.transform("top_values", lambda x: F.concat_ws(":", x["value"], x["n"])), ",").alias("top"), F.array_join(F.transform("histogram", lambda x: x["n"].cast("string")), ",").alias("histogram"))


_BENFORD = """WITH v AS (SELECT abs({c}) AS a FROM {t} WHERE {c} <> 0), d AS (SELECT CAST(floor(a / pow(10, floor(log10(a) + 1e-12))) AS INT) AS digit, count(*) AS n, min(a) AS lo, max(a) AS hi FROM v GROUP BY 1),
s AS (SELECT sum(n) AS total, min(lo) AS lo, max(hi) AS hi FROM d), x AS (SELECT total, s.lo, s.hi, sum(pow(coalesce(n, 0) - total * log10(1 + 1.0 / k), 2) / (total * log10(1 + 1.0 / k))) AS chi2 FROM s, range(1, 10) r(k) LEFT JOIN d ON d.digit = k GROUP BY ALL)
SELECT '{c}' AS "column", CAST(total AS BIGINT) AS n_values, round(chi2, 4) AS chi2, CASE WHEN total < 100 OR hi < 10 * lo THEN 'not_applicable' WHEN exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6) >= 0.05 THEN 'compliant' ELSE 'violating' END AS verdict FROM x"""


@query("p09_benford", _BENFORD.replace("{c}", "o_totalprice").replace("{t}", "orders"))
def _(table):
    return rounded(p.benford(table("orders"), ["o_totalprice"]), 4)


_IQR = "WITH q AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) SELECT '{c}' AS \"column\", round(any_value(a - 1.5 * (b - a)), 4) AS lo, round(any_value(b + 1.5 * (b - a)), 4) AS hi, count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers, round(count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count(*), 4) AS ratio FROM lineitem, q WHERE {c} IS NOT NULL"


@query("p10_iqr_outliers", " UNION ALL ".join(f"SELECT * FROM ({_IQR.replace('{c}', c)})" for c in ("l_extendedprice", "l_quantity")))
def _(table):
    return rounded(p.iqr_outliers(table("lineitem"), ["l_extendedprice", "l_quantity"]), 4)


_MADOUT = "WITH m AS (SELECT median({c}) AS m FROM lineitem), d AS (SELECT median(abs({c} - m)) AS mad, any_value(m) AS m FROM lineitem, m) SELECT '{c}' AS \"column\", count(*) FILTER (WHERE mad > 0 AND abs(0.6745 * ({c} - m) / mad) > 3.5) AS outliers, round(count(*) FILTER (WHERE mad > 0 AND abs(0.6745 * ({c} - m) / mad) > 3.5) / count(*), 6) AS ratio FROM lineitem, d WHERE {c} IS NOT NULL"


@query("p11_mad_outliers", " UNION ALL ".join(f"SELECT * FROM ({_MADOUT.replace('{c}', c)})" for c in ("l_extendedprice", "l_quantity")))
def _(table):
    return rounded(p.mad_outliers(table("lineitem"), ["l_extendedprice", "l_quantity"]))


@query("p12_farthest", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, round(abs(o_totalprice - (SELECT median(o_totalprice) FROM orders)), 4) AS distance FROM orders ORDER BY abs(o_totalprice - (SELECT median(o_totalprice) FROM orders)) DESC, o_orderkey LIMIT 200")
def _(table):
    return rounded(p.farthest(table("orders"), "o_totalprice", ["o_orderkey"]), 4)


@query("p13_quality_issues", "SELECT * FROM (SELECT \"column\", ratio, CASE WHEN ratio >= 0.1 THEN 'critical' WHEN ratio > 0.05 THEN 'warning' END AS severity FROM (SELECT 'value' AS \"column\", round(count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*), 6) AS ratio FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) WHERE value IS NOT NULL)) WHERE severity IS NOT NULL")
def _(table):
    return rounded(p.quality_issues(p.iqr_outliers(table("events"), ["value"])))


@query("p14_eligibility", f"SELECT \"column\", CASE WHEN nulls = total THEN 'INELIGIBLE' WHEN distinct_values = 1 OR null_ratio > 0.95 OR cardinality_ratio < 0.0001 THEN 'WARN' ELSE 'ELIGIBLE' END AS status, CASE WHEN nulls = total THEN 'all_null' WHEN distinct_values = 1 THEN 'single_value' WHEN null_ratio > 0.95 THEN 'high_null' WHEN cardinality_ratio < 0.0001 THEN 'near_constant' ELSE 'ok' END AS reason FROM ({_BASIC})")
def _(table):
    return p.eligibility(p.basic_counts(table("customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))


@query("p15_column_quarantine", "SELECT c_custkey, 'c_mktsegment' AS \"column\", c_mktsegment AS value, 'near_constant' AS reason FROM customer")
def _(table):
    return p.drop_ineligible(table("customer"), "c_custkey", {"c_mktsegment": "near_constant"})[1]


@query("p16_value_search", "SELECT * FROM (SELECT 'p_type' AS \"column\", p_type AS value, count(*) AS count FROM part WHERE lower(p_type) LIKE '%e%' GROUP BY 2 UNION ALL SELECT 'p_name', p_name, count(*) FROM part WHERE lower(p_name) LIKE '%e%' GROUP BY 2) ORDER BY count DESC, 1, 2 LIMIT 20")
def _(table):
    return p.value_search(table("part"), ["p_type", "p_name"], "E")


@query("p17_signs", _union("SELECT '{c}' AS \"column\", CASE WHEN min({c}) IS NULL THEN 'empty' WHEN max({c}) < 0 THEN 'all_negative' WHEN min({c}) >= 0 THEN 'none_negative' ELSE 'mixed' END AS signs FROM customer", ["c_acctbal", "c_nationkey"]))
def _(table):
    return p.sign_summary(table("customer"), ["c_acctbal", "c_nationkey"])


@query("x01_bounds", "SELECT min(o_orderdate)::TIMESTAMP AS first_ts, max(o_orderdate)::TIMESTAMP AS last_ts, count(DISTINCT o_orderdate) AS distinct_ts, date_diff('day', min(o_orderdate), max(o_orderdate)) AS span_days FROM orders")
def _(table):
    return rounded(t.bounds(table("orders"), "o_orderdate"))


_GAPS = "g AS (SELECT ts, next_ts, (epoch_us(next_ts) - epoch_us(ts)) / 1e6 AS gap_s FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS next_ts FROM (SELECT DISTINCT {c} AS ts FROM {t} WHERE {c} IS NOT NULL)) WHERE next_ts IS NOT NULL)"
_OGAPS, _EGAPS = _GAPS.replace("{c}", "o_orderdate").replace("{t}", "orders"), _GAPS.replace("{c}", "ts").replace("{t}", "events")


@query("x02_gap_statistics", f"WITH {_EGAPS} SELECT round(median(gap_s), 6) AS median_gap, round(min(gap_s), 6) AS min_gap, round(max(gap_s), 6) AS max_gap, count(*) AS n_gaps FROM g")
def _(table):
    return rounded(t.gap_statistics(table("events"), "ts"))


@query("x03_granularity", f"WITH {_OGAPS} SELECT median(gap_s) AS median_gap, CASE WHEN abs(median(gap_s) - 86400) <= 3600 THEN 'day' ELSE 'irregular' END AS grain FROM g")
def _(table):
    return t.granularity(table("orders"), "o_orderdate").select("median_gap", "grain")


@query("x04_completeness", "SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS present, date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 AS expected, round(count(DISTINCT date_trunc('month', o_orderdate)) / (date_diff('month', min(o_orderdate), max(o_orderdate)) + 1), 6) AS completeness FROM orders")
def _(table):
    return rounded(t.completeness(table("orders"), "o_orderdate", "month"))


@query("x05_significant_gaps", f"WITH {_EGAPS}, m AS (SELECT median(gap_s) AS mid FROM g) SELECT ts, next_ts, round(gap_s, 2) AS gap_s, CAST(floor(gap_s / mid) - 1 AS BIGINT) AS missing, CASE WHEN gap_s > 10 * mid THEN 'severe' WHEN gap_s > 5 * mid THEN 'moderate' ELSE 'minor' END AS severity FROM g, m WHERE gap_s > 2 * mid ")
def _(table):
    return rounded(t.significant_gaps(table("events"), "ts"), 2)


@query("x06_last_period_fill", "WITH p AS (SELECT date_trunc('month', o_orderdate) AS period, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT max(period) AS last FROM p) SELECT any_value(n) FILTER (WHERE period = last) AS last_rows, median(n) FILTER (WHERE period < last) AS typical, round(any_value(n) FILTER (WHERE period = last) / median(n) FILTER (WHERE period < last), 6) AS fill, any_value(n) FILTER (WHERE period = last) >= median(n) FILTER (WHERE period < last) AS is_full FROM p, l")
def _(table):
    return rounded(t.last_period_fill(table("orders"), "o_orderdate"))


@query("x07_staleness", f"WITH {_OGAPS} SELECT CAST(epoch(TIMESTAMP '2000-01-01') - epoch((SELECT max(o_orderdate) FROM orders)) AS DOUBLE) AS age_s, median(gap_s) AS median_gap, epoch(TIMESTAMP '2000-01-01') - epoch((SELECT max(o_orderdate) FROM orders)) > 2 * median(gap_s) AS stale FROM g")
def _(table):
    return t.staleness(table("orders"), "o_orderdate", "2000-01-01 00:00:00")


@query("x09_flow_window", "SELECT date_diff('day', min(o_orderdate), max(o_orderdate)) AS span, count(DISTINCT o_orderdate::DATE) AS n, round(date_diff('day', min(o_orderdate), max(o_orderdate)) * count(DISTINCT o_orderdate::DATE) / (count(DISTINCT o_orderdate::DATE) - 1.0), 6) AS window_days FROM orders WHERE o_orderstatus = 'F'")
def _(table):
    return rounded(t.flow_window(table("orders"), "o_orderdate", "o_orderstatus = 'F'"))


_FLOWS = [("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'", "same"), ("o_orderkey % 2 = 0", "o_orderkey % 2 = 0", "agree"), ("o_orderkey < 0", "o_orderkey > 0", "empty"), ("o_orderkey = 1", "o_orderkey > 0", "single")]
_WINDOW = "(SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS n, epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS s FROM orders WHERE {c})"
_DAYS = "CASE WHEN {x}.n > 1 AND {x}.s > 0 THEN {x}.s / 86400.0 * {x}.n / ({x}.n - 1) END"
_RESOLVED = "SELECT '{k}' AS \"case\", round(CASE WHEN reason IS NULL THEN d ELSE 30 END, 6)::DOUBLE AS days, reason IS NULL AS derived, reason, 2 AS flows FROM (SELECT {d} AS d, CASE WHEN least(a.n, b.n) = 0 THEN 'a flow has no rows' WHEN {d} IS NULL OR {e} IS NULL THEN 'a flow spans a single period' WHEN round({d}, 3) <> round({e}, 3) THEN 'flows disagree' END AS reason FROM {a} a, {b} b)"


@query("x09_reconciled_window", " UNION ALL ".join(_RESOLVED.format(k=k, a=_WINDOW.format(c=a), b=_WINDOW.format(c=b), d=_DAYS.format(x="a"), e=_DAYS.format(x="b")) for a, b, k in _FLOWS))
def _(table):
    out = None
    for a, b, name in _FLOWS:
        one = t.reconciled_window([(table("orders"), "o_orderdate", a), (table("orders"), "o_orderdate", b)], 30, "month").select(F.lit(name).alias("case"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("x08_profile_temporal", "WITH d AS (SELECT DISTINCT l_shipdate AS t FROM lineitem WHERE l_shipdate IS NOT NULL), n AS (SELECT epoch(lead(t) OVER (ORDER BY t)) - epoch(t) AS gap FROM d) SELECT 'l_shipdate' AS \"column\", min(t)::TIMESTAMP AS first_ts, max(t)::TIMESTAMP AS last_ts, count(*) AS distinct_ts, date_diff('day', min(t), max(t)) AS span_days, (SELECT median(gap) FROM n) AS median_gap, (SELECT CASE WHEN abs(median(gap) - 86400) <= 3600 THEN 'day' ELSE 'irregular' END FROM n) AS grain FROM d")
def _(table):
    from siltstone.operators.temporal import profile_temporal

    return rounded(profile_temporal(table("lineitem")).withColumn("first_ts", F.col("first_ts").cast("timestamp")).withColumn("last_ts", F.col("last_ts").cast("timestamp")))


@query("x03_grain_confidence", f"WITH {_EGAPS}, m AS (SELECT median(gap_s) AS mid, min(gap_s) AS lo, max(gap_s) AS hi FROM g), w AS (SELECT mid, lo, hi, CASE WHEN abs(mid - 1) <= 0.5 THEN 'second' WHEN abs(mid - 60) <= 5 THEN 'minute' WHEN abs(mid - 3600) <= 300 THEN 'hour' WHEN abs(mid - 86400) <= 3600 THEN 'day' ELSE 'irregular' END AS grain FROM m) SELECT grain, round(CASE WHEN grain = 'irregular' THEN 0.3 ELSE 1 - least((hi - lo) / mid / 10, 0.5) END::DOUBLE, 6) AS confidence FROM w")
def _(table):
    return rounded(t.granularity(table("events"), "ts").select("grain", "confidence"))


@query("x04_weeks_and_quarters", "SELECT 'week' AS grain, count(DISTINCT date_trunc('week', o_orderdate)) AS present, CAST(date_diff('day', date_trunc('week', min(o_orderdate)), date_trunc('week', max(o_orderdate))) / 7 AS BIGINT) + 1 AS expected FROM orders UNION ALL SELECT 'quarter', count(DISTINCT date_trunc('quarter', o_orderdate)), date_diff('quarter', min(o_orderdate), max(o_orderdate)) + 1 FROM orders UNION ALL SELECT 'hour', count(DISTINCT date_trunc('hour', o_orderdate)), date_diff('hour', min(o_orderdate), max(o_orderdate)) + 1 FROM orders")
def _(table):
    parts = [t.completeness(table("orders"), "o_orderdate", grain).selectExpr(f"'{grain}' AS grain", "present", "expected") for grain in ("week", "quarter", "hour")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TAIL = "exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6)"
_BENFORD_P = _BENFORD.replace("round(chi2, 4) AS chi2", "chi2")


@query("p13_all_issues", " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", 'outliers' AS issue, round(count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count(*), 6) AS value, CASE WHEN count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count(*) >= 0.1 THEN 'critical' ELSE 'warning' END AS severity FROM orders, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM orders)) WHERE value > 0.05 UNION ALL SELECT \"column\", 'benford', round({_TAIL}, 6), 'warning' FROM ({_BENFORD_P.replace('{c}', c).replace('{t}', 'orders')}) WHERE verdict = 'violating'" for c in ("o_totalprice", "o_custkey")))
def _(table):
    return rounded(p.all_issues(table("orders"), ["o_totalprice", "o_custkey"]))


_AS_OF = "2030-01-01 00:00:00"
_TEMPORAL = """SELECT '{c}' AS "column", count(*) AS distinct_ts, min(t)::TIMESTAMP AS first_ts, max(t)::TIMESTAMP AS last_ts, any_value(mid) AS median_gap, CASE WHEN abs(any_value(mid) - 86400) <= 3600 THEN 'day' ELSE 'irregular' END AS grain,
CASE WHEN abs(any_value(mid) - 86400) <= 3600 THEN count(*) END AS present, CASE WHEN abs(any_value(mid) - 86400) <= 3600 THEN date_diff('day', min(t), max(t)) + 1 END AS expected, count(*) FILTER (WHERE gap > 2 * mid) AS n_gaps_over,
round(max(gap) FILTER (WHERE gap > 2 * mid) / 86400, 6) AS largest_gap_days, least(100, count(*) FILTER (WHERE gap > 2 * mid)) AS listed, epoch(TIMESTAMP '{as_of}') - epoch(max(t)) AS age_s, epoch(TIMESTAMP '{as_of}') - epoch(max(t)) > 2 * any_value(mid) AS stale
FROM (SELECT *, median(gap) OVER () AS mid FROM (SELECT t, epoch(lead(t) OVER (ORDER BY t)) - epoch(t) AS gap FROM (SELECT DISTINCT {c} AS t FROM {table} WHERE {c} IS NOT NULL)))"""


@query("x08_full_temporal", " UNION ALL ".join(_TEMPORAL.format(c=c, table=x, as_of=_AS_OF) for c, x in (("o_orderdate", "orders"), ("ts", "events"))))
def _(table):
    one = lambda x: t.full_temporal_profile(table(x), _AS_OF)
    out = one("orders").unionByName(one("events"))
    largest, listed = F.expr("round(largest_gap_days * 1e6D) / 1e6D").alias("largest_gap_days"), F.size("gaps").cast("long").alias("listed")
    return out.select("column", "distinct_ts", "first_ts", "last_ts", "median_gap", "grain", "present", "expected", "n_gaps_over", largest, listed, "age_s", "stale")
