"""Typing queries over text made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import typing as t
from siltstone.plans.base import query, rounded

_RAW = "(SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || CASE WHEN o_orderkey % 4 = 0 THEN ' USD' ELSE ' EUR' END AS money FROM orders)"


def _raw(table):
    whole = "cast(cast(floor(o_totalprice) AS bigint) AS string)"
    return table("orders").selectExpr("cast(o_orderkey AS string) AS id", "CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS day", f"CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE {whole} END AS price", f"concat({whole}, CASE WHEN o_orderkey % 4 = 0 THEN ' USD' ELSE ' EUR' END) AS money")


_DISTINCT = f"SELECT DISTINCT day AS v FROM {_RAW}"


@query("t01_pattern_rates", " UNION ALL ".join(f"SELECT '{n}' AS pattern, round(avg(CASE WHEN regexp_matches(v, '{p}') THEN 1.0 ELSE 0 END), 6) AS rate FROM ({_DISTINCT})" for n, p, _, _ in t.PATTERNS))
def _(table):
    return rounded(t.pattern_match_rates(_raw(table), "day"))


_WHOLE = "(avg(CASE WHEN regexp_matches(v, '^-?[0-9]+$') THEN 1.0 ELSE 0 END) + any_value(rate)) / 2 >= 0.85"
_DECIDED = "SELECT '{c}' AS \"column\", CASE WHEN " + _WHOLE + " THEN 'integer' ELSE 'text' END AS pattern, CASE WHEN " + _WHOLE + " THEN 'BIGINT' ELSE 'VARCHAR' END AS type FROM (SELECT {c} AS v, (SELECT count(TRY_CAST({c} AS BIGINT)) / count({c}) FROM {raw}) AS rate FROM {raw} GROUP BY 1)"
# No date format alone parses four fifths of the days; all that match some day do together.
_MIX = f"SELECT 'day' AS \"column\", CASE WHEN greatest(iso, us) >= 0.8 THEN CASE WHEN iso >= us THEN 'iso_date' ELSE 'us_date' END WHEN iso + us >= 0.8 THEN 'iso_date+us_date+eu_slash_date' ELSE 'text' END AS pattern, CASE WHEN iso + us >= 0.8 THEN 'DATE' ELSE 'VARCHAR' END AS type FROM (SELECT count(*) FILTER (WHERE day LIKE '____-__-__') / count(day) AS iso, count(*) FILTER (WHERE day LIKE '__/__/____') / count(day) AS us FROM {_RAW})"


@query("t07_decide_types", " UNION ALL ".join([_DECIDED.format(c="id", raw=_RAW), _MIX, _DECIDED.format(c="price", raw=_RAW)]))
def _(table):
    return t.decide_types(t.type_candidates(_raw(table), ["id", "day", "price"]))


@query("t07_overridden", _MIX + " UNION ALL SELECT 'price', 'decimal_dot', 'DOUBLE' UNION ALL SELECT 'id', 'text', 'VARCHAR'")
def _(table):
    raw = _raw(table)
    named = raw.sparkSession.createDataFrame([("price", "decimal_dot", "DOUBLE"), ("id", "text", "VARCHAR")], "column string, pattern string, type string")
    return t.decide_types(t.type_candidates(raw, ["id", "day", "price"]), named)


@query("t07_mixed_built", f"SELECT CAST(id AS BIGINT) AS id, CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y')) AS DATE) AS day FROM {_RAW}")
def _(table):
    raw = _raw(table)
    decided = {r["column"]: r["pattern"] for r in t.decide_types(t.type_candidates(raw, ["id", "day"])).collect()}
    return t.build_typed(raw, decided).select("id", "day")


@query("t08_build_typed", f"SELECT CAST(id AS BIGINT) AS id, TRY_CAST(price AS BIGINT) AS price FROM {_RAW}")
def _(table):
    return t.build_typed(_raw(table), {"id": "integer", "price": "integer"}).select("id", "price")


@query("t09_quarantine", f"SELECT id, price FROM {_RAW} WHERE price IS NOT NULL AND TRY_CAST(price AS BIGINT) IS NULL")
def _(table):
    return t.build_quarantine(_raw(table), {"id": "integer", "price": "integer"}).select("id", "price")


@query("t10_cast_report", f"SELECT 'price' AS \"column\", count(*) FILTER (WHERE TRY_CAST(price AS BIGINT) IS NULL) AS failed, count(TRY_CAST(price AS BIGINT)) AS succeeded, round(count(TRY_CAST(price AS BIGINT)) / count(*), 6) AS rate FROM {_RAW} UNION ALL SELECT 'id', 0, count(*), 1.0 FROM {_RAW}")
def _(table):
    return rounded(t.cast_report(_raw(table), {"id": "integer", "price": "integer"}))


@query("t11_rejected_tokens", f"SELECT price AS token, count(*) AS n FROM {_RAW} WHERE TRY_CAST(price AS BIGINT) IS NULL GROUP BY 1")
def _(table):
    return t.rejected_tokens(_raw(table), "price", "integer")


@query("t05_unit", f"SELECT u AS unit, round((n / sum(n) OVER () + 1) / 2, 6) AS confidence FROM (SELECT regexp_extract(money, '[A-Z]+$') AS u, count(*) AS n FROM {_RAW} GROUP BY 1) ORDER BY n DESC, u LIMIT 1")
def _(table):
    return rounded(t.detect_unit(_raw(table), "money"))


@query("t12_promote", "SELECT c_custkey, c_name FROM customer")
def _(table):
    return t.promote(table("customer")).select("c_custkey", "c_name")


@query("t03_failing_examples", f"SELECT DISTINCT day AS value FROM {_RAW} WHERE NOT regexp_matches(day, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') ORDER BY value LIMIT 5")
def _(table):
    return t.failing_examples(_raw(table), "day", "iso_date")


_ISO, _US = "count(*) FILTER (WHERE day LIKE '____-__-__')", "count(*) FILTER (WHERE day LIKE '__/__/____')"


@query("t04_mixed_formats", f"SELECT 'DATE' AS type, round(({_ISO} + {_US}) / count(day), 6) AS rate, round(greatest({_ISO}, {_US}) / count(day), 6) AS best_alone, greatest({_ISO}, {_US}) / count(day) < 0.8 AS needs_mix FROM {_RAW} UNION ALL SELECT 'DOUBLE', 0, 0, false UNION ALL SELECT 'BOOLEAN', 0, 0, false")
def _(table):
    return rounded(t.mixed_formats(_raw(table), "day"))


@query("t06_type_candidates", f"SELECT 'id' AS \"column\", 'integer' AS pattern, 'BIGINT' AS type, 1.0::DOUBLE AS confidence UNION ALL SELECT 'money', 'text', 'VARCHAR', 1.0::DOUBLE UNION ALL SELECT 'price', 'integer', 'BIGINT', round((avg(CASE WHEN regexp_matches(v, '^[0-9]+$') THEN 1.0 ELSE 0 END) + (SELECT count(TRY_CAST(price AS BIGINT)) / count(price) FROM {_RAW})) / 2, 6) FROM (SELECT DISTINCT price AS v FROM {_RAW})")
def _(table):
    return rounded(t.type_candidates(_raw(table), ["id", "price", "money"]).select("column", "pattern", "type", "confidence"))


@query("t04_mixed_build", f"SELECT CAST(id AS BIGINT) AS id, CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y')) AS DATE) AS day FROM {_RAW}")
def _(table):
    return t.build_typed(_raw(table), {"id": "integer", "day": "mixed:DATE"}).select("id", "day")


_MADE = {
    "quarter": ("year(o_orderdate) || 'Q' || quarter(o_orderdate)", "concat(year(o_orderdate), 'Q', quarter(o_orderdate))", "period_yyyy_qq", "date_trunc('quarter', o_orderdate)::DATE"),
    "month": ("strftime(o_orderdate, '%Y-%m')", "date_format(o_orderdate, 'yyyy-MM')", "period_yyyy_mm", "date_trunc('month', o_orderdate)::DATE"),
    "german": ("strftime(o_orderdate, '%d.%m.%Y')", "date_format(o_orderdate, 'dd.MM.yyyy')", "eu_date", "o_orderdate::DATE"),
    "spelled": ("strftime(o_orderdate, '%d-%b-%Y')", "date_format(o_orderdate, 'dd-MMM-yyyy')", "dd_mon_yyyy", "o_orderdate::DATE"),
    "dollars": ("'$' || CAST(floor(o_totalprice) AS BIGINT)", "concat('$', cast(floor(o_totalprice) AS bigint))", "currency_usd", "floor(o_totalprice)::DOUBLE"),
    "share": ("(o_orderkey % 100) || '%'", "concat(o_orderkey % 100, '%')", "percentage", "((o_orderkey % 100) / 100)::DOUBLE"),
    "comma": ("(o_orderkey % 100) || ',5'", "concat(o_orderkey % 100, ',5')", "decimal_comma", "((o_orderkey % 100) + 0.5)::DOUBLE"),
    "answer": ("CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END", "CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END", "boolean_yn", "o_orderstatus = 'F'"),
}


@query("t02_catalogue_parses", "SELECT o_orderkey, " + ", ".join(f"{want} AS {name}" for name, (_, _, _, want) in _MADE.items()) + " FROM orders")
def _(table):
    text = table("orders").selectExpr("o_orderkey", *[f"{made} AS {name}" for name, (_, made, _, _) in _MADE.items()])
    return t.build_typed(text, {name: pattern for name, (_, _, pattern, _) in _MADE.items()})


@query("t02_catalogue_decides", " UNION ALL ".join(f"SELECT '{name}' AS \"column\", '{pattern}' AS pattern FROM (SELECT count(*) AS n FROM orders) WHERE n > 0" for name, (_, _, pattern, _) in _MADE.items()))
def _(table):
    text = table("orders").selectExpr(*[f"{made} AS {name}" for name, (_, made, _, _) in _MADE.items()])
    return t.decide_types(t.type_candidates(text, list(_MADE))).select("column", "pattern")


@query("t09_quarantine_at", f"SELECT id, price, TIMESTAMP '2024-05-01 12:00:00' AS quarantined_at FROM {_RAW} WHERE price IS NOT NULL AND TRY_CAST(price AS BIGINT) IS NULL")
def _(table):
    return t.build_quarantine(_raw(table), {"id": "integer", "price": "integer"}, "2024-05-01 12:00:00").select("id", "price", "quarantined_at")
