"""Metrics as graphs of extract and formula steps, drilling, grids, and stock/flow reconciliation."""

from __future__ import annotations

import ast
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.joins import full_join_null_safe
from siltstone.operators.quantiles import exact_quantiles


def extract(df: DataFrame, aggregate: str, where: list[str] | None = None, dims: list[str] | None = None) -> DataFrame:
    """One aggregate as ``value``, of filtered rows, by dimensions if any."""
    for w in where or []:
        df = df.where(w)
    return df.groupBy(*(dims or [])).agg(F.expr(aggregate).alias("value"))


_SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.USub: "-", ast.UAdd: "+"}


def _safe(formula: str, names: list[str]) -> str:
    """The formula as SQL with null for a division by zero; only numbers, the four signs and known names may stand in it."""

    def sql(x: ast.AST) -> str:
        if isinstance(x, ast.BinOp) and type(x.op) in _SIGNS:
            left, right = sql(x.left), sql(x.right)
            return f"(({left}) / nullif({right}, 0))" if isinstance(x.op, ast.Div) else f"({left} {_SIGNS[type(x.op)]} {right})"
        if isinstance(x, ast.UnaryOp) and type(x.op) in _SIGNS:
            return f"({_SIGNS[type(x.op)]} {sql(x.operand)})"
        if isinstance(x, ast.Constant) and type(x.value) in (int, float):
            return f"{float(x.value)!r}D"
        if isinstance(x, ast.Name) and x.id in names:
            return f"`{x.id}`"
        raise ValueError(f"{ast.unparse(x)!r} may not stand in {formula!r}")

    try:
        return sql(ast.parse(formula.strip(), mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"no formula: {formula!r}") from e


def formula_column(formula: str, names: list[str]) -> Column:
    """A formula over columns as an expression; a division by zero is null."""
    return F.expr(_safe(formula, names))


def evaluate_metric(steps: dict[str, DataFrame], constants: dict[str, float], formulas: dict[str, str]) -> DataFrame:
    """One row with the value of every step; formulas may use steps before them."""
    out = None
    for name, step in steps.items():
        one = step.select(F.col("value").cast("double").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    out = out.selectExpr("*", *[f"{v}D AS {n}" for n, v in constants.items()])
    for name, formula in formulas.items():
        out = out.selectExpr("*", f"{_safe(formula, out.columns)} AS {name}")
    return out


def metric_library(tables: dict[str, DataFrame], library: dict[str, dict]) -> DataFrame:
    """``metric, value, status`` of every metric of a library.

    Each one has ``steps`` (name: table, aggregate), a ``formula`` over them and a ``range`` that holds its usual values.
    """
    parts = []
    for name, spec in library.items():
        steps = {step: extract(tables[t], aggregate) for step, (t, aggregate) in spec["steps"].items()}
        value = evaluate_metric(steps, {}, {"value": spec["formula"]}).select("value")
        lo, hi = spec["range"]
        parts.append(support_check(value, "value", f"value BETWEEN {lo} AND {hi}").select(F.lit(name).alias("metric"), "value", "status"))
    return reduce(DataFrame.unionByName, parts)


def must_reconcile(computations: DataFrame, witnesses: DataFrame) -> DataFrame:
    """``concept, healthy, lineage`` of concepts with two healthy ``concept, computation, health`` or more, and how many ``concept`` witnesses lineage has of them."""
    healthy = computations.where(F.col("health") == "healthy").groupBy("concept").agg(F.count_distinct("computation").alias("healthy")).where("healthy >= 2")
    return healthy.join(witnesses.groupBy("concept").agg(F.count("*").alias("lineage")), "concept", "left").selectExpr("concept", "healthy", "coalesce(lineage, 0) AS lineage")


def support_check(values: DataFrame, column: str, condition: str) -> DataFrame:
    return values.selectExpr(column, f"CASE WHEN {column} IS NULL THEN 'inconclusive' WHEN {condition} THEN 'supported' ELSE 'out_of_range' END AS status")


def range_label(values: DataFrame, column: str, ranges: list[tuple[str, float, float]]) -> DataFrame:
    case = " ".join(f"WHEN {column} >= {lo} AND {column} < {hi} THEN '{name}'" for name, lo, hi in ranges)
    return values.selectExpr(column, f"CASE {case} END AS label")


def scoped(df: DataFrame, where: list[str], column: str, value: str) -> DataFrame:
    """The default scope, unless a filter uses its column already."""
    for w in where:
        df = df.where(w)
    return df if any(re.search(rf"\b{column}\b", w) for w in where) else df.where(F.col(column) == value)


def additivity(declared: DataFrame) -> DataFrame:
    """Whether ``metric, aggregate, behaviour`` adds up: everywhere, not over time, or never; the most restrictive counts."""
    level = F.expr("CASE WHEN aggregate = 'sum' AND behaviour = 'flow' THEN 0 WHEN aggregate = 'count' AND behaviour <> 'stock' THEN 0 WHEN aggregate IN ('sum', 'count') THEN 1 ELSE 2 END")
    return declared.groupBy("metric").agg(F.max(level).alias("level")).selectExpr("metric", "element_at(array('additive', 'semi_additive', 'non_additive'), level + 1) AS verdict")


def formula_additivity(declared: DataFrame, parts: DataFrame) -> DataFrame:
    """Per ``formula`` of ``formula, metric, operation``: as additive as its least additive part; a product or ratio never is.

    ``axes`` says along what it may be added up: all axes, all but time, or none.
    """
    rank = F.expr("CASE verdict WHEN 'additive' THEN 0 WHEN 'semi_additive' THEN 1 ELSE 2 END")
    least = parts.join(additivity(declared).select("metric", rank.alias("level")), "metric", "left").groupBy("formula").agg(F.max(F.expr("CASE WHEN operation IN ('*', '/') OR level IS NULL THEN 2 ELSE level END")).alias("level"))
    return least.selectExpr("formula", "element_at(array('additive', 'semi_additive', 'non_additive'), level + 1) AS verdict", "element_at(array('all', 'all but time', 'none'), level + 1) AS axes")


def bucket_start(ts: str, size: int, unit: str) -> str:
    """Start of the bucket of ``size`` units: seconds to days from 1 January, weeks from Monday 3 January, months to years from January 2000."""
    if unit in ("month", "quarter", "year"):
        return month_bucket(ts, size * {"month": 1, "quarter": 3, "year": 12}[unit])
    origin, seconds = ("2000-01-03" if unit == "week" else "2000-01-01"), size * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit]
    n = f"timestampdiff(SECOND, timestamp_ntz'{origin} 00:00:00', cast({ts} AS timestamp_ntz))"
    return f"timestampadd(SECOND, {n} - pmod({n}, {seconds}), timestamp_ntz'{origin} 00:00:00')"


#: The units of grain tokens such as 15m or 3M.
GRAIN_UNITS = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "M": "month", "q": "quarter", "y": "year"}


def grain_bucket(ts: str, grain: str) -> str:
    """``bucket_start`` of a token: a number from 1 to 9999 without leading zeros and a unit of ``GRAIN_UNITS``, whose case counts."""
    number, unit = grain[:-1], grain[-1:]
    if unit not in GRAIN_UNITS or not (number.isascii() and number.isdigit()) or number[0] == "0" or len(number) > 4:
        raise ValueError(f"no grain {grain!r}")
    return bucket_start(ts, int(number), GRAIN_UNITS[unit])


def drill(df: DataFrame, dims: list[str], measures: list[str], pins: dict[str, str | None] | None = None) -> DataFrame:
    """Rows and sums by dimensions; a pin of None keeps nulls."""
    for c, v in (pins or {}).items():
        df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
    return df.groupBy(*dims).agg(F.count("*").alias("rows"), *[F.sum(m).alias(m) for m in measures])


def drill_difference(plus: DataFrame, minus: DataFrame, dims: list[str]) -> DataFrame:
    """An additive formula by dimensions: signed parts in one grouping, null if a part is null."""
    both = plus.unionByName(minus.withColumn("value", -F.col("value")))
    return both.groupBy(*dims).agg(F.when(F.count("*") == F.count("value"), F.sum("value")).alias("value"))


def drill_ratio(top: DataFrame, bottom: DataFrame, dims: list[str]) -> DataFrame:
    joined = full_join_null_safe([top.withColumnRenamed("value", "top"), bottom.withColumnRenamed("value", "bottom")], dims)
    return joined.selectExpr(*dims, "try_divide(top, bottom) AS value")


def month_bucket(ts: str, months: int) -> str:
    """Start of the bucket of so many months, counted from January 2000."""
    n = f"(year({ts}) * 12 + month({ts}) - 1 - 24000)"
    start = f"({n} - pmod({n}, {months}) + 24000)"
    return f"make_date(cast(floor({start} / 12) AS int), cast(pmod({start}, 12) + 1 AS int), 1)"


def grid(df: DataFrame, filters: list[str], sort: list[tuple[str, bool]], limit: int, offset: int = 0) -> DataFrame:
    """A page plus one row, in a total order."""
    for f in filters:
        df = df.where(f)
    order = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in sort] + [F.col(c).asc_nulls_last() for c in df.columns]
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def chart(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """Sum, mean, median, least, greatest and count of ``y`` per group; medians are exact and a large group is many tasks' work."""
    keys = [x, *([colour] if colour else [])]
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    sums = df.groupBy(*keys).agg(F.sum(y).alias("sum"), F.avg(y).alias("mean"), F.min(y).alias("min"), F.max(y).alias("max"), F.count(y).alias("count"))
    middle = exact_quantiles(df.select(group.alias("column"), F.col(y).cast("double").alias("value")), [0.5]).select(F.col("column").alias("group_"), F.col("q")[0].alias("median"))
    return sums.withColumn("of_", group).join(middle, F.col("of_") == F.col("group_"), "left").select(*keys, "sum", "mean", "median", "min", "max", "count")


def fingerprint(df: DataFrame, rows: int = 200) -> DataFrame:
    """sha-256 of the first rows in total order, doubles to 12 digits."""
    shown = [F.format_string("%.12g", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    top = df.orderBy(*df.columns).limit(rows).select(F.to_json(F.struct(*shown)).alias("row"))
    return top.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n"), 256).alias("sha256"), F.count("*").alias("rows"))


def bounded_sample(df: DataFrame, order: list[str], rows: int = 200, size: int = 256 * 1024) -> DataFrame:
    """The first rows whose JSON fits into ``size`` bytes."""
    top = df.orderBy(*order).limit(rows).withColumn("json_bytes", F.octet_length(F.to_json(F.struct(*df.columns))))
    return top.withColumn("used", F.sum("json_bytes").over(Window.orderBy(*order))).where(F.col("used") <= size).drop("used", "json_bytes")


def slice_series(df: DataFrame, dim: str, ts: str, measure: str, grain: str = "month") -> DataFrame:
    return df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("entity"), F.date_trunc(grain, ts).alias("period")).agg(F.sum(measure).alias("total"), F.count("*").alias("rows"))


def align(measures: DataFrame, events: DataFrame) -> DataFrame:
    """Measure and event totals of the same entity and period; no event counts zero."""
    return measures.join(events.withColumnsRenamed({"total": "event", "rows": "event_rows"}), ["entity", "period"], "left").selectExpr("entity", "period", "total", "coalesce(event, 0) AS event", "rows", "coalesce(event_rows, 0) AS event_rows")


def reconcile(aligned: DataFrame, least_periods: int = 4, most_residual: float = 0.5) -> DataFrame:
    """Per entity, whether the events explain the measure as a flow or its changes (a stock)."""
    w = Window.partitionBy("entity").orderBy("period")
    steps = aligned.withColumn("change", F.col("total") - F.lag("total").over(w))
    r = steps.groupBy("entity").agg(F.count("*").alias("periods"), F.try_divide(F.sum(F.expr("abs(total - event)")), F.sum(F.expr("abs(event)"))).alias("r_flow"), F.try_divide(F.sum(F.expr("abs(change - event)")), F.sum(F.expr("CASE WHEN change IS NOT NULL THEN abs(event) END"))).alias("r_stock"))
    return r.selectExpr("*", f"CASE WHEN periods < {least_periods} OR least(r_flow, r_stock) > {most_residual} OR least(r_flow, r_stock) IS NULL THEN 'abstain' WHEN r_flow <= r_stock THEN 'flow' ELSE 'stock' END AS vote")


def reconcile_verdict(votes: DataFrame, agreement: float = 0.8) -> DataFrame:
    from siltstone.functions.stats import wilson_lower

    one = votes.agg(F.count_if(F.col("vote") == "flow").alias("flow"), F.count_if(F.col("vote") == "stock").alias("stock")).withColumn("voters", F.col("flow") + F.col("stock"))
    one = one.withColumn("support", wilson_lower("greatest(flow, stock)", "voters"))
    return one.selectExpr("flow", "stock", "support", f"CASE WHEN voters < 2 THEN 'abstain' WHEN flow >= {agreement} * voters THEN 'flow' WHEN stock >= {agreement} * voters THEN 'stock' ELSE 'undecided' END AS verdict")
