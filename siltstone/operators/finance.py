"""Finance metrics over a ledger of concepts: one scan for all concepts, then formulas over their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.metrics import formula_column

# Every metric with its unit, its formula over concepts and metrics before it, the values that are usual, and from which
# value on which label holds (None: no check, or the formula is an aggregate of the ledger itself).
METRICS: list[tuple[str, str, str, tuple[float, float] | None, list[tuple[float, str]]]] = [
    ("transaction_count", "count", "transaction_count", None, [(0, "NONE"), (1, "ACTIVE")]),
    ("active_accounts", "count", "active_accounts", None, [(0, "NONE"), (1, "ACTIVE")]),
    ("average_transaction_value", "currency", "average_transaction_value", None, [(0, "POSITIVE")]),
    ("current_ratio", "ratio", "current_assets / current_liabilities", (0, 1e308), [(0, "CRITICAL"), (1, "CONCERNING"), (1.5, "HEALTHY"), (2.01, "STRONG"), (3.01, "EXCESS")]),
    ("gross_profit", "currency", "revenue - cost_of_goods_sold", None, [(-1e9, "CRITICAL"), (0, "BREAKEVEN"), (1, "POSITIVE")]),
    ("gross_margin", "percentage", "(revenue - cost_of_goods_sold) / revenue * 100", None, [(-999, "NEGATIVE"), (0, "POOR"), (20, "FAIR"), (40, "GOOD"), (60, "EXCELLENT"), (80, "EXCEPTIONAL")]),
    ("operating_income", "currency", "gross_profit - operating_expense", None, [(-1e9, "LOSS"), (0, "BREAKEVEN"), (1, "PROFITABLE")]),
    ("operating_margin", "percentage", "operating_income / revenue * 100", None, [(-999, "CRITICAL"), (0, "POOR"), (5, "FAIR"), (15, "GOOD"), (25, "EXCELLENT")]),
    ("net_income", "currency", "operating_income - interest - tax", None, [(-1e9, "LOSS"), (0, "BREAKEVEN"), (1, "PROFITABLE")]),
    ("net_margin", "percentage", "net_income / revenue * 100", None, [(-999, "LOSS"), (0, "THIN"), (5, "FAIR"), (10, "GOOD"), (20, "EXCELLENT")]),
    ("ebitda", "currency", "operating_income + depreciation", None, [(-1e9, "NEGATIVE"), (0, "BREAKEVEN"), (1, "POSITIVE")]),
    ("ebitda_margin", "percentage", "ebitda / revenue * 100", None, [(-999, "POOR"), (5, "FAIR"), (15, "GOOD"), (25, "EXCELLENT"), (40, "EXCEPTIONAL")]),
    ("dso", "days", "accounts_receivable / revenue * days_in_period", (0, 365), [(0, "EXCELLENT"), (31, "GOOD"), (46, "CONCERNING"), (61, "POOR"), (91, "CRITICAL")]),
    ("dio", "days", "inventory / cost_of_goods_sold * days_in_period", (0, 365), [(0, "EXCELLENT"), (31, "GOOD"), (61, "MODERATE"), (91, "EXTENDED"), (121, "CRITICAL")]),
    ("dpo", "days", "accounts_payable / cost_of_goods_sold * days_in_period", (0, 365), [(0, "LOW"), (21, "GOOD"), (46, "EXTENDED"), (61, "CONCERNING"), (91, "CRITICAL")]),
    ("cash_conversion_cycle", "days", "dso + dio - dpo", None, [(-999, "NEGATIVE"), (1, "EFFICIENT"), (31, "MODERATE"), (61, "EXTENDED"), (91, "CONCERNING")]),
]
CONCEPTS = ["revenue", "cost_of_goods_sold", "operating_expense", "interest", "tax", "depreciation", "accounts_receivable", "accounts_payable", "inventory", "current_assets", "current_liabilities"]
#: Days of a period where the flows do not tell.
DEFAULT_DAYS = 30.0


def concept_values(ledger: DataFrame) -> DataFrame:
    """``concept, value, first_ts, last_ts, periods`` of ``concept, amount, behaviour, ts, account`` rows.

    A flow adds up over all time; a stock stands as in its last month.  Amounts are summed up per concept and month first, so a
    concept that most rows share costs one row per month and task.
    """
    months = ledger.where(F.col("concept").isNotNull()).groupBy("concept", "behaviour", F.date_trunc("month", "ts").alias("month")).agg(F.sum("amount").alias("amount"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return months.groupBy("concept").agg(
        F.expr("CASE WHEN max(behaviour) = 'stock' THEN max_by(amount, month) ELSE sum(amount) END").alias("value"),
        F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), F.count("month").alias("periods"), F.max("behaviour").alias("behaviour"),
    )


def period_days(values: DataFrame, flows: list[str], default: float = DEFAULT_DAYS) -> DataFrame:
    """``days, derived``: the one period that the ``flows`` span, corrected for the month that the last one opens; ``default`` if they are missing, of one month, or disagree."""
    span = F.expr("(unix_micros(CAST(last_ts AS timestamp)) - unix_micros(CAST(first_ts AS timestamp))) / 86400e6D")
    each = values.where(F.col("concept").isin(flows)).withColumn("days", F.when((F.col("periods") > 1) & (span > 0), span * F.col("periods") / (F.col("periods") - 1)))
    found = each.agg(F.count("days").alias("known"), F.count_distinct(F.round("days", 3)).alias("different"), F.min("days").alias("days"))
    ok = f"known = {len(flows)} AND different = 1"
    return found.selectExpr(f"CASE WHEN {ok} THEN days ELSE {float(default)}D END AS days", f"{ok} AS derived")


def _label(value: Column, labels: list[tuple[float, str]]) -> Column:
    out = F.lit(None).cast("string")
    for least, name in labels:
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def finance_metrics(ledger: DataFrame, days: float | None = None) -> DataFrame:
    """``metric, value, unit, status, label`` of all sixteen metrics.

    A metric whose concepts are not in the ledger, or that divides by zero, is inconclusive, as are those built on it.  days: length of the
    period; by default that which revenue and cost of goods sold agree on.  Transactions are the rows with a concept that is a flow.
    """
    values = concept_values(ledger)
    one = values.agg(*[F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in CONCEPTS])
    flows = ledger.where("concept IS NOT NULL AND behaviour = 'flow'").agg(F.count("amount").cast("double").alias("transaction_count"), F.count_distinct("account").cast("double").alias("active_accounts"), F.avg("amount").alias("average_transaction_value"))
    period = period_days(values, ["revenue", "cost_of_goods_sold"]).select(F.col("days").alias("days_in_period")) if days is None else ledger.sparkSession.createDataFrame([(float(days),)], "days_in_period double")
    wide = one.crossJoin(F.broadcast(flows)).crossJoin(F.broadcast(period))
    for name, _, formula, _, _ in METRICS:
        if formula != name:
            wide = wide.withColumn(name, formula_column(formula, wide.columns))
    rows = [
        F.struct(
            F.lit(name).alias("metric"), F.col(name).alias("value"), F.lit(unit).alias("unit"),
            F.when(F.col(name).isNull(), "inconclusive").when(F.lit(True) if usual is None else F.col(name).between(*usual), "supported").otherwise("out_of_range").alias("status"),
            _label(F.col(name), labels).alias("label"),
        )
        for name, unit, _, usual, labels in METRICS
    ]
    return wide.select(F.explode(F.array(*rows)).alias("m")).select("m.*")
