"""Column profiles and statistical quality: counts, moments, percentiles, outliers, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.stats import chi2_tail_8
from siltstone.operators.longform import cells
from siltstone.operators.quantiles import counted_quantiles, exact_quantiles, value_counts
from siltstone.sources.scratch import stored


def basic_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Total, nulls, distinct values and their ratios, per column."""
    return (
        cells(df, columns).groupBy("column")
        .agg(F.count("*").alias("total"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_distinct("value").alias("distinct_values"))
        .selectExpr("column", "total", "nulls", "distinct_values", "nulls / total AS null_ratio", "try_divide(distinct_values, total - nulls) AS cardinality_ratio", "distinct_values = total - nulls AND total > nulls AS is_unique")
    )


def _moments(counts: DataFrame) -> DataFrame:
    """Counts and moments per column from one table of value counts.

    Where every value of a column has at most nine decimals, the mean is that of the exact sum, whatever
    the order of the rows.
    """
    decimal = "try_cast(value AS decimal(24, 9))"
    base = counts.groupBy("column").agg(
        F.sum("n").alias("total"), F.expr("coalesce(sum(CASE WHEN value IS NULL THEN n END), 0)").alias("nulls"), F.count("value").alias("distinct_values"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.expr("sum(CASE WHEN value IS NOT NULL THEN n END)").alias("m"), F.expr(f"coalesce(bool_and(cast({decimal} AS double) = value), true)").alias("plain"),
        F.expr(f"cast(try_sum({decimal} * cast(n AS decimal(12, 0))) AS double)").alias("exact"), F.expr("sum(value * n)").alias("rough"),
    ).withColumn("mean", F.expr("CASE WHEN plain AND exact IS NOT NULL THEN exact ELSE rough END / m"))
    off = counts.join(F.broadcast(base.select("column", "mean")), "column").withColumn("d", F.col("value") - F.col("mean"))
    powers = off.groupBy("column").agg(*[F.sum(F.expr(f"n * {' * '.join(['d'] * k)}")).alias(f"d{k}") for k in (2, 3, 4)])
    g1, g2 = "(d3 / m) / pow(d2 / m, 1.5D)", "(d4 / m) / pow(d2 / m, 2D) - 3"
    return base.join(F.broadcast(powers), "column").selectExpr(
        "column", "total", "nulls", "distinct_values", "min", "max", "mean", "CASE WHEN m > 1 THEN sqrt(d2 / (m - 1)) END AS stddev",
        f"CASE WHEN m > 2 AND d2 > 0 THEN {g1} * sqrt(m * (m - 1D)) / (m - 2) END AS skewness",
        f"CASE WHEN m > 3 AND d2 > 0 THEN (m - 1D) / ((m - 2D) * (m - 3D)) * ((m + 1D) * ({g2}) + 6) END AS kurtosis",
    )


def numeric_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least, greatest, mean, deviation, bias-corrected skewness and kurtosis, coefficient of variation."""
    return _moments(_written_counts(df, columns)).drop("total", "nulls", "distinct_values").withColumn("cv", F.try_divide("stddev", F.abs("mean")))


SHARES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def percentiles(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """p01, p25, p50, p75, p99 per column: interpolated and exact, or approximate within 1/accuracy."""
    if accuracy is None:
        return _percentiles(_written_counts(df, columns))
    found = cells(df, columns, numeric=True).groupBy("column").agg(F.expr(f"percentile_approx(value, array({', '.join(f'{s}D' for s in SHARES.values())}), {accuracy})").alias("q"))
    return found.selectExpr("column", *[f"q[{i}] AS {name}" for i, name in enumerate(SHARES)])


def _written_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of numeric columns, written: one scan of ``df`` for all that is read from them."""
    return stored(value_counts(cells(df, columns, numeric=True)))


def _percentiles(counts: DataFrame) -> DataFrame:
    return counted_quantiles(counts, list(SHARES.values())).selectExpr("column", *[f"q[{i}] AS {name}" for i, name in enumerate(SHARES)])


def _held(per_column: DataFrame) -> DataFrame:
    """A table of one row per column as a local one."""
    return per_column.sparkSession.createDataFrame(per_column.collect(), per_column.schema)


def _around_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells with their column's median and median absolute deviation; the joined side has one row per column."""
    long = cells(df, columns, numeric=True).where("value IS NOT NULL")
    # One row per column each, found once and not again for every later use.
    mid = _held(exact_quantiles(long, [0.5]).selectExpr("column", "q[0] AS p50"))
    off = _held(exact_quantiles(long.join(F.broadcast(mid), "column").selectExpr("column", "abs(value - p50) AS value"), [0.5]).selectExpr("column", "q[0] AS mad"))
    return long.join(F.broadcast(mid.join(F.broadcast(off), "column")), "column")


def robust_spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median absolute deviation and its ratio to the median."""
    return _around_median(df, columns).groupBy("column").agg(F.first("mad").alias("mad"), F.first("p50").alias("p50")).selectExpr("column", "mad", "try_divide(mad, abs(p50)) AS robust_cv")


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    return cells(df, columns).groupBy("column").agg(F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"), F.avg(F.length("value")).alias("avg_length"))


def top_values(df: DataFrame, columns: list[str], k: int = 200) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value, with their share of all rows."""
    counts = cells(df, columns).groupBy("column", "value").count()
    total = counts.groupBy("column").agg(F.sum("count").alias("total"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = counts.where("value IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(total), "column").selectExpr("column", "rank", "value", "count", "count / total AS share")


def histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """Equal-width bins per column; a column with one value has none."""
    long = cells(df, columns, numeric=True).where("value IS NOT NULL")
    span = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi").withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    bin_ = F.greatest(F.lit(1), F.least(F.lit(bins), F.floor((F.col("value") - F.col("lo")) / F.col("width")).cast("int") + 1))
    return long.join(F.broadcast(span), "column").groupBy("column", bin_.alias("bin")).agg(F.min("lo").alias("lo"), F.min("width").alias("width"), F.count("*").alias("n")).selectExpr("column", "bin", "lo + (bin - 1) * width AS bucket_min", "lo + bin * width AS bucket_max", "n")


def profile(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Counts, moments and percentiles of all numeric ``columns``, one row each."""
    counts = _written_counts(df, columns)
    return _moments(counts).join(F.broadcast(_percentiles(counts) if accuracy is None else percentiles(df, columns, accuracy)), "column", "left")


def _histograms(counts: DataFrame, bins: int) -> DataFrame:
    """``column, histogram``: ``bins`` equal-width bins of counted values as an array, empty bins included."""
    found = counts.where("value IS NOT NULL AND NOT isnan(value)")
    span = found.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi")
    bin_ = F.expr(f"greatest(1, least({bins}, CAST(floor((value - lo) / ((hi - lo) / {bins})) AS INT) + 1))")
    held = found.join(F.broadcast(span.withColumnRenamed("column", "s_column")), F.col("column") == F.col("s_column")).groupBy("column", bin_.alias("bin")).agg(F.sum("n").alias("n"))
    every = span.select("column", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).join(held, ["column", "bin"], "left")
    width = f"(hi - lo) / {bins}"
    cell = F.struct("bin", F.expr(f"lo + (bin - 1) * {width}").alias("low"), F.expr(f"lo + bin * {width}").alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
    return every.groupBy("column").agg(F.array_sort(F.collect_list(cell)).alias("histogram"))


def full_profile(df: DataFrame, columns: list[str], numeric: list[str], k: int = 10, bins: int = 20) -> DataFrame:
    """One row per column of any type: counts, text lengths, its ``k`` most frequent values, and for ``numeric`` ones moments, percentiles, robust spread and a histogram.

    top_values: ``value, n`` by n and then value, as an array; histogram: ``bin, low, high, n`` of ``bins`` equal-width bins, null for a
    column of one value.  Everything is read from value counts, which are written once.
    """
    counts = stored(value_counts(cells(df, columns)))
    found = counts.where("value IS NOT NULL").groupBy("column").agg(
        F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"), F.expr("sum(length(value) * n) / sum(n)").alias("avg_length"),
    )
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counts.where("value IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("top"))
    sizes = counts.groupBy("column").agg(F.sum("n").alias("total"), F.expr("coalesce(sum(CASE WHEN value IS NULL THEN n END), 0)").alias("nulls"), F.count("value").alias("distinct_values"))
    out = sizes.join(F.broadcast(found), "column", "left").join(F.broadcast(top), "column", "left")
    names = ["min_length", "max_length", "avg_length", F.col("top")[0]["value"].alias("top_value"), F.col("top")[0]["n"].alias("top_count"), F.transform("top", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_values")]
    if not numeric:
        return out.select(*sizes.columns, *names)
    numbers = stored(counts.where(F.col("column").isin(numeric)).selectExpr("column", "try_cast(value AS double) AS value", "n").groupBy("column", "value").agg(F.sum("n").alias("n")))
    mid = counted_quantiles(numbers, [0.5]).selectExpr("column", "q[0] AS mid")
    off = stored(numbers.where("value IS NOT NULL").join(F.broadcast(_held(mid).withColumnRenamed("column", "m_column")), F.col("column") == F.col("m_column")).selectExpr("column", "abs(value - mid) AS value", "n").groupBy("column", "value").agg(F.sum("n").alias("n")))
    spread = counted_quantiles(off, [0.5]).selectExpr("column", "q[0] AS mad").join(F.broadcast(mid), "column").selectExpr("column", "mad", "try_divide(mad, abs(mid)) AS robust_cv")
    told = _moments(numbers).drop("total", "nulls", "distinct_values").join(F.broadcast(_percentiles(numbers)), "column", "left").join(F.broadcast(spread), "column", "left").join(F.broadcast(_histograms(numbers, bins)), "column", "left")
    return out.join(F.broadcast(told), "column", "left").select(*sizes.columns, *names, *[c for c in told.columns if c != "column"])


def benford(df: DataFrame, columns: list[str], min_values: int = 100) -> DataFrame:
    """Chi-square of first non-zero digits against Benford's law; needs enough values over a decade or more."""
    long = cells(df, columns, numeric=True).where("value <> 0").withColumn("a", F.abs("value"))
    digit = F.expr("cast(floor(a / pow(10D, floor(log10(a) + 1e-12D))) AS int)")
    counts = long.withColumn("digit", digit).groupBy("column", "digit").agg(F.count("*").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    total = counts.groupBy("column").agg(F.sum("n").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    nine = total.select("*", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("digit"))
    cell = nine.join(counts.select("column", "digit", "n"), ["column", "digit"], "left")
    want = "total * log10(1 + 1D / digit)"
    stat = cell.groupBy("column").agg(F.first("total").alias("n_values"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum(F.expr(f"pow(coalesce(n, 0) - {want}, 2) / ({want})")).alias("chi2"))
    verdict = F.when((F.col("n_values") < min_values) | (F.col("hi") < 10 * F.col("lo")), "not_applicable").when(chi2_tail_8("chi2") >= 0.05, "compliant").otherwise("violating")
    return stat.select("column", "n_values", "chi2", verdict.alias("verdict"))


def iqr_outliers(df: DataFrame, columns: list[str], reach: float = 1.5) -> DataFrame:
    long = cells(df, columns, numeric=True).where("value IS NOT NULL")
    q = exact_quantiles(long, [0.25, 0.75]).selectExpr("column", f"q[0] - {reach}D * (q[1] - q[0]) AS lo", f"q[1] + {reach}D * (q[1] - q[0]) AS hi")
    return long.join(F.broadcast(q), "column").groupBy("column").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count_if(F.expr("value < lo OR value > hi")).alias("outliers"), F.count("*").alias("n")).selectExpr("column", "lo", "hi", "outliers", "outliers / n AS ratio")


def mad_outliers(df: DataFrame, columns: list[str], cut: float = 3.5) -> DataFrame:
    """Values whose modified z-score exceeds ``cut``; none where the deviation is zero."""
    return _around_median(df, columns).groupBy("column").agg(F.count_if(F.expr(f"mad > 0 AND abs(0.6745D * (value - p50) / mad) > {cut}D")).alias("outliers"), F.count("*").alias("n")).selectExpr("column", "outliers", "outliers / n AS ratio")


def farthest(df: DataFrame, column: str, key: list[str], k: int = 200) -> DataFrame:
    """The ``k`` rows farthest from the median of ``column``."""
    x = exact_quantiles(cells(df, [column], numeric=True), [0.5]).selectExpr("q[0] AS p50")
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(x)).withColumn("distance", F.abs(F.col(column) - F.col("p50")))
    return rows.orderBy(F.desc("distance"), *key).limit(k).select(*key, column, "distance")


def quality_issues(outliers: DataFrame) -> DataFrame:
    """Warnings over 5 %, critical from 10 % outliers."""
    return outliers.selectExpr("column", "ratio", "CASE WHEN ratio >= 0.1 THEN 'critical' WHEN ratio > 0.05 THEN 'warning' END AS severity").where("severity IS NOT NULL")


def all_issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, issue, value, severity``: outlier shares over 5 % (critical from 10 %), and first digits off Benford's law, with its p-value."""
    out = quality_issues(iqr_outliers(df, columns)).selectExpr("column", "'outliers' AS issue", "ratio AS value", "severity")
    digits = benford(df, columns).where("verdict = 'violating'").select("column", F.lit("benford").alias("issue"), chi2_tail_8("chi2").alias("value"), F.lit("warning").alias("severity"))
    return out.unionByName(digits)


def eligibility(counts: DataFrame, max_null: float = 0.95, near_constant: float = 0.0001) -> DataFrame:
    """First matching rule over ``basic_counts``."""
    return counts.selectExpr(
        "column",
        f"CASE WHEN nulls = total THEN 'INELIGIBLE' WHEN distinct_values = 1 THEN 'WARN' WHEN null_ratio > {max_null}D THEN 'WARN' WHEN cardinality_ratio < {near_constant}D THEN 'WARN' ELSE 'ELIGIBLE' END AS status",
        f"CASE WHEN nulls = total THEN 'all_null' WHEN distinct_values = 1 THEN 'single_value' WHEN null_ratio > {max_null}D THEN 'high_null' WHEN cardinality_ratio < {near_constant}D THEN 'near_constant' ELSE 'ok' END AS reason",
    )


def drop_ineligible(df: DataFrame, key: str, reasons: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The table without the columns named in ``reasons``, and their cells as ``key, column, value, reason``."""
    if not reasons:
        return df, cells(df, df.columns[:1], keep=[key]).withColumn("reason", F.lit("")).limit(0)
    why = F.element_at(F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv]), F.col("column"))
    return df.drop(*reasons), cells(df, list(reasons), keep=[key]).withColumn("reason", why)


def value_search(df: DataFrame, columns: list[str], needle: str, limit: int = 20) -> DataFrame:
    """Values that hold ``needle`` in any case, most frequent first."""
    hits = cells(df, columns).where(F.lower("value").contains(needle.lower()))
    return hits.groupBy("column", "value").count().orderBy(F.desc("count"), "column", "value").limit(limit)


def sign_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    ranges = cells(df, columns, numeric=True).groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ranges.selectExpr("column", "CASE WHEN lo IS NULL THEN 'empty' WHEN hi < 0 THEN 'all_negative' WHEN lo >= 0 THEN 'none_negative' ELSE 'mixed' END AS signs")
