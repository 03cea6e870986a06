"""Profiles of time columns: bounds, gaps, grain, completeness, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.quantiles import counted_quantiles, exact_quantiles, range_bits, value_counts
from siltstone.sources.scratch import stored

#: Seconds of each grain and how far the median gap may be from them.
GRAINS = {"second": (1, 0.5), "minute": (60, 5), "hour": (3600, 300), "day": (86400, 3600), "week": (604800, 86400), "month": (2592000, 259200), "quarter": (7776000, 777600), "year": (31536000, 3153600)}
#: Confidence of an irregular series, and the variation that halves that of a regular one.
IRREGULAR, HALVED_AT = 0.3, 5


def bounds(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_distinct(ts).alias("distinct_ts")).withColumn("span_days", F.datediff("last_ts", "first_ts"))


def gaps(df: DataFrame, ts: str, range_rows: int = 1 << 18) -> DataFrame:
    """Every distinct time with the next one and the seconds between.

    Times are cut into ranges of about ``range_rows`` rows by a bounded sketch, whatever days they crowd into; the next time is
    found within a range, and only the last of a range looks at the first of the next one.
    """
    seen = df.where(F.col(ts).isNotNull()).select(F.col(ts).alias("ts"))
    bits = range_bits(seen.count(), range_rows)
    times = seen.distinct().withColumn("part", F.lit(0))
    if bits:
        at = ", ".join(f"{i / 2**bits}D" for i in range(1, 2**bits))
        cuts = seen.selectExpr("unix_micros(CAST(ts AS timestamp)) AS m").agg(F.expr(f"percentile_approx(m, array({at}), {20 * 2**bits})").alias("cuts"))
        times = seen.distinct().crossJoin(F.broadcast(df.sparkSession.createDataFrame(cuts.collect(), cuts.schema))).withColumns({"m": F.expr("unix_micros(CAST(ts AS timestamp))"), "part": F.lit(0)})
        for bit in reversed(range(bits)):
            times = times.withColumn("part", F.expr(f"part + CASE WHEN m > cuts[part + {2**bit - 1}] THEN {2**bit} ELSE 0 END"))
    times = times.select("ts", "part")
    inside = times.withColumn("next_ts", F.lead("ts").over(Window.partitionBy("part").orderBy("ts")))
    if bits:
        # One row per range.
        opens = times.groupBy("part").agg(F.min("ts").alias("opens")).select("part", F.lead("opens").over(Window.orderBy("part")).alias("next_open"))
        inside = inside.join(F.broadcast(opens), "part").select("ts", F.coalesce("next_ts", "next_open").alias("next_ts"))
    return inside.select("ts", "next_ts").where("next_ts IS NOT NULL").withColumn("gap_s", (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)


def _gap_counts(found: DataFrame) -> DataFrame:
    return stored(value_counts(found.select(F.lit("gap").alias("column"), F.col("gap_s").alias("value"))))


def gap_statistics(df: DataFrame, ts: str) -> DataFrame:
    """Median, least and greatest gap and their number, of which the median is null and the number zero without gaps."""
    counts = _gap_counts(gaps(df, ts))
    ends = counts.agg(F.min("value").alias("min_gap"), F.max("value").alias("max_gap"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_gaps"))
    return _median_gap(counts).crossJoin(F.broadcast(ends)).select("median_gap", "min_gap", "max_gap", "n_gaps")


def _median_gap(counts: DataFrame) -> DataFrame:
    """One row with the median of counted gaps, null without any."""
    return counted_quantiles(counts, [0.5]).agg(F.first(F.col("q")[0]).alias("median_gap"))


def granularity(df: DataFrame, ts: str) -> DataFrame:
    """The grain whose length the median gap meets, or ``irregular``, and how sure that is: the more gaps vary, the less."""
    case = " ".join(f"WHEN abs(median_gap - {s}) <= {t} THEN '{g}'" for g, (s, t) in GRAINS.items())
    named = gap_statistics(df, ts).selectExpr("*", f"CASE {case} ELSE 'irregular' END AS grain")
    return named.selectExpr("median_gap", "grain", f"CASE WHEN grain = 'irregular' THEN {IRREGULAR}D ELSE 1 - least((max_gap - min_gap) / median_gap / {2 * HALVED_AT}, 0.5D) END AS confidence")


#: Periods between the starts ``lo`` and ``hi`` of two of each grain.
STEPS = {
    "second": "timestampdiff(SECOND, lo, hi)", "minute": "timestampdiff(MINUTE, lo, hi)", "hour": "timestampdiff(HOUR, lo, hi)", "day": "datediff(hi, lo)", "week": "datediff(hi, lo) / 7",
    "month": "(year(hi) - year(lo)) * 12 + month(hi) - month(lo)", "quarter": "(year(hi) - year(lo)) * 4 + quarter(hi) - quarter(lo)", "year": "year(hi) - year(lo)",
}


def completeness(df: DataFrame, ts: str, grain: str) -> DataFrame:
    """Periods that occur against periods between the first and the last."""
    step, cut = STEPS[grain], F.date_trunc(grain, ts)
    return df.agg(F.count_distinct(cut).alias("present"), F.min(cut).alias("lo"), F.max(cut).alias("hi")).selectExpr("present", f"cast({step} + 1 AS bigint) AS expected", f"present / ({step} + 1) AS completeness")


def significant_gaps(df: DataFrame, ts: str) -> DataFrame:
    """Every gap over twice the median, with severity and missing periods."""
    found = stored(gaps(df, ts))
    mid = _median_gap(_gap_counts(found)).withColumnRenamed("median_gap", "mid")
    big = found.crossJoin(F.broadcast(mid)).where("gap_s > 2 * mid")
    return big.selectExpr("ts", "next_ts", "gap_s", "cast(floor(gap_s / mid) - 1 AS bigint) AS missing", "CASE WHEN gap_s > 10 * mid THEN 'severe' WHEN gap_s > 5 * mid THEN 'moderate' ELSE 'minor' END AS severity")


def last_period_fill(df: DataFrame, ts: str, grain: str = "month") -> DataFrame:
    """Rows of the last period against the median of the others."""
    per = stored(df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(grain, ts).alias("period")).count())
    last = per.agg(F.max(F.struct("period", "count")).alias("last")).where("last IS NOT NULL")
    before = per.crossJoin(F.broadcast(last)).where("period < last.period").select(F.lit("rows").alias("column"), F.col("count").cast("double").alias("value"))
    typical = exact_quantiles(before, [0.5]).agg(F.first(F.col("q")[0]).alias("typical"))
    return last.crossJoin(F.broadcast(typical)).selectExpr("last.count AS last_rows", "typical", "try_divide(last.count, typical) AS fill", "last.count >= typical AS is_full")


def staleness(df: DataFrame, ts: str, as_of: str) -> DataFrame:
    """Whether the age at ``as_of`` exceeds twice the median gap."""
    mid = gap_statistics(df, ts).select("median_gap")
    age = df.agg(F.expr(f"unix_timestamp(timestamp'{as_of}') - unix_timestamp(cast(max({ts}) AS timestamp))").alias("age_s"))
    return age.crossJoin(F.broadcast(mid)).selectExpr("cast(age_s AS double) AS age_s", "median_gap", "age_s > 2 * median_gap AS stale")


def flow_window(df: DataFrame, ts: str, condition: str) -> DataFrame:
    """Days that a filtered flow spans, corrected for the period that its last day opens."""
    return df.where(condition).agg(F.datediff(F.max(ts), F.min(ts)).alias("span"), F.count_distinct(F.to_date(ts)).alias("n")).selectExpr("span", "n", "CASE WHEN n > 1 THEN span * n / (n - 1D) END AS window_days")


def reconciled_window(flows: list[tuple[DataFrame, str, str]], default: float, grain: str = "day") -> DataFrame:
    """``days, derived, reason, flows``: the one period that all ``frame, time, condition`` flows of a metric span.

    Each flow's window is measured on the rows that its condition keeps and corrected for the period that its last one opens.
    If a flow has no row or a single period, or flows disagree by a thousandth of a day, ``default`` days stand, with the reason.
    """
    from functools import reduce

    one = lambda i, df, ts, cond: df.where(cond).agg(
        (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))).alias("span_us"), F.count_distinct(F.date_trunc(grain, ts)).alias("n")
    ).selectExpr(f"{i} AS flow", "n", "CASE WHEN n > 1 AND span_us > 0 THEN span_us / 86400e6D * n / (n - 1D) END AS days")
    windows = reduce(DataFrame.unionByName, [one(i, *f) for i, f in enumerate(flows)])
    both = windows.agg(F.count("*").alias("flows"), F.count("days").alias("measured"), F.count_if(F.col("n") == 0).alias("empty"), F.count_distinct(F.round("days", 3)).alias("different"), F.min_by("days", "flow").alias("first"))
    reason = "CASE WHEN empty > 0 THEN 'a flow has no rows' WHEN measured < flows THEN 'a flow spans a single period' WHEN different > 1 THEN 'flows disagree' END"
    return both.selectExpr(f"CASE WHEN ({reason}) IS NULL THEN first ELSE {float(default)}D END AS days", f"({reason}) IS NULL AS derived", f"{reason} AS reason", "flows")


def full_temporal_profile(df: DataFrame, as_of: str, most_gaps: int = 100) -> DataFrame:
    """One row per time column: bounds, gaps, grain and its confidence, completeness, the largest gaps, how full the last period is, and staleness at ``as_of``.

    ``column, first_ts, last_ts, distinct_ts, span_days, median_gap, min_gap, max_gap, grain, confidence, present, expected, completeness,
    gaps, n_gaps_over, largest_gap_days, last_rows, typical, is_full, age_s, stale``.  gaps: the ``most_gaps`` longest of those over twice the
    median, as ``ts, next_ts, gap_s, missing, severity``; n_gaps_over counts all of them.  An irregular column has no
    periods to be complete by.  Distinct times and gaps are found once per column; what follows reads the written gaps.
    """
    from functools import reduce

    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

    times = [f.name for f in df.schema if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]
    if not times:
        raise ValueError("no time column")
    return reduce(DataFrame.unionByName, [_temporal_row(df, c, as_of, most_gaps) for c in times])


def _temporal_row(df: DataFrame, ts: str, as_of: str, most_gaps: int) -> DataFrame:
    spark = df.sparkSession
    found = stored(gaps(df.select(F.col(ts).cast("timestamp").alias(ts)), ts))
    counts = _gap_counts(found)
    # A median of whole microseconds is a whole number of halves: without that a gap of exactly twice the median may count as longer.
    mid_gap = _median_gap(counts).selectExpr("rint(median_gap * 2e6D) / 2e6D AS median_gap")
    stats = counts.agg(F.min("value").alias("min_gap"), F.max("value").alias("max_gap")).crossJoin(F.broadcast(mid_gap))
    case = " ".join(f"WHEN abs(median_gap - {s}) <= {t} THEN '{g}'" for g, (s, t) in GRAINS.items())
    told = stats.selectExpr("*", f"CASE {case} ELSE 'irregular' END AS grain").selectExpr("*", f"CASE WHEN grain = 'irregular' THEN {IRREGULAR}D ELSE 1 - least((max_gap - min_gap) / median_gap / {2 * HALVED_AT}, 0.5D) END AS confidence")
    # One row: the grain that later sums are by.
    known = told.first()
    told = spark.createDataFrame([known], told.schema)
    seen = df.where(F.col(ts).isNotNull())
    ends = seen.agg(F.min(F.col(ts).cast("timestamp")).alias("first_ts"), F.max(F.col(ts).cast("timestamp")).alias("last_ts"), F.count_distinct(ts).alias("distinct_ts")).withColumn("span_days", F.datediff("last_ts", "first_ts").cast("long"))
    over = found.where(f"gap_s > 2 * {float(known['median_gap'])!r}D") if known["median_gap"] else found.where("false")
    mid = f"{float(known['median_gap'] or 1.0)!r}D"
    rated = over.selectExpr("ts", "next_ts", "gap_s", f"CAST(floor(gap_s / {mid}) - 1 AS bigint) AS missing", f"CASE WHEN gap_s > 10 * {mid} THEN 'severe' WHEN gap_s > 5 * {mid} THEN 'moderate' ELSE 'minor' END AS severity")
    few = rated.orderBy(F.desc("gap_s"), "ts").limit(most_gaps).agg(F.array_sort(F.collect_list(F.struct((-F.col("gap_s")).alias("k"), "ts", "next_ts", "gap_s", "missing", "severity"))).alias("g"))
    listed = few.select(F.transform("g", lambda x: F.struct(*[x[c].alias(c) for c in ("ts", "next_ts", "gap_s", "missing", "severity")])).alias("gaps"))
    out = ends.crossJoin(F.broadcast(told)).crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(over.agg(F.count("*").alias("n_gaps_over"), (F.max("gap_s") / 86400).alias("largest_gap_days"))))
    if known["grain"] in STEPS:
        full = completeness(seen, ts, known["grain"])
        last = last_period_fill(seen, ts, known["grain"]).select("last_rows", "typical", "is_full")
        out = out.crossJoin(F.broadcast(full)).crossJoin(F.broadcast(last))
    else:
        out = out.selectExpr("*", "CAST(NULL AS bigint) AS present", "CAST(NULL AS bigint) AS expected", "CAST(NULL AS double) AS completeness", "CAST(NULL AS bigint) AS last_rows", "CAST(NULL AS double) AS typical", "CAST(NULL AS boolean) AS is_full")
    age = F.expr(f"(unix_micros(timestamp'{as_of}') - unix_micros(last_ts)) / 1e6D")
    names = ["first_ts", "last_ts", "distinct_ts", "span_days", "median_gap", "min_gap", "max_gap", "grain", "confidence", "present", "expected", "completeness", "gaps", "n_gaps_over", "largest_gap_days", "last_rows", "typical", "is_full"]
    return out.select(F.lit(ts).alias("column"), *names, age.alias("age_s"), (age > 2 * F.col("median_gap")).alias("stale"))


def profile_temporal(df: DataFrame) -> DataFrame:
    """Bounds, gap statistics and grain of every time column, one row each."""
    from functools import reduce

    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

    times = [f.name for f in df.schema if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]
    if not times:
        raise ValueError("no time column")
    one = lambda c: bounds(df, c).crossJoin(F.broadcast(granularity(df, c))).select(F.lit(c).alias("column"), "first_ts", "last_ts", "distinct_ts", "span_days", "median_gap", "grain")
    return reduce(DataFrame.unionByName, map(one, times))
