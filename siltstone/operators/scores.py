"""Validation verdicts and scores over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balance(df: DataFrame, legs: str, left: str, right: str) -> DataFrame:
    """``leg, deviation, magnitude`` of two totals per leg."""
    return df.groupBy(F.col(legs).alias("leg")).agg(F.expr(f"sum({left}) - sum({right})").alias("deviation"), F.expr(f"abs(sum({left}))").alias("magnitude"))


def constraint(df: DataFrame, name: str, condition: str) -> DataFrame:
    return df.selectExpr(f"'{name}' AS leg", f"CASE WHEN {condition} THEN 0D ELSE 1D END AS bad").groupBy("leg").agg(F.sum("bad").alias("deviation"), F.count("*").cast("double").alias("magnitude"))


def comparison(df: DataFrame, legs: str, left: str, right: str) -> DataFrame:
    """``leg, deviation, magnitude`` of two columns row by row: how far they differ in all, against the size of the first."""
    return df.groupBy(F.col(legs).alias("leg")).agg(F.expr(f"sum(abs({left} - {right}))").alias("deviation"), F.expr(f"sum(abs({left}))").alias("magnitude"))


def aggregate_check(df: DataFrame, name: str, aggregate: str, expected: float) -> DataFrame:
    """``leg, deviation, magnitude`` of one aggregate against what it should be."""
    return df.agg(F.expr(aggregate).cast("double").alias("x")).selectExpr(f"'{name}' AS leg", f"x - {expected}D AS deviation", f"abs({expected}D) AS magnitude")


def verdict(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The worst leg decides; no rows, or a deviation that is no finite number, is an error."""
    usable = "deviation IS NOT NULL AND NOT isnan(deviation) AND abs(deviation) < double('infinity')"
    one = rows.agg(F.count("*").alias("n"), F.count_if(F.expr(f"NOT ({usable})")).alias("bad"), F.max_by(F.struct("leg", "deviation", "magnitude"), F.struct(F.abs("deviation"), "leg")).alias("w"))
    return one.selectExpr(f"CASE WHEN n = 0 OR bad > 0 THEN 'error' WHEN abs(w.deviation) <= {tolerance} THEN 'passed' ELSE 'failed' END AS status", "w.leg AS leg", "w.deviation AS deviation", "w.magnitude AS magnitude")


def run_summary(checks: DataFrame) -> DataFrame:
    """Counts by status of ``name, status, critical`` rows."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return checks.agg(n("passed"), n("failed"), n("skipped"), n("error"), F.coalesce(F.bool_or(F.expr("critical AND status = 'failed'")), F.lit(False)).alias("critical_failure")).selectExpr("*", "CASE WHEN failed + error > 0 THEN 'failed' WHEN passed > 0 THEN 'passed' ELSE 'skipped' END AS overall")


def severity(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("leg", "least(1D, try_divide(abs(deviation), magnitude)) AS score")


def graded_severity(checks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``leg, score`` of ``leg, deviation, magnitude, critical``: a critical check that fails counts in full."""
    return checks.selectExpr("leg", f"CASE WHEN critical AND abs(deviation) > {tolerance} THEN 1D ELSE least(1D, coalesce(try_divide(abs(deviation), magnitude), 0D)) END AS score")


def kl_surprise(shares: DataFrame) -> DataFrame:
    """1 - 2^-KL of observed ``p`` against reference ``q``."""
    return shares.agg(F.sum(F.expr("CASE WHEN p > 0 THEN p * log2(p / q) ELSE 0 END")).alias("kl")).selectExpr("kl", "1 - pow(2D, -kl) AS score")


def opinion_pool(witnesses: DataFrame) -> DataFrame:
    """Log-linear posterior, conflict and ignorance of ``target, witness, reliability, p array``."""
    long = witnesses.select("target", "witness", "reliability", F.posexplode("p").alias("state", "p")).withColumn("p", F.greatest("p", F.lit(1e-9)))
    states = long.groupBy("target", "state").agg(F.sum(F.expr("reliability * ln(p)")).alias("logit"), F.sum(F.expr("reliability * p")).alias("mix"), F.sum("reliability").alias("weight"))
    norm = states.withColumn("z", F.exp("logit") / F.sum(F.exp("logit")).over(Window.partitionBy("target"))).withColumn("mean", F.col("mix") / F.col("weight"))
    post = norm.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "z"))), lambda s: s.z).alias("posterior"), F.sum(F.expr("-mean * log2(mean)")).alias("h_mean"), F.count("*").alias("k"))
    own = long.groupBy("target").agg((F.sum(F.expr("-reliability * p * log2(p)")) / (F.sum("reliability") / F.count_distinct("state"))).alias("h_own"))
    return post.join(own, "target").selectExpr("target", "posterior", "try_divide(greatest(h_mean - h_own, 0), log2(k)) AS conflict", "h_own / log2(k) AS ignorance")


def expected_loss(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Risk and band of ``target, score`` per intent."""
    return scores.join(weights, "dimension").groupBy("target", "intent").agg(F.least(F.sum(F.expr("weight * score")), F.lit(1.0)).alias("risk")).selectExpr("target", "intent", "risk", "CASE WHEN risk >= 0.6 THEN 'blocked' WHEN risk >= 0.3 THEN 'investigate' ELSE 'ready' END AS band")


def readiness(losses: DataFrame) -> DataFrame:
    """The worst intent of every target."""
    return losses.groupBy("target").agg(F.max("risk").alias("risk"), F.max_by("intent", F.struct("risk", "intent")).alias("worst_intent")).selectExpr("*", "CASE WHEN risk >= 0.6 THEN 'blocked' WHEN risk >= 0.3 THEN 'investigate' ELSE 'ready' END AS band")


def readiness_report(scores: DataFrame, weights: DataFrame, expected: DataFrame) -> DataFrame:
    """Each target's worst intent, its drivers by impact, how much of what was expected is measured, and scores outside all loss tables.

    scores: ``target, dimension, score``.  weights: ``dimension, intent, weight``.  expected: ``target, dimension``.
    """
    losses = expected_loss(scores.join(weights.select("dimension").distinct(), "dimension", "left_semi"), weights)
    worst = readiness(losses)
    impact = scores.join(weights, "dimension").groupBy("target", "dimension").agg(F.max(F.expr("weight * score")).alias("impact"))
    level = "CASE WHEN impact >= 0.6 THEN 'high' WHEN impact >= 0.3 THEN 'medium' ELSE 'low' END"
    drivers = impact.groupBy("target").agg(F.sort_array(F.collect_list(F.struct((-F.col("impact")).alias("k"), F.concat_ws(":", "dimension", F.expr(level)).alias("d")))).alias("all")).select("target", F.array_join("all.d", ",").alias("drivers"))
    seen = expected.join(scores.select("target", "dimension", F.lit(1).alias("hit")), ["target", "dimension"], "left").groupBy("target").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
    coverage = seen.selectExpr("target", "CASE WHEN hits = 0 THEN 'unmeasured' WHEN hits < wanted THEN 'partial' ELSE 'measured' END AS coverage")
    direct = scores.join(weights.select("dimension").distinct(), "dimension", "left_anti").groupBy("target").agg(F.max("score").alias("direct"))
    return coverage.join(worst, "target", "left").join(drivers, "target", "left").join(direct, "target", "left").select("target", "risk", "worst_intent", "band", "drivers", "coverage", "direct")


def evaluate_contracts(scores: DataFrame, contracts: DataFrame, margin: float = 0.2, blocked: DataFrame | None = None) -> DataFrame:
    """``contract, mean, blocking, warnings, compliance, colour, strictest`` over ``column, dimension, score``.

    contracts: ``contract, dimension, threshold, overall``; its dimension stands for all dotted ones below it.  A dimension's mean
    over columns (zero if no column has it) blocks beyond its threshold by twice the margin, and warns from a margin below it;
    further, the mean of all dimensions beyond ``overall`` blocks, and so does any ``blocked`` column (a table of ``column``).
    Compliance is the share of dimensions within their threshold.  Red: a blocked column or three blocks; orange: any block;
    yellow: any warning.  The strictest contract is the one without a block that has the least ``overall`` (ties: the least thresholds in all).
    """
    level = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dimension", "[.]"))), lambda i: F.array_join(F.slice(F.split("dimension", "[.]"), 1, i), ".")))
    per_column = scores.withColumn("above", level).groupBy("above", "column").agg(F.avg("score").alias("score")).groupBy("above").agg(F.avg("score").alias("mean"))
    means = contracts.join(per_column, F.col("dimension") == F.col("above"), "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    beyond, near = F.expr(f"mean > threshold * {1 + 2 * margin}D"), F.expr(f"mean > threshold * {1 - margin}D")
    sums = means.groupBy("contract").agg(F.avg("mean").alias("mean"), F.count_if(beyond).alias("bad"), F.count_if(near & ~beyond).alias("warnings"), F.avg(F.expr("CASE WHEN mean > threshold THEN 0D ELSE 1D END")).alias("compliance"), F.max("overall").alias("overall"), F.sum("threshold").alias("width"))
    any_blocked = scores.sparkSession.range(1).select(F.lit(False).alias("stopped")) if blocked is None else blocked.agg((F.count("column") > 0).alias("stopped"))
    counted = sums.crossJoin(F.broadcast(any_blocked)).withColumn("blocking", F.expr("bad + CAST(mean > overall AS INT) + CAST(stopped AS INT)"))
    out = counted.withColumn("colour", F.expr("CASE WHEN blocking >= 3 OR stopped THEN 'red' WHEN blocking > 0 THEN 'orange' WHEN warnings > 0 THEN 'yellow' ELSE 'green' END"))
    passing = out.where("blocking = 0").agg(F.min_by("contract", F.struct("overall", "width", "contract")).alias("best"))
    return out.crossJoin(F.broadcast(passing)).select("contract", "mean", "blocking", "warnings", "compliance", "colour", F.coalesce(F.col("contract") == F.col("best"), F.lit(False)).alias("strictest"))


def contract(scores: DataFrame, thresholds: DataFrame, margin: float = 0.2) -> DataFrame:
    """Mean score per dimension against its threshold."""
    means = scores.groupBy("dimension").agg(F.avg("score").alias("mean"))
    return means.join(thresholds, "dimension").selectExpr("dimension", "mean", "threshold", f"CASE WHEN mean > threshold * {1 + 2 * margin}D THEN 'blocking' WHEN mean > threshold * {1 - margin}D THEN 'warning' ELSE 'ok' END AS status")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; the new one wins per key."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_age"))).where("_n = 1").drop("_n", "_age")


def current_runs(rows: DataFrame, heads: DataFrame) -> DataFrame:
    return rows.join(heads, ["target", "run_id"], "left_semi")
