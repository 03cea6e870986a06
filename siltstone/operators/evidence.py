"""Scores and labels that weigh evidence about columns, joins, cycles and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.stats import wilson_lower


#: Null shares from which each impact begins.
IMPACTS = {"none": 0.0, "minimal": 0.0, "moderate": 0.05, "significant": 0.2, "critical": 0.5}


def null_impact(df: DataFrame, columns: list[str], impacts: dict[str, float] = IMPACTS) -> DataFrame:
    """Null share of each column and the last impact whose share it reaches, in one scan; only a column without nulls has the first."""
    one = df.selectExpr(*[f"avg(CASE WHEN {c} IS NULL THEN 1D ELSE 0D END) AS c{i}" for i, c in enumerate(columns)])
    rows = one.selectExpr("stack({}, {}) AS (column, score)".format(len(columns), ", ".join(f"'{c}', c{i}" for i, c in enumerate(columns))))
    first, *rest = impacts.items()
    label = reduce(lambda below, step: F.when(F.col("score") >= step[1], F.lit(step[0])).otherwise(below), rest, F.lit(first[0]))
    return rows.withColumn("impact", F.when(F.col("score") == 0, F.lit(first[0])).otherwise(label))


def orphan_rate(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Share of present child keys without a parent; 0 if there is none.  Counts per key, no fan-out."""
    keys = parent.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    per_key = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("fk")).agg(F.count("*").alias("n"))
    found = per_key.join(keys, F.col("fk") == F.col("k"), "left")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("present"), F.coalesce(F.sum(F.expr("CASE WHEN k IS NULL THEN n END")), F.lit(0)).alias("orphans")).selectExpr("present", "orphans", "coalesce(try_divide(orphans, present), 0D) AS score")


def type_fidelity(report: DataFrame) -> DataFrame:
    """The worse of parse failures and quarantined rows of ``column, failed, total, quarantined, rows``."""
    return report.selectExpr("column", "least(1D, greatest(coalesce(try_divide(failed, total), 0D), coalesce(try_divide(quarantined, rows), 0D), 0D)) AS score")


def null_by_slice(df: DataFrame, column: str, slices: list[str], least_expected: float = 5.0) -> DataFrame:
    """Bias-corrected Cramér's V of missing values against each slice column; null where it abstains.

    It abstains under two slices, without any null or any value, and where an expected count is
    under ``least_expected``.
    """
    long = df.select(F.col(column).isNull().cast("long").alias("gone"), F.explode(F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])).alias("x"))
    cells = long.groupBy("x.slice", "x.value").agg(F.count("*").alias("n"), F.sum("gone").alias("gone"))
    totals = cells.groupBy("slice").agg(F.sum("n").alias("total"), F.sum("gone").alias("all_gone"), F.count("*").alias("k"), F.min("n").alias("least_n"), F.sum(F.expr("gone * gone / n")).alias("s1"), F.sum(F.expr("(n - gone) * (n - gone) / n")).alias("s0"))
    usable = f"k >= 2 AND all_gone > 0 AND all_gone < total AND least_n * least(all_gone, total - all_gone) / total >= {least_expected}"
    # Chi-square over n, from the sums of squares per slice.
    phi = "(s1 / all_gone + s0 / (total - all_gone) - 1)"
    v = f"sqrt(greatest(0D, {phi} - (k - 1) / (total - 1D)) / least(1 - 1 / (total - 1D), k - (k - 1) * (k - 1) / (total - 1D) - 1))"
    return totals.selectExpr("slice", f"CASE WHEN {usable} THEN {v} END AS v")


def worst_slices(df: DataFrame, column: str, slices: list[str], top: int = 5, least_expected: float = 5.0) -> DataFrame:
    """The ``top`` slice columns by ``null_by_slice``, each with the slice that misses the largest share of values."""
    long = df.select(F.col(column).isNull().cast("long").alias("gone"), F.explode(F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])).alias("x"))
    shares = long.groupBy("x.slice", "x.value").agg(F.avg("gone").alias("share"), F.count("*").alias("n"))
    worst = shares.groupBy("slice").agg(F.max_by(F.struct("value", "share", "n"), F.struct("share", "n", "value")).alias("w")).select("slice", "w.*")
    ranked = null_by_slice(df, column, slices, least_expected).where("v IS NOT NULL").orderBy(F.desc("v"), "slice").limit(top)
    return ranked.join(worst, "slice").select("slice", "v", "value", "share", "n")


def cycle_health(cycles: DataFrame) -> DataFrame:
    """Composite of ``cycle, completion, passed, run, confidence``.

    0.6 completion + 0.4 pass rate; one alone counts for both; without both, the confidence stands in.
    """
    rate = cycles.withColumn("pass_rate", F.expr("CASE WHEN run > 0 THEN passed / run END"))
    return rate.selectExpr("cycle", "completion", "pass_rate", "CASE WHEN completion IS NOT NULL AND pass_rate IS NOT NULL THEN 0.6D * completion + 0.4D * pass_rate ELSE coalesce(completion, pass_rate, confidence) END AS health")


def cited_values(df: DataFrame, column: str, cited: DataFrame) -> DataFrame:
    """Whether each cited ``value`` occurs in ``column``, and how often."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return cited.select("value").distinct().join(counts, "value", "left").selectExpr("value", "coalesce(n, 0) AS n", "n IS NOT NULL AS present")


def convention_candidates(events: DataFrame, entity: str, period: str, columns: list[str], most: int = 8) -> DataFrame:
    """Sums per entity and period of each event column and of each ordered difference of two."""
    forms = convention_forms(columns, most)
    sums = events.groupBy(F.expr(entity).alias("entity"), F.expr(period).alias("period")).agg(*[F.sum(c).alias(c) for c in columns])
    return sums.selectExpr("entity", "period", "stack({}, {}) AS (convention, m)".format(len(forms), ", ".join(f"'{n}', {e}" for n, e in forms.items())))


def convention_forms(columns: list[str], most: int = 8) -> dict[str, str]:
    """Each event column and each ordered difference of two: its name and its expression."""
    if len(columns) > most:
        raise ValueError(f"at most {most} event columns")
    return {c: c for c in columns} | {f"{a} - {b}": f"{a} - {b}" for a in columns for b in columns if a != b}


def votes(aligned: DataFrame, least_periods: int = 4, most_residual: float = 0.5) -> DataFrame:
    """Residuals and vote per ``convention, entity`` of ``convention, entity, period, y, m`` rows.

    A dead series or anchor, a short one, or two bad fits abstain; the smaller residual wins.
    """
    from pyspark.sql import Window

    step = aligned.withColumn("dy", F.col("y") - F.lag("y").over(Window.partitionBy("convention", "entity").orderBy("period")))
    return votes_of_steps(step, ["convention", "entity"], least_periods, most_residual)


def votes_of_steps(step: DataFrame, keys: list[str], least_periods: int = 4, most_residual: float = 0.5) -> DataFrame:
    """Residuals and vote per ``keys`` of ``y, dy, m`` rows, dy being the change of y since the period before."""
    fit = step.groupBy(*keys).agg(
        F.count("*").alias("periods"),
        F.sum(F.abs("y")).alias("size_y"),
        F.sum(F.abs("m")).alias("size_m"),
        F.expr("try_divide(sum(abs(y - m)), sum(abs(m)))").alias("r_flow"),
        F.expr("try_divide(sum(abs(dy - m)), sum(CASE WHEN dy IS NOT NULL THEN abs(m) END))").alias("r_stock"),
    )
    fires = f"periods >= {least_periods} AND size_y > 0 AND size_m > 0 AND least(r_flow, r_stock) <= {most_residual}"
    return fit.selectExpr(*keys, "periods", "r_flow", "r_stock", f"CASE WHEN {fires} THEN CASE WHEN r_flow IS NULL OR r_stock < r_flow THEN 'cumulative' ELSE 'per_period' END END AS vote")


def support(voted: DataFrame, least_voters: int = 2, least_agreement: float = 0.8, family: str | None = None) -> DataFrame:
    """Verdict per convention, and the Wilson bound of its winning votes over the entities of all of them - of those of the same ``family``, an expression over ``convention``."""
    if family is not None:
        of = F.expr(family)
        sizes = voted.groupBy(of.alias("family")).agg(F.count_distinct("entity").alias("n_all"))
        entities = voted.select("convention").distinct().withColumn("family", of).join(sizes, "family").select(F.col("convention").alias("own"), "n_all")
    else:
        entities = voted.agg(F.count_distinct("entity").alias("n_all"))
    sums = voted.groupBy("convention").agg(F.count("*").alias("entities"), F.count("vote").alias("voters"), F.count_if(F.expr("vote = 'per_period'")).alias("flow"), F.count_if(F.expr("vote = 'cumulative'")).alias("stock"))
    both = (sums.crossJoin(F.broadcast(entities)) if family is None else sums.join(entities, F.col("convention") == F.col("own"))).withColumn("hits", F.greatest("flow", "stock"))
    ok = f"voters >= {least_voters} AND hits / voters >= {least_agreement}"
    return both.withColumn("lower", F.greatest(F.lit(0.0), wilson_lower("hits", "n_all"))).selectExpr("convention", "entities", "voters", f"CASE WHEN {ok} THEN CASE WHEN flow >= stock THEN 'per_period' ELSE 'cumulative' END END AS pattern", f"CASE WHEN {ok} THEN hits / entities END AS match_rate", "lower")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` of every pair of columns in one scan, rows complete in the pair; null where one does not vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    var = lambda x, y: f"var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END)"
    one = df.selectExpr(*[f"try_divide(covar_pop({a}, {b}), sqrt({var(a, b)} * {var(b, a)})) AS r{i}" for i, (a, b) in enumerate(pairs)])
    return one.selectExpr("stack({}, {}) AS (a, b, r)".format(len(pairs), ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs))))


def multicollinearity(df: DataFrame, columns: list[str], share: float = 0.5) -> DataFrame:
    """``dimension, eigenvalue, condition_index, severity, members``: weak dimensions and who takes part.

    One scan on the cluster; only the matrix of correlations, one row per pair of columns, is
    decomposed on the driver.  Members are columns with over ``share`` of their variance in a
    dimension whose condition index passes 30.
    """
    import numpy as np

    place = {c: i for i, c in enumerate(columns)}
    matrix = np.eye(len(columns))
    for a, b, r in correlations(df, columns).collect():
        matrix[place[a], place[b]] = matrix[place[b], place[a]] = r if r is not None and r == r else 0.0
    values, vectors = np.linalg.eigh(matrix)
    size = np.maximum(np.abs(values), 1e-10)
    parts = vectors**2 / size
    parts /= parts.sum(1, keepdims=True)
    rows = []
    for d in np.argsort(-values):
        index = float(np.sqrt(values.max() / size[d]))
        members = [c for c in columns if index > 30 and parts[place[c], d] > share]
        rows.append((len(rows), float(values[d]), index, "severe" if index >= 30 else "moderate" if index >= 10 else "none", members if len(members) > 1 else []))
    return df.sparkSession.createDataFrame(rows, "dimension int, eigenvalue double, condition_index double, severity string, members array<string>")


def slice_candidates(profile: DataFrame, excluded: list[str], most_null: float = 0.5, most_unique: float = 0.9) -> DataFrame:
    """Columns fit to slice by, of ``column, total, nulls, distinct_values``; null counts as one value."""
    ok = f"distinct_values + CASE WHEN nulls > 0 THEN 1 ELSE 0 END >= 2 AND nulls <= {most_null} * total AND distinct_values < {most_unique} * total"
    return profile.where(ok).where(~F.col("column").isin(excluded)).select("column", "distinct_values", "nulls")


def profile_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.selectExpr("count(*) AS total", *[f"count({c}) AS n{i}" for i, c in enumerate(columns)], *[f"count(DISTINCT {c}) AS d{i}" for i, c in enumerate(columns)])
    return one.selectExpr("stack({}, {}) AS (column, total, nulls, distinct_values)".format(len(columns), ", ".join(f"'{c}', total, total - n{i}, d{i}" for i, c in enumerate(columns))))


def chain_edges(edges: DataFrame) -> DataFrame:
    """``a, b`` edges that lie on no cycle and that no longer path implies, whatever the length of either."""
    from siltstone.operators.graph import reachable, strong_components

    e = edges.where("a <> b").select("a", "b").distinct()
    groups = strong_components(e)
    side = lambda key: groups.select(F.col("node").alias(key), F.col("grp").alias(f"grp_{key}"))
    free = e.join(side("a"), "a", "left").join(side("b"), "b", "left").where("NOT coalesce(grp_a = grp_b, false)").select("a", "b")
    implied = free.select("a", F.col("b").alias("mid")).join(reachable(free).select(F.col("a").alias("mid"), "b"), "mid").select("a", "b").distinct()
    return free.join(implied, ["a", "b"], "left_anti")


def cyclic_groups(edges: DataFrame) -> DataFrame:
    """``node, grp``: nodes that reach each other, by their smallest one; cycles of any length."""
    from siltstone.operators.graph import strong_components

    return strong_components(edges)


def graph_shape(degrees: DataFrame, topology: DataFrame) -> DataFrame:
    """``v, e, c, ends, top, shape`` of a graph from the ``degree`` of its nodes and its ``topology``.

    Without circuits each component is a tree, so the whole is a forest: one component is a star if one node
    touches all others, a path if no node has more than two neighbours, else a tree.  With circuits it is a
    clique if every pair is joined, a ring if it is one component in which every node has two neighbours, else a net.
    """
    counts = degrees.agg(F.count_if(F.col("degree") == 1).alias("ends"), F.coalesce(F.max("degree"), F.lit(0)).alias("top"), F.coalesce(F.min("degree"), F.lit(0)).alias("least"))
    without = "CASE WHEN c > 1 THEN 'forest' WHEN top = v - 1 AND v > 3 THEN 'star' WHEN top <= 2 THEN 'path' ELSE 'tree' END"
    within = "CASE WHEN 2 * e = v * (v - 1) THEN 'clique' WHEN c = 1 AND least = 2 AND top = 2 THEN 'ring' WHEN c = 1 THEN 'net' ELSE 'nets' END"
    return topology.crossJoin(F.broadcast(counts)).selectExpr("v", "e", "c", "ends", "top", f"CASE WHEN v = 0 THEN 'empty' WHEN e = 0 THEN 'points' WHEN circuit_rank = 0 THEN {without} ELSE {within} END AS shape")
