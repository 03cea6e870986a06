"""Witnesses for and against a statement about data, pooled into one belief."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far each kind of witness is trusted, as parameters of the functions below.
NULL_TOKEN = {"cluster": 0.5, "type": 0.6, "vocabulary": 0.9}
BEHAVIOUR = {"claim": 0.6, "data": 0.9}
FORMULA = {"discovery": 0.9, "hypothesis": 0.6, "declaration": 0.875}
RELATION = {"overlap": 0.7, "judgement": 0.7, "manual": 0.9, "kept": 0.5}


def binary_pool(witnesses: DataFrame) -> DataFrame:
    """``target, belief, conflict, witnesses`` of ``target, reliability, p``: log-linear pool of yes against no.

    Conflict is the entropy that the mixed opinion has beyond that of the witnesses themselves.  A witness
    whose p is null abstains; a target with none has belief one half.
    """
    clipped = witnesses.withColumn("p", F.expr("CASE WHEN p IS NOT NULL THEN greatest(least(p, 1 - 1e-9D), 1e-9D) END"))
    h = lambda x: f"-({x} * log2({x}) + (1 - {x}) * log2(1 - {x}))"
    one = clipped.groupBy("target").agg(
        F.expr("coalesce(sum(reliability * ln(p / (1 - p))), 0D)").alias("odds"), F.expr("sum(CASE WHEN p IS NOT NULL THEN reliability END)").alias("weight"),
        F.expr("sum(reliability * p)").alias("mixed"), F.expr(f"sum(reliability * {h('p')})").alias("own"), F.count("p").alias("witnesses"),
    )
    mean = one.withColumn("mean", F.expr("try_divide(mixed, weight)"))
    return mean.selectExpr("target", "1D / (1D + exp(-odds)) AS belief", f"coalesce(greatest({h('mean')} - try_divide(own, weight), 0D), 0D) AS conflict", "witnesses")


def _witness(rows: DataFrame, reliability: float, p: str) -> DataFrame:
    return rows.selectExpr("target", f"{reliability}D AS reliability", f"cast({p} AS double) AS p")


def null_tokens(tokens: DataFrame, trust: dict[str, float] = NULL_TOKEN) -> DataFrame:
    """Belief that a rejected token stands for a missing value, of ``target, n, rejected, looks_typed, known``.

    A token that makes up much of what a column rejects, does not look like a value of the column's type, and
    is a known placeholder, is one.
    """
    parts = [("cluster", "0.5D + 0.5D * n / rejected"), ("type", "CASE WHEN looks_typed THEN 0.2D ELSE 0.7D END"), ("vocabulary", "CASE WHEN known THEN 0.95D ELSE 0.3D END")]
    rows = [_witness(tokens, trust[name], p) for name, p in parts]
    return binary_pool(rows[0].unionByName(rows[1]).unionByName(rows[2])).withColumn("is_null", F.col("belief") > 0.5)


def stock_or_flow(claims: DataFrame, reconciled: DataFrame, trust: dict[str, float] = BEHAVIOUR) -> DataFrame:
    """Belief that a measure is a flow, from ``target, claim, confidence`` and ``target, pattern, lower``; data overrule a claim that differs."""
    said = _witness(claims, trust["claim"], "CASE claim WHEN 'flow' THEN 0.5D + confidence / 2 WHEN 'stock' THEN 0.5D - confidence / 2 END")
    seen = _witness(reconciled, trust["data"], "CASE pattern WHEN 'per_period' THEN 0.5D + lower / 2 WHEN 'cumulative' THEN 0.5D - lower / 2 END")
    pool = binary_pool(said.unionByName(seen))
    both = pool.join(claims.select(F.col("target").alias("t1"), "claim"), F.col("target") == F.col("t1"), "left").join(reconciled.select(F.col("target").alias("t2"), "pattern"), F.col("target") == F.col("t2"), "left")
    found = "CASE pattern WHEN 'per_period' THEN 'flow' WHEN 'cumulative' THEN 'stock' END"
    return both.selectExpr("target", "belief", "conflict", f"coalesce({found}, claim) AS behaviour", f"coalesce({found} <> claim, false) AS overruled")


def derived_formulas(formulas: DataFrame, trust: dict[str, float] = FORMULA) -> DataFrame:
    """``column, score`` of ``column, formula, rate, hypothesis, declared``: the worse of the mismatch of a column's likeliest formula and the conflict about it."""
    keyed = formulas.withColumn("target", F.struct("column", "formula"))
    rows = [_witness(keyed, trust["discovery"], "rate"), _witness(keyed, trust["hypothesis"], "hypothesis"), _witness(keyed, trust["declaration"], "CASE WHEN declared THEN 0.95D END")]
    pool = binary_pool(rows[0].unionByName(rows[1]).unionByName(rows[2]))
    best = pool.join(keyed.select("target", "rate"), "target").groupBy("target.column").agg(F.max_by(F.struct("target.formula", "belief", "rate", "conflict"), F.struct("belief", "target.formula")).alias("b"))
    return best.selectExpr("column", "b.formula", "b.belief", "greatest(coalesce(1 - b.rate, 0D), b.conflict) AS score")


def relationships(joins: DataFrame, trust: dict[str, float] = RELATION) -> DataFrame:
    """Belief that a join is genuine, of ``target, score, confidence, judgement, manual, kept``; a null is a witness who is absent."""
    parts = [("overlap", "0.5D + (score - 0.5D) * confidence"), ("judgement", "judgement"), ("manual", "CASE WHEN manual THEN 0.98D WHEN NOT manual THEN 0.02D END"), ("kept", "CASE WHEN kept THEN 0.8D END")]
    rows = [_witness(joins, trust[name], p) for name, p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return binary_pool(out).withColumn("genuine", F.col("belief") >= 0.5)


def tier_capped(evidence: DataFrame) -> DataFrame:
    """``target, score`` of failed checks ``target, tier, reliability``: seed checks add up, of generated ones only the strongest counts."""
    sums = evidence.groupBy("target").agg(F.expr("coalesce(sum(CASE WHEN tier = 'seed' THEN reliability END), 0D)").alias("seed"), F.expr("coalesce(max(CASE WHEN tier <> 'seed' THEN reliability END), 0D)").alias("other"))
    return sums.selectExpr("target", "seed", "other", "least(1D, seed + other) AS score")


def declaration_scores(columns: DataFrame) -> DataFrame:
    """``column, dimension, score`` of ``column, type, role, unit, unit_confidence, unit_source, name_confidence``.

    A time role on another type, a measure without a unit's source, and doubt about a unit or a name count.
    """
    return columns.selectExpr(
        "column",
        "inline(array("
        "struct('time' AS dimension, CASE WHEN role = 'timestamp' AND type NOT IN ('DATE', 'TIMESTAMP') THEN 1D ELSE 0D END AS score), "
        "struct('unit' AS dimension, CASE WHEN unit IS NULL THEN 0D ELSE 1 - unit_confidence END AS score), "
        "struct('unit_source' AS dimension, CASE WHEN role = 'measure' AND unit IS NULL AND unit_source IS NULL THEN 1D ELSE 0D END AS score), "
        "struct('naming' AS dimension, 1 - coalesce(name_confidence, 0D) AS score)))",
    )
