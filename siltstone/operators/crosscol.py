"""Relations between columns: formulas, association, functional dependencies."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.stats import chi2_tail
from siltstone.operators.permutations import pair_tables

FORMULAS = {"sum": "{a} + {b}", "product": "{a} * {b}", "difference": "{a} - {b}", "ratio": "try_divide({a}, {b})"}


def _counters(target: str, formula: str, tolerance: float) -> tuple[str, str]:
    usable = f"{target} IS NOT NULL AND {target} <> 0 AND {formula} IS NOT NULL"
    return f"count_if({usable})", f"count_if({usable} AND abs({target} - ({formula})) < {tolerance})"


def formula_match(df: DataFrame, target: str, formula: str, tolerance: float = 0.01) -> DataFrame:
    """Rows on which ``target`` equals ``formula``, of those where both exist and the target is not zero."""
    total, hits = _counters(target, formula, tolerance)
    return df.selectExpr(f"{total} AS total", f"{hits} AS matched").selectExpr("total", "matched", "try_divide(matched, total) AS rate")


def find_derived(df: DataFrame, columns: list[str], min_rate: float = 0.8, tolerance: float = 0.01, targets: list[str] | None = None, at_once: int = 12) -> DataFrame:
    """All ``target = a op b`` over ``columns``, ``at_once`` of them per scan; the best formula per set of columns.

    Over a view of a fact and its dimensions, ``targets`` names the fact's columns: only those can be derived.
    """
    asked = []
    for target in targets or columns:
        for a, b in combinations([c for c in columns if c != target], 2):
            for rank, (op, shape) in enumerate(FORMULAS.items()):
                for x, y in [(a, b), (b, a)] if op in ("difference", "ratio") else [(a, b)]:
                    asked.append((f"'{target}', '{x}', '{op}', '{y}', {rank}", *_counters(target, shape.format(a=x, b=y), tolerance)))
    # So many formulas fit into one compiled aggregate.
    parts = []
    for start in range(0, len(asked), at_once):
        own = asked[start : start + at_once]
        one = df.selectExpr(*[f"{x} AS c{2 * i + k}" for i, (_, *both) in enumerate(own) for k, x in enumerate(both)])
        parts.append(one.selectExpr("stack({}, {}) AS (target, a, op, b, op_rank, total, matched)".format(len(own), ", ".join(f"{n}, c{2 * i}, c{2 * i + 1}" for i, (n, *_) in enumerate(own)))))
    rows = reduce(DataFrame.unionByName, parts)
    rated = rows.withColumn("rate", F.expr("try_divide(matched, total)")).where(F.col("rate") >= min_rate)
    best = Window.partitionBy(F.array_sort(F.array("target", "a", "b"))).orderBy(F.desc("rate"), "op_rank", "target", "a")
    return rated.withColumn("n", F.row_number().over(best)).where("n = 1").select("target", "a", "op", "b", "rate")


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """Chi-square, degrees of freedom, its p-value and Cramér's V of two columns, nulls left out.

    A table of two by two is corrected for continuity.  With under ``least`` rows, or a column of one value, there is no
    association to tell: chi-square, V and p are null.
    """
    cells = pair_counts(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    # Empty cells add their expectation, so the sum over full cells of n^2 / (na * nb) is enough.  Of two by two, all cells are as far off.
    joint = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.expr("n * n / (na * nb)")).alias("s"), F.sum("n").alias("total"), F.max(F.struct("na", "nb", "n")).alias("one"))
    sizes = rows.agg(F.count("*").alias("r")).crossJoin(F.broadcast(cols.agg(F.count("*").alias("c"))))
    off = "abs(one.n - one.na * one.nb / total)"
    corrected = f"CASE WHEN r = 2 AND c = 2 AND {off} > 0 THEN total * (s - 1) * pow(({off} - least(0.5D, {off})) / {off}, 2) ELSE total * (s - 1) END"
    tested = f"total >= {least} AND least(r, c) > 1"
    out = joint.crossJoin(F.broadcast(sizes)).selectExpr("total", f"CASE WHEN {tested} THEN greatest(0D, {corrected}) END AS chi2", "(r - 1) * (c - 1) AS df", "least(r, c) - 1 AS smaller")
    rated = out.selectExpr("total", "chi2", "df", "sqrt(chi2 / (total * smaller)) AS v").withColumn("p_value", chi2_tail("chi2", "df"))
    return rated.withColumn("strength", F.expr("CASE WHEN v >= 0.5 THEN 'strong' WHEN v >= 0.3 THEN 'moderate' WHEN v >= 0.1 THEN 'weak' ELSE 'none' END"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies in bits and mutual information over the smaller of them; nulls are a value."""
    cells = pair_counts(df, a, b)
    entropy = lambda x, name: x.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias(name))
    parts = entropy(cells.groupBy("a").agg(F.sum("n").alias("n")), "h_a").crossJoin(entropy(cells.groupBy("b").agg(F.sum("n").alias("n")), "h_b")).crossJoin(entropy(cells, "h_ab"))
    return parts.selectExpr("h_a", "h_b", "h_a + h_b - h_ab AS mi", "try_divide(h_a + h_b - h_ab, least(h_a, h_b)) AS nmi", "try_divide(h_a + h_b - h_ab, h_b) AS fraction_of_information")


def most_informative(df: DataFrame, target: str, columns: list[str], top: int = 5) -> DataFrame:
    """The ``top`` columns by the share of ``target``'s information that they hold, and whether it is more than nothing."""
    parts = [mutual_information(df, c, target).select(F.lit(c).alias("column"), "mi", "nmi", "fraction_of_information") for c in columns]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("informs", F.coalesce(F.col("mi") > 1e-9, F.lit(False))).orderBy(F.desc_nulls_last("fraction_of_information"), "column").limit(top)


def dependent_pairs(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """``a, b, mi, nmi``: the ``top`` pairs of ``columns`` by normalised mutual information (over the geometric mean of both entropies).

    A number only says whether it is there and not zero, so that a pair tells of presence and not of size; of other
    columns null is a label of its own.  All pairs are counted in one shuffle; a constant column informs nothing.
    Pairs that agree to twelve digits, beyond which sums are uncertain, come by name.
    """
    kinds = dict(df.dtypes)
    number = lambda t: t.startswith(("decimal", "tinyint", "smallint", "int", "bigint", "float", "double"))
    labels = df.select(*[F.coalesce(F.col(f"`{c}`") != 0, F.lit(False)).cast("string").alias(c) if number(kinds[c]) else F.col(f"`{c}`") for c in columns])
    tables = pair_tables(labels, list(combinations(columns, 2)), set(columns))
    entropy = lambda side: f"(ln(n) - aggregate({side}, 0D, (s, x) -> s + x.times * x.count * ln(x.count)) / n) / ln(2)"
    parts = tables.where("n > 0").selectExpr("a", "b", f"{entropy('a_counts')} AS h_a", f"{entropy('b_counts')} AS h_b", "(ln(n) - information / n) / ln(2) AS h_ab", "d_a", "d_b")
    scored = parts.selectExpr("a", "b", "greatest(0D, h_a + h_b - h_ab) AS mi", "CASE WHEN d_a > 1 AND d_b > 1 THEN greatest(0D, h_a + h_b - h_ab) / sqrt(h_a * h_b) ELSE 0D END AS nmi")
    return scored.orderBy(F.desc(F.round("nmi", 12)), "a", "b").limit(top)


def coverage_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """How complete the columns of a dimension are, on average and at worst, over the rows of a view."""
    return null_share(df, columns).agg(F.avg(1 - F.col("null_share")).alias("mean_coverage"), F.min(1 - F.col("null_share")).alias("least_coverage"))


def null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    stacked = ", ".join(f"'{c}', c{i}" for i, c in enumerate(columns))
    return df.selectExpr(*[f"avg(CASE WHEN {c} IS NULL THEN 1D ELSE 0D END) AS c{i}" for i, c in enumerate(columns)]).selectExpr(f"stack({len(columns)}, {stacked}) AS (column, null_share)")


def distinct_scan(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Distinct values of columns and of pairs, nulls counted, by one grouping of long rows."""
    text = lambda c: f"CAST(`{c}` AS STRING)"
    parts = [f"'{c}', {text(c)}, CAST(NULL AS STRING)" for c in columns] + [f"'{a},{b}', {text(a)}, {text(b)}" for a, b in pairs]
    return df.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (columns, x, y)").distinct().groupBy("columns").agg(F.count("*").alias("distinct_values"))


def dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """How well ``a`` determines ``b``: g3 error, Goodman-Kruskal lambda, rows outside the majority."""
    cells = pair_counts(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    kept = cells.groupBy("a").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg(F.sum("top").alias("kept"), F.sum("n").alias("total"))
    mode = cells.groupBy("b").agg(F.sum("n").alias("nb")).agg(F.max("nb").alias("mode"))
    return kept.crossJoin(F.broadcast(mode)).selectExpr("total", "1 - kept / total AS g3", "CASE WHEN total > mode THEN (kept - mode) / (total - mode) END AS lambda", "total - kept AS minority")


def benjamini_hochberg(p_values: DataFrame, name: str, p: str, q: float = 0.05, parts: int = 1024) -> DataFrame:
    """Which tests of a family pass at false-discovery rate ``q``.

    Ranks are counted within equal ranges of p; only the ``parts`` range totals are added up in one place.
    """
    cut = p_values.select(name, p, F.least(F.floor(F.col(p) * parts), F.lit(parts - 1)).alias("part"))
    sizes = cut.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("part").alias("b_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("m"))
    ranked = cut.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(p, name))).join(F.broadcast(before), F.col("part") == F.col("b_part")).select(name, p, (F.col("before") + F.col("own")).alias("rank"), "m")
    last = ranked.where(F.expr(f"{p} <= {q}D * rank / m")).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("last"))
    return ranked.crossJoin(F.broadcast(last)).select(name, p, "rank", (F.col("rank") <= F.col("last")).alias("significant"))


def variance_reduction(df: DataFrame, measure: str, dim: str, min_rows: int = 200) -> DataFrame:
    """Share of a measure's variance between the groups of ``dim`` that have enough rows."""
    own = F.col(measure).cast("double")
    groups = df.where(F.col(dim).isNotNull() & F.col(measure).isNotNull()).groupBy(dim).agg(F.count("*").alias("n"), F.avg(own).alias("mean"), F.var_pop(own).alias("var")).where(F.col("n") >= min_rows)
    # Means and variances of groups merge without loss; their means are taken from the middle of all groups.
    centre = groups.agg(F.avg("mean").alias("centre"))
    total = groups.crossJoin(F.broadcast(centre)).withColumn("d", F.col("mean") - F.col("centre")).agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.expr("n * var")).alias("within"), F.sum(F.expr("n * d")).alias("s"), F.sum(F.expr("n * d * d")).alias("ss"))
    return total.selectExpr("groups", "n", "CASE WHEN groups > 1 THEN try_divide(ss - s * s / n, within + ss - s * s / n) END AS eta2")


def slice_effects(df: DataFrame, measure: str, dim: str, min_rows: int = 200) -> DataFrame:
    base = df.agg(F.avg(measure).alias("base"))
    groups = df.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.count(measure).alias("n"), F.avg(measure).alias("mean")).where(F.col("n") >= min_rows)
    return groups.crossJoin(F.broadcast(base)).selectExpr(dim, "n", "mean", "try_divide(mean, base) - 1 AS effect")


def guarded_effects(df: DataFrame, measure: str, dim: str, min_rows: int = 200, least: float = 0.05) -> DataFrame:
    """``slice_effects``, but none at all where the baseline is under ``least`` standard deviations: a ratio to it would mean nothing."""
    near_zero = df.agg(F.coalesce(F.abs(F.avg(measure)) < least * F.stddev_pop(measure), F.lit(True)).alias("near_zero"))
    return slice_effects(df, measure, dim, min_rows).crossJoin(F.broadcast(near_zero)).where("NOT near_zero").drop("near_zero")


def entity_rows(df: DataFrame, entity: str, measure: str, dim: str, key: str) -> DataFrame:
    """One row per entity with its sum, weight and the first non-null ``dim`` by ``key``."""
    return df.groupBy(entity).agg(F.sum(measure).alias("total"), F.count(measure).alias("weight"), F.min_by(dim, F.when(F.col(dim).isNotNull(), F.col(key))).alias("dim"))


def home_entities(df: DataFrame, entities: list[str], dims: list[str]) -> DataFrame:
    """``dim, home`` of each dimension: the coarsest entity within which it is constant, null if there is none.

    A dimension that is one to one with an entity only renames it and is left out.
    """
    parts = []
    for e in entities:
        per = df.where(F.col(e).isNotNull()).groupBy(e).agg(*[F.count_distinct(d).alias(f"n_{d}") for d in dims], *[F.max(d).cast("string").alias(f"v_{d}") for d in dims])
        one = per.agg(F.count("*").alias("size"), *[F.max(f"n_{d}").alias(f"n_{d}") for d in dims], *[F.count_distinct(f"v_{d}").alias(f"v_{d}") for d in dims])
        stacked = ", ".join(f"'{d}', n_{d}, v_{d}" for d in dims)
        parts.append(one.selectExpr(f"'{e}' AS entity", "size", f"stack({len(dims)}, {stacked}) AS (dim, most, values)"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fits = F.expr("most <= 1 AND values < size")
    out = every.groupBy("dim").agg(F.min_by(F.when(fits, F.col("entity")), F.when(fits, F.struct("size", "entity"))).alias("home"), F.bool_or(F.expr("most <= 1 AND values = size")).alias("renames"))
    return out.where("NOT renames").select("dim", "home")


def null_gate(df: DataFrame, measure: str, dim: str, least: float = 0.5) -> DataFrame:
    """Slices whose measure is observed at less than ``least`` times the overall rate are dropped."""
    base = df.agg((F.count(measure) / F.count("*")).alias("base"))
    return df.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.count("*").alias("n"), (F.count(measure) / F.count("*")).alias("observed")).crossJoin(F.broadcast(base)).selectExpr(dim, "n", "observed", f"observed >= {least}D * base AS kept")


def entity_collapse(df: DataFrame, entity: str, measure: str, dim: str) -> DataFrame:
    return df.groupBy(entity).agg(F.sum(measure).alias("total"), F.count(measure).alias("weight"), F.min(dim).alias("dim"))


def entity_constancy(df: DataFrame, entity: str, dims: list[str]) -> DataFrame:
    """Whether each dimension has one value within every entity."""
    per = df.groupBy(entity).agg(*[F.count_distinct(d).alias(d) for d in dims])
    return per.selectExpr(f"stack({len(dims)}, {', '.join(f'{chr(39)}{d}{chr(39)}, {d}' for d in dims)}) AS (dim, n)").groupBy("dim").agg(F.max("n").alias("most"), (F.max("n") <= 1).alias("constant"))


def within_entity_residual(df: DataFrame, entity: str, measure: str, key: list[str]) -> DataFrame:
    means = df.groupBy(F.col(entity).alias("e")).agg(F.avg(measure).alias("mean"))
    return df.join(means, F.col(entity) == F.col("e")).select(*key, (F.col(measure) - F.col("mean")).alias("residual"))
