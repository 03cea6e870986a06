"""What drives a measure: targets, gains, permutation gate, greedy tree and the ranked list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.crosscol import entity_constancy, variance_reduction, within_entity_residual
from siltstone.sources.scratch import stored

#: Rows of a group that counts, permutations, and the share of the usual rate at which a group's value must be observed.
MIN_ROWS, PERMUTATIONS, LEAST_OBSERVED = 200, 500, 0.5
#: Rows of a hash-ordered sample; bits by which its cut-off is found at a time, and rows of the range that is ordered.
SAMPLE_ROWS, RANGE_BITS, RANGE_ROWS = 200_000, 12, 10_000


def weighted_reduction(df: DataFrame, top: str, bottom: str, dim: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Share of the variance of the ratio ``top / bottom``, weighted by ``bottom``, between the groups of ``dim``."""
    rows = df.where(F.col(dim).isNotNull() & F.col(top).isNotNull() & (F.col(bottom) > 0))
    # What the overall ratio explains goes first, so that large ratios leave no digits lost.
    centre = df.where(F.col(top).isNotNull() & (F.col(bottom) > 0)).agg((F.sum(top) / F.sum(bottom)).alias("centre"))
    rest = rows.crossJoin(F.broadcast(centre)).withColumn("rest", F.expr(f"{top} - centre * {bottom}"))
    groups = rest.groupBy(dim).agg(F.count("*").alias("n"), F.sum(bottom).alias("w"), F.sum("rest").alias("s"), F.sum(F.expr(f"rest * rest / {bottom}")).alias("ss")).where(F.col("n") >= min_rows)
    total = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.expr("s * s / w")).alias("between"))
    return total.selectExpr("groups", "n", "CASE WHEN groups > 1 THEN try_divide(between - s * s / w, ss - s * s / w) END AS gain")


def target(df: DataFrame, kind: str, measure: str, bottom: str | None = None, entity: str | None = None, keep_missing: bool = False) -> DataFrame:
    """``df`` with the ``value`` that a kind of target explains and its ``weight``.

    flow and stock: the measure itself (a flow adds up, a stock averages: see ``target_statistic``);
    ratio: measure over ``bottom``, weighted by it; entity_mean: one row per entity; residual_ratio: the
    ratio less that of the entity.  Rows without a value are left out unless ``keep_missing``.
    """
    ratio = F.when(F.col(bottom) > 0, F.col(measure) / F.col(bottom)) if bottom else None
    if kind in ("flow", "stock"):
        out = df.withColumns({"value": F.col(measure).cast("double"), "weight": F.lit(1.0)})
    elif kind == "ratio":
        out = df.withColumns({"value": ratio, "weight": F.col(bottom).cast("double")})
    elif kind == "entity_mean":
        out = df.groupBy(entity).agg(F.avg(measure).alias("value"), F.count(measure).cast("double").alias("weight"))
    elif kind == "residual_ratio":
        own = df.where(F.col(measure).isNotNull() & (F.col(bottom) > 0)).groupBy(F.col(entity).alias("e_")).agg((F.sum(measure) / F.sum(bottom)).alias("own_"))
        out = df.join(own, F.col(entity) == F.col("e_")).withColumns({"value": ratio - F.col("own_"), "weight": F.col(bottom).cast("double")}).drop("e_", "own_")
    else:
        raise ValueError(f"no target of kind {kind!r}")
    return out if keep_missing else out.where("value IS NOT NULL")


def target_statistic(rows: DataFrame, kind: str) -> DataFrame:
    """What a slice of a target comes to: a flow's sum, else the weighted mean."""
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("v") if kind == "flow" else F.expr("try_divide(sum(value * weight), sum(weight))").alias("v"))


def collapse_aliases(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """``column, rank`` candidates with one column per alias group ``column, representative``: the best-ranked stands, under the group's name."""
    named = candidates.join(groups, "column", "left").select(F.coalesce("representative", "column").alias("name"), "column", "rank")
    return named.groupBy("name").agg(F.min_by("column", F.struct("rank", "column")).alias("column"), F.min("rank").alias("rank"), F.count("*").alias("members"))


def hash_sample(df: DataFrame, columns: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` rows in the order of a hash of ``columns``: the same ones whatever the partitions.

    Rows per range of hashes tell in which range the last row lies; it is cut again until it holds at most ``RANGE_ROWS``
    rows or a single hash.  Smaller hashes are all taken, only that range is ordered, as different rows with counts.
    """
    keyed = df.select(*columns).withColumn("h_", F.xxhash64(*[F.col(c).cast("string") for c in columns]))
    bits, taken, inside = 64, 0, F.lit(True)
    while True:
        bits = max(0, bits - RANGE_BITS)
        part = F.shiftright("h_", bits)
        sizes = keyed.where(inside).groupBy(part.alias("part")).count().orderBy("part").collect()
        at = None
        for at in sizes:
            if taken + at["count"] >= rows:
                break
            taken += at["count"]
        else:
            return keyed.orderBy("h_", *columns).drop("h_")
        inside = part == at["part"]
        if at["count"] <= RANGE_ROWS or bits == 0:
            break
    same = keyed.where(inside).groupBy("h_", *columns).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("h_", *columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = same.withColumn("take_", F.least(F.col("n_"), F.lit(rows - taken) - before)).where("take_ > 0").withColumn("i_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("take_"))))
    return keyed.where(part < at["part"]).unionByName(last.drop("n_", "take_", "i_")).orderBy("h_", *columns).drop("h_")


def driver_cells(df: DataFrame, dims: list[str]) -> DataFrame:
    """One row per combination of ``dims`` (as text): rows, rows with a value, and their sums of weight and value.

    ``u, v, q`` are the sums of ``w``, ``w y`` and ``w y^2``, ``uu, uv, vv`` those of products of the first two, with y the value less
    the overall mean, so that no digits are lost.  All gains and tests are sums over these cells.
    """
    centre = df.where("value IS NOT NULL").agg(F.expr("coalesce(try_divide(sum(value * weight), sum(weight)), 0D)").alias("centre"))
    rows = df.select("value", "weight", *dims).crossJoin(F.broadcast(centre)).selectExpr(*[f"CAST(`{d}` AS STRING) AS `{d}`" for d in dims], "value IS NOT NULL AS seen", "CASE WHEN value IS NOT NULL THEN CAST(weight AS DOUBLE) END AS w_", "CASE WHEN value IS NOT NULL THEN weight * (value - centre) END AS wy_", "value - centre AS y_")
    sums = {"u": "w_", "v": "wy_", "q": "wy_ * y_", "uu": "w_ * w_", "uv": "w_ * wy_", "vv": "wy_ * wy_"}
    return rows.groupBy(*dims).agg(F.count("*").alias("rows"), F.count_if("seen").alias("n"), *[F.expr(f"coalesce(sum({e}), 0D)").alias(k) for k, e in sums.items()])


_SUMS = ("u", "v", "q")


def _long(cells: DataFrame, dims: list[str]) -> DataFrame:
    """A row per node, cell and dimension that the node's path has not used."""
    pairs = ", ".join(f"'{d}', `{d}`" for d in dims)
    keyed = cells.withColumn("cell", F.xxhash64(*dims))
    return keyed.selectExpr("node", "used", "cell", "rows", "n", *_SUMS, f"stack({len(dims)}, {pairs}) AS (dim, value)").where("value IS NOT NULL AND NOT array_contains(used, dim)").drop("used")


def _kept_groups(long: DataFrame, min_rows: int, least_observed: float) -> DataFrame:
    """Groups with enough rows whose value is not missing far more often than elsewhere in the dimension."""
    groups = long.groupBy("node", "dim", "value").agg(*[F.sum(c).alias(c) for c in ("rows", "n", *_SUMS)])
    usual = groups.groupBy(F.col("node").alias("node_"), F.col("dim").alias("dim_")).agg((F.sum("n") / F.sum("rows")).alias("usual"))
    return groups.join(usual, F.expr("node = node_ AND dim = dim_")).where((F.col("n") >= min_rows) & (F.col("n") >= least_observed * F.col("usual") * F.col("rows"))).select("node", "dim", "value", "n", *_SUMS)


def _gains(kept: DataFrame) -> DataFrame:
    """Variance reduction per node and dimension with at least two groups."""
    total = kept.groupBy("node", "dim").agg(F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in _SUMS], F.sum(F.expr("try_divide(v * v, u)")).alias("between"))
    gain = F.expr("coalesce(CASE WHEN q - try_divide(v * v, u) > 0 THEN greatest(0D, (between - v * v / u) / (q - v * v / u)) END, 0D)")
    return total.where("groups > 1").select("node", "dim", gain.alias("gain"))


def driver_gains(df: DataFrame, dims: list[str], min_rows: int = MIN_ROWS, least_observed: float = LEAST_OBSERVED) -> DataFrame:
    """``dim, gain``: the share of the variance of ``value`` (weighted by ``weight``) between the groups of each dimension, over all rows.

    Groups under ``min_rows`` observed rows are left out of both sides, as are those whose value is observed at under
    ``least_observed`` times the rate of the dimension's rows.  A dimension with fewer than two groups gains nothing.
    """
    cells = driver_cells(df, dims).withColumns({"node": F.lit(""), "used": F.array().cast("array<string>")})
    names = df.sparkSession.createDataFrame([(d,) for d in dims], "name string")
    return names.join(_gains(_kept_groups(_long(cells, dims), min_rows, least_observed)), F.col("name") == F.col("dim"), "left").select(F.col("name").alias("dim"), F.coalesce("gain", F.lit(0.0)).alias("gain"))


def _gate(cells: DataFrame, dims: list[str], min_rows: int, draws: int, least_observed: float) -> DataFrame:
    """``node, dim, gain, p, n`` of every dimension with two groups or more in every node of ``cells``.

    Under a shuffle of the rows of a node the sums of all groups together follow, by the limit theorem for
    permutations, a normal law whose covariance is that of the shuffle itself: rows shared by two groups make
    it up.  It is drawn by giving each cell noise of the variance of its rows and adding up cells; what
    the noise of the whole node comes to is taken off.  The noise is a hash of cell and draw, so that all
    dimensions see the same one and nothing depends on partitions.
    """
    long = _long(cells, dims)
    kept = stored(_kept_groups(long, min_rows, least_observed))
    sums = cells.groupBy("node").agg(*[F.sum(c).alias(f"node_{c}") for c in ("n", *_SUMS, "uu", "uv", "vv")])
    mean = "coalesce(try_divide(node_v, node_u), 0D)"
    node = sums.selectExpr(
        "node AS node_", "node_n", "node_u / node_n AS mean_u", f"node_q - {mean} * node_v AS spread",
        f"greatest(0D, node_vv - 2 * {mean} * node_uv + {mean} * {mean} * node_uu) / greatest(1, node_n - 1) AS c_ee",
        f"(node_uv - {mean} * node_uu) / greatest(1, node_n - 1) AS c_eu", "greatest(0D, node_uu - node_u * node_u / node_n) / greatest(1, node_n - 1) AS c_uu",
    ).selectExpr("node_", "node_n", "mean_u", "spread", "sqrt(c_ee) AS l11", "coalesce(try_divide(c_eu, sqrt(c_ee)), 0D) AS l21", "sqrt(greatest(0D, c_uu - coalesce(try_divide(c_eu * c_eu, c_ee), 0D))) AS l22")
    uniform = lambda i: f"(shiftrightunsigned(xxhash64(cell, draw, {i}), 11) + 0.5D) / 9007199254740992D"

    def noise(rows: DataFrame, *groups: str) -> DataFrame:
        drawn = rows.where("n > 0").select(*groups, "cell", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        polar = drawn.selectExpr(*groups, "draw", f"sqrt(-2 * n * ln({uniform(1)})) AS radius", f"{uniform(2)} * 2 * pi() AS angle")
        return polar.groupBy(*groups, "draw").agg(F.sum(F.expr("radius * cos(angle)")).alias("a"), F.sum(F.expr("radius * sin(angle)")).alias("b"))

    groups = noise(long.join(kept.select("node", "dim", "value"), ["node", "dim", "value"]), "node", "dim", "value")
    whole = noise(cells.withColumn("cell", F.xxhash64(*dims)), "node").select(F.col("node").alias("whole"), F.col("draw").alias("whole_draw"), F.col("a").alias("all_a"), F.col("b").alias("all_b"))
    moved = (
        groups.join(kept.select("node", "dim", "value", F.col("n").alias("n_g")), ["node", "dim", "value"]).join(node, F.expr("node = node_")).join(whole, F.expr("node = whole AND draw = whole_draw"))
        .selectExpr("node", "dim", "draw", "n_g", "node_n", "spread", "mean_u", "l11", "l21", "l22", "a - n_g / node_n * all_a AS a", "b - n_g / node_n * all_b AS b")
        .selectExpr("node", "dim", "draw", "n_g", "spread * n_g / node_n AS q", "l11 * a AS e", "greatest(n_g * mean_u / 100, n_g * mean_u + l21 * a + l22 * b) AS w")
    )
    of_draw = moved.groupBy("node", "dim", "draw").agg(F.count("*").alias("groups"), F.sum("q").alias("q"), F.sum("e").alias("e"), F.sum("w").alias("w"), F.sum(F.expr("e * e / w")).alias("between")).where("groups > 1")
    best = stored(of_draw.groupBy("node", "draw").agg(F.max(F.expr("coalesce(try_divide(between - e * e / w, q - e * e / w), 0D)")).alias("best")))
    tested = _gains(kept).join(best.select(F.col("node").alias("best_node"), "best"), F.expr("node = best_node")).groupBy("node", "dim", "gain").agg(((F.count_if(F.col("best") >= F.col("gain")) + 1) / (F.count("*") + 1)).alias("p"))
    return tested.join(node.selectExpr("node_", "node_n AS n"), F.expr("node = node_")).select("node", "dim", "gain", "p", "n")


def permutation_gate(df: DataFrame, dims: list[str], min_rows: int = MIN_ROWS, permutations: int = PERMUTATIONS, least_observed: float = LEAST_OBSERVED) -> DataFrame:
    """``dim, gain, p``: each dimension's gain on ``value`` and how often the greatest gain of any dimension is as large by chance.

    Gains are those of ``driver_gains``, over all rows.  Draws follow the law of sums under a shuffle (see ``_gate``), with its exact
    means and covariances; it is close to normal for groups of ``min_rows`` rows unless a few rows make up most of the variance.
    p counts the data as one draw; a dimension with fewer than two groups has p = 1.
    """
    cells = stored(driver_cells(df, dims)).withColumns({"node": F.lit(""), "used": F.array().cast("array<string>")})
    names = df.sparkSession.createDataFrame([(d,) for d in dims], "name string")
    tested = _gate(cells, dims, min_rows, permutations, least_observed)
    return names.join(tested, F.col("name") == F.col("dim"), "left").select(F.col("name").alias("dim"), F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("p", F.lit(1.0)).alias("p"))


def driver_tree(df: DataFrame, dims: list[str], depth: int = 2, alpha: float = 0.05, min_rows: int = MIN_ROWS, split_rows: int | None = None, permutations: int = PERMUTATIONS, least_observed: float = LEAST_OBSERVED) -> DataFrame:
    """``path, depth, dim, gain, p, n``: the best significant dimension of the whole, then of its large values, and so on.

    ``df`` has ``value`` and ``weight``.  A value is split further with ``split_rows`` rows or more (four times
    ``min_rows``); a dimension must pass alpha / (depth + 1).  All nodes of a depth are tested at once, on the cells of
    ``driver_cells``, so jobs grow with the depth and not with the nodes.
    """
    least = split_rows or 4 * min_rows
    cells = stored(driver_cells(df, dims).withColumns({"node": F.lit(""), "used": F.array().cast("array<string>")}))
    found: list[DataFrame] = []
    for level in range(depth):
        passed = _gate(cells, dims, min_rows, permutations, least_observed).where((F.col("gain") > 0) & (F.col("p") <= alpha / (level + 1)))
        best = stored(passed.groupBy("node").agg(F.max(F.struct("gain", "dim", "p", "n")).alias("s")).select("node", "s.*"))
        found.append(best.select(F.col("node").alias("path"), F.lit(level).alias("depth"), "dim", "gain", "p", "n"))
        if level + 1 == depth or best.isEmpty():
            break
        split = best.select(F.col("node").alias("node_"), F.col("dim").alias("by"))
        chosen = F.coalesce(*[F.when(F.col("by") == d, F.col(d)) for d in dims])
        inside = stored(cells.join(split, F.expr("node = node_")).withColumn("at", chosen).where("at IS NOT NULL"))
        large = _kept_groups(inside.select("node", F.col("by").alias("dim"), F.col("at").alias("value"), "rows", "n", *_SUMS), least, least_observed)
        step = F.concat(F.col("by"), F.lit(" = "), F.col("at"))
        below = inside.join(large.select(F.col("node").alias("large"), F.col("value").alias("large_at")), F.expr("node = large AND at = large_at"))
        cells = stored(below.withColumns({"node": F.when(F.col("node") == "", step).otherwise(F.concat("node", F.lit(" > "), step)), "used": F.array_append("used", F.col("by"))}).select(*cells.columns))
    return reduce(DataFrame.unionByName, found)


def one_per_alias(dims: list[str], aliases: DataFrame | None) -> list[str]:
    """``dims`` with one column per alias group ``column, representative``: the representative if it is a candidate, else the first by name."""
    if aliases is None:
        return dims
    # One row per column of the table.
    group = {r["column"]: r["representative"] for r in aliases.collect()}
    kept = {}
    for d in sorted(dims, key=lambda d: (group.get(d, d) != d, d)):
        kept.setdefault(group.get(d, d), d)
    return [d for d in dims if d in kept.values()]


def rank_drivers(df: DataFrame, measure: str, dims: list[str], entity: str | None = None, key: list[str] | None = None, icc_at: float = 0.3, alpha: float = 0.05, min_rows: int = MIN_ROWS, permutations: int = PERMUTATIONS, aliases: DataFrame | None = None, least_observed: float = LEAST_OBSERVED) -> DataFrame:
    """``list, family, rank, dim, gain, p, verdict`` of every dimension.

    Where most of a measure's variance lies between entities, dimensions that are constant within an entity
    explain entity means and come first; the others explain what is left within entities.  Otherwise rows are
    explained as they are.  Of columns that say the same (``aliases``: ``column, representative``) one takes part, and groups
    in which the measure is mostly missing do not count.  Dimensions that no group of enough rows, or no significance, supports abstain.
    """
    dims = one_per_alias(dims, aliases)
    plain = target(df, "flow", measure, keep_missing=True)
    families: list[tuple[str, DataFrame, list[str], int]] = []
    if entity and ((variance_reduction(plain, measure, entity, 2).first()["eta2"] or 0.0) >= icc_at):
        constant = {r["dim"] for r in entity_constancy(plain, entity, dims).where("constant").collect()}
        of_entity = [d for d in dims if d in constant]
        if of_entity:
            per = plain.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.avg(measure).alias("value"), F.count(measure).cast("double").alias("weight"), *[F.min(d).alias(d) for d in of_entity])
            families.append(("entity", per, of_entity, max(2, min_rows // 20)))
        inner = [d for d in dims if d not in constant]
        if inner:
            rest = within_entity_residual(plain, entity, measure, [*(key or []), *inner]).withColumns({"value": F.col("residual"), "weight": F.lit(1.0)})
            families.append(("row", rest, inner, min_rows))
    else:
        families.append(("row", plain, dims, min_rows))
    parts = []
    for place, (family, rows, own, least) in enumerate(families):
        gate = permutation_gate(rows, own, least, permutations, least_observed)
        parts.append(gate.select(F.lit("primary" if place == 0 else "secondary").alias("list"), F.lit(family).alias("family"), "dim", "gain", "p"))
    verdict = F.expr(f"CASE WHEN gain <= 0 THEN 'too few rows' WHEN p > {alpha} THEN 'not significant' ELSE 'driver' END")
    every = reduce(DataFrame.unionByName, parts).withColumn("verdict", verdict)
    order = Window.partitionBy("list").orderBy(F.expr("verdict <> 'driver'"), F.desc("gain"), "dim")
    return every.select("list", "family", F.row_number().over(order).alias("rank"), "dim", "gain", "p", "verdict")
