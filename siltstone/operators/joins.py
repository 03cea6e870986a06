"""Finding, measuring and using joins between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from siltstone.sources.scratch import stored


def family(dtype) -> str | None:
    """Type family for joins; booleans and nested types join nothing."""
    if isinstance(dtype, BooleanType):
        return None
    for name, kinds in (("numeric", NumericType), ("string", StringType), ("temporal", (DateType, TimestampType, TimestampNTZType))):
        if isinstance(dtype, kinds):
            return name
    return None


def join_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of the values of all joinable columns: ``table, column, family, value, n``."""
    parts = []
    for name, df in tables.items():
        cols = [(f.name, family(f.dataType)) for f in df.schema.fields if family(f.dataType)]
        kind = {"numeric": "cast(cast(`{0}` AS decimal(38,6)) AS string)", "string": "`{0}`", "temporal": "cast(cast(`{0}` AS timestamp_ntz) AS string)"}
        cells = ", ".join(f"'{c}', '{f}', {kind[f].format(c)}" for c, f in cols)
        parts.append(df.selectExpr(f"'{name}' AS table", f"stack({len(cols)}, {cells}) AS (column, family, value)").where("value IS NOT NULL").groupBy("table", "column", "family", "value").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def join_statistics(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table", "column", "family").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("non_null")).withColumn("uniqueness", F.col("distinct_values") / F.col("non_null"))


def _with_sides(pairs: DataFrame, stats: DataFrame, max_ratio: float, key_at: float) -> DataFrame:
    """Pairs ``a, b`` of columns with ``d_*``, ``u_*`` and cardinality; of very unequal ones only those whose larger side is a key."""
    side = lambda s: stats.select(F.struct("table", "column").alias(s), F.col("distinct_values").alias(f"d_{s}"), F.col("uniqueness").alias(f"u_{s}"))
    out = pairs.join(F.broadcast(side("a")), "a").join(F.broadcast(side("b")), "b")
    larger_is_key = F.expr(f"CASE WHEN d_a >= d_b THEN u_a ELSE u_b END >= {key_at}")
    cardinality = F.expr(f"concat(CASE WHEN u_a >= {key_at} THEN '1' ELSE 'n' END, ':', CASE WHEN u_b >= {key_at} THEN '1' ELSE CASE WHEN u_a >= {key_at} THEN 'n' ELSE 'm' END END)")
    return out.where((F.expr(f"greatest(d_a, d_b) / least(d_a, d_b) <= {max_ratio}")) | larger_is_key).withColumn("cardinality", cardinality)


def _named(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("table", "column")], *more)


def _exact_pairs(cells: DataFrame, stats: DataFrame, min_score: float, max_ratio: float, key_at: float, within: bool) -> DataFrame:
    live = cells.join(F.broadcast(stats.select("table", "column")), ["table", "column"])
    per_value = live.groupBy("family", "value").agg(F.sort_array(F.collect_set(F.struct("table", "column"))).alias("at")).where(F.size("at") > 1)
    pairs = per_value.select(F.explode("at").alias("a"), "at").select("a", F.explode("at").alias("b")).where("a < b" if within else "a < b AND a.table <> b.table").groupBy("a", "b").agg(F.count("*").alias("shared"))
    contained = F.expr(f"greatest(CASE WHEN u_b >= {key_at} AND shared / d_a >= 0.95 THEN shared / d_a ELSE 0 END, CASE WHEN u_a >= {key_at} AND shared / d_b >= 0.95 THEN shared / d_b ELSE 0 END)")
    return _with_sides(pairs, stats, max_ratio, key_at).withColumn("score", F.greatest(F.expr("shared / (d_a + d_b - shared)"), contained)).where(F.col("score") >= min_score)


def find_joins(tables: dict[str, DataFrame], min_score: float = 0.5, max_ratio: float = 100, key_at: float = 0.95, within: bool = True) -> DataFrame:
    """Column pairs by shared values: Jaccard, or containment in a key; also pairs ``within`` one table.

    All pairs are counted at once: one equi-join on values.  A value's columns are collected
    first - at most as many as the tables have - so a common value costs column pairs, not row pairs.
    """
    cells = join_cells(tables)
    stats = join_statistics(cells).where("distinct_values > 1")
    return _named(_exact_pairs(cells, stats, min_score, max_ratio, key_at, within), "shared", "score", "cardinality")


def permuted(x: str, y: str, size: int) -> list[str]:
    """SQL of so many hashes of a value, of the first and the second 28 bits of its digest."""
    prime = (1 << 31) - 1
    return [f"(({pow(16807, 7 * i + 1, prime)} * {x} + {pow(48271, 5 * i + 3, prime)} * {y}) % {prime})" for i in range(size)]


def find_joins_adaptive(tables: dict[str, DataFrame], estimate_from: int = 1_000_000, min_score: float = 0.5, max_ratio: float = 100, key_at: float = 0.95, within: bool = True, size: int = 128) -> DataFrame:
    """``find_joins`` that estimates pairs with a column of at least ``estimate_from`` distinct values, with ``algorithm`` and ``confidence``.

    The values of such a column are hashed once and never meet another column's: of each column only
    ``size`` minima are joined, place by place, and the share of equal ones estimates the Jaccard
    score (the confidence is one less its standard error).  Containment cannot be told from minima,
    so a small column inside a large key is found by ``find_joins`` alone.
    """
    cells = join_cells(tables)
    stats = join_statistics(cells).where("distinct_values > 1")
    exact = _exact_pairs(cells, stats.where(F.col("distinct_values") < estimate_from), min_score, max_ratio, key_at, within)
    # Only types that have a large column at all need minima.
    asked = stats.join(F.broadcast(stats.where(F.col("distinct_values") >= estimate_from).select("family").distinct()), "family", "left_semi")
    digest = "md5(concat(family, ':', value))"
    hashed = cells.join(F.broadcast(asked.select("table", "column")), ["table", "column"]).selectExpr("family", "table", "column", f"cast(conv(substr({digest}, 1, 7), 16, 10) AS bigint) AS x", f"cast(conv(substr({digest}, 8, 7), 16, 10) AS bigint) AS y")
    minima = hashed.groupBy("family", "table", "column").agg(F.array(*[F.expr(f"min({h})") for h in permuted("x", "y", size)]).alias("minima"))
    places = minima.select("family", F.struct("table", "column").alias("at"), F.posexplode("minima").alias("place", "least"))
    met = places.withColumnRenamed("at", "a").join(places.withColumnRenamed("at", "b"), ["family", "place", "least"]).where("a < b" if within else "a < b AND a.table <> b.table")
    score = F.col("same") / size
    estimated = _with_sides(met.groupBy("a", "b").agg(F.count("*").alias("same")), stats, max_ratio, key_at).where(F.greatest("d_a", "d_b") >= estimate_from).withColumn("score", score).where(score >= min_score)
    error = F.when(score < 1, F.sqrt(score * (1 - score) / size)).otherwise(1 / size**0.5)
    ends = ("score", "cardinality", "algorithm", "confidence")
    return _named(exact.withColumns({"algorithm": F.lit("exact"), "confidence": F.lit(1.0)}), *ends).unionByName(_named(estimated.withColumns({"algorithm": F.lit("minhash"), "confidence": 1 - error}), *ends))


def min_hashes(df: DataFrame, column: str, size: int = 128) -> DataFrame:
    """One row of ``size`` minima, each under another seed, in one aggregate."""
    return df.where(F.col(column).isNotNull()).agg(F.array(*[F.min(F.xxhash64(F.lit(i), F.col(column).cast("string"))) for i in range(size)]).alias("minima"))


def estimated_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select(F.col("minima").alias("x")).crossJoin(F.broadcast(b.select(F.col("minima").alias("y"))))
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return both.select((same / F.size("x")).alias("jaccard"), (1 - 1 / F.sqrt(F.size("x"))).alias("confidence"))


def direction_metrics(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Integrity by rows and by distinct keys from ``left`` to ``right``; no fan-out, one join."""
    keys = right.where(F.col(right_key).isNotNull()).select(F.col(right_key).alias("k")).distinct().withColumn("hit", F.lit(True))
    per_key = left.where(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("lk")).count().join(keys, F.col("lk") == F.col("k"), "left")
    return per_key.agg(F.sum("count").alias("total"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("count"))), F.lit(0)).alias("matched"), F.count("*").alias("keys"), F.count("hit").alias("matched_keys")).selectExpr("total", "total - matched AS orphans", "100 * try_divide(matched, total) AS integrity_pct", "100 * try_divide(matched_keys, keys) AS coverage_pct")


def both_directions(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``direction_metrics`` from either side, as ``direction`` forward and backward."""
    forward = direction_metrics(left, right, left_key, right_key).select(F.lit("forward").alias("direction"), "*")
    return forward.unionByName(direction_metrics(right, left, right_key, left_key).select(F.lit("backward").alias("direction"), "*"))


def evaluate_candidates(tables: dict[str, DataFrame], candidates: list[tuple[str, str, str, str]]) -> DataFrame:
    """Every candidate ``(table, column, table, column)`` with its metrics both ways, measured cardinality and
    fan-out, in one plan; the pair of highest integrity, then coverage, speaks for its two tables."""
    parts = []
    for a, x, b, y in candidates:
        left, right = tables[a], tables[b]
        there = direction_metrics(left, right, x, y).selectExpr("integrity_pct", "orphans", "coverage_pct")
        back = direction_metrics(right, left, y, x).selectExpr("integrity_pct AS back_integrity_pct", "orphans AS back_orphans")
        shape = measured_cardinality(left, right, [x], [y]).select("cardinality")
        trap = fan_trap(left, right, x, y).select("multiplies")
        one = there.crossJoin(F.broadcast(back)).crossJoin(F.broadcast(shape)).crossJoin(F.broadcast(trap))
        parts.append(one.select(F.lit(a).alias("table_a"), F.lit(x).alias("column_a"), F.lit(b).alias("table_b"), F.lit(y).alias("column_b"), "*"))
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy(F.sort_array(F.array("table_a", "table_b"))).orderBy(F.desc_nulls_last("integrity_pct"), F.desc_nulls_last("coverage_pct"), "column_a", "column_b")
    return every.withColumn("best", F.row_number().over(order) == 1)


def spread(df: DataFrame, keys: list[str], rows: int, each: int = 1 << 20) -> DataFrame:
    """``df`` of about so many ``rows`` by ``keys``, in as many parts as keep ``each`` rows to a task, however large it is."""
    return df.repartition(max(1, -(-rows // each)), *keys)


def measured_cardinality(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], rows: int | None = None) -> DataFrame:
    """Most matches each way, from counts per key; the join itself is never made.

    Both sides are counted in one aggregate; with the number of their ``rows`` in parts of bounded size.
    """
    on = [f"k{i}" for i in range(len(left_keys))]
    side = lambda df, keys, *ones: df.dropna(subset=keys).select(*[F.col(k).alias(n) for k, n in zip(keys, on, strict=True)], *[F.lit(x).cast("long").alias(n) for x, n in zip(ones, ("l", "r"), strict=True)])
    both = side(left, left_keys, 1, 0).unionByName(side(right, right_keys, 0, 1))
    counts = (both if rows is None else spread(both, on, rows)).groupBy(*on).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).where("n_left > 0 AND n_right > 0")
    return counts.agg(F.max("n_left").alias("max_left"), F.max("n_right").alias("max_right")).selectExpr("max_left", "max_right", "concat(CASE WHEN max_left = 1 THEN '1' ELSE 'n' END, ':', CASE WHEN max_right = 1 THEN '1' WHEN max_left = 1 THEN 'n' ELSE 'm' END) AS cardinality")


def join_coverage(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    found = left.join(right.select(F.col(right_key).alias("k")).distinct(), F.col(left_key) == F.col("k"), "left")
    return found.agg(F.count("*").alias("total"), F.count("k").alias("covered")).selectExpr("total", "covered", "covered / total AS coverage")


def fan_trap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows before and after a left join, from key counts."""
    counts = right.groupBy(F.col(right_key).alias("k")).agg(F.count("*").alias("n"))
    per = left.groupBy(left_key).agg(F.count("*").alias("rows")).join(counts, F.col(left_key) == F.col("k"), "left")
    return per.agg(F.sum("rows").alias("before"), F.sum(F.expr("rows * coalesce(n, 1)")).alias("after")).selectExpr("before", "after", "after > before AS multiplies")


def surrogate_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """``_sk__a__b``: md5 of the keys joined by a bar; null if any is null."""
    parts = [F.col(k).cast("string") for k in keys]
    joined = reduce(lambda a, b: F.concat(a, F.lit("|"), b), parts)
    return df.withColumn("_sk__" + "__".join(keys), F.md5(joined))


def composite_key(left: DataFrame, right: DataFrame, first: tuple[str, str], more: list[tuple[str, str]], most: int = 4) -> tuple[list[tuple[str, str]], str]:
    """Add column pairs until a side of the join is unique; tests only the few given pairs.

    The columns of each side are written once, whatever made them.
    """
    chosen, rest = [first], list(more)
    own, others = ([p[i] for p in (first, *more)] for i in (0, 1))
    same = left is right
    left = stored(left.select(*dict.fromkeys(own + others if same else own)))
    right = left if same else stored(right.select(*dict.fromkeys(others)))
    rows = left.count() + right.count()
    worst = lambda pairs: measured_cardinality(left, right, [a for a, _ in pairs], [b for _, b in pairs], rows).first()
    now = worst(chosen)
    while now["cardinality"] == "n:m" and rest and len(chosen) < most:
        options = [(worst([*chosen, x]), x) for x in rest]
        now, best = min(options, key=lambda o: (min(o[0]["max_left"] or 0, o[0]["max_right"] or 0), o[1]))
        chosen.append(best)
        rest.remove(best)
    return chosen, now["cardinality"]


def composite_coverage(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` with all key columns present, those with a partner on all ``pairs``, and their share."""
    keys = right.select(*[F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(pairs)]).dropna().distinct().withColumn("hit", F.lit(True))
    asked = left.dropna(subset=[a for a, _ in pairs]).groupBy(*[F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(pairs)]).agg(F.count("*").alias("n"))
    found = asked.join(keys, [f"k{i}" for i in range(len(pairs))], "left")
    return found.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("covered")).selectExpr("total", "covered", "try_divide(covered, total) AS coverage")


def mint_both(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a composite join with one surrogate key, named after the left columns."""
    name = "_sk__" + "__".join(a for a, _ in pairs)
    mint = lambda df, keys: df.withColumn(name, F.md5(reduce(lambda a, b: F.concat(a, F.lit("|"), b), [F.col(k).cast("string") for k in keys])))
    return mint(left, [a for a, _ in pairs]), mint(right, [b for _, b in pairs])


def grain_safe(fact: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``fk, repeated, kept`` per dimension: how many of the fact's rows a join would repeat; such a dimension is not kept."""
    parts = []
    for fk, (dim, key) in dims.items():
        rows = repeated_keys(fact, dim, fk, key).agg(F.coalesce(F.sum("fact_rows"), F.lit(0)).alias("repeated"))
        parts.append(rows.select(F.lit(fk).alias("fk"), "repeated", (F.col("repeated") == 0).alias("kept")))
    return reduce(DataFrame.unionByName, parts)


def resolved_paths(pairs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``ambiguous_paths`` with how many of them are ``confirmed``; one alone resolves the choice."""
    key = lambda df: df.select(F.least("table_a", "table_b").alias("one"), F.greatest("table_a", "table_b").alias("other"), F.sort_array(F.array(F.concat_ws(".", "table_a", "column_a"), F.concat_ws(".", "table_b", "column_b"))).alias("path")).distinct()
    sure = key(confirmed).groupBy("one", "other").agg(F.count("*").alias("confirmed"))
    return ambiguous_paths(pairs).join(sure, ["one", "other"], "left").selectExpr("one", "other", "paths", "coalesce(confirmed, 0) AS confirmed", "coalesce(confirmed = 1, false) AS resolved")


def enrich(fact: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left joins of dimensions by fact column: ``{fk: (dimension, key)}`` gives ``fk__attribute`` columns.

    A dimension with repeated keys is left out, as it would change the grain.  Whether one is broadcast is left
    to Spark, which knows its bytes when the join runs.
    """
    out = fact
    for fk, (dim, key) in dims.items():
        if dim.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").take(1):
            continue
        side = dim.where(F.col(key).isNotNull()).select(*[F.col(c).alias(f"{fk}__{c}") for c in dim.columns])
        out = out.join(side, out[fk] == side[f"{fk}__{key}"], "left").drop(f"{fk}__{key}")
    return out


def repeated_keys(fact: DataFrame, dim: DataFrame, fk: str, key: str) -> DataFrame:
    """Fact keys whose dimension rows repeat: what would change the grain."""
    twice = dim.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("dim_rows")).where("dim_rows > 1")
    return fact.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("fact_rows")).join(twice, "k")


def riding(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` with a partner."""
    return left.join(right.select(F.col(right_key).alias("k")).distinct(), F.col(left_key) == F.col("k"), "left_semi")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def override_relationships(found: DataFrame, rejected: DataFrame, added: DataFrame) -> DataFrame:
    """Drop rejected pairs, whichever side comes first, and add confirmed ones."""
    key = lambda a, b: F.sort_array(F.array(a, b))
    out = found.withColumn("k", key("a", "b")).join(rejected.select(key("a", "b").alias("k")), "k", "left_anti")
    new = added.withColumn("k", key("a", "b")).join(out.select("k"), "k", "left_anti")
    return out.unionByName(new, allowMissingColumns=True).drop("k")


def measured_additions(tables: dict[str, DataFrame], added: list[tuple[str, str]]) -> DataFrame:
    """``a, b`` joins that a user adds, as ``table.column``, each measured both ways like a found one."""
    split = [(*a.split(".", 1), *b.split(".", 1)) for a, b in added]
    out = evaluate_candidates(tables, split)
    return out.select(F.concat_ws(".", "table_a", "column_a").alias("a"), F.concat_ws(".", "table_b", "column_b").alias("b"), "integrity_pct", "back_integrity_pct", "cardinality")


def ambiguous_paths(pairs: DataFrame) -> DataFrame:
    """Table pairs that more than one column pair joins."""
    return pairs.groupBy(F.least("table_a", "table_b").alias("one"), F.greatest("table_a", "table_b").alias("other")).agg(F.count_distinct(F.struct("column_a", "column_b")).alias("paths")).where("paths > 1")


def full_join_null_safe(parts: list[DataFrame], dims: list[str]) -> DataFrame:
    """Grouped results side by side; nulls in dimensions meet nulls."""
    out = parts[0]
    for i, part in enumerate(parts[1:]):
        right = part.withColumnsRenamed({d: f"r{i}_{d}" for d in dims})
        on: Column = reduce(lambda a, b: a & b, [out[d].eqNullSafe(right[f"r{i}_{d}"]) for d in dims])
        joined = out.join(right, on, "full")
        out = joined.select(*[F.coalesce(d, f"r{i}_{d}").alias(d) for d in dims], *[c for c in joined.columns if c not in dims and not c.startswith(f"r{i}_")])
    return out
