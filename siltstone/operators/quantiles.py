"""Exact quantiles from value counts, without one task that holds all values of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import stored

#: Different values that a task orders, and bits of the number of ranges of a column at most.
RANGE_VALUES, MOST_BITS = 1 << 16, 14


def value_counts(rows: DataFrame) -> DataFrame:
    """``column, value, n`` of ``column, value`` rows."""
    return rows.groupBy("column", "value").agg(F.count("*").alias("n"))


def range_bits(values: int, range_values: int | None = None) -> int:
    """Bits of the number of ranges that hold about ``range_values`` of so many values each."""
    return min(MOST_BITS, max(0, -(-values // (range_values or RANGE_VALUES)) - 1).bit_length())


def exact_quantiles(rows: DataFrame, shares: list[float], range_values: int | None = None) -> DataFrame:
    """``column, q``: interpolated quantiles of the non-null values of each column, one per share."""
    return counted_quantiles(stored(value_counts(rows)), shares, range_values)


def counted_quantiles(counts: DataFrame, shares: list[float], range_values: int | None = None) -> DataFrame:
    """As ``exact_quantiles``, of ``column, value, n``, which is read more than once: pass a written table.

    A bounded sketch cuts a column's values into ranges of about ``range_values`` different ones; only the number of values of the largest
    column reaches the driver.  Ranges are counted; only those that hold a wanted rank are ordered, each on its own.
    """
    counts = counts.where(F.col("value").isNotNull() & ~F.isnan("value"))
    bits = range_bits(counts.groupBy("column").count().agg(F.max("count")).first()[0] or 0, range_values)
    counts = counts.withColumn("part", F.lit(0))
    if bits:
        at = ", ".join(f"{i / 2**bits}D" for i in range(1, 2**bits))
        known = stored(counts.groupBy(F.col("column").alias("c_column")).agg(F.expr(f"percentile_approx(value, array({at}), {20 * 2**bits})").alias("cuts")))
        counts = counts.join(known, F.col("column") == F.col("c_column"))
        for bit in reversed(range(bits)):
            counts = counts.withColumn("part", F.expr(f"part + CASE WHEN value > cuts[part + {2**bit - 1}] THEN {2**bit} ELSE 0 END"))
    counts = counts.select("column", "value", "n", "part")
    before = F.sum("n").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.groupBy("column", "part").agg(F.sum("n").alias("n")).select("column", "part", "n", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("column")).alias("total"))
    wanted = sums.select("*", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("place", "share")).withColumn("h", F.expr("(total - 1) * share"))
    wanted = wanted.select("column", "part", "n", "before", "place", F.expr("h - floor(h)").alias("rest"), F.explode(F.expr("array(struct(0 AS side, floor(h) AS rank), struct(1 AS side, ceil(h) AS rank))")).alias("r"))
    wanted = wanted.where("r.rank >= before AND r.rank < before + n").select(F.col("column").alias("w_column"), F.col("part").alias("w_part"), "before", "place", "rest", "r.side", "r.rank")
    # At most two wanted ranks per column and share.
    asked = wanted.groupBy("w_column", "w_part").agg(F.first("before").alias("before"), F.collect_list(F.struct("place", "rest", "side", "rank")).alias("ranks"))
    inside = counts.join(asked, F.expr("column = w_column AND part = w_part"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("column", "part").orderBy("value"))
    hits = inside.withColumn("upto", upto).select("column", "value", "n", "upto", F.inline("ranks")).where("rank < upto AND rank >= upto - n")
    each = hits.groupBy("column", "place").agg(F.max(F.expr("CASE WHEN side = 0 THEN value END")).alias("lo"), F.max(F.expr("CASE WHEN side = 1 THEN value END")).alias("hi"), F.first("rest").alias("rest"))
    return each.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("place", F.expr("lo + (hi - lo) * rest").alias("v")))).alias("all")).select("column", F.col("all.v").alias("q"))
