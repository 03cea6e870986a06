"""Permutation tests from margins: what a shuffle of one column does to a table of two columns depends on their value counts only.

Statistics of a pair of columns are sums over the cells of their contingency table.  If one column is shuffled, the
table is a random one with the same margins, so it is drawn as such and no row is needed.  Names of values do not matter
either: a margin is the list of its counts, each with the number of values that have it, at most about
``sqrt(2 * rows)`` entries.  Only these leave the aggregate, as one row per pair, and draws are dealt over the cluster.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import stored

#: Draws, draws of a block, and hits from which a pair is given up after the block.
DRAWS, BLOCK, STOP_AT = 2999, 100, 20
#: Cells of a table per row up to which it is drawn margin by margin; else rows are shuffled, so many at a time.
DENSE, PART_ROWS = 4, 1 << 22
#: Totals from which the library's sampler is not defined.
MOST_TOTAL = 10**9


def pair_tables(df: DataFrame, pairs: list[tuple[str, str]], null_is_value: set[str] | None = None) -> DataFrame:
    """One row per pair of columns: sizes of both margins and of their table, and what the two say about each other.

    ``a, b, n, d_a, d_b, d_ab, kept_ab, kept_ba, mode_a, mode_b, information, association, a_counts, b_counts``; kept_ab: rows whose
    ``b`` is the commonest of their ``a``.  Rows with a null in either column are left out, but for columns in
    ``null_is_value`` (default: none), where null is a value.  All pairs are counted in one shuffle.
    """
    as_value = null_is_value or set()
    text = lambda c: f"coalesce('=' || CAST(`{c}` AS STRING), '-')" if c in as_value else f"'=' || CAST(`{c}` AS STRING)"
    cells = df.selectExpr(f"stack({len(pairs)}, {', '.join(f'{i}, {text(a)}, {text(b)}' for i, (a, b) in enumerate(pairs))}) AS (pair, x, y)").where("x IS NOT NULL AND y IS NOT NULL")
    counted = stored(cells.groupBy("pair", "x", "y").agg(F.count("*").alias("n")))
    side = lambda key, name: counted.groupBy("pair", key).agg(F.sum("n").alias(f"n_{name}"), F.max("n").alias("top"))
    listed = []
    for key, name, kept in (("x", "a", "kept_ab"), ("y", "b", "kept_ba")):
        same = side(key, name).groupBy("pair", f"n_{name}").agg(F.count("*").alias("times"), F.sum("top").alias("top"))
        listed.append(same.groupBy("pair").agg(
            F.sort_array(F.collect_list(F.struct(F.col(f"n_{name}").alias("count"), "times"))).alias(f"{name}_counts"),
            F.sum("times").alias(f"d_{name}"), F.sum("top").alias(kept), F.max(f"n_{name}").alias(f"mode_{name}"),
        ))
    joined = counted.join(side("x", "a").select("pair", "x", "n_a"), ["pair", "x"]).join(side("y", "b").select("pair", "y", "n_b"), ["pair", "y"])
    sums = joined.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("d_ab"), F.sum(F.expr("n * ln(n)")).alias("information"), F.sum(F.expr("n / n_a * n / n_b")).alias("association"))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return names.join(sums.join(listed[0], "pair").join(listed[1], "pair"), "pair", "left").drop("pair").selectExpr("a", "b", "coalesce(n, 0) AS n", "d_a", "d_b", "d_ab", "kept_ab", "kept_ba", "mode_a", "mode_b", "information", "association", "a_counts", "b_counts")


def taken(rng: np.random.Generator, colours: np.ndarray, k: int) -> np.ndarray:
    """How many of each colour a draw of ``k`` holds; beyond the sampler's range by the normal law with the same mean and variance, one colour after another."""
    total = int(colours.sum())
    if total < MOST_TOTAL:
        return rng.multivariate_hypergeometric(colours, k, method="marginals")
    out, left = np.zeros(len(colours), np.int64), k
    for i, own in enumerate(colours.tolist()):
        rest = total - own
        if rest == 0:
            out[i] = left
        else:
            mean = left * own / total
            spread = np.sqrt(max(0.0, mean * (rest / total) * ((total - left) / max(1, total - 1))))
            out[i] = int(min(max(round(rng.normal(mean, spread)), left - rest, 0), own, left))
        total, left = rest, left - int(out[i])
    return out


def expanded(counts: list) -> np.ndarray:
    """Counts of all values from ``count, times`` entries."""
    return np.repeat(np.array([c["count"] for c in counts], np.int64), np.array([c["times"] for c in counts], np.int64))


class _Sum:
    """A statistic gathered from cells ``n`` with their totals ``n_a`` and ``n_b``; ``who`` are the values of ``a``."""

    def __init__(self, kind: str, values: int) -> None:
        self.kind, self.total, self.best = kind, 0.0, np.zeros(values if kind == "kept" else 0, np.int64)

    def add(self, who: np.ndarray | int, n: np.ndarray, n_a: np.ndarray | int, n_b: np.ndarray | int) -> None:
        if self.kind == "information":
            full = n[n > 1].astype(float)
            self.total += float((full * np.log(full)).sum())
        elif self.kind == "association":
            self.total += float((n / n_a * (n / n_b)).sum())
        else:
            np.maximum.at(self.best, np.broadcast_to(who, n.shape), n)

    def value(self) -> float:
        return float(self.best.sum()) if self.kind == "kept" else self.total


def random_statistic(rng: np.random.Generator, a: np.ndarray, b: np.ndarray, kind: str) -> float:
    """The statistic ``kind`` (information, association or kept) of a random table with the margins ``a`` and ``b``."""
    out = _Sum(kind, len(a))
    flip = len(a) < len(b)
    large, small = (b, a) if flip else (a, b)
    put = lambda at_large, at_small, n: out.add(at_small, n, a[at_small], b[at_large]) if flip else out.add(at_large, n, a[at_large], b[at_small])
    if len(large) * len(small) <= DENSE * int(a.sum()):
        rest, every = large.copy(), np.arange(len(large))
        for i, k in enumerate(small.tolist()):
            n = taken(rng, rest, k)
            rest -= n
            at = np.flatnonzero(n)
            put(every[at], np.full(len(at), i), n[at])
        return out.value()
    # Sparse: values of the larger side in parts of bounded rows, whose share of the smaller side is drawn first.
    rest, start = small.copy(), 0
    ends = np.cumsum(large)
    while start < len(large):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_ROWS, "right")))
        n = taken(rng, rest, int(large[start:stop].sum()))
        rest -= n
        shuffled = rng.permutation(np.repeat(np.arange(len(small)), n))
        key, cells = np.unique(np.repeat(np.arange(start, stop), large[start:stop]) * len(small) + shuffled, return_counts=True)
        put(key // len(small), key % len(small), cells)
        start = stop
    return out.value()


def permutation_p(tables: DataFrame, draws: int = DRAWS, block: int = BLOCK, stop_at: int = STOP_AT, statistic: str = "information", kept: str = "kept_ab") -> DataFrame:
    """``tables`` (of ``pair_tables``) with ``hits, draws, p``: how often a shuffle gives the statistic or more.

    Blocks of draws count in their order up to the one in which a pair has ``stop_at`` hits; p counts the data as one
    draw.  All pairs draw their first block, then those still open all others at once.  A pair without rows has p = 1.
    """
    own = kept if statistic == "kept" else statistic
    margins = stored(tables.select("a", "b", F.col(own).cast("double").alias("own"), "a_counts", "b_counts").where("n > 0"))
    blocks = -(-draws // block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for r in df.itertuples(index=False):
                a, b = expanded(r.a_counts), expanded(r.b_counts)
                size = min(block, draws - r.block * block)
                rng = np.random.default_rng([17, zlib.crc32(f"{r.a}\x1f{r.b}".encode()), int(r.block)])
                # Sums in another order may differ in their last digits; a table as telling as the data is a hit.
                least = r.own - 1e-9 * max(1.0, abs(r.own))
                out.append((r.a, r.b, int(r.block), sum(random_statistic(rng, a, b, statistic) >= least for _ in range(size)), size))
            yield pd.DataFrame(out, columns=["a", "b", "block", "hits", "size"])

    def drawn(asked: DataFrame, first: int, last: int) -> DataFrame:
        """A task for each pair and block."""
        spread = asked.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return stored(spread.repartition(tasks, "a", "b", "block").mapInPandas(run, "a string, b string, block int, hits long, size long"))

    done = drawn(margins, 0, 1)
    if blocks > 1:
        still = done.where(F.col("hits") < stop_at).select(F.col("a").alias("a_"), F.col("b").alias("b_"))
        done = done.unionByName(drawn(margins.join(still, F.expr("a = a_ AND b = b_")).drop("a_", "b_"), 1, blocks))
    before = Window.partitionBy("a", "b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = done.withColumn("so_far", F.coalesce(F.sum("hits").over(before), F.lit(0))).where(F.col("so_far") < stop_at)
    found = counted.groupBy(F.col("a").alias("a_"), F.col("b").alias("b_")).agg(F.sum("hits").alias("hits"), F.sum("size").alias("draws"))
    both = tables.drop("a_counts", "b_counts").join(found, F.expr("a = a_ AND b = b_"), "left").drop("a_", "b_")
    return both.withColumns({"hits": F.coalesce("hits", F.lit(0)), "draws": F.coalesce("draws", F.lit(0))}).withColumn("p", F.expr("(hits + 1) / (draws + 1)"))
