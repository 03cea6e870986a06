"""Vectors of whole numbers dealt into blocks, for searches of a stated query set against all rows.

A search pairs blocks of rows with lots of queries; every pair is one group of at most about
``block_rows`` rows and ``lot_rows`` queries, whatever one label, length or vector holds, because both
are dealt by a hash of ``vec_id``.  Only numbers of blocks, one per class, reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Squared lengths from here on could make scores that are no 64-bit whole numbers.
LONGEST_SQUARE = 2.0**62


def integer_vectors(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", **extra: Column) -> DataFrame:
    """``vec_id, v`` with ``v = floor(scale * x)`` and ``extra`` columns, of the rows that take part.

    No part take rows without a vec_id, with a null or empty vector or a null or non-finite component, vectors
    whose products may pass 64 bits (length 2^31 after scaling), and those of another size than the commonest
    (ties: the smallest size).  Of rows that share a vec_id the one with the largest ``v`` counts.
    """
    x = F.col(embedding).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), *[c.alias(n) for n, c in extra.items()]).where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~F.exists("x", bad))
    square = F.aggregate("x", F.lit(0.0), lambda total, c: total + F.floor(c * scale) * F.floor(c * scale).cast("double"))
    whole = rows.where(square < LONGEST_SQUARE).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"), *extra)
    one = whole.groupBy("vec_id").agg(F.max(F.struct("v", *extra)).alias("s")).select("vec_id", "s.*")
    sizes = one.groupBy(F.size("v").alias("size")).count()
    common = sizes.agg(F.max_by("size", F.struct("count", -F.col("size"))).alias("common"))
    return one.join(F.broadcast(common), F.size("v") == F.col("common")).drop("common")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def exact_pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all their products are exact as such, else as they are."""
    longest = [float(np.sqrt((m.astype(float) ** 2).sum(1).max(initial=0.0))) for m in (a, b)]
    return (a.astype(float), b.astype(float)) if longest[0] * longest[1] < 2.0**52 else (a, b)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, level = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
    need = k - len(above)
    if len(level) > need:
        level = level[np.argpartition(ids[level], need - 1)[:need]]
    return np.concatenate([above, level])


def blocks_of(count: Column, rows: int) -> Column:
    return F.ceil(count / F.lit(float(rows))).cast("long")


def dealt(blocks: Column, salt: int = 0) -> Column:
    """The block of a row among ``blocks``, by its vec_id alone."""
    return F.pmod(F.xxhash64("vec_id", F.lit(salt)), blocks)


def top(found: DataFrame, k: int, *groups: str, score: str = "score", vec_id: str = "vec_id") -> DataFrame:
    """``found`` with ``rank``: per group the ``k`` highest scores, ties to the smaller ``vec_id``."""
    order = Window.partitionBy(*groups).orderBy(F.desc(score), vec_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
