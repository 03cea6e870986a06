"""Hard negatives by segment summaries: means and deviations of vector segments bound scores before any is computed.

Cut two vectors into the same segments.  Within a segment of ``n`` components the inner product is ``n`` times the
product of the means, give or take at most ``n`` times the product of the (population) deviations, by
Cauchy-Schwarz.  Summed over segments that gives an interval for the score.  Summaries of the finest segments
are stored beside each vector; those of longer segments follow from them, so the interval is refined level by level,
from one segment on, and only pairs that no level excludes are scored exactly.  The lower bounds also serve: the
k-th largest of them among rows that surely qualify is a score that a row must reach.

Searched are first the anchors' positives (best rows of the same label) and then, per positive, the best rows of other
labels within a band of the positive's score.  Both searches go in two rounds: an anchor meets one block of rows,
which gives the score to reach, then all other blocks.  Rows are dealt to blocks by a hash, so a label that
most rows share is many blocks.

Defined results: rows without a label take no part, see ``integer_vectors`` for the others; a table without
anchors gives no rows; an anchor without positives, or whose positives have no row in their band, has none; the band of a
negative positive score is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written
from siltstone.llm.vector_blocks import best_of, blocks_of, exact_pair, integer_vectors, matrix, top

#: Components of the finest segments, queries bounded at a time, and the share of open pairs under which they are gathered one by one.
FINEST, CHUNK, SPARSE = 4, 64, 0.25
#: Bounds are computed in floating point and give way by this share of the lengths' product.
SLACK = 1e-9


def segment_weights(size: int) -> np.ndarray:
    """Lengths of the finest segments: a power of two of them, of about ``FINEST`` components."""
    count = 1 << max(0, (size // FINEST).bit_length() - 1)
    return np.diff(np.arange(count + 1) * size // count)


def summaries(rows: np.ndarray) -> np.ndarray:
    """Per row the means and then the deviations of its finest segments."""
    weights = segment_weights(rows.shape[1])
    starts = np.concatenate([[0], np.cumsum(weights)[:-1]])
    x = rows.astype(float)
    mean = np.add.reduceat(x, starts, 1) / weights
    rest = x - np.repeat(mean, weights, 1)
    return np.hstack([mean, np.sqrt(np.add.reduceat(rest * rest, starts, 1) / weights)])


def levels(stored: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """From one segment to the finest: means and deviations, times the root of the segment's length, so that bounds are plain products."""
    weights = segment_weights(size).astype(float)
    mean, var = stored[:, : len(weights)], stored[:, len(weights) :] ** 2
    out = [(mean * np.sqrt(weights), np.sqrt(var * weights))]
    while len(weights) > 1:
        a, b = weights[::2], weights[1::2]
        both = (a * mean[:, ::2] + b * mean[:, 1::2]) / (a + b)
        var = (a * (var[:, ::2] + (mean[:, ::2] - both) ** 2) + b * (var[:, 1::2] + (mean[:, 1::2] - both) ** 2)) / (a + b)
        mean, weights = both, a + b
        out.append((mean * np.sqrt(weights), np.sqrt(var * weights)))
    return out[::-1]


def products(a: np.ndarray, b: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """``a @ b.T`` where ``open_``: as a whole, or pair by pair where few are open."""
    if open_.mean() >= SPARSE:
        return a @ b.T
    out = np.zeros(open_.shape, a.dtype)
    r, c = np.nonzero(open_)
    out[r, c] = np.einsum("ij,ij->i", a[r], b[c])
    return out


class Summaries:
    """Vectors with their stored summaries, all levels of them, and their lengths."""

    def __init__(self, rows: np.ndarray, stored: np.ndarray) -> None:
        self.rows, self.levels = rows, levels(stored, rows.shape[1])
        self.length = np.sqrt((rows.astype(float) ** 2).sum(1))


def bounded_scores(asked: Summaries, own: Summaries, open_: np.ndarray, low: np.ndarray, high: np.ndarray, sure_low: np.ndarray, sure_high: np.ndarray, k: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Per chunk of queries: its place, which pairs no bound excludes, and their exact scores.

    Wanted are scores from ``low`` to ``high``; rows surely within ``sure_low`` and ``sure_high`` qualify for
    every use, so the k-th best of their lower bounds raises ``low``.
    """
    q_rows, p_rows = exact_pair(asked.rows, own.rows)
    for start in range(0, len(q_rows), CHUNK):
        at = slice(start, start + CHUNK)
        alive, least = open_[at].copy(), low[at].copy()
        slack = SLACK * (asked.length[at] * own.length.max(initial=0.0) + 1)
        for (q_mean, q_dev), (p_mean, p_dev) in zip(asked.levels, own.levels, strict=True):
            if not alive.any():
                break
            middle, reach = products(q_mean[at], p_mean, alive), products(q_dev[at], p_dev, alive)
            lower, upper = middle - reach, middle + reach
            if alive.shape[1] >= k:
                sure = alive & (lower >= sure_low[at][:, None]) & (upper <= sure_high[at][:, None])
                kth = np.partition(np.where(sure, lower, -np.inf), -k, axis=1)[:, -k]
                least = np.maximum(least, kth - slack)
            alive &= (upper >= (least - slack)[:, None]) & (lower <= (high[at] + slack)[:, None])
        yield at, alive, products(q_rows[at], p_rows, alive)


def _sides(asked: pd.DataFrame, own: pd.DataFrame) -> tuple[Summaries, Summaries]:
    return Summaries(matrix(asked.q), np.stack(asked.q_s.to_numpy())), Summaries(matrix(own.v), np.stack(own.s.to_numpy()))


FOUND = "query_id long, positive_id long, vec_id long, score long, scored long"


def _found(parts: list[tuple[int, int | None, list[int], list[int], int]]) -> pd.DataFrame:
    """Rows of ``query_id, positive_id, ids, scores, scored``; the last stands in a row of its own."""
    query, positive, ids, scores, work = [], [], [], [], []
    for q, p, own_ids, own_scores, scored in parts:
        n = len(own_ids) + 1
        query += [q] * n
        positive += [p] * n
        ids += [*own_ids, None]
        scores += [*own_scores, None]
        work += [0] * (n - 1) + [scored]
    return pd.DataFrame({"query_id": pd.Series(query, dtype="int64"), "positive_id": pd.Series(positive, dtype="Int64"), "vec_id": pd.Series(ids, dtype="Int64"), "score": pd.Series(scores, dtype="Int64"), "scored": pd.Series(work, dtype="int64")})


def positives_tile(k: int):
    """A function of one group: the anchors' best ``k`` other rows of a block, all of one label."""

    def tile(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return _found([])
        q, p = _sides(asked, own)
        ids, who = own.vec_id.to_numpy(), asked.query_id.to_numpy()
        open_ = ids[None] != who[:, None]
        low = asked["at"].to_numpy(dtype=float, na_value=-np.inf)
        far = np.full(len(who), np.inf)
        parts = []
        for at, alive, scores in bounded_scores(q, p, open_, low, far, -far, far, k):
            for i in range(len(alive)):
                cols = np.flatnonzero(alive[i])
                cols = cols[scores[i, cols] >= low[at][i]]
                cols = cols[best_of(scores[i, cols], ids[cols], k)]
                parts.append((int(who[at][i]), None, ids[cols].tolist(), [int(x) for x in scores[i, cols]], int(alive[i].sum())))
        return _found(parts)

    return tile


def negatives_tile(k: int, band: tuple[int, int]):
    """A function of one group: per anchor and positive the best ``k`` rows of another label whose score is within ``band`` hundredths of the positive's."""

    def tile(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return _found([])
        q, p = _sides(asked, own)
        ids, labels, who = own.vec_id.to_numpy(), own.label.to_numpy(), asked.query_id.to_numpy()
        open_ = labels[None] != asked.q_label.to_numpy()[:, None]
        # Whole-number bounds of every band, in Python's own numbers: they may pass 64 bits on the way.
        bands = [[(w["positive_id"], max(-(-band[0] * w["score"] // 100), w["at"] if w["at"] is not None else -(2**63)), band[1] * w["score"] // 100) for w in ws] for ws in asked.windows]
        low, high = (np.array([f(b[i] for b in own_bands) for own_bands in bands], float) for f, i in ((min, 1), (max, 2)))
        sure_low, sure_high = (np.array([f(b[i] for b in own_bands) for own_bands in bands], float) for f, i in ((max, 1), (min, 2)))
        parts = []
        for at, alive, scores in bounded_scores(q, p, open_, low, high, sure_low, sure_high, k):
            for i, own_bands in enumerate(bands[at]):
                cols = np.flatnonzero(alive[i])
                row, row_ids, work = scores[i, cols], ids[cols], len(cols)
                for positive_id, least, most in own_bands:
                    inside = np.flatnonzero((row >= least) & (row <= most))
                    inside = inside[best_of(row[inside], row_ids[inside], k)]
                    parts.append((int(who[at][i]), int(positive_id), row_ids[inside].tolist(), [int(x) for x in row[inside]], work))
                    work = 0
        return _found(parts)

    return tile


def two_rounds(rows: DataFrame, asked: DataFrame, tile, reached, block_rows: int, lot_rows: int) -> DataFrame:
    """What ``tile`` finds for ``asked`` (``cls, query_id, ...``) among ``rows`` (``cls, vec_id, ...``) of their class, as ``FOUND``.

    Classes are dealt into blocks.  ``reached(asked, found)`` adds to the queries what one block each gave.
    """
    lots = asked.groupBy("cls").agg(blocks_of(F.count("*"), lot_rows).alias("lots"))
    sizes = written(rows.groupBy("cls").agg(blocks_of(F.count("*"), block_rows).alias("blocks")).join(lots, "cls"))
    placed = rows.join(sizes, "cls").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    # Fresh columns, so that the two sides of a cogroup share none.
    again = sizes.select("cls", F.col("blocks").alias("blocks"), F.col("lots").alias("lots"))
    queries = asked.join(again, "cls").withColumn("home", F.pmod(F.xxhash64("query_id", F.lit(1)), "blocks"))
    first = ["cls", "block"]
    at_home = written(placed.groupBy(*first).cogroup(queries.withColumn("block", F.col("home")).groupBy(*first)).applyInPandas(tile, FOUND))
    sides = [*first, "lot"]
    to_all = lambda df, name, number: df.where("blocks > 1").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1)))
    own = to_all(placed, "lot", "lots")
    others = to_all(reached(queries, at_home), "block", "blocks").where("block <> home").withColumn("lot", F.pmod(F.xxhash64("query_id", F.lit(2)), "lots"))
    return written(at_home.unionByName(own.groupBy(*sides).cogroup(others.groupBy(*sides)).applyInPandas(tile, FOUND)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256, block_rows: int = 8192, lot_rows: int = 8192, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, scored``.

    Scores are inner products of ``floor(scale * x)``.  For each row that ``is_anchor`` selects (an expression over
    ``vec_id``) and each of its ``positives`` best other rows of the same label, the ``negatives`` best rows of other labels
    whose score is at least ``band[0]`` and at most ``band[1]`` hundredths of the positive's; ties to the smaller
    vec_id.  label: an expression over ``vectors``.  scored: exact products computed for the anchor's negatives.
    """
    label = (F.col("label") if label is None else label).cast("long")
    whole = integer_vectors(vectors.where(label.isNotNull()), scale, vec_id, embedding, label=label)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                yield df.assign(s=list(summaries(matrix(df.v))))

    rows = written(whole.mapInPandas(summed, "vec_id long, v array<long>, label long, s array<double>"))
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("s").alias("q_s"), F.col("label").alias("q_label"))

    def nth(found: DataFrame, k: int, *groups: str) -> DataFrame:
        """The score that a group's k-th best so far has."""
        return top(found.where("vec_id IS NOT NULL"), k, *groups).groupBy(*groups).agg(F.when(F.count("*") == k, F.min("score")).alias("at"))

    own_label = rows.select(F.col("label").alias("cls"), "vec_id", "v", "s")
    of_label = anchors.select(F.col("q_label").alias("cls"), "query_id", "q", "q_s", F.lit(None).cast("long").alias("at"))
    near = two_rounds(own_label, of_label, positives_tile(positives), lambda q, found: q.drop("at").join(nth(found, positives, "query_id"), "query_id", "left"), block_rows, lot_rows)
    best = written(top(near.where("vec_id IS NOT NULL"), positives, "query_id").select("query_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    def with_windows(queries: DataFrame, at: DataFrame | None) -> DataFrame:
        """At most ``positives`` bands per anchor."""
        known = best.withColumn("at", F.lit(None).cast("long")) if at is None else best.join(at, ["query_id", "positive_id"], "left")
        windows = known.groupBy("query_id").agg(F.collect_list(F.struct("positive_id", F.col("positive_score").alias("score"), "at")).alias("windows"))
        return queries.drop("windows").join(windows, "query_id")

    one = F.lit(0).cast("long").alias("cls")
    other_label = rows.select(one, "vec_id", "v", "s", "label")
    asked = with_windows(anchors.select(one, "query_id", "q", "q_s", "q_label"), None)
    hard = two_rounds(other_label, asked, negatives_tile(negatives, band), lambda q, found: with_windows(q, nth(found, negatives, "query_id", "positive_id")), block_rows, lot_rows)
    work = hard.groupBy(F.col("query_id").alias("w_id")).agg(F.sum("scored").alias("scored"))
    ranked = top(hard.where("vec_id IS NOT NULL").drop("scored"), negatives, "query_id", "positive_id").join(best, ["query_id", "positive_id"])
    return ranked.join(work, F.col("query_id") == F.col("w_id")).select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "scored"
    )
