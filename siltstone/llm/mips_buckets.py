"""Exact top-k search by inner product: vectors grouped by length, pruned by local cosine thresholds.

Vectors of similar length (within ``RATIO``) form a bucket, and a bucket is dealt into blocks.  If ``t`` is the
k-th score that a query has so far, a vector of a bucket can only reach it if the cosine of the two is at least
``t / (|query| * longest of the bucket)``, the local threshold.  Above 1 the bucket is left out.  Else two ways
may prune: by length (vectors shorter than ``t / |query|`` cannot reach t) and by coordinates: on the sphere the
angle of a vector to an axis differs from the query's by no more than the arc of the local threshold, so on
the query's largest coordinates only an interval of the vectors' coordinates is open, found in sorted
lists.  From which local threshold on coordinates cost less is measured per block on a few of its queries.
What is left is verified by exact whole-number products, so either way gives the same rows.

On Spark a query first meets one block of long vectors, which gives its threshold; with it, queries are
grouped by the length that they need, and each group goes only to the buckets that hold such vectors.  Work is that of
the stated queries against all rows, in blocks, less what is pruned; on vectors of one length and without
structure (the shipped ones) nearly nothing is.

Defined results: see ``integer_vectors`` for the rows that take part (zero vectors do); a table without
queries or candidates gives no rows; with fewer than ``k`` candidates all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written
from siltstone.llm.vector_blocks import best_of, blocks_of, dealt, exact_pair, integer_vectors, matrix, top

#: Lengths of a bucket; coordinates that prune; queries on which a block chooses its way; queries scored at a time.
RATIO, FOCUS, TRIED, CHUNK = 0.9, 4, 16, 128
#: A row fetched by its place costs about as much as so many rows of a dense product.
FETCH = 4.0
#: Bounds are computed in floating point and give way by this much.
SLACK = 1e-9

RESULT = "query_id long, vec_id long, score long, verified long"


def length_class(length: Column) -> Column:
    """The number of the bucket of a length; -1 for nothing.  At most about 210 for lengths below 2^31."""
    return F.when(length > 0, F.floor(F.log(length) / -math.log(RATIO))).otherwise(-1).cast("int")


class Bucket:
    """The rows of one block, sorted by length, with sorted coordinates once they are asked for."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        length = np.sqrt((rows.astype(float) ** 2).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.rows, self.length = ids[order], rows[order], length[order]
        self._lists: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors, and per coordinate the order of its values and the values in it."""
        if self._lists is None:
            unit = self.rows / np.where(self.length > 0, self.length, 1.0)[:, None]
            order = unit.argsort(0, kind="stable")
            self._lists = unit, order, np.take_along_axis(unit, order, 0)
        return self._lists

    def by_length(self, least: float) -> int:
        """How many rows, from the longest on, reach the length ``least``."""
        return int(np.searchsorted(-self.length, -least * (1 - SLACK), "right"))

    def by_coordinates(self, unit_query: np.ndarray, threshold: float, least: float) -> tuple[np.ndarray, int]:
        """Rows whose coordinates leave room for a cosine of ``threshold``, and how many were looked at."""
        unit, order, sorted_values = self.lists()
        arc = math.acos(max(-1.0, min(1.0, threshold - SLACK)))
        focus = np.argsort(-np.abs(unit_query), kind="stable")[:FOCUS]
        angle = np.arccos(np.clip(unit_query[focus], -1.0, 1.0))
        low, high = np.cos(np.minimum(math.pi, angle + arc)) - SLACK, np.cos(np.maximum(0.0, angle - arc)) + SLACK
        spans = [(np.searchsorted(sorted_values[:, f], a), np.searchsorted(sorted_values[:, f], b, "right")) for f, a, b in zip(focus, low, high, strict=True)]
        first = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
        rows = order[spans[first][0] : spans[first][1], focus[first]]
        seen = len(rows)
        rows = rows[self.length[rows] >= least * (1 - SLACK)]
        for i, f in enumerate(focus):
            if i != first:
                value = unit[rows, f]
                rows = rows[(value >= low[i]) & (value <= high[i])]
        return rows, seen


def search(bucket: Bucket, query_ids: np.ndarray, queries: np.ndarray, at: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Per query the ids and scores of its at most ``k`` best rows that reach the score ``at`` (minus infinity: none yet), and how many rows were scored."""
    found: list[tuple[np.ndarray, np.ndarray, int]] = [(np.empty(0, np.int64), np.empty(0), 0)] * len(queries)
    rows, asked = exact_pair(bucket.rows, queries)
    q_length = np.sqrt((queries.astype(float) ** 2).sum(1))
    longest = bucket.length[0]
    # A threshold of zero or less leaves every row open.
    local = np.full(len(queries), -1.0)
    open_ = (at > 0) & (q_length > 0) & (longest > 0)
    local[open_] = at[open_] / (q_length[open_] * longest)
    local[(at > 0) & ~open_] = np.inf
    least = np.zeros(len(queries))
    least[open_] = at[open_] / q_length[open_]
    live = np.flatnonzero(local <= 1 + SLACK)
    live = live[np.argsort(-local[live], kind="stable")]

    # From which local threshold on do coordinates cost less than length?  Tried on queries spread over all thresholds.
    cut = math.inf
    for i in live[np.linspace(0, len(live) - 1, min(TRIED, len(live))).astype(int)] if len(live) else ():
        if local[i] <= 0:
            break
        rest, seen = bucket.by_coordinates(queries[i] / q_length[i], local[i], least[i])
        if seen / 8 + FETCH * len(rest) >= bucket.by_length(least[i]):
            break
        cut = local[i]

    def keep(i: int, scores: np.ndarray, ids: np.ndarray, scored: int) -> None:
        own = (ids != query_ids[i]) & (scores >= at[i])
        scores, ids = scores[own], ids[own]
        best = best_of(scores, ids, k)
        found[i] = (ids[best], scores[best], scored)

    dense = []
    for i in live:
        if local[i] >= cut:
            own, _ = bucket.by_coordinates(queries[i] / q_length[i], local[i], least[i])
            keep(i, rows[own] @ asked[i], bucket.ids[own], len(own))
        else:
            dense.append(i)
    for start in range(0, len(dense), CHUNK):
        part = dense[start : start + CHUNK]
        prefix = [bucket.by_length(least[i]) for i in part]
        scores = asked[part] @ rows[: max(prefix)].T
        for j, i in enumerate(part):
            keep(i, scores[j, : prefix[j]], bucket.ids[: prefix[j]], prefix[j])
    return found


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block_rows: int = 8192, lot_rows: int = 8192, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score, verified``: for each row that ``is_query`` selects (an expression over
    ``vec_id``), the ``k`` other rows with the highest inner product of ``floor(scale * x)``, ties to the smaller vec_id.

    verified: exact products computed for the query.
    """
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c)
    rows = written(integer_vectors(vectors, scale, vec_id, embedding).withColumn("length", F.sqrt(square)).withColumn("cls", length_class(F.col("length"))))
    # One row per length class, a bounded number.
    classes = rows.groupBy("cls").agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries"), F.max("length").alias("longest")).orderBy(F.desc("cls")).collect()
    if not classes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, verified long")
    # The longest classes, up to half a block of rows, are the bucket that every query meets first; each other class is one.
    start = least_start = classes[0]["cls"]
    sizes: dict[int, list] = {}
    before = 0
    for c in classes:
        if before * 2 < block_rows:
            least_start = c["cls"]
        own = sizes.setdefault(start if c["cls"] >= least_start else c["cls"], [0, c["longest"]])
        own[0] += c["n"]
        before += c["n"]
    blocks = {cls: -(-n // block_rows) for cls, (n, _) in sizes.items()}
    table = spark.createDataFrame(list(blocks.items()), "bucket int, blocks long")
    placed = rows.withColumn("bucket", F.when(F.col("cls") >= least_start, start).otherwise(F.col("cls"))).join(F.broadcast(table), "bucket").withColumn("block", dealt(F.col("blocks"))).drop("blocks", "cls")
    home_lots = max(1, -(-sum(c["queries"] for c in classes) // (blocks[start] * lot_rows)))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("length").alias("q_length"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks[start])).alias("home"))

    def tile(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts: list[pd.DataFrame] = []
        if len(own) and len(asked):
            bucket = Bucket(own.vec_id.to_numpy(), matrix(own.v))
            at = asked["at"].to_numpy(dtype=float, na_value=-np.inf)
            ids = asked.query_id.to_numpy()
            for query_id, (found, scores, scored) in zip(ids, search(bucket, ids, matrix(asked.q), at, k), strict=True):
                # One row more counts the work.
                parts.append(pd.DataFrame({"query_id": query_id, "vec_id": pd.array([*found.tolist(), None], "Int64"), "score": pd.array([*(int(s) for s in scores), None], "Int64"), "verified": [0] * len(found) + [scored]}))
        if not parts:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="Int64"), "verified": pd.Series(dtype="int64")})
        return pd.concat(parts, ignore_index=True)

    first_sides = ["block", "lot"]
    long_rows = placed.where(F.col("bucket") == start).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(home_lots - 1).cast("long"))))
    first_asked = queries.select("query_id", "q", F.col("home").alias("block"), F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(home_lots)).alias("lot"), F.lit(None).cast("long").alias("at"))
    at_home = written(long_rows.groupBy(*first_sides).cogroup(first_asked.groupBy(*first_sides)).applyInPandas(tile, RESULT))
    home = top(at_home.where("vec_id IS NOT NULL"), k, "query_id")
    reached = home.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("at"))
    need = F.when((F.col("at") > 0) & (F.col("q_length") > 0), F.col("at") / F.col("q_length"))
    known = written(queries.join(reached, "query_id", "left").withColumn("need", F.coalesce(need, F.lit(0.0))).withColumn("group", length_class(F.col("need"))))
    groups = known.groupBy("group").agg(F.min("need").alias("need"), blocks_of(F.count("*"), lot_rows).alias("lots")).collect()
    # Which bucket meets which group of queries: bounded by the square of the number of length classes.
    meets = [(cls, blocks[cls], g["group"], g["lots"]) for cls, (_, longest) in sizes.items() for g in groups if longest >= g["need"] * (1 - SLACK)]
    if not meets:
        return top(at_home, k, "query_id").where("false").select("query_id", "rank", "vec_id", "score", "verified")
    pairs = F.broadcast(spark.createDataFrame(meets, "bucket int, blocks long, group int, lots long"))
    sides = ["bucket", "block", "group", "lot"]
    own = placed.join(pairs, "bucket").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).select(*sides, "vec_id", "v")
    asked = (
        known.join(pairs, "group").withColumn("lot", F.pmod(F.xxhash64("query_id", F.lit(2)), "lots")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .where(~((F.col("bucket") == start) & (F.col("block") == F.col("home")))).select(*sides, "query_id", "q", F.col("at"))
    )
    others = written(own.groupBy(*sides).cogroup(asked.groupBy(*sides)).applyInPandas(tile, RESULT))
    every = at_home.unionByName(others)
    work = every.groupBy(F.col("query_id").alias("w_id")).agg(F.sum("verified").alias("verified"))
    best = top(every.where("vec_id IS NOT NULL").drop("verified"), k, "query_id")
    return best.join(work, F.col("query_id") == F.col("w_id")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")
