"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stop.

Vectors are projected to fewer dimensions by a Gaussian matrix.  If two vectors are ``d`` apart,
their squared projected distance divided by ``d * d`` follows chi-square; so once the next
projected neighbour is farther than the ``confidence`` quantile allows for the k-th distance
found so far, a neighbour is still missing with probability ``1 - confidence`` at most, and the
search stops.  Projected neighbours come in the order of their projected distance, from a
kd-tree, and each one met is verified on the original vectors.

That bound holds for any number of dimensions; which one costs least depends on the data, so it
is chosen on the sample: vectors with structure in few dimensions need few, while among nearly
uniform ones (as in the shipped tables, whose tenth neighbour is at three quarters of the usual
distance) few dimensions leave most vectors to verify.  Each query reports how many it verified,
and in how many rows of opened leaves it computed projected distances.

On Spark the top of the kd-tree is fitted on a sample of about ``sample_rows`` projections
and cuts space into cells; every row is indexed.  A query first searches its own cell, then, with
the distance found there, every cell whose box the same chi-square test does not exclude.  Cells
are salted into blocks of about ``block_rows`` rows; each block builds its own tree in one task.

Defined results: vectors that are null, empty or zero, that hold null or non-finite parts, or whose
length differs from the commonest one take no part; rows without a vec_id take no part; of rows
that share a vec_id one counts, the one with the largest vector; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import written

#: Numbers of projected dimensions to choose from, rows of a leaf, and neighbours verified at a time.
DIMS, LEAF, RUN = (8, 16, 32, 48), 256, 64
#: Verifying a vector costs about as much as reading so many times its length of projections, as it is fetched from anywhere.
FETCH = 3


def chi_square(dims: int, confidence: float) -> float:
    """The quantile of chi-square, by the cube-root normal approximation (Wilson and Hilferty)."""
    spread = 2 / (9 * dims)
    return dims * (1 - spread + NormalDist().inv_cdf(confidence) * spread**0.5) ** 3


def projection(size: int, dims: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, size, dims]).standard_normal((size, dims))


def cheapest_dims(sample: np.ndarray, k: int, confidence: float, queries: int = 64) -> int:
    """The number of dimensions with the least cost of projected and verified distances on a sample."""
    if len(sample) <= k:
        return DIMS[0]
    asked = np.arange(min(queries, len(sample)))

    def squares(x: np.ndarray) -> np.ndarray:
        d = (x[asked] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[asked] @ x.T
        d[asked, asked] = np.inf
        return d

    kth = np.partition(squares(sample), k - 1, axis=1)[:, k - 1]
    size = sample.shape[1]
    share = {m: (squares(sample @ projection(size, m)) <= chi_square(m, confidence) * kth[:, None]).mean() for m in DIMS}
    return min(DIMS, key=lambda m: m + FETCH * size * share[m])


class KDTree:
    """A kd-tree over projected points, searched in the order of projected distance."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.nodes: list[tuple] = []  # (box low, box high, left, right, rows)
        self._build(points, np.arange(len(points)), leaf)

    def _build(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        own = points[rows]
        low, high = own.min(0), own.max(0)
        at = len(self.nodes)
        self.nodes.append(None)
        axis = int((high - low).argmax())
        if len(rows) <= leaf or high[axis] == low[axis]:
            self.nodes[at] = (low, high, -1, -1, rows)
            return at
        order = own[:, axis].argsort(kind="stable")
        mid = len(rows) // 2
        left = self._build(points, rows[order[:mid]], leaf)
        right = self._build(points, rows[order[mid:]], leaf)
        self.nodes[at] = (low, high, left, right, None)
        return at

    def _gap(self, node: int, q: np.ndarray) -> float:
        low, high = self.nodes[node][:2]
        d = np.maximum(np.maximum(low - q, q - high), 0.0)
        return float(d @ d)

    def search(self, q: np.ndarray, verify, k: int, bound: float, ratio: float) -> tuple[list[tuple[float, int]], int, int]:
        """The best ``k`` of ``verify(rows) -> (distances, ids)``, given that ``bound`` is already reached, how many
        were verified, and how many rows the opened leaves held.

        Stops once the projected squared distance of the next neighbour exceeds ``ratio`` times
        the square of the k-th distance.
        """
        best: list[tuple[float, int]] = []  # negated, the worst first
        limit, verified, projected = bound, 0, 0
        # Nodes by the gap of their box; rows of an opened leaf by their own projected distance.
        heap: list[tuple[float, int, int, np.ndarray | None, np.ndarray | None]] = [(self._gap(0, q), 0, 0, None, None)]
        tick = 0
        while heap:
            gap, _, node, own, rows = heapq.heappop(heap)
            if gap > ratio * limit * limit:
                break
            if own is None:
                _, _, left, right, inside = self.nodes[node]
                if inside is None:
                    for child in (left, right):
                        tick += 1
                        heapq.heappush(heap, (self._gap(child, q), tick, child, None, None))
                    continue
                d = self.points[inside] - q
                gaps = (d * d).sum(1)
                projected += len(gaps)
                order = gaps.argsort(kind="stable")
                own, rows = gaps[order], inside[order]
            else:
                take = max(1, int(np.searchsorted(own[:RUN], ratio * limit * limit, "right")))
                distances, ids = verify(rows[:take])
                verified += len(ids)
                near = distances <= limit
                for d, i in zip(distances[near].tolist(), ids[near].tolist(), strict=True):
                    item = (-d, -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    limit = min(limit, -best[0][0])
                own, rows = own[take:], rows[take:]
            if len(own):
                tick += 1
                heapq.heappush(heap, (float(own[0]), tick, node, own, rows))
        return sorted((-d, -i) for d, i in best), verified, projected


def usable_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _fit_cells(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Axes and thresholds of the top of the tree, in heap order."""
    cuts: list[tuple[int, float]] = []
    parts = [points]
    for _ in range(depth):
        nxt = []
        for own in parts:
            axis = int((own.max(0) - own.min(0)).argmax()) if len(own) else 0
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            cuts.append((axis, cut))
            nxt += [own[own[:, axis] <= cut], own[own[:, axis] > cut]]
        parts = nxt
    return cuts


def _cell_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if cuts:
        axes, at = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
        for _ in range((len(cuts) + 1).bit_length() - 1):
            right = points[np.arange(len(points)), axes[node]] > at[node]
            node = 2 * node + 1 + right
        node -= len(cuts)
    return node


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, confidence: float = 0.95, block_rows: int = 4096, most_cells: int = 1024, sample_rows: int = 16_384, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score, verified, projected``: for each row that ``is_query`` selects (an expression over
    ``vec_id``), its ``k`` nearest other rows by Euclidean distance, ties to the smaller vec_id.

    confidence: least probability that a neighbour is met before the search stops.  most_cells: cells of
    the top of the tree, whose boxes the driver holds; beyond, cells have more blocks.  sample_rows: rows
    expected in the sample that fits the top of the tree, chosen by a hash of the vec_id.
    """
    spark = vectors.sparkSession
    rows = written(usable_vectors(vectors, vec_id, embedding))
    result = "query_id long, rank int, vec_id long, score double, verified long, projected long"
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    size, total = sizes["size"], sizes["count"]
    rows = rows.where(F.size("v") == size)
    depth = max(0, min(most_cells, -(-total // block_rows)) - 1).bit_length()
    sample = _matrix(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(total)) < sample_rows).select("v").toPandas().v)
    dims = cheapest_dims(sample, k, confidence)
    matrix, ratio = projection(size, dims), chi_square(dims, confidence)
    cuts = _fit_cells(sample @ matrix, depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            points = _matrix(df.v) @ matrix if len(df) else np.empty((0, dims))
            yield pd.DataFrame({"vec_id": df.vec_id, "v": df.v, "p": list(points), "cell": _cell_of(points, cuts)})

    placed = written(rows.mapInPandas(place, "vec_id long, v array<double>, p array<double>, cell long"))
    # At most ``most_cells`` boxes and counts.
    agg = [F.min(F.col("p")[i]).alias(f"lo{i}") for i in range(dims)] + [F.max(F.col("p")[i]).alias(f"hi{i}") for i in range(dims)]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("n_q"), *agg).orderBy("cell").collect()
    low = np.array([[c[f"lo{i}"] for i in range(dims)] for c in cells])
    high = np.array([[c[f"hi{i}"] for i in range(dims)] for c in cells])
    ids = np.array([c["cell"] for c in cells])
    blocks = {c["cell"]: -(-c["n"] // block_rows) for c in cells}
    block_count = F.create_map(*[F.lit(int(x)) for kv in blocks.items() for x in kv])
    salted = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), block_count[F.col("cell")].cast("long")))
    queries = placed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("p").alias("qp"), "cell")

    def search(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int | None, float | None, int, int]] = []
        if len(own) and len(asked):
            v, who = _matrix(own.v), own.vec_id.to_numpy()
            tree = KDTree(_matrix(own.p))
            for query_id, q, qp, bound in zip(asked.query_id, asked.q, asked.qp, asked.bound, strict=True):
                q = np.asarray(q)

                def verify(found: np.ndarray, q=q, query_id=query_id):
                    found = found[who[found] != query_id]
                    d = v[found] - q
                    return np.sqrt((d * d).sum(1)), who[found]

                found, verified, projected = tree.search(np.asarray(qp), verify, k, bound, ratio)
                out += [(query_id, i, d, 0, 0) for d, i in found]
                out.append((query_id, None, None, verified, projected))
        ids, others, scores, verified, projected = zip(*out, strict=True) if out else ((), (), (), (), ())
        return pd.DataFrame({"query_id": pd.Series(ids, dtype="int64"), "vec_id": pd.Series(others, dtype="Int64"), "score": pd.Series(scores, dtype="float64"), "verified": pd.Series(verified, dtype="int64"), "projected": pd.Series(projected, dtype="int64")})

    def run(asked: DataFrame) -> DataFrame:
        """Search blocks for rows of ``query_id, q, qp, cell, bound``; queries go to every block of a cell in lots."""
        spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block_count[F.col("cell")].cast("long") - 1)))
        return written(salted.groupBy("cell", "block").cogroup(spread.groupBy("cell", "block")).applyInPandas(search, "query_id long, vec_id long, score double, verified long, projected long"))

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = lambda df: df.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    at_home = run(queries.withColumn("bound", F.lit(float("inf"))))
    home = written(top(at_home).select("query_id", "vec_id", "score"))
    bounds = home.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).otherwise(float("inf")).alias("bound"))
    asked = queries.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if not len(df):
                continue
            qp = _matrix(df.qp)
            gap = np.maximum(np.maximum(low[None] - qp[:, None], qp[:, None] - high[None]), 0.0)
            near = ((gap * gap).sum(2) <= ratio * (df.bound.to_numpy() ** 2)[:, None]) & (ids[None] != df.cell.to_numpy()[:, None])
            who, where = np.nonzero(near)
            yield df.iloc[who].assign(cell=ids[where])

    others = run(asked.mapInPandas(route, "query_id long, q array<double>, qp array<double>, cell long, bound double"))
    work = at_home.unionByName(others).groupBy(F.col("query_id").alias("w_id")).agg(*[F.sum(c).alias(c) for c in ("verified", "projected")])
    found = top(home.unionByName(others.select("query_id", "vec_id", "score"))).join(work, F.col("query_id") == F.col("w_id"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified", "projected")
