"""Nearest neighbours and preference pairs."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import ann_kdtree, preference_chat
from siltstone.llm.queries import ORACLE_SQL, op10_preference_pairs


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 16)).astype(np.float32)
    v[700] = v[100]
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0, 2.0]), (None, [1.0] * 16), (3, [float(x) for x in v[3]])]
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + odd, "vec_id long, embedding array<float>")
    out = ann_kdtree.nearest(table, F.col("vec_id") % 100 == 0, block_rows=256).collect()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in own)
        hits += len({r.vec_id for r in own} & set(best.tolist()))
    assert hits >= 0.9 * 150
    assert {r.query_id for r in out} == set(range(0, 1500, 100))
    assert ann_kdtree.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann_kdtree.nearest(table.where("vec_id < 4"), F.col("vec_id") == 0).count() == 3


def test_nearest_verifies_few_of_structured_vectors(spark):
    """20,000 vectors near a six-dimensional surface, beside columns with names that the operator uses itself."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((20_000, 6)) @ rng.standard_normal((6, 64)) + 0.01 * rng.standard_normal((20_000, 64))
    table = spark.createDataFrame([(i, r.tolist(), i, 0.0, "c") for i, r in enumerate(v)], "vec_id long, embedding array<double>, query_id long, score double, cell string")
    out = ann_kdtree.nearest(table, F.col("vec_id") % 1000 == 0).toPandas()
    hits = 0
    for q, own in out.groupby("query_id"):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(d.argsort()[:10]) & set(own.vec_id))
    assert hits >= 0.9 * 200
    work = out.groupby("query_id")[["verified", "projected"]].first().mean()
    assert work.verified < 0.2 * len(v) and work.verified <= work.projected < 0.6 * len(v)


def test_chi_square_quantiles():
    for dims, confidence, want in ((8, 0.9, 13.362), (8, 0.99, 20.090), (32, 0.95, 46.194)):
        assert abs(ann_kdtree.chi_square(dims, confidence) - want) < 0.005 * want


def test_tree_meets_neighbours_in_order():
    rng = np.random.default_rng(1)
    points = rng.standard_normal((3000, 4))
    q = rng.standard_normal(4)
    seen = []
    tree = ann_kdtree.KDTree(points, 64)
    found, verified, projected = tree.search(q, lambda rows: (seen.extend(rows.tolist()), (((points[rows] - q) ** 2).sum(1) ** 0.5, rows))[1], 10, float("inf"), 1.0)
    d = ((points - q) ** 2).sum(1) ** 0.5
    assert [i for _, i in found] == d.argsort(kind="stable")[:10].tolist()
    assert verified == len(seen) <= projected < 1500


def test_preference_pairs(spark):
    turns = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "x"), (3, 0, "user", None), (3, 1, "assistant", "same")], turns)
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "bad one"), (3, 0, "user", None), (3, 1, "assistant", "same"), (4, 0, "user", "y")], turns)
    out = {r.pair_id: r for r in preference_chat.preference_pairs(chosen, rejected).collect()}
    assert set(out) == {1, 3}
    assert out[1].prompt == "<|user|>\nhi<|end|>\n" and not out[1].tie and out[3].tie and out[3].chosen == ""
    for text, mask, want in ((out[1].chosen, out[1].chosen_mask, "good<|end|>"), (out[1].rejected, out[1].rejected_mask, "bad one<|end|>")):
        start, size = map(int, mask.split(":"))
        assert text[start : start + size] == want
    assert preference_chat.preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


def test_preference_pairs_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    got = op10_preference_pairs(spark, "/root/testdata/sf0.001")
    want = con.execute(ORACLE_SQL["op10_preference_pairs"])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_preference_pairs_of_odd_rows(spark):
    """Very long turns, repeated rows, null ids, and columns named like those of the operator."""
    schema = "pair_id long, turn long, role string, text string, at int, c string, shared boolean"
    long_ = "word " * 40_000
    chosen = [(1, 0, "user", long_, 1, "x", True), (1, 1, "assistant", "good", 1, "x", True), (2, 0, "user", "a", 1, "x", True), (2, 0, "user", "a", 1, "x", True), (2, 1, "assistant", "b", 1, "x", True), (None, 0, "user", "n", 1, "x", True)]
    rejected = [(1, 0, "user", long_, 1, "x", True), (1, 1, "assistant", long_, 1, "x", True), (2, 0, "user", "a", 1, "x", True), (2, 1, "assistant", "b", 1, "x", True), (None, 0, "user", "n", 1, "x", True)]
    out = {r.pair_id: r for r in preference_chat.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    assert set(out) == {1, 2}
    start, size = map(int, out[1].rejected_mask.split(":"))
    assert out[1].rejected[start : start + size] == long_ + "<|end|>" and out[1].prompt == f"<|user|>\n{long_}<|end|>\n"
    assert out[2].n_shared == 1 and not out[2].tie and out[2].chosen.count("<|user|>") == 1
    none = spark.createDataFrame([], schema)
    assert preference_chat.preference_pairs(none, none).count() == 0


def test_stale_reply_of_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "old"), (1, 2, None, "?"), (1, 3, "assistant", "new"), (1, 3, "assistant", "new"), (2, 0, "assistant", "only"), (3, None, "user", None), (3, 0, "assistant", None)]
    out = sorted((tuple(r) for r in preference_chat.stale_reply(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert out == sorted([(1, 0, "user", "q"), (1, 1, "assistant", "old"), (1, 2, None, "?"), (1, 3, "assistant", "old"), (1, 3, "assistant", "old"), (2, 0, "assistant", ""), (3, None, "user", None), (3, 0, "assistant", "")], key=str)
