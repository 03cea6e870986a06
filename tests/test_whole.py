"""Operators that once did less than the whole job."""

from datetime import datetime, timedelta

from siltstone.operators import evidence, joins, temporal, typing
from siltstone.plans.registry import QUERIES


def test_every_significant_gap(spark):
    at, rows = datetime(2024, 1, 1), []
    for i in range(1000):
        at += timedelta(hours=5 if i % 4 == 0 else 1)
        rows.append((at,))
    out = temporal.significant_gaps(spark.createDataFrame(rows, "ts timestamp"), "ts").collect()
    assert len(out) == 249
    assert {(r.gap_s, r.missing, r.severity) for r in out} == {(18000.0, 4, "minor")}  # five times the median exactly is not beyond it


def test_joins_within_a_table(spark):
    accounts = spark.createDataFrame([(i, i // 3 if i else None) for i in range(60)], "account_id long, parent_id long")
    out = joins.find_joins({"accounts": accounts}).collect()
    assert [(r.table_a, r.column_a, r.table_b, r.column_b, r.shared, r.score, r.cardinality) for r in out] == [("accounts", "account_id", "accounts", "parent_id", 20, 1.0, "1:n")]


def test_graph_of_every_order(spark):
    data = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{data}/orders.parquet").count()
    assert QUERIES["g02_topology"](spark, data).first().e == orders
    assert QUERIES["g01_node_roles"](spark, data).where("node LIKE 'o%'").count() == orders
    assert QUERIES["g05_hop"](spark, data).count() > orders / 2


def test_cycles_and_chains_of_any_length(spark):
    ring = [(i, (i + 1) % 15) for i in range(15)]
    order = [3, 17, 8, 1, 12, 5, 19, 0, 14, 9, 2, 16]
    second = [(100 + order[i], 100 + order[(i + 1) % 12]) for i in range(12)]
    path = [(200 + i, 201 + i) for i in range(9)]
    edges = spark.createDataFrame([*ring, *second, *path, (5, 103), (103, 200), (200, 209), (7, 7)], "a long, b long")
    got = {(r.node, r.grp) for r in evidence.cyclic_groups(edges).collect()}
    assert got == {(i, 0) for i in range(15)} | {(100 + k, 100) for k in order}
    assert {tuple(r) for r in evidence.chain_edges(edges).select("a", "b").collect()} == {*path, (5, 103), (103, 200)}


def test_rates_of_all_distinct_values(spark):
    mixed = spark.range(24_000).selectExpr("CASE WHEN id < 12000 THEN cast(10000 + id AS string) ELSE concat('x', id) END AS v")
    rates = {r.pattern: r.rate for r in typing.pattern_match_rates(mixed, "v").collect()}
    assert rates["integer"] == 0.5
