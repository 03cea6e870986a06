"""Steps that would grow faster than their tables: leaves of graphs, and votes of facts."""

import random
from datetime import datetime

import pytest

from siltstone.operators import graph as g
from siltstone.operators import lineage


def _brute(nodes, edges):
    """Neighbours, components and cyclic groups of one graph, by walking from every node."""
    near, out = {n: set() for n in nodes}, {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
            out[a].add(b)

    def reached(start, ways):
        seen, todo = set(), [start]
        while todo:
            for n in ways[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        return seen

    parts = {frozenset(reached(n, near) | {n}) for n in nodes}
    ahead = {n: reached(n, out) for n in nodes}
    rings = {frozenset(m for m in ahead[n] if n in ahead[m]) for n in nodes if n in ahead[n]}
    degrees = [len(x) for x in near.values()]
    return len(nodes), sum(degrees) // 2, len(parts), sum(d >= 3 for d in degrees), degrees.count(1), degrees.count(0), len(rings)


def test_pattern_classes_leave_leaves_out_of_rounds(spark, monkeypatch):
    rng = random.Random(5)
    graphs = {
        "star": ([], [(f"n{i}", "hub") for i in range(300)]), "pairs": ([], [(f"l{i}", f"r{i}") for i in range(200)]),
        "both": (["alone"], [("a", "b"), ("b", "a"), ("c", "a"), ("d", "d")]), "path": ([], [(f"p{i}", f"p{i + 1}") for i in range(12)]),
        "ring with leaves": ([], [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [(f"x{i}", f"r{i % 5}") for i in range(200)]),
    } | {f"random {k}": ([str(i) for i in range(14)], [(str(rng.randrange(14)), str(rng.randrange(14))) for _ in range(5 + 3 * k)]) for k in range(6)}
    nodes = [(name, n) for name, (more, edges) in graphs.items() for n in {*more, *(x for e in edges for x in e)}]
    edges = [(name, a, b) for name, (_, own) in graphs.items() for a, b in own]
    # Rows of all graphs that go through rounds.
    rows = []
    rounds, rings = g._components, g.strong_components
    monkeypatch.setattr(g, "_components", lambda n, e: rows.append(n.count() + e.count()) or rounds(n, e))
    monkeypatch.setattr(g, "strong_components", lambda e: rows.append(e.count()) or rings(e))
    out = g.pattern_classes(spark.createDataFrame(nodes, "graph string, node string"), spark.createDataFrame(edges, "graph string, a string, b string"))
    got = {r.graph: (r.v, r.e, r.c, r.hubs, r.leaves, r.isolated, r.cycles) for r in out.collect()}
    assert got == {name: _brute({n for of, n in nodes if of == name}, own) for name, (_, own) in graphs.items()}
    assert len(rows) == 2
    assert sum(rows) < 400


def test_graphs_with_separators_in_their_names(spark):
    nodes = spark.createDataFrame([("a", "b\x1fc"), ("a\x1fb", "c"), ("a\x1fb", "d")], "graph string, node string")
    out = g.pattern_classes(nodes, spark.createDataFrame([("a\x1fb", "c", "d")], "graph string, a string, b string"))
    assert {(r.graph, r.v, r.e, r.c) for r in out.collect()} == {("a", 1, 0, 1), ("a\x1fb", 2, 1, 1)}


def test_facts_are_spread_after_their_last_shuffle(spark, monkeypatch):
    """Votes against a plain count, with months without events, empty sums and a shop that only one side has."""
    rng = random.Random(3)
    months, lines = [], []
    for shop in range(6):
        for month in range(1, 11):
            months.append((shop, datetime(2024, month, 1), None if month == 4 else float(rng.randrange(50, 99)), float(rng.randrange(99))))
            if shop < 5 and (shop + month) % 7:
                lines += [(shop, datetime(2024, month, rng.randrange(1, 28)), float(rng.randrange(60)), None if shop == 1 and month < 6 else float(rng.randrange(30))) for _ in range(rng.randrange(2, 5))]
    facts = {
        "months": lineage.Fact(spark.createDataFrame(months, "store int, month timestamp, y double, z double"), {("shop", "seller"): "store"}, ["month"], ["y", "z"]),
        "lines": lineage.Fact(spark.createDataFrame(lines, "shop int, day timestamp, a double, b double"), {("shop", "seller"): "shop"}, ["day"], ["a", "b"]),
    }
    matrix = spark.createDataFrame([(f, "shop", "seller") for f in facts], "fact string, dimension string, role string")
    plans, tables = [], []
    write = lineage.stored

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        tables.append(write(df))
        return tables[-1]

    monkeypatch.setattr(lineage, "stored", kept)
    lineage.reconcile_facts(facts, matrix).collect()
    # Written before: each period once per measure and convention.
    assert max(t.count() for t in tables) <= len(months)
    assert "Exchange" not in plans[-1].split("Generate")[0]

    got = {tuple(r.convention.split("\x1e")[1:]) + (int(r.entity),): (r.periods, r.r_flow, r.r_stock) for r in tables[-1].collect()}
    total = lambda values: sum(v for v in values if v is not None) if any(v is not None for v in values) else None
    want = {}
    for shop in range(5):
        mine = [(m[1].month, m[2:]) for m in months if m[0] == shop]
        for place, measure in enumerate("yz"):
            for name in ("a", "b", "a - b", "b - a"):
                ys, ms = [], []
                for month, values in mine:
                    own = [x for x in lines if x[0] == shop and x[1].month == month]
                    sums = {"a": total([x[2] for x in own]), "b": total([x[3] for x in own])}
                    parts = [sums[c] for c in name.split(" - ")]
                    ys.append(values[place])
                    ms.append(0.0 if None in parts else parts[0] - sum(parts[1:]))
                steps = [None] + [None if p is None or q is None else q - p for p, q in zip(ys, ys[1:], strict=False)]
                size = lambda ms: sum(map(abs, ms)) or None
                flow, stock = size(ms), size([m for d, m in zip(steps, ms, strict=True) if d is not None])
                want[measure, name, shop] = (
                    len(mine), flow and sum(abs(y - m) for y, m in zip(ys, ms, strict=True) if y is not None) / flow,
                    stock and sum(abs(d - m) for d, m in zip(steps, ms, strict=True) if d is not None) / stock,
                )
    assert set(got) == set(want)
    for key, value in want.items():
        assert got[key] == pytest.approx(value), key
