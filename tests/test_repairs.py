"""Formulas, names, quantiles, shapes and closures against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import adjudicate, crosscol, evidence, graph, lineage, metrics, profile, typing
from siltstone.operators import scores as scores_module
from siltstone.operators.quantiles import exact_quantiles
from siltstone.sources import readers


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("a / 2.5", 4.0), ("a / b", None), ("a / ((b + c))", 2.0), ("a / -b", None), ("a / (b * (c + 1))", None), ("-a + 3 * c", 5.0), ("a - b - c", 5.0), ("a / c / c", 0.4), ("(a + c) / (a - 2 * c)", None), ("2 / 0", None),
    ],
)
def test_formulas(spark, formula, want):
    steps = {k: spark.createDataFrame([(v,)], "value double") for k, v in (("a", 10.0), ("b", 0.0), ("c", 5.0))}
    assert metrics.evaluate_metric(steps, {}, {"x": formula}).first().x == want


@pytest.mark.parametrize("formula", ["a + d", "a ** b", "a; b", "f(a)", "a if b else c", "'x'", "a +", "a < b"])
def test_formulas_refuse(formula):
    with pytest.raises(ValueError):
        metrics._safe(formula, ["a", "b", "c"])


def test_names():
    assert readers.safe_names(["Cust Key", " Name", "Näme!", "2024", "", "  ", "A/R paid", "Straße", "日本"]) == ["cust_key", "name", "name_2", "c_2024", "column_4", "column_5", "ar_paid", "strae", "column_8"]
    assert readers.safe_names(["a", "x", "a", "y", "a", "2 b", "2b", "__c  d__"]) == ["a", "x", "a_2", "y", "a_3", "c_2_b", "c_2b", "c_d"]
    assert len(set(readers.safe_names(["a", "a_2", "a", "a"]))) == 4


def test_null_strings_keep_their_case(spark):
    df = spark.createDataFrame([(x,) for x in ("None", "NONE", "null", "Null", " n/a ", "#N/A", "#n/a", "--", "-999", "x", "")], "v string")
    assert [r.v for r in readers.blank_nulls(df).collect() if r.v is not None] == ["NONE", "#n/a", "-999", "x"]
    assert readers.blank_sentinels(df, ["v"]).where("v IS NULL").count() == 1


def test_database_reader(spark, tmp_path):
    """Orders in a database of their own, read in ranges at the same time, are those of the file."""
    url = "jdbc:derby:memory:shop;create=true"
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("o_orderkey AS order_key", "CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS cust", "o_totalprice AS price", "CAST(o_orderdate AS DATE) AS day")
    orders.write.format("jdbc").option("url", url).option("dbtable", "orders").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    queries = {"all": "SELECT * FROM orders", "dear": 'SELECT "order_key", "price" FROM orders WHERE "price" > 200000', "none": 'SELECT * FROM orders WHERE "price" < 0', "days": 'SELECT "day", count(*) AS "n" FROM orders GROUP BY "day"'}
    split = {"all": ("cust", 5), "none": ("cust", 5), "days": ("day", 3)}
    with pytest.warns(UserWarning, match="'none' returned no rows"):
        out = readers.read_database(spark, url, queries, split, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert out["all"].columns == ["order_key", "cust", "price", "day"] and out["none"].count() == 0
    assert out["all"].rdd.getNumPartitions() == 5 and out["days"].rdd.getNumPartitions() == 3 and out["dear"].rdd.getNumPartitions() == 1
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(out["all"]) == rows(orders)
    assert rows(out["dear"]) == rows(orders.where("price > 200000").select("order_key", "price"))
    assert rows(out["days"]) == rows(orders.groupBy("day").count())


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {"even": rng.normal(size=5000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "skewed": np.concatenate([np.zeros(4000), rng.pareto(0.5, 100)])}
    rows = [(c, float(v)) for c, vs in values.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    out = {r["column"]: r.q for r in exact_quantiles(spark.createDataFrame(rows, "column string, value double").repartition(5), shares).collect()}
    assert set(out) == set(values)
    for c, vs in values.items():
        assert np.allclose(out[c], np.quantile(vs, shares), rtol=1e-12, atol=0), c
    assert exact_quantiles(spark.createDataFrame([], "column string, value double"), [0.5]).count() == 0


def test_profile(spark):
    rng = np.random.default_rng(4)
    x = rng.gamma(2, 3, 2000).round(3)
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)], "x double, gone double")
    out = {r["column"]: r for r in profile.profile(df, ["x", "gone"]).collect()}
    n, d = len(x), x - x.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    assert (out["x"].total, out["x"].nulls, out["x"].distinct_values) == (2001, 1, len(set(x)))
    assert np.isclose(out["x"].mean, x.mean()) and np.isclose(out["x"].stddev, x.std(ddof=1)) and np.isclose(out["x"].skewness, g1 * np.sqrt(n * (n - 1)) / (n - 2))
    assert (out["gone"].nulls, out["gone"].mean, out["gone"].p50, out["gone"].stddev) == (2001, None, None, None)


@pytest.mark.parametrize(
    ("edges", "nodes", "shape"),
    [
        ([], 0, "empty"), ([], 3, "points"), ([(0, 1), (0, 2), (0, 3)], 4, "star"), ([(0, 1), (1, 2)], 3, "path"), ([(0, 1), (1, 2), (1, 3), (3, 4)], 5, "tree"), ([(0, 1), (2, 3)], 4, "forest"),
        ([(0, 1), (1, 2), (2, 3), (3, 0)], 4, "ring"), ([(0, 1), (1, 2), (2, 0)], 3, "clique"), ([(0, 1), (1, 2), (2, 0), (2, 3)], 4, "net"), ([(0, 1), (1, 2), (2, 0), (3, 4)], 5, "nets"),
    ],
)
def test_shapes(spark, edges, nodes, shape):
    e, v = spark.createDataFrame(edges, "a long, b long"), spark.range(nodes).withColumnRenamed("id", "node")
    assert evidence.graph_shape(graph.node_roles(v, e), graph.topology(v, e)).first().shape == shape


@pytest.mark.parametrize("n", [2, 5, 8, 13, 50])
def test_rings(spark, n):
    order = random.Random(n).sample(range(n), n)
    ring = [(order[i], order[(i + 1) % n]) for i in range(n)]
    assert {(r.node, r.grp) for r in evidence.cyclic_groups(spark.createDataFrame(ring, "a long, b long")).collect()} == {(i, 0) for i in range(n)}


def test_closure(spark):
    rng = random.Random(7)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(35)}
    steps = {}
    for start in range(25):
        front, n, seen = {start}, 0, {start}
        while front:
            n += 1
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            steps |= {(start, b): n for b in front}
    assert {(r.a, r.b): r.steps for r in graph.closure(spark.createDataFrame(sorted(edges), "a long, b long")).collect()} == steps


def test_discovery_rate(spark):
    rng = np.random.default_rng(1)
    p = [(i, float(x)) for i, x in enumerate([*rng.random(200), *(rng.random(50) * 1e-3), 0.0, 1.0])]
    ranked = sorted(p, key=lambda r: (r[1], r[0]))
    last = max((k for k, (_, x) in enumerate(ranked, 1) if x <= 0.05 * k / len(p)), default=0)
    out = crosscol.benjamini_hochberg(spark.createDataFrame(p, "t long, p double"), "t", "p").collect()
    assert {(r.t, r["rank"], r.significant) for r in out} == {(t, k, k <= last) for k, (t, _) in enumerate(ranked, 1)}


def test_second_term_must_pay(spark):
    rows = [("m", "one", 1, 0.8, 0.1, 100, 5.0), ("m", "two - three", 2, 0.8, 0.1, 100, 4.9), ("k", "one", 1, 0.8, 0.1, 100, 5.0), ("k", "two - three", 2, 0.8, 0.1, 100, 1.0), ("j", "low", 1, 0.2, 0.0, 9, 0.0), ("j", "two - three", 2, 0.5, 0.3, 9, 1.0)]
    out = lineage.best_candidate(spark.createDataFrame(rows, "measure string, convention string, terms int, lower double, residual double, n long, rss double"))
    assert {r.measure: r.convention for r in out.collect()} == {"m": "one", "k": "two - three", "j": "two - three"}


def test_pool(spark):
    rows = [("a", 1.0, 0.9), ("a", 1.0, 0.1), ("b", 0.5, 0.8), ("b", 0.9, None), ("c", 0.7, None)]
    out = {r.target: r for r in adjudicate.binary_pool(spark.createDataFrame(rows, "target string, reliability double, p double")).collect()}
    assert np.isclose(out["a"].belief, 0.5) and out["a"].conflict > 0.5
    assert np.isclose(out["b"].belief, 2 / 3) and out["b"].conflict == 0 and out["b"].witnesses == 1
    assert (out["c"].belief, out["c"].conflict, out["c"].witnesses) == (0.5, 0.0, 0)


def test_catalogue(spark):
    examples = {
        "iso_date": "2024-01-15", "iso_datetime": "2024-01-15T10:30:00", "us_date": "1/15/24", "eu_slash_date": "25/12/2024", "eu_date": "15.1.24", "dd_mon_yy": "01-apr-25", "dd_mon_yyyy": "15-Jan-2024", "period_yyyy_mm": "2024-01", "period_yyyy_qq": "2024Q3",
        "time_only": "10:30", "uuid": "550e8400-e29b-41d4-a716-446655440000", "email": "a@b.org", "phone_intl": "+41 79 123 45 67", "url": "https://a.org/x", "integer": "-456", "decimal_dot": "-0.5", "decimal_comma": "123,45", "scientific": "-4.5E-3",
        "percentage": "12.5%", "currency_usd": "$1,234.56", "currency_eur": "1.234,56 €", "currency_gbp": "£1,234.56", "currency_chf": "CHF 1'234.56", "boolean_tf": "TRUE", "boolean_yn": "No", "boolean_10": "1",
    }
    assert list(examples) == [p[0] for p in typing.PATTERNS]
    df = spark.createDataFrame([tuple(examples.values())], list(examples))
    row = typing.build_typed(df, {c: c for c in examples}).first()
    assert all(v is not None for v in row), row
    assert (row.percentage, row.currency_usd, row.currency_eur, row.currency_gbp, row.currency_chf, row.boolean_yn) == (0.125, 1234.56, 1234.56, 1234.56, 1234.56, False)
    assert (str(row.period_yyyy_qq), str(row.us_date), str(row.eu_date)) == ("2024-07-01", "2024-01-15", "2024-01-15")
    rates = {c: {r.pattern for r in typing.pattern_match_rates(df, c).where("rate = 1").collect()} for c in examples}
    assert all(c in rates[c] for c in examples)
    assert spark.createDataFrame([("x",)], "v string").select(*[F.expr(e.format(c="v")).alias(n) for n, _, _, e in typing.PATTERNS]).first() == tuple([None] * len(typing.PATTERNS))


def test_multicollinearity(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 3000))
    columns = {"a": a, "b": b, "total": a + b + 1e-6 * rng.normal(size=3000), "free": rng.normal(size=3000), "flat": np.ones(3000)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values(), strict=True)], list(columns))
    out = evidence.multicollinearity(df, list(columns)).collect()
    own = np.corrcoef(np.array([columns[c] for c in ("a", "b", "total", "free")]))
    want = sorted([*np.linalg.eigvalsh(own), 1.0], reverse=True)
    assert np.allclose([r.eigenvalue for r in out], want, atol=1e-6)
    assert [sorted(r.members) for r in out if r.severity == "severe"] == [["a", "b", "total"]]
    assert all(not r.members for r in out if r.severity == "none")


def test_null_impact_takes_other_bounds(spark):
    df = spark.createDataFrame([(None if i < 3 else i, i) for i in range(10)], "x long, y long")
    assert {r["column"]: r.impact for r in evidence.null_impact(df, ["x", "y"]).collect()} == {"x": "significant", "y": "none"}
    assert {r["column"]: r.impact for r in evidence.null_impact(df, ["x", "y"], {"clean": 0.0, "soiled": 0.0}).collect()} == {"x": "soiled", "y": "clean"}


def test_contract_colours(spark):
    scores = spark.createDataFrame([("a", "nulls", 0.4), ("b", "nulls", 0.6)], "column string, dimension string, score double")
    contracts = spark.createDataFrame([("red", "nulls", 0.1, 1.0), ("orange", "nulls", 0.42, 1.0), ("yellow", "nulls", 0.6, 1.0), ("green", "nulls", 0.99, 1.0), ("mean", "nulls", 0.99, 0.2)], "contract string, dimension string, threshold double, overall double")
    out = {r.contract: r for r in scores_module.evaluate_contracts(scores, contracts).collect()}
    assert {c: r.colour for c, r in out.items()} == {"red": "orange", "orange": "yellow", "yellow": "yellow", "green": "green", "mean": "orange"}
    assert [c for c, r in out.items() if r.strictest] == ["orange"] and [out[c].compliance for c in ("red", "orange", "yellow")] == [0.0, 0.0, 1.0]
