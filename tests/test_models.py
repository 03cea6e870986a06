"""Finance metrics, model graphs and reconciliation of facts on planted tables."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import finance, lineage, model_graph


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "concept string, amount double, behaviour string, ts timestamp, account string")


def test_finance_metrics(spark):
    month = lambda m, d=1: datetime(2024, m, d)
    rows = []
    for m in range(1, 13):
        rows += [("revenue", 100.0, "flow", month(m), f"a{m % 3}"), ("cost_of_goods_sold", 60.0, "flow", month(m), "b"), ("operating_expense", 10.0, "flow", month(m), "b")]
        # A stock stands as in its last month.
        rows += [("accounts_receivable", 50.0 * m, "stock", month(m), "c"), ("inventory", 30.0, "stock", month(m), "c"), ("accounts_payable", 12.0, "stock", month(m), "c")]
    rows += [("interest", 20.0, "flow", month(5), "b"), ("tax", 40.0, "flow", month(6), "b"), ("current_assets", 300.0, "stock", month(12), "c"), ("current_assets", 30.0, "stock", month(12, 9), "c"), ("current_liabilities", 0.0, "stock", month(12), "c"), (None, 7.0, "flow", month(1), "z")]
    out = {r.metric: r for r in finance.finance_metrics(_ledger(spark, rows)).collect()}
    assert len(out) == 16
    days = 335 * 12 / 11
    want = {"gross_profit": 480.0, "gross_margin": 40.0, "operating_income": 360.0, "operating_margin": 30.0, "net_income": 300.0, "net_margin": 25.0, "dso": 600 / 1200 * days, "dio": 30 / 720 * days, "dpo": 12 / 720 * days, "transaction_count": 38.0, "active_accounts": 4.0}
    assert all(abs(out[m].value - v) < 1e-9 for m, v in want.items())
    assert abs(out["cash_conversion_cycle"].value - (want["dso"] + want["dio"] - want["dpo"])) < 1e-9
    # No depreciation is known, and nothing is owed.
    assert all(out[m].value is None and out[m].status == "inconclusive" and out[m].label is None for m in ("ebitda", "ebitda_margin", "current_ratio"))
    assert (out["gross_margin"].label, out["net_margin"].label, out["dso"].label, out["dso"].status) == ("GOOD", "EXCELLENT", "CRITICAL", "supported")
    assert abs({r.metric: r.value for r in finance.finance_metrics(_ledger(spark, rows), days=30).collect()}["dso"] - 15) < 1e-12
    none = {r.metric: r.status for r in finance.finance_metrics(_ledger(spark, [])).collect()}
    assert len(none) == 16 and none["dso"] == none["gross_profit"] == "inconclusive"


def test_periods_that_disagree(spark):
    rows = [("revenue", 1.0, "flow", datetime(2024, m, 1), "a") for m in (1, 2, 3)] + [("cost_of_goods_sold", 1.0, "flow", datetime(2024, m, 1), "a") for m in (1, 2)]
    values = finance.concept_values(_ledger(spark, rows))
    assert tuple(finance.period_days(values, ["revenue", "cost_of_goods_sold"]).first()) == (30.0, False)
    assert finance.period_days(values, ["revenue"]).first().derived


def test_model_graph(spark):
    vertices = spark.createDataFrame([("c1", "concept", "revenue"), ("c2", "concept", "income"), ("g1", "grounding", "sum of sales"), ("k1", "column", "amount"), ("k2", "column", "day"), ("t1", "table", "sales"), ("t2", "table", "days"), ("v1", "table", "sales view")], "node string, kind string, name string")
    edges = spark.createDataFrame(
        [
            ("part_of", "c1", "c2", {"tolerance": "0.5"}), ("disjoint_with", "c1", "t1", {}), ("grounded_by", "c1", "g1", {}), ("uses", "g1", "k1", {"role": "value"}), ("uses", "g1", "gone", {"role": "value"}),
            ("belongs_to", "k1", "t1", {}), ("belongs_to", "k2", "t2", {}), ("references", "k1", "k2", {"cardinality": "n:1", "introduces_duplicates": "false"}),
            ("conforms", "t1", "t2", {"dimension": "d", "attribute": "a"}), ("conforms", "t2", "t1", {"dimension": "d", "attribute": "a"}),
            ("derived_from", "v1", "t2", {"base_role": "dimension"}), ("derived_from", "v1", "t1", {"base_role": "fact"}), ("unknown", "c1", "c2", {}),
        ],
        "kind string, a string, b string, props map<string, string>",
    )
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(model_graph.concept_edges(vertices, edges)) == [("revenue", "part_of", 0.5, "income")]
    assert rows(model_graph.column_uses(vertices, edges)) == [("revenue", "sum of sales", "value", "amount", "sales")]
    assert rows(model_graph.table_references(vertices, edges)) == [("sales", "amount", "days", "day", "n:1", False)]
    assert rows(model_graph.conformed_dimensions(vertices, edges)) == [("days", "sales", "d", "a")]
    assert rows(model_graph.derivations(vertices, edges)) == [("sales view", ["days"])]
    assert sorted(rows(model_graph.unresolved(vertices, edges))) == [("disjoint_with", 1), ("unknown", 1), ("uses", 1)]
    assert model_graph.column_uses(vertices.limit(0), edges).count() == 0


def test_reconcile_facts(spark):
    """A journal, monthly sums of it per shop, a running balance of debits less credits, noise, and a date axis that is off."""
    rng = np.random.default_rng(7)
    lines, months = [], []
    for shop in range(8):
        balance = 100.0
        for month in range(1, 13):
            debit = credit = 0.0
            for _ in range(int(rng.integers(2, 6))):
                d, c = float(rng.integers(10, 200)), float(rng.integers(5, 90))
                lines.append((shop, datetime(2024, month, int(rng.integers(1, 28))), datetime(2025, int(rng.integers(1, 13)), 1), d, c))
                debit, credit = debit + d, credit + c
            balance += debit - credit
            months.append((shop, datetime(2024, month, 28), debit, balance, float(rng.integers(1, 10**6))))
    journal = spark.createDataFrame(lines, "shop int, day timestamp, due timestamp, debit double, credit double")
    summary = spark.createDataFrame(months, "store int, month timestamp, turnover double, balance double, noise double")
    facts = {"journal": lineage.Fact(journal, {("shop", "seller"): "shop"}, ["day", "due"], ["debit", "credit"]), "summary": lineage.Fact(summary, {("shop", "seller"): "store"}, ["month"], ["turnover", "balance", "noise"])}
    matrix = spark.createDataFrame([("journal", "shop", "seller"), ("summary", "shop", "seller"), ("summary", "other", "x")], "fact string, dimension string, role string")
    out = {r.measure: r for r in lineage.reconcile_facts(facts, matrix).collect()}
    assert set(out) == {"turnover", "balance"}
    assert (out["turnover"].convention, out["turnover"].pattern, out["turnover"].event_time, out["turnover"].terms) == ("debit", "per_period", "day", 1)
    assert (out["balance"].convention, out["balance"].pattern, out["balance"].event_time, out["balance"].terms) == ("debit - credit", "cumulative", "day", 2)
    assert all(r.fact == "summary" and r.event_fact == "journal" for r in out.values())
    # Without a shared dimension there is nothing to compare, and sums never explain their finer lines.
    assert lineage.reconcile_facts(facts, matrix.where("dimension = 'other'")).count() == 0
    assert lineage.reconcile_facts(facts, matrix).where(F.col("fact") == "journal").count() == 0
