"""P-values, associations, contracts, windows, grains and mixed formats against plain Python."""

import math
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.stats import chi2_tail, log_gamma
from siltstone.operators import crosscol, metrics, scores, temporal, typing


def _tail(x, df):
    """Closed forms: a sum for even degrees of freedom, one more term for odd ones."""
    h = x / 2
    if df % 2 == 0:
        return math.fsum(math.exp(k * math.log(h) - h - math.lgamma(k + 1)) for k in range(df // 2))
    return math.erfc(math.sqrt(h)) + math.fsum(math.exp((k - 0.5) * math.log(h) - h - math.lgamma(k + 0.5)) for k in range(1, (df + 1) // 2))


def test_chi_square_tail(spark):
    rows = [(float(x), d) for d in (1, 2, 3, 5, 8, 16, 17, 61, 200, 999, 1000, 20_001) for x in (0.01, 0.5, 1, d * 0.3 + 0.1, d * 0.7 + 0.2, d, d + 1.5, d * 1.1 + 2, d * 1.5 + 5, d * 2 + 40)]
    for r in spark.createDataFrame(rows, "x double, d int").select("x", "d", chi2_tail("x", "d").alias("p"), F.expr(log_gamma("(d / 2D)")).alias("g")).collect():
        assert abs(r.p - _tail(r.x, r.d)) < 1e-9, r
        assert abs(r.g - math.lgamma(r.d / 2)) < 1e-9 * max(1, abs(r.g))
    odd = spark.createDataFrame([(None, 3), (0.0, 3), (-1.0, 3), (1.0, 0), (1.0, None)], "x double, d int").select(chi2_tail("x", "d").alias("p")).collect()
    assert [r.p for r in odd] == [None, 1.0, 1.0, None, None]


def _association(rows):
    """Chi-square with the correction of two by two."""
    rows = [(a, b) for a, b in rows if a is not None and b is not None]
    na, nb, n, total = Counter(a for a, _ in rows), Counter(b for _, b in rows), Counter(rows), len(rows)
    two = len(na) == len(nb) == 2
    chi2 = 0.0
    for a in na:
        for b in nb:
            want = na[a] * nb[b] / total
            off = abs(n[a, b] - want)
            chi2 += (off - (min(0.5, off) if two else 0)) ** 2 / want
    return chi2, (len(na) - 1) * (len(nb) - 1), math.sqrt(chi2 / (total * (min(len(na), len(nb)) - 1)))


@pytest.mark.parametrize("shape", [(2, 2), (2, 5), (4, 3), (9, 8)])
def test_cramers_v(spark, shape):
    rng = np.random.default_rng(sum(shape))
    rows = [(int(a), int((a + rng.integers(0, 3)) % shape[1] if rng.random() < 0.2 else rng.integers(0, shape[1]))) for a in rng.integers(0, shape[0], 300)] + [(None, 1), (1, None)]
    out = crosscol.cramers_v(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    chi2, df, v = _association(rows)
    assert (out.total, out.df) == (300, df) and abs(out.chi2 - chi2) < 1e-9 and abs(out.v - v) < 1e-9 and abs(out.p_value - _tail(chi2, df)) < 1e-9


@pytest.mark.parametrize("rows", [[(1, 1)] * 4 + [(2, 2)] * 5, [(1, 1), (1, 2)] * 20, []])
def test_cramers_v_abstains(spark, rows):
    out = crosscol.cramers_v(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert out.chi2 is None and out.v is None and out.p_value is None


def test_dependent_pairs(spark):
    """A debit excludes a credit, whatever their sizes; null is a label; a column without zeros tells nothing."""
    rows = []
    for i in range(400):
        debit = float(i + 1) if i % 3 else 0.0
        rows.append((debit, None if debit else 7.5 * i + 1, "x" if i % 5 == 0 else None, "same", float(i + 1), ("p", "q", None)[i % 3]))
    table = spark.createDataFrame(rows, "debit double, credit double, mark string, one string, full double, third string")
    out = crosscol.dependent_pairs(table, table.columns, 20).collect()

    def nmi(x, y):
        h = lambda v: -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())
        return max(0.0, h(x) + h(y) - h(list(zip(x, y, strict=True)))) / math.sqrt(h(x) * h(y)) if h(x) and h(y) else 0.0

    labels = {c: [bool(r[i]) if c in ("debit", "credit", "full") else r[i] for r in rows] for i, c in enumerate(table.columns)}
    assert len(out) == 15 and all(abs(r.nmi - nmi(labels[r.a], labels[r.b])) < 1e-9 for r in out)
    assert {frozenset((r.a, r.b)) for r in out[:1]} == {frozenset(("debit", "credit"))} and abs(out[0].nmi - 1) < 1e-9
    assert crosscol.dependent_pairs(table.limit(0), table.columns).count() == 0


def test_contracts(spark):
    found = [("a", "types.parse", 0.5), ("b", "types.parse", 0.1), ("a", "types.unit", 0.3), ("a", "values", 0.2), ("b", "values", 0.1)]
    table = spark.createDataFrame(found, "column string, dimension string, score double")
    limits = lambda *rows: spark.createDataFrame(list(rows), "contract string, dimension string, threshold double, overall double")
    # Column a has 0.4 for types and b 0.1, so the mean is 0.25; that of values is 0.15.
    run = lambda *rows, **more: {r.contract: r for r in scores.evaluate_contracts(table, limits(*rows), **more).collect()}
    out = run(("tight", "types", 0.1, 0.1), ("tight", "values", 0.1, 0.1), ("near", "types", 0.2, 0.5), ("near", "values", 0.18, 0.5), ("wide", "types", 0.9, 0.9), ("wide", "missing", 0.1, 0.9))
    assert (out["tight"].blocking, out["tight"].colour, out["tight"].compliance) == (3, "red", 0.0) and abs(out["tight"].mean - 0.2) < 1e-12
    assert (out["near"].blocking, out["near"].warnings, out["near"].colour, out["near"].compliance, out["near"].strictest) == (0, 2, "yellow", 0.5, True)
    assert (out["wide"].colour, out["wide"].compliance, out["wide"].strictest) == ("green", 1.0, False)
    stopped = run(("wide", "types", 0.9, 0.9), blocked=spark.createDataFrame([("b",)], "column string"))["wide"]
    assert (stopped.blocking, stopped.colour, stopped.strictest) == (1, "red", False)
    assert run(("one", "types", 0.1, 0.9))["one"].colour == "orange"


def test_windows_of_flows(spark):
    days = lambda *ds: spark.createDataFrame([(datetime(2024, m, d), k) for m, d, k in ds], "ts timestamp, kind string")
    a = days(*[(m, 28, "x") for m in range(1, 13)], (1, 1, "y"))
    run = lambda *conditions: temporal.reconciled_window([(a, "ts", c) for c in conditions], 30, "month").first()
    assert abs(run("kind = 'x'", "kind = 'x'").days - 335 * 12 / 11) < 1e-9 and run("kind = 'x'").derived
    assert tuple(run("kind = 'x'", "true")) == (30.0, False, "flows disagree", 2)
    assert tuple(run("kind = 'x'", "kind = 'y'")) == (30.0, False, "a flow spans a single period", 2)
    assert tuple(run("kind = 'z'", "true"))[:3] == (30.0, False, "a flow has no rows")


def test_grain_tokens(spark):
    at = lambda token: str(spark.sql(f"SELECT {metrics.grain_bucket('timestamp_ntz{}2024-05-10 13:37:21{}'.format(chr(39), chr(39)), token)} AS t").first().t)
    assert [at(t) for t in ("15m", "20s", "2h", "1d", "1w", "5M", "1q", "1y")] == ["2024-05-10 13:30:00", "2024-05-10 13:37:20", "2024-05-10 12:00:00", "2024-05-10 00:00:00", "2024-05-06 00:00:00", "2024-03-01", "2024-04-01", "2024-01-01"]
    for bad in ("", "m", "0m", "015m", "1mo", "1Q", " 1m", "12345m", "1.5h"):
        with pytest.raises(ValueError, match="no grain"):
            metrics.grain_bucket("x", bad)


def test_mixed_candidates(spark):
    rows = [("2024-05-01", "1", "a"), ("05/02/2024", "2.5", "b"), ("03-May-24", "x", None), ("2024-05-04", "4", "c"), ("05/06/2024", "5", "d"), ("06-MAY-24", "6.5", "e")]
    table = spark.createDataFrame(rows, "day string, number string, name string")
    out = {(r.column, r.pattern): r for r in typing.type_candidates(table, ["day", "number", "name"]).collect()}
    assert set(out) == {("day", "iso_date+us_date+eu_slash_date+dd_mon_yy"), ("number", "decimal_dot+integer".replace("decimal_dot+integer", "text")), ("name", "text")} or ("number", "integer") in out
    decided = {r["column"]: r["pattern"] for r in typing.decide_types(typing.type_candidates(table, ["day"])).collect()}
    built = typing.build_typed(table, decided).collect()
    assert [str(r.day) for r in built] == ["2024-05-01", "2024-05-02", "2024-05-03", "2024-05-04", "2024-05-06", "2024-05-06"]
    assert typing.type_candidates(table.limit(0), ["day"]).collect()[0].pattern == "text"


@pytest.mark.parametrize("range_values", [7, 100, 10**6])
def test_quantiles_by_ranges(spark, range_values):
    from siltstone.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(3)
    values = {"even": rng.normal(size=1500), "ties": rng.integers(0, 3, 900).astype(float), "one": np.array([4.0])}
    rows = [(c, float(x)) for c, v in values.items() for x in v] + [("even", None), ("even", float("nan")), ("none", None)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    out = {r["column"]: r.q for r in exact_quantiles(spark.createDataFrame(rows, "column string, value double"), shares, range_values).collect()}
    assert set(out) == set(values)
    for c, v in values.items():
        assert np.allclose(out[c], np.quantile(v, shares), atol=1e-12)


@pytest.mark.parametrize("range_rows", [3, 40, 10**6])
def test_gaps_by_ranges(spark, range_rows):
    """Times that crowd into one day, repeat, and jump over years."""
    rng = np.random.default_rng(9)
    seconds = sorted({int(x) for x in [*rng.integers(0, 4000, 300), *rng.integers(10**8, 10**8 + 50, 40), 3 * 10**8]})
    rows = [(datetime.fromtimestamp(1_500_000_000 + s),) for s in seconds for _ in range(1 + s % 3)] + [(None,)]
    out = sorted((r.ts, r.gap_s) for r in temporal.gaps(spark.createDataFrame(rows, "ts timestamp"), "ts", range_rows).collect())
    assert [g for _, g in out] == [float(b - a) for a, b in zip(seconds, seconds[1:], strict=False)]
    assert temporal.gap_statistics(spark.createDataFrame([], "ts timestamp"), "ts").first().n_gaps == 0


def test_full_profile(spark):
    from siltstone.operators import profile

    values = [1.0, 1.0, 2.0, 5.0, 5.0, 5.0, 11.0, None]
    table = spark.createDataFrame([(v, "a" if i % 3 else "bb", 4) for i, v in enumerate(values)], "x double, t string, c int")
    out = {r["column"]: r for r in profile.full_profile(table, ["x", "t", "c"], ["x", "c"], k=2, bins=4).collect()}
    assert [(b.bin, b.low, b.high, b.n) for b in out["x"].histogram] == [(1, 1.0, 3.5, 3), (2, 3.5, 6.0, 3), (3, 6.0, 8.5, 0), (4, 8.5, 11.0, 1)]
    assert [(v.value, v.n) for v in out["x"].top_values] == [("5.0", 3), ("1.0", 2)] and [(v.value, v.n) for v in out["t"].top_values] == [("a", 5), ("bb", 3)]
    assert out["c"].histogram is None and out["t"].histogram is None and out["t"].p50 is None
    x = np.array([v for v in values if v is not None])
    assert (out["x"].total, out["x"].nulls, out["x"].distinct_values) == (8, 1, 4) and abs(out["x"].p50 - np.median(x)) < 1e-12 and abs(out["x"].mad - np.median(abs(x - np.median(x)))) < 1e-12


def test_full_temporal_profile(spark):
    """Two years of days with a hole and a thin last day, beside a column of the same times that are irregular."""
    from datetime import timedelta

    start = datetime(2022, 1, 1)
    rows = []
    for d in range(730):
        if not 100 <= d < 112:
            rows += [(start + timedelta(days=d), start + timedelta(seconds=d**3), "x")] * (1 if d == 729 else 4)
    table = spark.createDataFrame(rows, "day timestamp, odd timestamp, t string")
    out = {r["column"]: r for r in temporal.full_temporal_profile(table, "2024-02-01 00:00:00", 1).collect()}
    day, odd = out["day"], out["odd"]
    assert (day.grain, day.present, day.expected, day.distinct_ts, day.last_rows, day.typical, day.is_full, day.stale) == ("day", 718, 730, 718, 1, 4.0, False, True)
    assert [(g.gap_s, g.missing, g.severity) for g in day.gaps] == [(13 * 86400.0, 12, "severe")] and day.n_gaps_over == 1 and abs(day.largest_gap_days - 13) < 1e-12
    assert odd.grain == "irregular" and odd.completeness is None and odd.n_gaps_over > 1 and len(odd.gaps) == 1
    empty = temporal.full_temporal_profile(table.limit(0), "2024-02-01 00:00:00").collect()
    assert [r.n_gaps_over for r in empty] == [0, 0] and empty[0].median_gap is None
    with pytest.raises(ValueError, match="no time column"):
        temporal.full_temporal_profile(table.select("t"), "2024-02-01 00:00:00")


def test_estimated_joins(spark):
    """Estimates lie within four standard errors of the exact scores of all columns, and no pair clearly above the bound is lost."""
    from siltstone.operators import joins
    from siltstone.plans.joins import _FAMILIES

    tables = {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in _FAMILIES}
    names = ("table_a", "column_a", "table_b", "column_b")
    cells = joins.join_cells(tables)
    stats = joins.join_statistics(cells).where("distinct_values > 1")
    d = {(r.table, r.column): r.distinct_values for r in stats.collect()}
    # Jaccard alone: with keys out of reach nothing is contained.
    exact = {tuple(r[n] for n in names): r.score for r in joins._named(joins._exact_pairs(cells, stats, 0.0, 100, 2.0, True), "score").collect()}
    got = {tuple(r[n] for n in names): r for r in joins.find_joins_adaptive(tables, estimate_from=20, min_score=0.05, key_at=2.0).collect()}
    large = {p for p in exact if max(d[p[:2]], d[p[2:]]) >= 20}
    for p, r in got.items():
        j = exact[p]
        assert r.algorithm == ("minhash" if p in large else "exact")
        assert abs(r.score - j) <= (4 * max(j * (1 - j) / 128, 1e-9) ** 0.5 if p in large else 1e-12), p
        assert r.confidence == 1 if p not in large else 0.9 < r.confidence < 1
    sure = {p for p in exact if exact[p] >= (0.05 + 4 * (exact[p] * (1 - exact[p]) / 128) ** 0.5 if p in large else 0.05)}
    assert sure <= set(got) and len(sure & large) >= 5
    # No large column: the rows of the exact search, which none is above.
    same = joins.find_joins(tables).drop("shared")
    small = joins.find_joins_adaptive(tables)
    assert set(small.columns) == {*same.columns, "algorithm", "confidence"}
    assert sorted(map(tuple, small.select(same.columns).collect())) == sorted(map(tuple, same.collect()))
    empty = {t: df.limit(0) for t, df in tables.items()}
    assert joins.find_joins_adaptive(empty, estimate_from=1).count() == 0
