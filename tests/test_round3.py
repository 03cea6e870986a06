"""What the third round found: long rings, near ties, placeholders among true values, and gaps of microseconds."""

from __future__ import annotations

import datetime

import duckdb

from siltstone.operators import graph as g
from siltstone.plans.registry import ORACLE_SQL, QUERIES
from tests.test_queries import _rows


def _agrees(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)), con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    return _rows(got.columns, [tuple(r) for r in got.collect()]), _rows(columns, want.fetchall())


def test_long_rings_take_few_rounds(spark, monkeypatch):
    written = []
    kept = g.stored
    monkeypatch.setattr(g, "stored", lambda df: written.append(1) or kept(df))
    n = 120
    ring = [(f"r{i:03}", f"r{(i + 1) % n:03}") for i in range(n)]
    # A ring with two shortcuts and a way out of it into another ring.
    forked = [(f"s{i:03}", f"s{(i + 1) % n:03}") for i in range(n)] + [("s010", "s090"), ("s050", "s020"), ("s030", "t"), ("t", "u"), ("u", "r000")]
    got = {r.node: r.grp for r in g.strong_components(spark.createDataFrame(ring + forked, "a string, b string")).collect()}
    assert got == {f"{x}{i:03}": f"{x}000" for x in "rs" for i in range(n)}
    assert len(written) < 70


def test_gaps_are_differences_of_whole_microseconds(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    steps = [0] + [137] * 40 + [274, 275, 685, 686, 1370, 1371, 411, 548]
    times = [start + datetime.timedelta(microseconds=sum(steps[: i + 1])) for i in range(len(steps))]
    got, want = _agrees(spark, tmp_path, "x05_significant_gaps", events=spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz"))
    assert got == want
    assert len(got) == 7


def test_true_values_written_like_a_placeholder(spark, tmp_path):
    rows = [(1, 9999, datetime.datetime(1970, 1, 1)), (2, 7, datetime.datetime(1900, 1, 1)), (3, 8, datetime.datetime(1995, 5, 5)), (4, 9998, datetime.datetime(1995, 5, 6))]
    got, want = _agrees(spark, tmp_path, "s08_sentinels", orders=spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"))
    assert got == want
    assert sum(r.count(None) for r in got) == 4


def test_near_ties_of_dependent_pairs_are_ranked_before_rounding(spark, tmp_path):
    # All combinations twenty times, and a few rows more: scores far below what six digits show.
    made = [(6 * i + k, k % 3, s, 1000.0 + 200000.0 * big, p) for i in range(20) for k in range(6) for s in "FOP" for big in (0, 1) for p in "12345"]
    made += [(6, 0, "P", 201000.0, "5"), (7, 1, "P", 201000.0, "5"), (6, 0, "O", 1000.0, "5")]
    orders = spark.createDataFrame(made, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")
    got, want = _agrees(spark, tmp_path, "a07_dependent_pairs", orders=orders)
    assert got == want
    assert len(got) == 5


def test_each_value_is_parsed_once_and_only_where_it_may_be_a_date(spark):
    from siltstone.operators import typing as t

    odd = ["", " 2020-01-02", "2020-1-2", "+2020-01-02", "-2020-01-02", "1/2/20", "1/2/2020", "1.2.2020", "1.2.20", "3-jan-20", "3-JAN-2020", "2020-03", "12:30", "9:30:15", "12345", "n/a", "7 EUR"]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    whole = {"iso_date": "v, 'yyyy-MM-dd'", "dd_mon_yy": "initcap(v), 'd-MMM-yy'", "dd_mon_yyyy": "initcap(v), 'd-MMM-yyyy'", "period_yyyy_mm": "concat(v, '-01'), 'yyyy-MM-dd'"}
    parse = {n: e.format(c="v") for n, _, _, e in t.PATTERNS}
    day = lambda x, y: f"cast(coalesce(try_to_timestamp(v, '{x}'), try_to_timestamp(v, '{y}')) AS date)"
    plain = {n: f"cast(try_to_timestamp({a}) AS date)" for n, a in whole.items()} | {"us_date": day("M/d/yyyy", "M/d/yy"), "eu_slash_date": day("d/M/yyyy", "d/M/yy"), "eu_date": day("d.M.yyyy", "d.M.yy")}
    plain["time_only"] = "CASE WHEN try_to_timestamp(concat('2000-01-01 ', v), 'yyyy-MM-dd H:mm[:ss]') IS NOT NULL THEN v END"
    assert df.where(" OR ".join(f"NOT ({parse[n]} <=> {e})" for n, e in plain.items())).count() == 0
    assert df.where(f"{parse['eu_date']} IS NOT NULL").count() == 2
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = t.catalogue_scan(df, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("d.M.yyyy") == 1


def test_composite_key_counts_in_parts_of_bounded_size(spark):
    from siltstone.operators import joins as j

    left = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 1), (2, None, 2), (None, "c", 3)], "x int, y string, z int")
    right = spark.createDataFrame([(1, "a", 1), (1, "a", 3), (2, "b", 1), (3, "d", 1)], "u bigint, v string, w int")
    assert j.composite_key(left, right, ("x", "u"), [("y", "v"), ("z", "w")]) == ([("x", "u"), ("z", "w")], "1:1")
    assert j.measured_cardinality(left, right, ["x", "y"], ["u", "v"], 4).first()[:] == (2, 2, "n:m")
    assert j.spread(left, ["x"], 5 << 20).rdd.getNumPartitions() == 5


def test_estimates_equal_their_sql(spark):
    from siltstone.operators import joins as j
    from siltstone.plans.base import rounded
    from siltstone.plans.joins import _FAMILIES

    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in _FAMILIES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    # As for a million distinct values, from twenty on.
    want = con.execute(ORACLE_SQL["j05_adaptive"].replace("1000000", "20"))
    columns = [d[0] for d in want.description]
    got = rounded(j.find_joins_adaptive({t: spark.read.parquet(f"{data}/{t}.parquet") for t in _FAMILIES}, estimate_from=20))
    rows = _rows(got.columns, [tuple(r) for r in got.collect()])
    assert rows == _rows(columns, want.fetchall())
    assert {r[0] for r in rows} == {"exact", "minhash"}
