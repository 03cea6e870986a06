"""What the fourth round found: medians of gaps that lie between two microseconds."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest

from siltstone.operators import temporal
from siltstone.plans.registry import ORACLE_SQL, QUERIES


def _times(start, steps):
    return [(start + datetime.timedelta(microseconds=sum(steps[:i])),) for i in range(len(steps) + 1)]


def test_full_temporal_keeps_half_microseconds(spark, tmp_path):
    """Near 1970 the SQL's doubles of seconds are exact enough to tell a median of 137.5 microseconds from 138."""
    steps = [137] * 20 + [138] * 15 + [700, 1400, 2100, 2800, 3500]
    tables = {"events": _times(datetime.datetime(1970, 1, 1), steps), "orders": _times(datetime.datetime(2024, 1, 1), [86_400_000_000] * 5)}
    con = duckdb.connect()
    for (table, rows), ts in zip(tables.items(), ("ts", "o_orderdate"), strict=True):
        spark.createDataFrame(rows, f"{ts} timestamp_ntz").write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["x08_full_temporal"])
    columns = [d[0] for d in want.description]
    got = {r["column"]: r for r in QUERIES["x08_full_temporal"](spark, str(tmp_path)).collect()}
    for row in want.fetchall():
        row = dict(zip(columns, row, strict=True))
        for c in columns:
            assert got[row["column"]][c] == (pytest.approx(row[c], abs=1e-9) if isinstance(row[c], float) else row[c]), c
    assert got["ts"].median_gap == 137.5e-6 and got["ts"].n_gaps_over == 5


@pytest.mark.parametrize("low", [22, 59, 299_432])
def test_gaps_of_exactly_twice_the_median_are_not_over(spark, low):
    steps = [low] * 15 + [low + 1] * 10 + [2 * low + 1] * 3 + [2 * low + 2] * 2
    random.Random(0).shuffle(steps)
    times = spark.createDataFrame(_times(datetime.datetime(2024, 1, 1), steps), "ts timestamp_ntz")
    row = temporal.full_temporal_profile(times, "2030-01-01 00:00:00").first()
    assert (row.median_gap, row.n_gaps_over, len(row.gaps)) == ((2 * low + 1) / 2e6, 2, 2)
