"""How a query and its SQL enter the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of a table reader under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as binary numbers, as most engines do, so that two engines' sums compare."""
    scale = f"1e{digits}D"
    return df.selectExpr(*[f"CASE WHEN abs({c}) < 1e9D THEN round({c} * {scale}) / {scale} ELSE round({c}, {digits}) END AS {c}" if t == "double" else f"cast({c} AS bigint) AS {c}" if t in ("int", "smallint", "tinyint") else c for c, t in df.dtypes])
