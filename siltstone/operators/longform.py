"""Tables in long form: one row per cell, so that all columns are handled in one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cells(df: DataFrame, columns: list[str], numeric: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``column, value`` (text, or double if ``numeric``) of every cell of ``columns``."""
    kind = "double" if numeric else "string"
    parts = ", ".join(f"'{c}', try_cast(`{c}` AS {kind})" for c in columns)
    return df.selectExpr(*(keep or []), f"stack({len(columns)}, {parts}) AS (column, value)")
