"""Readers that keep everything as text or trust the file, names made safe, and layers."""

from __future__ import annotations

import unicodedata
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Strings that stand for a missing value, and columns that exports leave behind.
NULLS_ANY_CASE = ["", "NULL", "NaN", "NA", "N/A", "MISSING", "UNKNOWN", "UNDEFINED", "NOT SET", "NOT PROVIDED", "NO DATA", "NO VALUE"]
NULLS_AS_WRITTEN = ["null", "None", "#N/A", "#NULL!", "#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "-", "--", "---", ".", "*"]
NUMERIC_SENTINELS = ["-999", "-9999", "9999"]
DATE_SENTINELS = ["0000-00-00", "1900-01-01", "1970-01-01"]
JUNK_COLUMNS = ["Unnamed: 0", "Unnamed: 0.1", "Unnamed: 0.2", "column0", "column00"]


def safe_name(header: str, position: int = 0) -> str:
    """Lower-case letters, digits and underscores: white space becomes one, accents and all else go.

    A name that would begin with a digit gets ``c_`` before it, an empty one is ``column_`` and its position.
    """
    letters = unicodedata.normalize("NFD", header.strip().lower())
    words = "".join("_" if c.isspace() else c for c in letters if c.isspace() or c == "_" or (c.isascii() and c.isalnum())).split("_")
    name = "_".join(w for w in words if w)
    if not name:
        return f"column_{position}"
    return f"c_{name}" if name[0].isdigit() else name


def safe_names(headers: list[str]) -> list[str]:
    """Safe names of all headers; the second of a name gets ``_2`` behind it, the third ``_3``, and so on."""
    out: list[str] = []
    times: dict[str, int] = {}
    for i, header in enumerate(headers):
        first = name = safe_name(header, i)
        # A numbered name may itself be a header's.
        while name in out or (times.get(first, 0) and name == first):
            times[first] = times.get(first, 1) + 1
            name = f"{first}_{times[first]}"
        times.setdefault(first, 1)
        out.append(name)
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))


def drop_junk(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.drop(*(names or JUNK_COLUMNS))


def blank_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text cells that only stand for a missing value become null."""
    text = [f.name for f in df.schema if isinstance(f.dataType, StringType) and (columns is None or f.name in columns)]
    missing = lambda c: F.upper(F.trim(c)).isin([n.upper() for n in NULLS_ANY_CASE]) | F.trim(c).isin(NULLS_AS_WRITTEN)
    return df.withColumns({c: F.when(~missing(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in text})


def blank_sentinels(df: DataFrame, numeric: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
    """Cells of text columns that hold a number or a date which only stands for a missing one become null."""
    listed = [(c, NUMERIC_SENTINELS) for c in numeric or []] + [(c, DATE_SENTINELS) for c in dates or []]
    return df.withColumns({c: F.when(~F.trim(F.col(f"`{c}`")).isin(values), F.col(f"`{c}`")) for c, values in listed})


def read_csv_text(spark: SparkSession, path: str | list[str], header: list[str] | None = None) -> DataFrame:
    """All columns as text, null strings blanked, junk dropped, names made safe; a malformed line fails.

    ``header`` names the columns and saves the pass that reads them from the file.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"').option("multiLine", False)
    if header is not None:
        reader = reader.schema(StructType([]) if not header else ", ".join(f"`{h}` string" for h in header))
    raw = reader.csv(path)
    # Every header has its place and its number, also those that go.
    named = [(n, h) for n, h in zip(safe_names(raw.columns), raw.columns, strict=True) if h not in JUNK_COLUMNS]
    return drop_junk(blank_nulls(raw)).toDF(*[n for n, _ in named])


def read_json_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every top-level field as the JSON text of its value, strings in quotes; a missing one or a null is null."""
    df = spark.read.json(path)
    # A list of one value is its text in brackets.
    text = lambda c: F.expr(f"substring(to_json(array(`{c}`), map('ignoreNullFields', 'false')), 2, length(to_json(array(`{c}`), map('ignoreNullFields', 'false'))) - 2)")
    return normalise_columns(df.select(*[F.when(F.col(f"`{c}`").isNotNull(), text(c)).alias(c) for c in df.columns]))


def read_parquet_typed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return normalise_columns(spark.read.parquet(path))


def read_database(spark: SparkSession, url: str, queries: dict[str, str], split: dict[str, tuple[str, int]] | None = None, **options: str) -> dict[str, DataFrame]:
    """One DataFrame per named query over JDBC, with a warning for one without rows.

    split: for a query, a column of whole numbers or times and the number of ranges that are read at the same time; their
    bounds are asked of the database first.  Rows with a null there come with the first range.
    """
    reader = lambda sql: spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", f"({sql}) q_")
    out = {}
    for name, sql in queries.items():
        rows = reader(sql)
        if name in (split or {}):
            column, parts = split[name]
            quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
            low, high = reader(f"SELECT MIN({quoted}) AS low_value, MAX({quoted}) AS high_value FROM ({sql}) r_").load().first()
            if low is not None and parts > 1:
                rows = rows.option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts))
        out[name] = normalise_columns(rows.load())
        if not out[name].take(1):
            warnings.warn(f"query {name!r} returned no rows", stacklevel=2)
    return out


def load_many(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """One table per file by its kind; two files of one name are an error."""
    readers = {"csv": read_csv_text, "json": read_json_text, "jsonl": read_json_text, "parquet": read_parquet_typed}
    out: dict[str, DataFrame] = {}
    for path in paths:
        stem, _, kind = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")
        name = safe_name(stem)
        if kind not in readers:
            raise ValueError(f"no reader for {path}")
        if name in out:
            raise ValueError(f"two files are named {name}")
        out[name] = readers[kind](spark, path)
    return out


def write_layer(df: DataFrame, root: str, layer: str, name: str) -> DataFrame:
    """``df`` in place of the table ``name`` of a layer (raw, typed, quarantine, enriched), read back."""
    path = f"{root.rstrip('/')}/{layer}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def peek(df: DataFrame, n: int = 10) -> DataFrame:
    """Per column up to five distinct sample values of the first ``n`` rows."""
    few = df.limit(n)
    cells = ", ".join(f"'{c}', cast(`{c}` AS string)" for c in df.columns)
    return few.selectExpr(f"stack({len(df.columns)}, {cells}) AS (column, value)").groupBy("column").agg(F.slice(F.array_sort(F.collect_set("value")), 1, 5).alias("samples"))


def preview(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """The first ``n`` rows, and whether there are more."""
    return df.limit(n), len(df.limit(n + 1).take(n + 1)) > n
