"""Types of text columns: pattern shares, cast tests, decisions, typed and quarantined tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

# A failed parse costs far more than a look for the sign that its format cannot do without.
_DAY = "CASE WHEN contains({c}, '%s') THEN cast(coalesce(try_to_timestamp({c}, '%s'), try_to_timestamp({c}, '%s')) AS date) END"
_DATED = "CASE WHEN contains({c}, '-') THEN cast(try_to_timestamp(%s, '%s') AS date) END"
_NUMBER = "try_cast(regexp_replace(%s, '[^0-9.+-]', '') AS double)"

# Name, pattern and type of every format of the catalogue, and the expression that parses a value ({c}).
PATTERNS = [
    ("iso_date", r"^\d{4}-\d{2}-\d{2}$", "DATE", _DATED % ("{c}", "yyyy-MM-dd")),
    ("iso_datetime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "TIMESTAMP", "CASE WHEN length({c}) >= 19 THEN try_cast({c} AS timestamp_ntz) END"),
    ("us_date", r"^\d{1,2}/\d{1,2}/\d{2,4}$", "DATE", _DAY % ("/", "M/d/yyyy", "M/d/yy")),
    ("eu_slash_date", r"^\d{1,2}/\d{1,2}/\d{2,4}$", "DATE", _DAY % ("/", "d/M/yyyy", "d/M/yy")),
    ("eu_date", r"^\d{1,2}\.\d{1,2}\.\d{2,4}$", "DATE", _DAY % (".", "d.M.yyyy", "d.M.yy")),
    ("dd_mon_yy", r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "DATE", _DATED % ("initcap({c})", "d-MMM-yy")),
    ("dd_mon_yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "DATE", _DATED % ("initcap({c})", "d-MMM-yyyy")),
    ("period_yyyy_mm", r"^\d{4}-\d{2}$", "DATE", _DATED % ("concat({c}, '-01')", "yyyy-MM-dd")),
    ("period_yyyy_qq", r"^\d{4}-?[Qq][1-4]$", "DATE", "CASE WHEN {c} RLIKE '^[0-9]{{4}}-?[Qq][1-4]$' THEN make_date(cast(left({c}, 4) AS int), (cast(right({c}, 1) AS int) - 1) * 3 + 1, 1) END"),
    ("time_only", r"^\d{1,2}:\d{2}(:\d{2})?$", "TIME", "CASE WHEN contains({c}, ':') AND try_to_timestamp(concat('2000-01-01 ', {c}), 'yyyy-MM-dd H:mm[:ss]') IS NOT NULL THEN {c} END"),
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "VARCHAR", "CASE WHEN {c} RLIKE '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$' THEN {c} END"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "VARCHAR", "CASE WHEN {c} RLIKE '^[^@ ]+@[^@ ]+[.][^@ ]+$' THEN {c} END"),
    ("phone_intl", r"^\+\d{1,3}[\d\s\-]{7,}$", "VARCHAR", "CASE WHEN {c} RLIKE '^[+][0-9]{{1,3}}[0-9 -]{{7,}}$' THEN {c} END"),
    ("url", r"^https?://[^\s]+$", "VARCHAR", "CASE WHEN {c} RLIKE '^https?://[^ ]+$' THEN {c} END"),
    ("integer", r"^-?\d+$", "BIGINT", "try_cast({c} AS bigint)"),
    ("decimal_dot", r"^-?\d+\.\d+$", "DOUBLE", "try_cast({c} AS double)"),
    ("decimal_comma", r"^-?\d+,\d+$", "DOUBLE", "try_cast(replace({c}, ',', '.') AS double)"),
    ("scientific", r"^-?\d+\.?\d*[eE][+-]?\d+$", "DOUBLE", "CASE WHEN lower({c}) LIKE '%e%' THEN try_cast({c} AS double) END"),
    ("percentage", r"^-?\d+\.?\d*%$", "DOUBLE", "CASE WHEN {c} LIKE '%\\%' THEN try_cast(replace({c}, '%', '') AS double) / 100 END"),
    ("currency_usd", r"^\$[\d,]+\.?\d*$", "DOUBLE", "CASE WHEN {c} LIKE '$%' THEN " + _NUMBER % "replace({c}, ',', '')" + " END"),
    ("currency_eur", r"^€[\d\s.]+,?\d*$|^[\d\s.]+,?\d*\s*€$", "DOUBLE", "CASE WHEN {c} LIKE '%€%' THEN " + _NUMBER % "replace(replace({c}, '.', ''), ',', '.')" + " END"),
    ("currency_gbp", r"^£[\d,]+\.?\d*$", "DOUBLE", "CASE WHEN {c} LIKE '£%' THEN " + _NUMBER % "replace({c}, ',', '')" + " END"),
    ("currency_chf", r"^CHF\s*[\d\x27]+\.?\d*$|^[\d\x27]+\.?\d*\s*CHF$", "DOUBLE", "CASE WHEN {c} LIKE '%CHF%' THEN " + _NUMBER % "{c}" + " END"),
    ("boolean_tf", r"(?i)^(true|false)$", "BOOLEAN", "CASE lower({c}) WHEN 'true' THEN true WHEN 'false' THEN false END"),
    ("boolean_yn", r"(?i)^(yes|no|y|n)$", "BOOLEAN", "CASE lower({c}) WHEN 'yes' THEN true WHEN 'y' THEN true WHEN 'no' THEN false WHEN 'n' THEN false END"),
    ("boolean_10", r"^[01]$", "BOOLEAN", "CASE {c} WHEN '1' THEN true WHEN '0' THEN false END"),
]
#: Units that a pattern itself tells.
UNITS = {"currency_usd": "USD", "currency_eur": "EUR", "currency_gbp": "GBP", "currency_chf": "CHF", "percentage": "%"}


def pattern_match_rates(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Share of the distinct values that each pattern matches; with ``most``, of the first so many in value order."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    if most is not None:
        values = values.orderBy("v").limit(most)
    one = values.agg(*[F.avg(F.col("v").rlike(p).cast("double")).alias(n) for n, p, _, _ in PATTERNS])
    return one.selectExpr("stack({}, {}) AS (pattern, rate)".format(len(PATTERNS), ", ".join(f"'{n}', {n}" for n, *_ in PATTERNS)))


def cast_tests(df: DataFrame, column: str) -> DataFrame:
    """Per pattern, how many of all values its expression parses; text always does."""
    one = df.selectExpr(f"count({column}) AS n", *[f"count({e.format(c=column)}) AS {n}" for n, _, _, e in PATTERNS])
    return one.selectExpr("stack({}, {}) AS (pattern, type, parsed, total)".format(len(PATTERNS) + 1, ", ".join([f"'{n}', '{t}', {n}, n" for n, _, t, _ in PATTERNS] + ["'text', 'VARCHAR', n, n"])))


def catalogue_scan(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, pattern, type, matched, parsed, distinct_values, total`` for every text column and pattern, in one shuffle and one aggregate.

    matched: distinct values that fit the pattern.  parsed: rows whose value its expression parses.  A row with the pattern
    ``mixed`` per type of several patterns counts the rows that any matching pattern of the type parses.
    """
    cells = df.selectExpr(f"stack({len(columns)}, {', '.join(f'{chr(39)}{c}{chr(39)}, CAST(`{c}` AS STRING)' for c in columns)}) AS (column, v)").where("v IS NOT NULL")
    values = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    several = [t for t in dict.fromkeys(p[2] for p in PATTERNS) if t != "VARCHAR" and sum(p[2] == t for p in PATTERNS) > 1]
    # Each value is matched and parsed once, before anything is counted.
    told = values.select("column", "n", *[F.col("v").rlike(p).alias(f"f_{n}") for n, p, _, _ in PATTERNS], *[F.expr(f"({e.format(c='v')}) IS NOT NULL").alias(f"k_{n}") for n, _, _, e in PATTERNS])
    counts = [F.count_if(f"f_{n}").alias(f"m_{n}") for n, *_ in PATTERNS] + [F.sum(F.when(F.col(f"k_{n}"), F.col("n")).otherwise(0)).alias(f"p_{n}") for n, *_ in PATTERNS]
    # A value counts for a mixed column if a pattern that it fits also parses it.
    mixed = lambda t: reduce(lambda x, y: x | y, [F.col(f"f_{n}") & F.col(f"k_{n}") for n, _, kind, _ in PATTERNS if kind == t])
    counts += [F.sum(F.when(mixed(t), F.col("n")).otherwise(0)).alias(f"p_mixed_{t}") for t in several]
    one = told.groupBy("column").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("total"), *counts)
    rows = [f"'{n}', '{t}', m_{n}, p_{n}" for n, _, t, _ in PATTERNS] + [f"'mixed', '{t}', 0L, p_mixed_{t}" for t in several]
    return one.selectExpr("column", "distinct_values", "total", f"stack({len(rows)}, {', '.join(rows)}) AS (pattern, type, matched, parsed)").select("column", "pattern", "type", "matched", "parsed", "distinct_values", "total")


def type_candidates(df: DataFrame, columns: list[str], min_match: float = 0.5, min_cast: float = 0.8) -> DataFrame:
    """``column, pattern, type, confidence``: patterns that enough values match and parse; text, with confidence 1, only where none does.

    A type that no pattern alone passes may be a mix: if two patterns or more of it match some value and together parse
    ``min_cast`` of the rows, their names joined by + are a candidate.  One scan, whatever the number of columns.
    """
    places = df.sparkSession.createDataFrame([(n, i) for i, (n, *_) in enumerate(PATTERNS)], "name string, place int")
    scan = catalogue_scan(df, columns)
    rated = scan.withColumns({"match_rate": F.expr("matched / distinct_values"), "cast_rate": F.expr("parsed / total")})
    alone = f"pattern <> 'mixed' AND match_rate >= {min_match} AND cast_rate >= {min_cast}"
    of_type = Window.partitionBy("column", "type")
    named = rated.join(F.broadcast(places), F.col("pattern") == F.col("name"), "left").withColumns({
        "passes": F.bool_or(F.expr(alone)).over(of_type), "seen": F.count_if(F.expr("pattern <> 'mixed' AND matched > 0")).over(of_type), "all_matched": F.sum("matched").over(of_type),
        "names": F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.expr("pattern <> 'mixed' AND matched > 0"), F.struct("place", "pattern"))).over(of_type)), lambda x: x["pattern"]), "+"),
    })
    single = named.where(alone).selectExpr("column", "pattern", "type", "(match_rate + cast_rate) / 2 AS confidence")
    mix = named.where(f"pattern = 'mixed' AND NOT passes AND seen >= 2 AND cast_rate >= {min_cast}").selectExpr("column", "names AS pattern", "type", "(least(1D, all_matched / distinct_values) + cast_rate) / 2 AS confidence")
    found = single.unionByName(mix)
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    text = every.join(found.select("column").distinct(), "column", "left_anti").selectExpr("column", "'text' AS pattern", "'VARCHAR' AS type", "1D AS confidence")
    return found.unionByName(text)


def decide_types(candidates: DataFrame, overrides: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """A manual type wins, then the best candidate from ``least`` on, else text."""
    order = Window.partitionBy("column").orderBy(F.desc("confidence"), "pattern")
    best = candidates.withColumn("n", F.row_number().over(order)).where("n = 1")
    out = best.selectExpr("column", f"CASE WHEN confidence >= {least} THEN pattern ELSE 'text' END AS pattern", f"CASE WHEN confidence >= {least} THEN type ELSE 'VARCHAR' END AS type")
    if overrides is None:
        return out
    return out.join(overrides.select("column", F.col("pattern").alias("o_pattern"), F.col("type").alias("o_type")), "column", "left").selectExpr("column", "coalesce(o_pattern, pattern) AS pattern", "coalesce(o_type, type) AS type")


def _parse(decisions: dict[str, str]) -> dict[str, str]:
    expr = {n: e for n, _, _, e in PATTERNS} | {"text": "{c}"}
    # mixed:TYPE stands for all patterns of a type, the first that parses a value.
    expr |= {f"mixed:{kind}": f"coalesce({', '.join(e for _, _, k, e in PATTERNS if k == kind)})" for kind in {p[2] for p in PATTERNS}}
    # Names joined by + are a mix of just these; each only reads values that fit it.
    fits = {n: p.replace("\\", "\\\\") for n, p, _, _ in PATTERNS}
    mix = lambda names: f"coalesce({', '.join(f'CASE WHEN {{c}} RLIKE {chr(34)}' + fits[n].replace('{', '{{').replace('}', '}}') + f'{chr(34)} THEN {expr[n]} END' for n in names)})"
    return {c: (mix(p.split("+")) if "+" in p else expr[p]).format(c=f"`{c}`") for c, p in decisions.items()}


def build_typed(raw: DataFrame, decisions: dict[str, str]) -> DataFrame:
    """``raw`` with each decided column (name -> pattern) parsed; failures become null."""
    return raw.withColumns({c: F.expr(e) for c, e in _parse(decisions).items()})


def _failed(decisions: dict[str, str]) -> dict[str, str]:
    return {c: f"(`{c}` IS NOT NULL AND {e} IS NULL)" for c, e in _parse(decisions).items()}


def build_quarantine(raw: DataFrame, decisions: dict[str, str], at: str | None = None) -> DataFrame:
    """Raw rows with any value that fails its cast; with ``at``, a time, as ``quarantined_at``."""
    out = raw.where(" OR ".join(_failed(decisions).values()))
    return out if at is None else out.withColumn("quarantined_at", F.expr(f"timestamp_ntz'{at}'"))


def cast_report(raw: DataFrame, decisions: dict[str, str]) -> DataFrame:
    bad = list(_failed(decisions).items())
    one = raw.selectExpr(*[f"count_if({f}) AS f{i}" for i, (_, f) in enumerate(bad)], *[f"count(`{c}`) AS n{i}" for i, (c, _) in enumerate(bad)])
    return one.selectExpr("stack({}, {}) AS (column, failed, total)".format(len(bad), ", ".join(f"'{c}', f{i}, n{i}" for i, (c, _) in enumerate(bad)))).selectExpr("column", "failed", "total - failed AS succeeded", "try_divide(total - failed, total) AS rate")


def rejected_tokens(raw: DataFrame, column: str, pattern: str) -> DataFrame:
    return raw.where(_failed({column: pattern})[column]).groupBy(F.col(column).alias("token")).agg(F.count("*").alias("n"))


def detect_unit(df: DataFrame, column: str) -> DataFrame:
    """The commonest unit behind a number; confidence is the mean of its share and the parse rate."""
    unit = F.regexp_extract(column, r"^[-+0-9.,]+\s*([A-Za-z%$€£¥]+)$", 1)
    counts = df.where(F.col(column).isNotNull()).groupBy(unit.alias("unit")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("unit") != "", F.col("n"))).alias("parsed"))
    return counts.where("unit <> ''").crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "unit").limit(1).selectExpr("unit", "(n / parsed + parsed / total) / 2 AS confidence").where("confidence > 0.5")


def promote(raw: DataFrame) -> DataFrame:
    """A table from a source with types of its own, as it is: its columns need no test, and none is quarantined."""
    untyped = [f.name for f in raw.schema if isinstance(f.dataType, NullType)]
    return raw.withColumns({c: F.col(f"`{c}`").cast("string") for c in untyped})


def failing_examples(df: DataFrame, column: str, pattern: str, most: int = 5) -> DataFrame:
    """The first distinct values, in value order, that the pattern's expression cannot parse."""
    return df.where(_failed({column: pattern})[column]).select(F.col(column).alias("value")).distinct().orderBy("value").limit(most)


def mixed_formats(df: DataFrame, column: str, min_cast: float = 0.8) -> DataFrame:
    """Per type with several patterns: the share of values that any of them parses, and whether only they together pass.

    A type passes alone if one of its patterns parses ``min_cast`` of the values.
    """
    kinds = {t: [e.format(c=f"`{column}`") for _, _, kind, e in PATTERNS if kind == t] for t in dict.fromkeys(p[2] for p in PATTERNS) if t != "VARCHAR"}
    several = {t: es for t, es in kinds.items() if len(es) > 1}
    one = df.selectExpr(f"count(`{column}`) AS n", *[f"count(coalesce({', '.join(es)})) AS all_{t}" for t, es in several.items()], *[f"greatest({', '.join(f'count({e})' for e in es)}) AS best_{t}" for t, es in several.items()])
    rows = one.selectExpr("stack({}, {}) AS (type, together, best, total)".format(len(several), ", ".join(f"'{t}', all_{t}, best_{t}, n" for t in several)))
    return rows.selectExpr("type", "try_divide(together, total) AS rate", "try_divide(best, total) AS best_alone", f"coalesce(try_divide(together, total) >= {min_cast} AND try_divide(best, total) < {min_cast}, false) AS needs_mix")
