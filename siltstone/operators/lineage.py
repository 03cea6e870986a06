"""Which event columns make up a measure: shared cells, direction, votes, and the best candidate of each measure."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.evidence import convention_forms, support, votes, votes_of_steps
from siltstone.operators.hierarchies import shared_groupings
from siltstone.sources.scratch import stored


def shared_cells(measures: DataFrame, events: DataFrame) -> DataFrame:
    """``entity, period, total, rows`` of both sides for entities that both have; a period without events counts zero."""
    both = measures.join(events.select("entity").distinct(), "entity", "left_semi")
    right = events.withColumnsRenamed({"total": "event", "rows": "event_rows"})
    return both.join(right, ["entity", "period"], "left").selectExpr("entity", "period", "total", "coalesce(event, 0) AS event", "rows", "coalesce(event_rows, 0) AS event_rows")


def direction_gate(cells: DataFrame) -> DataFrame:
    """Whether the event side is the finer one: it has more rows over the shared cells."""
    return cells.agg(F.sum("rows").alias("rows"), F.sum("event_rows").alias("event_rows")).selectExpr("rows", "event_rows", "coalesce(event_rows > rows, false) AS finer")


def best_candidate(candidates: DataFrame, worth: float = 10.0) -> DataFrame:
    """One row per measure of ``measure, convention, terms, lower, residual, n, rss``.

    The highest lower bound of support wins.  Among equals one term beats two, unless the second lowers the
    Bayesian information criterion by more than ``worth``; then the smaller residual wins.
    """
    top = candidates.withColumn("most", F.max("lower").over(Window.partitionBy("measure"))).where("lower = most")
    scored = top.withColumn("bic", F.expr("n * ln(greatest(rss, 1e-12D) / n) + terms * ln(n)"))
    of = lambda terms: F.min_by(F.struct("convention", "terms", "lower", "residual", "bic"), F.when(F.col("terms") == terms, F.struct("residual", "convention")))
    both = scored.groupBy("measure").agg(of(1).alias("one"), of(2).alias("two"))
    chosen = F.when(F.col("one").isNull(), F.col("two")).when(F.col("two").isNotNull() & (F.col("one.bic") - F.col("two.bic") > worth), F.col("two")).otherwise(F.col("one"))
    return both.select("measure", chosen.alias("c")).select("measure", "c.convention", "c.terms", "c.lower", "c.residual")


def reconcile_measures(measures: DataFrame, conventions: DataFrame) -> DataFrame:
    """The verdict of each measure: ``measure, convention, terms, pattern, lower``.

    measures: ``measure, entity, period, y``.  conventions: ``convention, terms, entity, period, m``.
    Each pair of measure and convention is voted on entity by entity.
    """
    pair = F.concat_ws("\x1f", "measure", "convention")
    aligned = measures.join(conventions, ["entity", "period"]).select("measure", pair.alias("convention"), "terms", "entity", "period", "y", "m")
    voted = votes(aligned)
    supported = support(voted).where("pattern IS NOT NULL")
    fit = voted.where("vote IS NOT NULL").groupBy("convention").agg(F.avg(F.expr("least(r_flow, r_stock)")).alias("residual"), F.count("*").alias("n"), F.sum(F.expr("pow(least(r_flow, r_stock), 2)")).alias("rss"))
    terms = aligned.select(F.col("convention").alias("c"), "terms", F.col("measure")).distinct()
    ready = supported.join(fit, "convention").join(terms, F.col("convention") == F.col("c")).select("measure", F.element_at(F.split("convention", "\x1f"), -1).alias("convention"), "terms", "lower", "residual", "n", "rss", "pattern")
    best = best_candidate(ready)
    return best.join(ready.select("measure", "convention", "pattern"), ["measure", "convention"]).select("measure", "convention", "terms", "pattern", "lower")


@dataclass(frozen=True)
class Fact:
    """A fact table: its rows, the column of each shared dimension and role, its event times, and its numbers.

    Keys are no quantities and stand in neither list of numbers.
    """

    rows: DataFrame
    dimensions: dict[tuple[str, str], str]
    times: list[str]
    numbers: list[str] = field(default_factory=list)


VERDICT = ["fact", "measure", "event_fact", "dimension", "role", "time", "event_time", "convention", "terms", "pattern", "lower"]


def reconcile_facts(facts: dict[str, Fact], matrix: DataFrame, grain: str = "month") -> DataFrame:
    """The verdict of each measure of every fact: by which event columns of which other fact, dimension, and times it adds up, and how.

    ``fact, measure, event_fact, dimension, role, time, event_time, convention, terms, pattern, lower``.  matrix: ``fact, dimension, role`` as of
    ``bus_matrix``; facts are compared by what they share.  Of two facts the events must be the finer one, by rows over the cells that
    both have; only then votes are taken, entity by entity, and the best candidate over all pairs, dimensions and times
    stands.  A measure that nothing explains has no row.  Each fact is summed up once per dimension and time; only the names of shared dimensions,
    and which ways have the finer events, reach the driver.
    """
    spark = matrix.sparkSession
    empty = spark.createDataFrame([], "fact string, measure string, event_fact string, dimension string, role string, time string, event_time string, convention string, terms int, pattern string, lower double")
    shared = [r for r in shared_groupings(matrix).collect() if r["fact_a"] in facts and r["fact_b"] in facts]
    ways = []
    for r in shared:
        for a, b in ((r["fact_a"], r["fact_b"]), (r["fact_b"], r["fact_a"])):
            key = (r["dimension"], r["role"])
            if key in facts[a].dimensions and key in facts[b].dimensions and facts[a].numbers and facts[b].numbers:
                ways += [(a, b, *key, s, t) for s in facts[a].times for t in facts[b].times]
    if not ways:
        return empty

    # Too many event columns are an error whichever way turns out to be the finer one.
    conventions = [list(convention_forms(facts[b].numbers)) for _, b, *_ in ways]
    written: dict[tuple, DataFrame] = {}

    def cells(name: str, key: tuple[str, str], time: str) -> DataFrame:
        """``entity, period, rows, n0, n1, ...``: rows and sums of all numbers, written once for all ways that a fact takes part in."""
        if (name, key, time) not in written:
            fact = facts[name]
            present = fact.rows.where(F.col(time).isNotNull() & F.col(fact.dimensions[key]).isNotNull())
            by = present.select(F.col(fact.dimensions[key]).cast("string").alias("entity"), F.date_trunc(grain, time).alias("period"), *[F.col(c).alias(f"n{i}") for i, c in enumerate(fact.numbers)])
            written[name, key, time] = stored(by.groupBy("entity", "period").agg(F.count("*").alias("rows"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(fact.numbers))]))
        return written[name, key, time]

    sides = [(cells(a, (dimension, role), time), cells(b, (dimension, role), event_time)) for a, b, dimension, role, time, event_time in ways]
    rows = lambda df, name: df.select("entity", "period", F.col("rows").alias(name))
    shares = [rows(own, "rows").join(rows(other, "event_rows"), ["entity", "period"]).agg(F.sum("rows").alias("rows"), F.sum("event_rows").alias("event_rows")).select(F.lit(i).alias("way"), "rows", "event_rows") for i, (own, other) in enumerate(sides)]
    finer = sorted(r["way"] for r in reduce(DataFrame.unionByName, shares).where("event_rows > rows").select("way").collect())
    if not finer:
        return empty
    ballots = []
    for i in finer:
        (own, other), (a, b) = sides[i], ways[i][:2]
        measures, forms = facts[a].numbers, convention_forms([f"e{k}" for k in range(len(facts[b].numbers))])
        events = other.select("entity", "period", *[F.col(f"n{k}").alias(f"e{k}") for k in range(len(facts[b].numbers))])
        # A period without events of an entity that has some counts zero.
        known = own.drop("rows").join(events.select("entity").distinct(), "entity", "left_semi").join(events, ["entity", "period"], "left")
        # Changes are taken on one row per period; measures and conventions are spread only within a task that holds their entity.
        before = Window.partitionBy("entity").orderBy("period")
        series = known.withColumns({f"n{k}": F.col(f"n{k}").cast("double") for k in range(len(measures))}).withColumns({f"d{k}": F.col(f"n{k}") - F.lag(f"n{k}").over(before) for k in range(len(measures))})
        spread = series.selectExpr("*", f"stack({len(measures)}, {', '.join(f'{k}, n{k}, d{k}' for k in range(len(measures)))}) AS (place, y, dy)")
        steps = spread.selectExpr("entity", "place", "y", "dy", f"stack({len(forms)}, {', '.join(f'{k}, coalesce(CAST({e} AS DOUBLE), 0D)' for k, e in enumerate(forms.values()))}) AS (form, m)")
        names = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(at) + 1)
        ballots.append(votes_of_steps(steps, ["entity", "place", "form"]).withColumn("convention", F.concat_ws("\x1e", F.lit(str(i)), names(measures, "place"), names(conventions[i], "form"))).drop("place", "form"))
    voted = stored(reduce(DataFrame.unionByName, ballots))
    ready = support(voted, family="split(convention, '\x1e')[0]").where("pattern IS NOT NULL")
    fit = voted.where("vote IS NOT NULL").groupBy(F.col("convention").alias("of")).agg(F.avg(F.expr("least(r_flow, r_stock)")).alias("residual"), F.count("*").alias("n"), F.sum(F.expr("pow(least(r_flow, r_stock), 2)")).alias("rss"))
    listed = spark.createDataFrame([(str(i), *w) for i, w in enumerate(ways)], "way string, fact string, event_fact string, dimension string, role string, time string, event_time string")
    parts = F.split("convention", "\x1e")
    scored = ready.join(fit, F.col("convention") == F.col("of")).withColumns({"way": parts[0], "measure": parts[1], "terms": F.when(parts[2].contains(" - "), 2).otherwise(1)}).join(listed, "way")
    keyed = scored.withColumn("target", F.concat_ws("\x1e", "fact", "measure"))
    best = best_candidate(keyed.select(F.col("target").alias("measure"), "convention", "terms", "lower", "residual", "n", "rss")).select(F.col("measure").alias("t"), F.col("convention").alias("c"))
    return keyed.join(best, F.expr("target = t AND convention = c")).withColumn("convention", parts[2]).select(*VERDICT)
