"""Quality rules with robust multivariate outliers; DataFrame functions only.

Each text becomes a vector of transformed statistics.  Every language and source has a
minimum-covariance-determinant estimate of its own: from several starts, concentration steps
keep the ``core`` share of the group that lies nearest and estimate anew, until the determinant
falls no more; the smallest determinant wins.  Documents far from their group's centre in
Mahalanobis distance are rejected.

Each core is joined by ``prior`` pseudo-documents with the quartile estimate of the language,
and those of a language by as many of the whole table, so a group of a handful of documents
leans on its language and one of thousands on itself; no size switches the method.  A scatter
also holds the sampling noise of each rate on as many words, lines or windows (1 / 4n on
square roots), so a statistic that is zero in the whole core does not reject every document
that has any.  Both are constant during the steps, so a step never raises the determinant but
for the rank error of ``percentile_approx`` (1 in ``ACCURACY``), which finds quartiles and core edges.

Defined results: a null or word-less text has zero statistics and fails the base rule; null
``lang``/``source`` form groups of their own; repeated rows are scored one by one; an empty
table gives an empty result; windows of eight words are compared by 64-bit prints within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE, written

#: Transformed statistics with the spread that the pseudo-documents of an all but empty table have.
FEATURES = {"log_words": 1.0, "log_word_length": 0.1, "symbols": 0.15, "dup_lines": 0.15, "repeats": 0.15}
#: Units per statistic of which the sampling noise is 1 / (4 units).
UNITS = {"log_words": "n_words", "log_word_length": "n_words", "symbols": "n_words", "dup_lines": "n_lines", "repeats": "n_words / 8"}
#: Median and the 0.99999 quantile of chi-square with five degrees of freedom.
CHI2_MEDIAN, CHI2_CUT = 4.3515, 30.856
ACCURACY = 5000
#: Estimates are held on the driver and broadcast up to this many groups, else written and joined by a shuffle.
BROADCAST_GROUPS = 20_000

NAMES = list(FEATURES)
SIZE = range(len(NAMES))
PAIRS = [(i, j) for i in SIZE for j in range(i + 1)]
GROUP = ["g_lang", "g_source"]
#: Where the steps begin: quartiles of the group, of its language, and plain moments of the group.
STARTS = ("quartiles", "language", "moments")


def text_statistics(docs: DataFrame, whole_row: bool = False) -> DataFrame:
    """``doc_id, lang, source`` and the base statistics of every whole text; the input row as ``row``, if asked for."""
    row = [F.struct("*").alias("row")] if whole_row else []
    base = docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    body = F.btrim("text", F.lit(SPACE))
    split = base.select("*", F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\x09-\\x0D]+")).alias("words"))
    # Prints of windows of one, two, four and eight words, each from two of the size before.
    split = split.withColumn("n", F.size("words")).withColumn("print_1", F.transform("words", lambda w: F.xxhash64(w)))
    for size in (1, 2, 4):
        last = f"print_{size}"
        split = split.withColumn(f"print_{2 * size}", F.zip_with(last, F.slice(last, size + 1, F.greatest("n", F.lit(1))), lambda x, y: F.xxhash64(x, y)))
    split = split.withColumn("prints", F.slice("print_8", 1, F.greatest(F.col("n") - 7, F.lit(0))))
    split = split.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    # Each column below is read more than once by the next, so it is computed once.  Only texts with a repeated print sort theirs.
    again = F.size(F.array_distinct("prints")) < F.size("prints")
    split = split.withColumn("sorted", F.when(again, F.sort_array(F.transform("prints", lambda p, i: F.struct(p.alias("p"), i.alias("i"))))).otherwise(F.array().cast("array<struct<p:bigint,i:int>>")))
    split = split.withColumn("next", F.zip_with("sorted", F.slice("sorted", 2, F.greatest(F.size("sorted"), F.lit(1))), lambda a, b: F.coalesce(a.p == b.p, F.lit(False))))
    hit = F.zip_with("next", F.concat(F.array(F.lit(False)), F.col("next")), lambda a, b: a | b)
    split = split.withColumn("at", F.sort_array(F.filter(F.zip_with("sorted", hit, lambda k, h: F.when(h, k.i)), lambda i: i.isNotNull())))
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(8)), F.lit(8)))
    return split.select(
        *["row"] * whole_row, "doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g).alias("n_repeat_words"),
    )


def _vector(stats: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return stats.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "log_words": F.log1p("n_words"),
        "log_word_length": F.log1p(F.col("word_chars") / n),
        "symbols": F.sqrt(F.col("n_symbols") / n),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "g_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("none")),
        "g_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("none")),
    })


def _leaning(n: str, own: str, onto: str, prior: float) -> str:
    """``own``, known from ``n`` documents, with ``prior`` pseudo-documents that say ``onto``."""
    return f"({n} * {own} + {prior}D * {onto}) / ({n} + {prior}D)"


def _priors(sound: DataFrame, prior: float) -> tuple[DataFrame, bool]:
    """Whether there are few groups, and per group: ``n``, quartile centre and variance ``c_i, v_i``, those of the language ``p_i, t_i``, noise ``e_i`` and plain moments."""
    aggs = [F.expr(f"percentile_approx({x}, array(0.25D, 0.5D, 0.75D), {ACCURACY}) AS q_{i}") for i, x in enumerate(NAMES)]
    aggs += [F.expr(f"avg(1D / (4D * greatest({UNITS[x]}, 1))) AS z_{i}") for i, x in enumerate(NAMES)]
    few = len(sound.select(*GROUP).distinct().take(BROADCAST_GROUPS + 1)) <= BROADCAST_GROUPS
    each = sound.rollup(*GROUP).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *aggs, *_moments())
    each = _held(each.selectExpr("*", *[f"q_{i}[1] AS c_{i}" for i in SIZE], *[f"pow((q_{i}[2] - q_{i}[0]) / 1.349D, 2) AS v_{i}" for i in SIZE]), few)
    top = each.where("level = 3").selectExpr(*[f"c_{i} AS a_{i}" for i in SIZE], *[f"{_leaning('n', f'v_{i}', f'{FEATURES[x] ** 2}D', prior)} AS b_{i}" for i, x in enumerate(NAMES)], *[f"z_{i} AS y_{i}" for i in SIZE])
    langs = each.where("level = 1").crossJoin(F.broadcast(top))
    langs = langs.selectExpr("g_lang AS l_lang", *[f"{_leaning('n', own, onto, prior)} AS {name}" for i in SIZE for own, onto, name in ((f"c_{i}", f"a_{i}", f"p_{i}"), (f"v_{i}", f"b_{i}", f"t_{i}"), (f"z_{i}", f"y_{i}", f"x_{i}"))])
    groups = each.where("level = 0").join(langs, F.col("g_lang") == F.col("l_lang"))
    kept = [f"{c}_{i}" for c in "cvptm" for i in SIZE] + [f"s_{i}{j}" for i, j in PAIRS]
    return _held(groups.selectExpr(*GROUP, "n", *kept, *[f"{_leaning('n', f'z_{i}', f'x_{i}', prior)} AS e_{i}" for i in SIZE]), few), few


def _held(groups: DataFrame, few: bool) -> DataFrame:
    """A table of one row per group: on the driver, from where it is broadcast, if there are ``few``, else written."""
    return groups.sparkSession.createDataFrame(groups.collect(), groups.schema) if few else written(groups)


def _moments() -> list[Column]:
    return [F.count("*").alias("h"), *[F.expr(f"avg({x}) AS m_{i}") for i, x in enumerate(NAMES)], *[F.expr(f"covar_pop({NAMES[i]}, {NAMES[j]}) AS s_{i}{j}") for i, j in PAIRS]]


def _started(priors: DataFrame) -> DataFrame:
    """An estimate per group and start, before any step."""
    fields = {
        "quartiles": [("c_{i}", "v_{i}", "0D")], "language": [("p_{i}", "t_{i}", "0D")], "moments": [("m_{i}", "s_{i}{i}", "s_{i}{j}")],
    }
    parts = []
    for start, ((centre, own, other),) in fields.items():
        moments = [centre.format(i=i) + f" AS m_{i}" for i in SIZE] + [(own if i == j else other).format(i=i, j=j) + f" AS s_{i}{j}" for i, j in PAIRS]
        parts.append(priors.selectExpr(*GROUP, f"'{start}' AS start", "n AS h", *moments))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _factored(moments: DataFrame, priors: DataFrame, prior: float) -> DataFrame:
    """Centre ``m_i``, inverse ``w_ij`` of the scatter's Cholesky factor and ``log_det``, pseudo-documents and noise included."""
    named = priors.select(*[F.col(c).alias(f"r_{c}") for c in GROUP], *[f"{c}_{i}" for c in "pte" for i in SIZE])
    est = moments.join(named, F.expr("g_lang = r_g_lang AND g_source = r_g_source"))
    k = f"{prior}D"
    both = [f"(h * s_{i}{j} + {k} * {f't_{i}' if i == j else '0D'} + h * {k} / (h + {k}) * (m_{i} - p_{i}) * (m_{j} - p_{j})) / (h + {k}) + {f'e_{i}' if i == j else '0D'} AS s_{i}{j}" for i, j in PAIRS]
    est = est.selectExpr(*GROUP, "start", *[f"{_leaning('h', f'm_{i}', f'p_{i}', prior)} AS m_{i}" for i in SIZE], *both)
    minus = lambda i, j: "".join(f" - l_{i}{k} * l_{j}{k}" for k in range(j))
    for j in SIZE:
        est = est.selectExpr("*", f"sqrt(s_{j}{j}{minus(j, j)}) AS l_{j}{j}")
        est = est.selectExpr("*", *[f"(s_{i}{j}{minus(i, j)}) / l_{j}{j} AS l_{i}{j}" for i in SIZE[j + 1 :]])
    # The inverse, diagonal by diagonal, so that a distance is one plain expression.
    est = est.selectExpr("*", *[f"1D / l_{i}{i} AS w_{i}{i}" for i in SIZE], " + ".join(f"2 * ln(l_{i}{i})" for i in SIZE) + " AS log_det")
    for gap in SIZE[1:]:
        inner = lambda i, j: " + ".join(f"l_{i}{k} * w_{k}{j}" for k in range(j, i))
        est = est.selectExpr("*", *[f"-({inner(i, i - gap)}) / l_{i}{i} AS w_{i}{i - gap}" for i in SIZE[gap:]])
    return est.select(*GROUP, "start", "log_det", *[f"m_{i}" for i in SIZE], *[f"w_{i}{j}" for i, j in PAIRS])


def _on_group(rows: DataFrame, right: DataFrame, few: bool, how: str = "inner", keys: tuple[str, ...] = ("g_lang", "g_source")) -> DataFrame:
    right = right.withColumnsRenamed({c: f"e_{c}" for c in keys})
    on = F.expr(" AND ".join(f"{c} = e_{c}" for c in keys))
    return rows.join(F.broadcast(right) if few else right, on, how).drop(*[f"e_{c}" for c in keys])


def _distances(rows: DataFrame, est: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Squared Mahalanobis distance ``d2`` of each row from each estimate of its group."""
    z = [" + ".join(f"w_{i}{k} * ({NAMES[k]} - m_{k})" for k in range(i + 1)) for i in SIZE]
    return _on_group(rows, est, few, how).select(*rows.columns, "start", F.expr(" + ".join(f"({x}) * ({x})" for x in z)).alias("d2"))


class Estimates:
    """Robust centres and scatters of all groups, fitted on every document that passes the base rule."""

    def __init__(self, stats: DataFrame, core: float, prior: float, tolerance: float = 1e-3, most_steps: int = 30) -> None:
        sound = stats.where("not base_failed").select(*GROUP, "n_words", "n_lines", *NAMES)
        priors, self.few = _priors(sound, prior)
        self.prior, sound = prior, sound.select(*GROUP, *NAMES)

        def step(est: DataFrame) -> DataFrame:
            far = _distances(sound, est, self.few)
            edge = far.groupBy(*GROUP, "start").agg(F.percentile_approx("d2", F.lit(core), F.lit(ACCURACY)).alias("edge"))
            inside = _on_group(far, edge, self.few, keys=(*GROUP, "start")).where("d2 <= edge")
            return _held(_factored(inside.groupBy(*GROUP, "start").agg(*_moments()), priors, prior), self.few)

        # Two steps from every start, then the best one of each group goes on.
        est = step(step(_held(_factored(_started(priors), priors, prior), self.few)))
        own = [c for c in est.columns if c not in GROUP]
        smallest = lambda df: _held(df.groupBy(*GROUP).agg(F.min_by(F.struct(*own), F.struct("log_det", "start")).alias("best")).select(*GROUP, "best.*"), self.few)
        best = smallest(est)
        for _ in range(most_steps):
            after = step(best)
            before = best.select(*[F.col(c).alias(f"o_{c}") for c in GROUP], F.col("log_det").alias("was"))
            falls = after.join(before, F.expr("g_lang = o_g_lang AND g_source = o_g_source")).agg(F.max(F.expr("was - log_det"))).first()[0]
            if falls is None or falls <= tolerance:
                break
            best = smallest(after.unionByName(best))
        # The core understates the scatter: scale it so that the median distance is that of chi-square.
        mid = _distances(sound, best, self.few).groupBy(*GROUP).agg(F.percentile_approx("d2", F.lit(0.5), F.lit(ACCURACY)).alias("mid"), F.count("*").alias("n"))
        mid = mid.selectExpr(*GROUP, f"greatest({_leaning('n', 'mid', f'{CHI2_MEDIAN}D', prior)} / {CHI2_MEDIAN}D, 1D) AS wide")
        self.est = _held(_on_group(best, mid, self.few), self.few)

    def judged(self, stats: DataFrame, cut: float) -> DataFrame:
        """``stats`` with ``kept`` and the scaled ``distance2``, which is null only where a whole group fails the base rule."""
        wide = self.est.select(*GROUP, "wide")
        out = _on_group(_distances(stats, self.est.drop("wide"), self.few, "left"), wide, self.few, "left")
        d2 = F.col("d2") / F.col("wide")
        return out.select(*stats.columns, (~F.col("base_failed") & F.coalesce(d2 <= cut, F.lit(True))).alias("kept"), d2.alias("distance2"))


def robust_outliers(docs: DataFrame, core: float = 0.75, cut: float = CHI2_CUT, prior: float = 50.0) -> DataFrame:
    """Statistics, base rule, distance and verdict for every document.

    core: share of a group that each step keeps.  cut: largest squared distance that is kept.
    prior: pseudo-documents that join each group.  All documents enter the estimates and the verdicts.
    """
    stats = _vector(written(text_statistics(docs)))
    out = Estimates(stats, core, prior).judged(stats, cut)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2", "lang", "source")


def kept_documents(docs: DataFrame, core: float = 0.75, cut: float = CHI2_CUT, prior: float = 50.0) -> DataFrame:
    """The rows of ``docs`` that ``robust_outliers`` keeps, all columns; statistics are written beside the rows once."""
    stats = _vector(written(text_statistics(docs, whole_row=True)))
    return Estimates(stats, core, prior).judged(stats, cut).where("kept").select("row.*")
