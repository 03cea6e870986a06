"""Hierarchies among the columns of a table: aliases, drill-downs, roles, and the matrix of facts and dimensions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.crosscol import distinct_scan
from siltstone.operators.graph import connected_components
from siltstone.operators.permutations import DRAWS, pair_tables, permutation_p

#: Share of rows or of distinct pairs that may disagree, and of rows up to which two columns are near-copies.
MOST_ERROR, MOST_DISAGREE = 0.01, 0.05
#: Least share of a column's minority that a determinant must explain, complete rows under which an edge is flagged, and confidence that two columns are one dimension.
LEAST_LAMBDA, LEAST_ROWS, SAME_DIMENSION = 0.5, 100, 0.7
#: Bits of a sketch's size, and the relative error that its estimates are allowed (five standard errors).
SKETCH_BITS, SKETCH_ERROR = 12, 0.07


def pair_errors(df: DataFrame, columns: list[str], most: float = MOST_ERROR) -> DataFrame:
    """``a, b, error_ab, error_ba, alias``: the share of distinct pairs that one value of ``a`` (or of ``b``) too many makes.

    Columns are aliases when both errors are small: each value of one goes with one value of the other.
    """
    pairs = list(combinations(columns, 2))
    counts = distinct_scan(df, columns, pairs)
    names = df.sparkSession.createDataFrame([(a, b, f"{a},{b}") for a, b in pairs], "a string, b string, both string")
    of = lambda key, name: counts.select(F.col("columns").alias(key), F.col("distinct_values").alias(name))
    sized = names.join(F.broadcast(of("both", "d_ab")), "both").join(F.broadcast(of("a", "d_a")), "a").join(F.broadcast(of("b", "d_b")), "b")
    return sized.selectExpr("a", "b", "1 - d_a / d_ab AS error_ab", "1 - d_b / d_ab AS error_ba", f"greatest(1 - d_a / d_ab, 1 - d_b / d_ab) <= {most} AS alias")


def column_guards(profile: DataFrame, least_support: int = 100) -> DataFrame:
    """What each column of ``column, total, nulls, distinct_values`` may be: constant ones take no part, and only
    some can determine others (three values or more, under nine tenths of the rows)."""
    return profile.selectExpr("column", "distinct_values <= 1 AS is_constant", "distinct_values >= 3 AND distinct_values < 0.9 * total AS can_determine", f"total - nulls < {least_support} AS low_support")


def alias_groups(pairs: DataFrame) -> DataFrame:
    """``column, representative`` of all columns that alias pairs ``a, b`` connect; the smallest name stands for them."""
    edges = pairs.select("a", "b")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return connected_components(nodes, edges).select(F.col("node").alias("column"), F.col("component").alias("representative"))


def dependency_p_values(df: DataFrame, pairs: list[tuple[str, str]], draws: int = DRAWS, block: int = 100, stop_at: int = 20, statistic: str = "information") -> DataFrame:
    """``a, b, hits, draws, p``: how often shuffled values of ``b`` depend on ``a`` as much as they do, over all rows with both.

    statistic: information, association (chi-square) or kept (rows whose b is the commonest of their a).  Each pair stops
    after the block of draws in which it has ``stop_at`` hits.  p counts the data as one draw.
    """
    return permutation_p(pair_tables(df, pairs), draws, block, stop_at, statistic).select("a", "b", "hits", "draws", "p")


def near_copy(df: DataFrame, a: str, b: str, contexts: list[str], alpha: float = 0.05, most: float = MOST_DISAGREE, least: int = 10, draws: int = DRAWS) -> DataFrame:
    """``rate, disagreements, verdict`` of two columns that mostly agree.

    Without a disagreement they merge; beyond ``most`` it stays undecided.  Between, under ``least`` disagreements
    abstain; if a context column tells where they differ, they are two roles; if only the value of ``a`` does, the
    difference is systematic in the value; if nothing does, it is dirt.  All tests share ``alpha``, and if so many share it
    that ``draws`` cannot pass, it abstains as well.  Nulls are a value.
    """
    both = df.where(F.col(a).isNotNull() | F.col(b).isNotNull()).withColumn("differs", (~F.col(a).eqNullSafe(F.col(b))).cast("int"))
    n, bad = both.agg(F.count("*"), F.sum("differs")).first()
    rate = (bad or 0) / n if n else None
    if not n or rate > most:
        verdict = "undecided"
    elif not bad:
        verdict = "merge"
    elif bad < least:
        verdict = "abstain"
    else:
        asked = [*contexts, a]
        tables = pair_tables(both, [(c, "differs") for c in asked], set(asked))
        p = {r["a"]: r["p"] for r in permutation_p(tables, draws).select("a", "p").collect()}
        level = alpha / len(asked)
        systematic = "role" if any(p[c] <= level for c in contexts) else "value_systematic" if p[a] <= level else None
        verdict = systematic or ("abstain" if 1 / (draws + 1) > level else "dirt")
    return df.sparkSession.createDataFrame([(rate, bad or 0, verdict)], "rate double, disagreements long, verdict string")


def column_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, total, nulls, distinct_values`` of all columns by one shuffle."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    values = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, value)").groupBy("column", "value").agg(F.count("*").alias("n"))
    return values.groupBy("column").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.expr("CASE WHEN value IS NULL THEN n END")), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"))


def pair_sketches(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a, b, estimate``: about how many distinct pairs of values there are, nulls counted, from one mergeable sketch per pair."""
    parts = ", ".join(f"{i}, xxhash64(CAST(`{a}` AS STRING), `{a}` IS NULL, CAST(`{b}` AS STRING), `{b}` IS NULL)" for i, (a, b) in enumerate(pairs))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    sketched = df.selectExpr(f"stack({len(pairs)}, {parts}) AS (pair, h)").groupBy("pair").agg(F.hll_sketch_estimate(F.hll_sketch_agg("h", SKETCH_BITS)).alias("estimate"))
    return names.join(sketched, "pair").select("a", "b", "estimate")


def possible_pairs(df: DataFrame, sizes: dict[str, int], total: int, most: float = MOST_ERROR) -> list[tuple[str, str]]:
    """Pairs of columns that a sketch of their distinct pairs leaves open as alias or drill-down; only these need to be counted.

    sizes: distinct values, null counted as one.  If one column determines the other but for a share ``most`` of the rows, there are at
    most that many more pairs than values of the finer one.
    """
    pairs = list(combinations(sorted(sizes), 2))
    if not pairs:
        return []
    most_pairs = lambda a, b: max(sizes[a], sizes[b]) / (1 - most) + most * total
    return [(r["a"], r["b"]) for r in pair_sketches(df, pairs).collect() if r["estimate"] * (1 - SKETCH_ERROR) <= most_pairs(r["a"], r["b"])]


def passing(p_values: dict, q: float) -> set:
    """Keys of the tests of one small family that pass at false-discovery rate ``q``."""
    ranked = sorted(p_values, key=lambda k: p_values[k])
    last = max((i for i, k in enumerate(ranked, 1) if p_values[k] <= q * i / len(ranked)), default=0)
    return set(ranked[:last])


def chains(edges: set[tuple[str, str]]) -> list[list[str]]:
    """All longest paths over ``finer, coarser`` edges, without edges inside a cycle and without those that a longer path implies."""
    out: dict[str, set[str]] = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach: dict[str, set[str]] = {}
    for start in {n for e in edges for n in e}:
        seen, todo = set(), [start]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        reach[start] = seen
    free = {(a, b) for a, b in edges if a not in reach[b]}
    direct = {(a, b) for a, b in free if not any(c != b and (a, c) in free and b in reach[c] for c in out[a])}
    up: dict[str, list[str]] = {}
    for a, b in sorted(direct):
        up.setdefault(a, []).append(b)
    paths = [[a] for a in sorted(up) if a not in {b for _, b in direct}]
    done = []
    while paths:
        path = paths.pop(0)
        above = up.get(path[-1], [])
        paths += [[*path, b] for b in above]
        if not above:
            done.append(path)
    return done


def find_hierarchies(df: DataFrame, columns: list[str], most: float = MOST_ERROR, draws: int = DRAWS, q: float = 0.05, identities: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """``kind, members, score, verdict, needs_confirmation``: drill-downs (coarse to fine), aliases and roles among ``columns``.

    Constant columns take no part.  Two columns are alias candidates if their distinct values make at most a share ``most`` of pairs too
    many, both ways.  A column with three values or more, but not nearly a key, determines one with fewer values if at most that share
    of the rows disagrees and it explains half of what always guessing the commonest value misses; on rows with both, but where a
    column has nulls and one value only, null is a value.  Candidates must beat shuffled values, at false-discovery rate ``q``.

    Aliases that never disagree are merged, as are those whose few disagreements are dirt.  Few disagreements that another
    column foretells make two roles; undecided ones need confirmation.  Columns whose values differ but go one to one may
    be code and name or a coincidence: they are merged if ``identities`` says with a confidence of ``SAME_DIMENSION`` that
    they are one dimension, else they need confirmation.  A merged group takes part in drill-downs by its first name.  A
    drill-down with an edge that under ``LEAST_ROWS`` rows support needs confirmation.

    score: the largest error of a pair; verdict: that of ``near_copy``.  What reaches the driver is numbers per pair of columns.
    """
    spark = df.sparkSession
    schema = "kind string, members array<string>, score double, verdict string, needs_confirmation boolean"
    stats = {r["column"]: r for r in column_sizes(df, columns).collect()}
    size = {c: r["distinct_values"] + (r["nulls"] > 0) for c, r in stats.items()}
    live = {c: n for c, n in size.items() if n >= 2}
    if len(live) < 2:
        return spark.createDataFrame([], schema)
    total = next(iter(stats.values()))["total"]
    null_coded = {c for c in live if stats[c]["nulls"] and stats[c]["distinct_values"] <= 1}
    open_pairs = possible_pairs(df, live, total, most)
    if not open_pairs:
        return spark.createDataFrame([], schema)
    numbers = ["a", "b", "n", "d_a", "d_b", "d_ab", "kept_ab", "kept_ba", "mode_a", "mode_b"]

    # Drill-downs: rows with both, unless null is what a column says.
    edge_tables = pair_tables(df, open_pairs, null_coded).where("n > 0")
    error, thin, asked_edges = {}, set(), []
    for r in edge_tables.select(*numbers).collect():
        for fine, coarse, d_fine, d_coarse, kept, mode in ((r["a"], r["b"], r["d_a"], r["d_b"], r["kept_ab"], r["mode_b"]), (r["b"], r["a"], r["d_b"], r["d_a"], r["kept_ba"], r["mode_a"])):
            error[fine, coarse] = 1 - kept / r["n"]
            key_like = total >= 10 and live[fine] >= 0.9 * total
            if live[fine] < 3 or key_like or d_fine <= d_coarse or error[fine, coarse] > most:
                continue
            if r["n"] > mode and (kept - mode) / (r["n"] - mode) >= LEAST_LAMBDA:
                asked_edges.append((fine, coarse))
                if r["n"] < min(LEAST_ROWS, total):
                    thin.add((fine, coarse))
    # Aliases: null is a value, and the numbers of values must be close for both errors to be small.
    close = [(a, b) for a, b in open_pairs if max(live[a], live[b]) * (1 - most) <= min(live[a], live[b])]
    alias_error, alias_tables = {}, None
    if close:
        alias_tables = pair_tables(df, close, set(live))
        for r in alias_tables.select(*numbers).collect():
            worst = 1 - min(r["d_a"], r["d_b"]) / r["d_ab"]
            if worst <= most:
                alias_error[r["a"], r["b"]] = worst
    p_values = {}
    if asked_edges:
        either = {tuple(sorted(e)) for e in asked_edges}
        wanted = spark.createDataFrame(sorted(either), "a_ string, b_ string")
        tested = permutation_p(edge_tables.join(F.broadcast(wanted), F.expr("a = a_ AND b = b_")).drop("a_", "b_"), draws)
        of_pair = {(r["a"], r["b"]): r["p"] for r in tested.select("a", "b", "p").collect()}
        p_values |= {("edge", *e): of_pair[tuple(sorted(e))] for e in asked_edges}
    if alias_error:
        wanted = spark.createDataFrame(sorted(alias_error), "a_ string, b_ string")
        tested = permutation_p(alias_tables.join(F.broadcast(wanted), F.expr("a = a_ AND b = b_")).drop("a_", "b_"), draws)
        p_values |= {("alias", r["a"], r["b"]): r["p"] for r in tested.select("a", "b", "p").collect()}
    accepted = passing(p_values, q)

    twins = sorted((a, b) for kind, a, b in accepted if kind == "alias")
    rows: list[tuple] = []
    merged, apart = [], set()
    if twins:
        rates = df.selectExpr(*[f"avg(CASE WHEN CAST(`{a}` AS STRING) <=> CAST(`{b}` AS STRING) THEN 0D ELSE 1D END) AS r{i}" for i, (a, b) in enumerate(twins)]).first()
        same = {tuple(sorted(k)): v for k, v in (identities or {}).items()}
        for (a, b), rate in zip(twins, rates, strict=True):
            if rate == 0:
                merged.append((a, b))
                continue
            if rate > MOST_DISAGREE:
                verdict, joins = "one to one", same.get((a, b), 0.0) >= SAME_DIMENSION
            else:
                verdict = near_copy(df, a, b, [c for c in sorted(live) if c not in (a, b)], draws=draws).first()["verdict"]
                joins = verdict == "dirt"
            if joins:
                merged.append((a, b))
            else:
                apart.add(frozenset((a, b)))
                rows.append(("role" if verdict == "role" else "alias", [a, b], alias_error[a, b], verdict, verdict != "role"))
    group = {c: {c} for c in live}
    for a, b in merged:
        joint = group[a] | group[b]
        for c in joint:
            group[c] = joint
    head = {c: min(g) for c, g in group.items()}
    edges, thin_heads = set(), set()
    for kind, a, b in accepted:
        if kind == "edge" and frozenset((a, b)) not in apart and head[a] != head[b]:
            edges.add((head[a], head[b]))
            if (a, b) in thin:
                thin_heads.add((head[a], head[b]))
    for path in chains(edges):
        hops = list(zip(path, path[1:], strict=False))
        rows.append(("drilldown", path[::-1], max(error.get(h, 0.0) for h in hops), None, any(h in thin_heads for h in hops)))
    for members in {frozenset(g) for g in group.values() if len(g) > 1}:
        inside = [e for pair, e in alias_error.items() if set(pair) <= members]
        rows.append(("alias", sorted(members), max(inside), "merge", False))
    return spark.createDataFrame(rows, schema)


def override_hierarchies(found: DataFrame, rejected: DataFrame, added: DataFrame) -> DataFrame:
    """``kind, members`` without rejected member sets, whatever their order, and with added ones that are new."""
    keyed = lambda df: df.select("kind", "members", F.array_sort("members").alias("k"))
    left = keyed(found).join(keyed(rejected).select("k").distinct(), "k", "left_anti")
    return left.unionByName(keyed(added).join(left.select("k"), "k", "left_anti")).select("kind", "members")


def rollup_edges(hierarchies: DataFrame) -> DataFrame:
    """``name, child, parent, level`` between neighbouring levels of ``name, members`` (finest first)."""
    at = hierarchies.select("name", F.posexplode("members").alias("level", "member"))
    up = at.select(F.col("name").alias("n"), (F.col("level") - 1).alias("l"), F.col("member").alias("parent"))
    return at.join(up, F.expr("name = n AND level = l")).select("name", F.col("member").alias("child"), "parent", "level")


def bus_matrix(references: DataFrame, folded: DataFrame) -> DataFrame:
    """``fact, dimension, role, kind, facts, conformed``: which facts use which dimension in which role.

    references: ``fact, dimension, role`` by foreign keys.  folded: ``fact, a, b`` hierarchy edges between
    columns inside a fact; connected columns are one dimension, named by their smallest.  A dimension and role
    that two facts use conform.
    """
    own = folded.select("fact", F.concat_ws("\x1f", "fact", "a").alias("a"), F.concat_ws("\x1f", "fact", "b").alias("b"))
    nodes = own.select(F.col("a").alias("node")).union(own.select("b")).distinct()
    parts = connected_components(nodes, own).select(F.split("component", "\x1f").alias("c")).select(F.col("c")[0].alias("fact"), F.col("c")[1].alias("dimension"))
    cells = references.select("fact", "dimension", "role", F.lit("referenced").alias("kind")).distinct().unionByName(parts.distinct().select("fact", "dimension", F.col("dimension").alias("role"), F.lit("folded").alias("kind")))
    shared = cells.groupBy(F.col("dimension").alias("d"), F.col("role").alias("r")).agg(F.count_distinct("fact").alias("facts"))
    return cells.join(shared, F.expr("dimension = d AND role = r")).select("fact", "dimension", "role", "kind", "facts", (F.col("facts") > 1).alias("conformed"))


def shared_groupings(matrix: DataFrame) -> DataFrame:
    """``fact_a, fact_b, dimension, role`` by which two facts can be compared."""
    a, b = (matrix.select(F.col("fact").alias(f), "dimension", "role").distinct() for f in ("fact_a", "fact_b"))
    return a.join(b, ["dimension", "role"]).where("fact_a < fact_b").select("fact_a", "fact_b", "dimension", "role")


def propagate_slices(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """``fact, dimension, role, column``: slice columns of a dimension for every fact that carries it."""
    return references.select("fact", "dimension", "role").join(candidates.select("dimension", "column"), "dimension").select("fact", "dimension", "role", "column").distinct()


