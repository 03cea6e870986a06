"""Drivers and hierarchies on planted tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import drivers, hierarchies


@pytest.fixture(scope="module")
def sales(spark):
    """value: driven by region, and by product within the north only; noise drives nothing."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6000):
        region, product, noise, many = ("north", "south", "east")[rng.integers(3)], f"p{rng.integers(4)}", f"n{rng.integers(5)}", f"m{rng.integers(900)}"
        value = rng.normal() + 4 * (region == "north") + 3 * (region == "north" and product == "p1")
        rows.append((i, region, product, noise, many, float(value), 1.0))
    return spark.createDataFrame(rows, "id long, region string, product string, noise string, many string, value double, weight double").cache()


def _gain(y, code, least):
    groups = [[v for v, c in zip(y, code, strict=True) if c == k] for k in set(code)]
    groups = [g for g in groups if len(g) >= least]
    every = [v for g in groups for v in g]
    mean = sum(every) / len(every)
    return sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups) / sum((v - mean) ** 2 for v in every)


def test_gate(spark, sales):
    out = {r.dim: r for r in drivers.permutation_gate(sales, ["region", "product", "noise", "many"], permutations=99).collect()}
    own = sales.orderBy("id").toPandas()
    for dim in ("region", "product", "noise"):
        assert abs(out[dim].gain - _gain(own.value.tolist(), own[dim].tolist(), 200)) < 1e-9
    assert out["region"].p == out["product"].p == 0.01
    assert out["noise"].p > 0.05
    assert out["many"].gain == 0 and out["many"].p == 1


def test_gate_takes_nulls_and_no_rows(spark, sales):
    holes = sales.withColumn("region", F.when(F.col("id") % 3 > 0, F.col("region")))
    assert {r.dim: r.p for r in drivers.permutation_gate(holes, ["region"], permutations=19).collect()} == {"region": 0.05}
    assert [r.gain for r in drivers.permutation_gate(sales.limit(0), ["region"], permutations=5).collect()] == [0.0]


def test_tree(sales):
    out = [(r.path, r.dim) for r in drivers.driver_tree(sales, ["region", "product", "noise"], permutations=199).orderBy("depth", "path").collect()]
    assert out == [("", "region"), ("region = north", "product")]


def test_rank(spark):
    rng = np.random.default_rng(5)
    rows = []
    for entity in range(400):
        kind, other, level = ("a", "b")[entity % 2], f"o{rng.integers(3)}", rng.normal() * 2
        for _ in range(10):
            shift = ("x", "y")[rng.integers(2)]
            rows.append((len(rows), entity, kind, other, shift, float(level + 5 * (kind == "a") + 1.5 * (shift == "x") + 0.3 * rng.normal())))
    table = spark.createDataFrame(rows, "id long, entity long, kind string, other string, shift string, m double")
    out = {r.dim: r for r in drivers.rank_drivers(table, "m", ["kind", "other", "shift"], "entity", ["id"], permutations=99).collect()}
    assert (out["kind"].list, out["kind"].family, out["kind"].verdict, out["kind"].rank) == ("primary", "entity", "driver", 1)
    assert out["other"].verdict == "not significant"
    assert (out["shift"].list, out["shift"].family, out["shift"].verdict) == ("secondary", "row", "driver")
    alone = {r.dim: r for r in drivers.rank_drivers(table, "m", ["kind", "shift"], permutations=99).collect()}
    assert {r.list for r in alone.values()} == {"primary"} and alone["kind"].rank == 1


def test_sample_does_not_depend_on_partitions(sales):
    a = drivers.hash_sample(sales, ["id", "region"], 100).collect()
    assert a == drivers.hash_sample(sales.repartition(7), ["id", "region"], 100).collect() and len(a) == 100


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        city = int(rng.integers(40))
        rows.append((i, f"city{city}", f"state{city // 5}", f"country{city // 20}", f"code{city // 5}", f"flag{rng.integers(6)}", "same"))
    return spark.createDataFrame(rows, "id long, city string, state string, country string, code string, flag string, constant string").cache()


def test_hierarchies(places):
    columns = ["city", "state", "country", "code", "flag", "constant"]
    # Code and state go one to one, but only somebody who knows can say that they are one dimension.
    out = {(r.kind, tuple(r.members), r.needs_confirmation) for r in hierarchies.find_hierarchies(places, columns, draws=299).collect()}
    assert out == {("alias", ("code", "state"), True), ("drilldown", ("country", "code", "city"), False), ("drilldown", ("country", "state", "city"), False)}
    out = {(r.kind, tuple(r.members), r.needs_confirmation) for r in hierarchies.find_hierarchies(places, columns, draws=299, identities={("state", "code"): 0.9}).collect()}
    assert out == {("alias", ("code", "state"), False), ("drilldown", ("country", "code", "city"), False)}


def test_hierarchies_of_planted_columns(spark):
    """A dirty edge, a skewed column that anything seems to determine, roles, dirt, exact copies, columns that are null or one value, and few complete rows."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(4000):
        zip_, fact = int(rng.integers(60)), int(rng.integers(4))
        city = zip_ // 6
        dirty_city = city if i % 200 else (city + 1) % 10
        skew = "rare" if i % 130 == 0 else "usual"
        bill, ship = f"acct{zip_}", f"acct{(zip_ + 7) % 60}" if fact == 3 and i % 11 == 0 else f"acct{zip_}"
        dirt = f"acct{(zip_ + 1 + i % 50) % 60}" if rng.random() < 0.01 else f"acct{zip_}"
        marked = "x" if zip_ % 4 == 0 else None
        sparse = f"s{zip_ // 20}" if i % 50 == 0 else None
        rows.append((i, f"z{zip_}", f"c{dirty_city}", skew, bill, ship, dirt, bill, f"f{fact}", marked, sparse))
    table = spark.createDataFrame(rows, "id long, zip string, city string, skew string, bill string, ship string, dirt string, copy string, fact string, marked string, sparse string")
    find = lambda *columns: {(r.kind, tuple(r.members), r.verdict, r.needs_confirmation) for r in hierarchies.find_hierarchies(table, list(columns), draws=999).collect()}
    assert find("zip", "city", "skew", "fact", "id") == {("drilldown", ("city", "zip"), None, False)}
    assert find("bill", "copy", "fact") == {("alias", ("bill", "copy"), "merge", False)}
    assert ("role", ("bill", "ship"), "role", False) in hierarchy_pairs(table, ["bill", "ship", "fact"], most=0.9)
    assert ("alias", ("bill", "dirt"), "merge", False) in hierarchy_pairs(table, ["bill", "dirt", "fact"], most=0.9)
    assert find("zip", "marked") == {("drilldown", ("marked", "zip"), None, False)}
    assert find("zip", "sparse") == {("drilldown", ("sparse", "zip"), None, True)}


def hierarchy_pairs(table, columns, most):
    """Near-copies make many pairs of values in a small table, so the screen is set wide."""
    return {(r.kind, tuple(r.members), r.verdict, r.needs_confirmation) for r in hierarchies.find_hierarchies(table, columns, most=most, draws=999).collect()}


def test_sketches_leave_few_pairs(spark):
    """Only pairs that can be aliases or drill-downs are counted."""
    table = spark.range(20_000).selectExpr("id AS k", "id % 500 AS fine", "id % 500 DIV 10 AS coarse", "hash(id) % 400 AS h1", "hash(id, 1) % 300 AS h2", "hash(id, 2) % 350 AS h3")
    sizes = {r["column"]: r["distinct_values"] for r in hierarchies.column_sizes(table, ["fine", "coarse", "h1", "h2", "h3"]).collect()}
    assert hierarchies.possible_pairs(table, sizes, 20_000) == [("coarse", "fine")]


def test_chains():
    assert hierarchies.chains({("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")}) == [["x", "c"], ["a", "b", "c"]]
    assert hierarchies.chains({("a", "b"), ("b", "a"), ("z", "a")}) == [["z", "a"]]
    assert hierarchies.chains(set()) == []


def test_dependency_p_stops_early(places):
    out = {(r.a, r.b): r for r in hierarchies.dependency_p_values(places, [("city", "state"), ("flag", "country")], draws=300, block=50, stop_at=5).collect()}
    assert out["city", "state"].hits == 0 and out["city", "state"].draws == 300 and abs(out["city", "state"].p - 1 / 301) < 1e-12
    assert out["flag", "country"].hits >= 5 and out["flag", "country"].draws < 300


@pytest.mark.parametrize(
    ("copy", "verdict"),
    [
        ("city", "merge"),
        ("CASE WHEN id < 5 THEN 'z' ELSE city END", "abstain"),
        ("CASE WHEN id % 3 = 0 THEN 'z' ELSE city END", "undecided"),
        ("CASE WHEN flag = 'flag1' AND id % 5 = 0 THEN 'z' ELSE city END", "role"),
        ("CASE WHEN city = 'city7' THEN 'z' ELSE city END", "value_systematic"),
        ("CASE WHEN xxhash64(id) % 40 = 0 THEN 'z' ELSE city END", "dirt"),
    ],
)
def test_near_copies(places, copy, verdict):
    out = hierarchies.near_copy(places.withColumn("copy", F.expr(copy)), "city", "copy", ["flag"], draws=199).first()
    assert out.verdict == verdict, out


def test_empty_tables(places):
    none = places.limit(0)
    assert hierarchies.near_copy(none, "city", "state", ["flag"]).first().verdict == "undecided"
    assert hierarchies.alias_groups(none.select(F.col("city").alias("a"), F.col("state").alias("b"))).count() == 0


def test_hierarchies_of_no_rows(places):
    assert hierarchies.find_hierarchies(places.limit(0), ["city", "state"]).count() == 0
    assert hierarchies.pair_errors(places.limit(0), ["city", "state"]).count() == 0


def _shuffle_p(a, b, statistic, draws, rng):
    def value(x, y):
        _, inverse, n = np.unique(np.stack([x, y]), axis=1, return_inverse=True, return_counts=True)
        cells = np.unique(np.stack([x, y]), axis=1)
        if statistic == "information":
            return (n * np.log(n)).sum()
        if statistic == "association":
            return (n * n / np.bincount(x)[cells[0]] / np.bincount(y)[cells[1]]).sum()
        best = np.zeros(x.max() + 1)
        np.maximum.at(best, cells[0], n)
        return best.sum()

    own = value(a, b)
    return (1 + sum(value(a, rng.permutation(b)) >= own - 1e-9 for _ in range(draws))) / (1 + draws)


@pytest.mark.parametrize("statistic", ["information", "association", "kept"])
@pytest.mark.parametrize("kind", ["weak", "none", "many values", "skewed"])
def test_p_from_margins_is_that_of_shuffles(spark, statistic, kind):
    """Drawing tables from margins must give the p-value of shuffling rows, up to the error of either."""
    rng = np.random.default_rng(12)
    n, draws = 400, 600
    a = rng.integers(0, 150 if kind == "many values" else 6, n)
    b = rng.integers(0, 60 if kind == "many values" else 4, n)
    if kind == "weak":
        b = np.where(rng.random(n) < 0.12, a % 4, b)
    if kind == "skewed":
        b = (rng.random(n) < 0.05).astype(int)
    table = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a int, b int")
    got = hierarchies.dependency_p_values(table, [("a", "b")], draws, stop_at=10**9, statistic=statistic).first()
    want = _shuffle_p(a, b, statistic, draws, rng)
    assert got.draws == draws and abs(got.p - want) < 5 * (2 * max(want * (1 - want), 0.005) / draws) ** 0.5


def test_margins_of_large_tables():
    from siltstone.operators import permutations as p

    rng = np.random.default_rng(2)
    # Totals beyond the library's sampler, and parts of bounded rows: margins hold exactly.
    colours = np.array([3 * 10**9, 10**9, 5, 0])
    for k in (0, 7, 10**9, 4 * 10**9 + 5):
        out = p.taken(rng, colours, k)
        assert out.sum() == k and (out >= 0).all() and (out <= colours).all()
    many = [p.taken(rng, colours, 2 * 10**9)[1] for _ in range(300)]
    assert abs(np.mean(many) - 5 * 10**8) < 5 * np.std(many) / 300**0.5 + 1 and 0.7 < np.std(many) / (2e9 * 0.25 * 0.75 * 0.5) ** 0.5 < 1.3
    a, b = np.full(3000, 2), np.full(2000, 3)
    whole = [p.random_statistic(np.random.default_rng(i), a, b, "kept") for i in range(200)]
    old, p.PART_ROWS = p.PART_ROWS, 500
    try:
        parts = [p.random_statistic(np.random.default_rng(i), a, b, "kept") for i in range(200)]
    finally:
        p.PART_ROWS = old
    assert abs(np.mean(whole) - np.mean(parts)) < 1.5


def _numpy_gain(y, w, code, least):
    keep = [c for c in np.unique(code[code >= 0]) if (code == c).sum() >= least]
    if len(keep) < 2:
        return 0.0
    at = np.isin(code, keep)
    mean = (w[at] * y[at]).sum() / w[at].sum()
    between = sum(w[code == c].sum() * ((w * y)[code == c].sum() / w[code == c].sum() - mean) ** 2 for c in keep)
    return between / (w[at] * (y[at] - mean) ** 2).sum()


def test_gate_is_that_of_shuffles(spark):
    """Weak effects, dependent dimensions, weights, and values far from zero: p as from shuffling rows."""
    rng = np.random.default_rng(21)
    n = 3000
    a, c = rng.integers(0, 4, n), rng.integers(0, 3, n)
    b = np.where(rng.random(n) < 0.7, a, rng.integers(0, 4, n))
    w = rng.gamma(3, 1, n)
    y = 1e6 + rng.standard_normal(n) / np.sqrt(w) + 0.045 * a
    table = spark.createDataFrame([(int(i), int(j), int(k), float(v), float(x)) for i, j, k, v, x in zip(a, b, c, y, w, strict=True)], "a int, b int, c int, value double, weight double")
    out = {r.dim: r for r in drivers.permutation_gate(table, ["a", "b", "c"], permutations=800).collect()}
    codes = {"a": a, "b": b, "c": c}
    own = {k: _numpy_gain(y, w, v, 200) for k, v in codes.items()}
    best = []
    for _ in range(800):
        o = rng.permutation(n)
        best.append(max(_numpy_gain(y[o], w[o], v, 200) for v in codes.values()))
    for k in codes:
        want = (1 + sum(x >= own[k] for x in best)) / 801
        assert abs(out[k].gain - own[k]) < 1e-9
        assert abs(out[k].p - want) < 5 * (2 * max(want * (1 - want), 0.003) / 800) ** 0.5, (k, out[k].p, want)


def test_tree_is_that_of_numpy(spark):
    """Many nodes of one depth, against a tree grown node by node."""
    rng = np.random.default_rng(6)
    n = 9000
    codes = {d: rng.integers(0, k, n) for d, k in (("a", 3), ("b", 3), ("c", 4), ("d", 2))}
    y = 3.0 * codes["a"] + np.where(codes["a"] == 1, 2.0 * codes["b"], 0) + np.where(codes["a"] == 2, 1.5 * codes["c"], 0) + np.where((codes["a"] == 2) & (codes["c"] == 3), 2.0 * codes["d"], 0) + rng.standard_normal(n)
    table = spark.createDataFrame([(*(int(codes[d][i]) for d in "abcd"), float(y[i]), 1.0) for i in range(n)], "a int, b int, c int, d int, value double, weight double")
    out = {r.path: (r.depth, r.dim, r.n, round(r.gain, 9)) for r in drivers.driver_tree(table, list("abcd"), depth=3, min_rows=100, permutations=199).collect()}

    def grow(at, path, rest, depth, found):
        # The planted effects are far beyond, and the noise far below, what chance gives.
        gains = {d: _numpy_gain(y[at], np.ones(at.sum()), codes[d][at], 100) for d in rest}
        best = max(gains, key=lambda d: (gains[d], d))
        if gains[best] < 0.02:
            return
        found[path] = (depth, best, int(at.sum()), round(gains[best], 9))
        for v in np.unique(codes[best]):
            below = at & (codes[best] == v)
            if depth < 2 and below.sum() >= 400:
                grow(below, f"{path} > {best} = {v}" if path else f"{best} = {v}", [d for d in rest if d != best], depth + 1, found)

    want = {}
    grow(np.ones(n, bool), "", list("abcd"), 0, want)
    assert out == want and len(want) >= 4


def test_gate_leaves_out_groups_without_values(sales):
    """A group whose value is mostly missing does not count, though its few values differ."""
    holes = sales.withColumn("value", F.when((F.col("region") != "north") | (F.col("id") % 8 == 0), F.col("value")))
    gains = {r.dim: r.gain for r in drivers.driver_gains(holes, ["region"]).collect()}
    assert gains["region"] < 0.01 < {r.dim: r.gain for r in drivers.driver_gains(holes, ["region"], least_observed=0.0).collect()}["region"]


def test_aliases_of_drivers(spark, sales):
    aliases = spark.createDataFrame([("zone", "region"), ("region", "region")], "column string, representative string")
    assert drivers.one_per_alias(["zone", "region", "noise"], aliases) == ["region", "noise"]
    assert drivers.one_per_alias(["zone", "noise"], aliases) == ["zone", "noise"]
    twice = sales.withColumn("zone", F.upper("region")).withColumn("m", F.col("value"))
    out = drivers.rank_drivers(twice, "m", ["zone", "region", "noise"], permutations=99, aliases=aliases).collect()
    assert {r.dim for r in out} == {"region", "noise"}


@pytest.mark.parametrize("rows", [0, 1, 17, 500, 2999, 3000, 5000])
def test_sample_is_the_start_of_the_order(spark, rows):
    """As a full sort by hash, whatever repeats: a third of the rows are alike."""
    table = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id DIV 2 END AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'x' END AS b")
    whole = table.withColumn("h", F.xxhash64(F.col("a").cast("string"), F.col("b"))).orderBy("h", "a", "b").drop("h").collect()
    old, drivers.RANGE_ROWS = drivers.RANGE_ROWS, 5
    try:
        assert drivers.hash_sample(table, ["a", "b"], rows).collect() == whole[:rows]
    finally:
        drivers.RANGE_ROWS = old


def test_gains_keep_their_digits(spark):
    """Values around a thousand million vary by one."""
    from siltstone.operators import crosscol

    rng = np.random.default_rng(1)
    y, g = rng.standard_normal(3000), rng.integers(0, 3, 3000)
    y = y + g
    table = spark.createDataFrame([(float(1e9 + a), int(b), 2.0) for a, b in zip(y, g, strict=True)], "m double, g int, w double")
    shifted = (1e9 + y) - 1e9
    want = _numpy_gain(shifted, np.ones(3000), g, 200)
    assert abs(crosscol.variance_reduction(table, "m", "g").first()["eta2"] - want) < 1e-6
    assert abs(drivers.weighted_reduction(table.selectExpr("m * w AS t", "w", "g"), "t", "w", "g").first()["gain"] - want) < 1e-6
