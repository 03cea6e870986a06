"""Cross-column, dependency and driver queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import crosscol as x
from siltstone.plans.base import query, rounded

_LINE = "(SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_discount AS rebate FROM lineitem)"


def _line(table):
    return table("lineitem").selectExpr("*", "l_extendedprice * (1 - l_discount) AS net", "l_extendedprice * l_discount AS rebate")


@query("a01_formula_match", f"SELECT count(*) FILTER (WHERE net <> 0) AS total, count(*) FILTER (WHERE net <> 0 AND abs(net - (l_extendedprice - rebate)) < 0.01) AS matched, round(count(*) FILTER (WHERE net <> 0 AND abs(net - (l_extendedprice - rebate)) < 0.01) / count(*) FILTER (WHERE net <> 0), 6) AS rate FROM {_LINE}")
def _(table):
    return rounded(x.formula_match(_line(table), "net", "l_extendedprice - rebate"))


_DERIVED_FROM = ["l_extendedprice", "l_discount", "net", "rebate"]
_ASKED = [
    (t, a, op, b, rank, shape.format(a=a, b=b))
    for t in _DERIVED_FROM for a in _DERIVED_FROM for b in _DERIVED_FROM
    for rank, (op, shape) in enumerate({"sum": "{a} + {b}", "product": "{a} * {b}", "difference": "{a} - {b}", "ratio": "{a} / nullif({b}, 0)"}.items())
    if len({t, a, b}) == 3 and (op in ("difference", "ratio") or a < b)
]
_COUNTED = ", ".join(f"count(*) FILTER (WHERE {t} <> 0 AND ({f}) IS NOT NULL) AS t{i}, count(*) FILTER (WHERE {t} <> 0 AND abs({t} - ({f})) < 0.01) AS m{i}" for i, (t, _, _, _, _, f) in enumerate(_ASKED))
_EVERY = " UNION ALL ".join(f"SELECT '{t}' AS target, '{a}' AS a, '{op}' AS op, '{b}' AS b, {rank} AS op_rank, m{i} / nullif(t{i}, 0) AS rate FROM k" for i, (t, a, op, b, rank, _) in enumerate(_ASKED))


# A formula whose operands may change places stands once, in the order in which the columns are asked.
@query("a02_find_derived", f"WITH k AS (SELECT {_COUNTED} FROM {_LINE}), r AS ({_EVERY}), p(c, place) AS (VALUES ('l_extendedprice', 0), ('l_discount', 1), ('net', 2), ('rebate', 3)), o AS (SELECT target, CASE WHEN op IN ('sum', 'product') AND x.place > y.place THEN b ELSE a END AS a, op, CASE WHEN op IN ('sum', 'product') AND x.place > y.place THEN a ELSE b END AS b, op_rank, rate FROM r JOIN p x ON x.c = a JOIN p y ON y.c = b WHERE rate >= 0.8) SELECT target, a, op, b, round(rate, 6) AS rate FROM o QUALIFY row_number() OVER (PARTITION BY list_sort([target, a, b]) ORDER BY rate DESC, op_rank, target, a) = 1")
def _(table):
    return rounded(x.find_derived(_line(table), ["l_extendedprice", "l_discount", "net", "rebate"]))


_V = "WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), r AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), j AS (SELECT sum(n * n / (na * nb)) AS s, sum(n) AS total FROM c JOIN r USING (a) JOIN k USING (b)), z AS (SELECT (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM k) AS c) SELECT CAST(total AS BIGINT) AS total, round(total * (s - 1), 4) AS chi2, (r - 1) * (c - 1) AS df, round(sqrt(greatest(s - 1, 0) / (least(r, c) - 1)), 4) AS v, CASE WHEN sqrt(greatest(s - 1, 0) / (least(r, c) - 1)) >= 0.5 THEN 'strong' WHEN sqrt(greatest(s - 1, 0) / (least(r, c) - 1)) >= 0.3 THEN 'moderate' WHEN sqrt(greatest(s - 1, 0) / (least(r, c) - 1)) >= 0.1 THEN 'weak' ELSE 'none' END AS strength, round({p}, 4) AS p_value FROM j, z"


# The tail of chi-square with an even number of degrees of freedom is a sum; ``half`` of them.
_TAIL = "exp(-total * (s - 1) / 2) * (1 {more})"


def _tail(half):
    return _TAIL.format(more="".join(f" + pow(total * (s - 1) / 2, {k}) / gamma({k + 1})" for k in range(1, half)))


@query("a05_cramers_v", _V.format(a="l_returnflag", b="l_linestatus", t="lineitem", p=_tail(1)))
def _(table):
    return rounded(x.cramers_v(table("lineitem"), "l_returnflag", "l_linestatus"), 4)


@query("a05_many_levels", _V.format(a="l_linenumber", b="l_returnflag", t="lineitem", p=_tail(6)))
def _(table):
    return rounded(x.cramers_v(table("lineitem"), "l_linenumber", "l_returnflag"), 4)


_ORDER_LABELS = {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "big": "CASE WHEN o_totalprice > 150000 THEN o_totalprice ELSE 0 END", "third": "CASE WHEN o_custkey % 3 = 0 THEN 'x' END", "bonus": "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 2 END"}
_LABEL_SQL = {c: f"CAST(coalesce({e} <> 0, false) AS VARCHAR)" if c in ("big", "bonus") else f"coalesce('=' || {e}, '-')" for c, e in _ORDER_LABELS.items()}
_ENTROPY = "(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY {}))"
_PAIR_NMI = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_ENTROPY.format(_LABEL_SQL[a])} AS h_a, {_ENTROPY.format(_LABEL_SQL[b])} AS h_b, {_ENTROPY.format(_LABEL_SQL[a] + ', ' + _LABEL_SQL[b])} AS h_ab"
    for i, a in enumerate(_ORDER_LABELS) for b in list(_ORDER_LABELS)[i + 1 :]
)


@query("a07_dependent_pairs", f"SELECT a, b, round(mi, 6) AS mi, round(full_nmi, 6) AS nmi FROM (SELECT a, b, greatest(0, h_a + h_b - h_ab) AS mi, CASE WHEN h_a * h_b > 0 THEN greatest(0, h_a + h_b - h_ab) / sqrt(h_a * h_b) ELSE 0 END AS full_nmi FROM ({_PAIR_NMI})) ORDER BY round(full_nmi, 12) DESC, a, b LIMIT 5")
def _(table):
    return rounded(x.dependent_pairs(table("orders").selectExpr(*[f"{e} AS {c}" for c, e in _ORDER_LABELS.items()]), list(_ORDER_LABELS)))


_MI = "WITH c AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2), e AS (SELECT (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS h_a, (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS h_b, (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM c) AS h_ab) SELECT round(h_a, 6) AS h_a, round(h_b, 6) AS h_b, round(h_a + h_b - h_ab, 6) AS mi, round((h_a + h_b - h_ab) / least(h_a, h_b), 6) AS nmi, round((h_a + h_b - h_ab) / h_b, 6) AS fraction_of_information FROM e"


@query("a07_mutual_information", _MI)
def _(table):
    return rounded(x.mutual_information(table("part"), "p_brand", "p_type"))


@query("a09_dimension_coverage", "SELECT 'c_name' AS \"column\", round(avg(CASE WHEN c_name IS NULL THEN 1.0 ELSE 0 END), 6) AS null_share FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 UNION ALL SELECT 'c_mktsegment', round(avg(CASE WHEN c_mktsegment IS NULL THEN 1.0 ELSE 0 END), 6) FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(table):
    view = table("orders").join(table("customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rounded(x.null_share(view, ["c_name", "c_mktsegment"]))


@query("h01_distinct_scan", "SELECT 'p_brand' AS columns, count(DISTINCT p_brand) AS distinct_values FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_brand,p_type', count(DISTINCT (p_brand, p_type)) FROM part")
def _(table):
    return x.distinct_scan(table("part"), ["p_brand", "p_type"], [("p_brand", "p_type")])


_G3 = "WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2), k AS (SELECT sum(top) AS kept, sum(n) AS total FROM (SELECT max(n) AS top, sum(n) AS n FROM c GROUP BY a)), m AS (SELECT max(nb) AS mode FROM (SELECT sum(n) AS nb FROM c GROUP BY b)) SELECT CAST(total AS BIGINT) AS total, round(1 - kept / total, 6) AS g3, round((kept - mode) / (total - mode), 6) AS lambda, CAST(total - kept AS BIGINT) AS minority FROM k, m"


@query("h03_dependency", _G3.format(a="n_nationkey", b="n_regionkey", t="nation JOIN customer ON n_nationkey = c_nationkey"))
def _(table):
    return rounded(x.dependency(table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")), "n_nationkey", "n_regionkey"))


@query("h04_weak_dependency", _G3.format(a="p_brand", b="p_type", t="part"))
def _(table):
    return rounded(x.dependency(table("part"), "p_brand", "p_type"))


@query("h07_benjamini_hochberg", "WITH p AS (SELECT c_nationkey AS test, pow(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END), 2) AS p FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS rank, count(*) OVER () AS m FROM p) SELECT test, round(p, 9) AS p, rank, rank <= (SELECT coalesce(max(rank), 0) FROM r WHERE p <= 0.05 * rank / m) AS significant FROM r")
def _(table):
    p = table("customer").groupBy(F.col("c_nationkey").alias("test")).agg(F.expr("pow(avg(CASE WHEN c_acctbal < 0 THEN 1D ELSE 0D END), 2)").alias("p"))
    return rounded(x.benjamini_hochberg(p, "test", "p"), 9)


@query("d01_null_gate", "SELECT o_orderpriority, count(*) AS n, round(count(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / count(*), 6) AS observed, count(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / count(*) >= 0.5 * (SELECT count(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / count(*) FROM orders) AS kept FROM orders GROUP BY 1")
def _(table):
    return rounded(x.null_gate(table("orders").withColumn("m", F.expr("CASE WHEN o_orderstatus = 'F' THEN o_totalprice END")), "m", "o_orderpriority"))


@query("d02_variance_reduction", "WITH g AS (SELECT count(*) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS ss FROM orders GROUP BY o_orderpriority HAVING count(*) >= 200) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS eta2 FROM g")
def _(table):
    return rounded(x.variance_reduction(table("orders"), "o_totalprice", "o_orderpriority"))


@query("d04_intraclass", "WITH g AS (SELECT count(*) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS ss FROM orders GROUP BY o_custkey HAVING count(*) >= 2) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n)), 6) AS eta2 FROM g")
def _(table):
    return rounded(x.variance_reduction(table("orders"), "o_totalprice", "o_custkey", 2))


@query("d06_slice_effects", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders) - 1, 4) AS effect FROM orders GROUP BY 1 HAVING count(*) >= 200")
def _(table):
    return rounded(x.slice_effects(table("orders"), "o_totalprice", "o_orderpriority"), 4)


@query("d10_entity_collapse", "SELECT o_custkey, round(sum(o_totalprice), 4) AS total, count(*) AS weight, min(o_orderpriority) AS dim FROM orders GROUP BY 1")
def _(table):
    return rounded(x.entity_collapse(table("orders"), "o_custkey", "o_totalprice", "o_orderpriority"), 4)


@query("d11_entity_constancy", "SELECT dim, max(n) AS most, max(n) <= 1 AS constant FROM (SELECT 'o_orderstatus' AS dim, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders GROUP BY o_custkey) GROUP BY 1")
def _(table):
    return x.entity_constancy(table("orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("d12_within_entity_residual", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 3) AS residual FROM orders")
def _(table):
    return rounded(x.within_entity_residual(table("orders"), "o_custkey", "o_totalprice", ["o_orderkey"]), 3)


_VIEW = "(SELECT l_quantity AS qty, round(l_quantity * p_retailprice, 2) AS listed, l_discount, p_retailprice AS retail, p_size AS size FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _derived_sql(target, a, op, b, formula):
    usable = f"{target} <> 0 AND ({formula}) IS NOT NULL"
    return f"SELECT '{target}' AS target, '{a}' AS a, '{op}' AS op, '{b}' AS b, count(*) FILTER (WHERE {usable} AND abs({target} - ({formula})) < 0.01) / count(*) FILTER (WHERE {usable}) AS rate FROM {_VIEW}"


@query("a03_derived_in_view", "SELECT target, a, op, b, round(rate, 6) AS rate FROM (" + " UNION ALL ".join([
    _derived_sql("listed", "qty", "product", "retail", "qty * retail"), _derived_sql("qty", "listed", "ratio", "retail", "listed / nullif(retail, 0)"),
    _derived_sql("listed", "qty", "sum", "retail", "qty + retail"), _derived_sql("qty", "listed", "ratio", "size", "listed / nullif(size, 0)"), _derived_sql("listed", "qty", "product", "size", "qty * size"),
]) + ") WHERE rate >= 0.8 QUALIFY row_number() OVER (PARTITION BY list_sort([target, a, b]) ORDER BY rate DESC, op = 'ratio', target) = 1")
def _(table):
    view = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_quantity AS qty", "round(l_quantity * p_retailprice, 2) AS listed", "l_discount", "p_retailprice AS retail", "p_size AS size")
    return rounded(x.find_derived(view, ["qty", "listed", "retail", "size"], targets=["qty", "listed"]))


def _mi_sql(c):
    h = lambda by: f"(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM part GROUP BY {by}))"
    return f"SELECT '{c}' AS \"column\", {h(c)} AS h_a, {h('p_type')} AS h_b, {h(f'{c}, p_type')} AS h_ab"


@query("a07_most_informative", f"SELECT \"column\", round(h_a + h_b - h_ab, 6) AS mi, round((h_a + h_b - h_ab) / nullif(least(h_a, h_b), 0), 6) AS nmi, round((h_a + h_b - h_ab) / nullif(h_b, 0), 6) AS fraction_of_information, h_a + h_b - h_ab > 1e-9 AS informs FROM ({' UNION ALL '.join(map(_mi_sql, ('p_brand', 'p_size', 'p_name')))}) ORDER BY 4 DESC NULLS LAST, 1 LIMIT 2")
def _(table):
    return rounded(x.most_informative(table("part"), "p_type", ["p_brand", "p_size", "p_name"], 2))


@query("a09_coverage_score", "SELECT round((avg(CASE WHEN c_name IS NULL THEN 0.0 ELSE 1 END) + avg(CASE WHEN c_mktsegment IS NULL THEN 0.0 ELSE 1 END)) / 2, 6) AS mean_coverage, round(least(avg(CASE WHEN c_name IS NULL THEN 0.0 ELSE 1 END), avg(CASE WHEN c_mktsegment IS NULL THEN 0.0 ELSE 1 END)), 6) AS least_coverage FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(table):
    view = table("orders").join(table("customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rounded(x.coverage_score(view, ["c_name", "c_mktsegment"]))
