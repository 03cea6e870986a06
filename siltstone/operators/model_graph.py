"""Reads of a property graph about data: concepts, groundings, columns, tables and what joins them.

Vertices are ``node, kind, name`` rows and edges ``kind, a, b, props`` rows, with ``props`` a map of text.  Each read is two joins of
one kind of edge with the kinds of vertices that it may touch; an edge with an end that no such vertex has is left out
and told by ``unresolved``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of concept edges, and what each other kind of edge goes from and to.
PREDICATES = ("part_of", "disjoint_with", "reconciles_with")
ENDS = dict.fromkeys(PREDICATES, ("concept", "concept")) | {"grounded_by": ("concept", "grounding"), "uses": ("grounding", "column"), "belongs_to": ("column", "table"), "references": ("column", "column"), "conforms": ("table", "table"), "derived_from": ("table", "table")}


def _ends(kind: Column, place: int) -> Column:
    out = F.lit(None).cast("string")
    for k, ends in ENDS.items():
        out = F.when(kind == k, ends[place]).otherwise(out)
    return out


def matched(vertices: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``kind, a, a_name, b, b_name, props`` of edges whose ends are vertices of the kinds that they may touch."""
    side = lambda c: vertices.select(F.col("node").alias(c), F.col("kind").alias(f"{c}_kind"), F.col("name").alias(f"{c}_name"))
    own = edges.where(F.col("kind").isin(*kinds)).select("kind", "a", "b", "props", _ends(F.col("kind"), 0).alias("a_kind"), _ends(F.col("kind"), 1).alias("b_kind"))
    return own.join(side("a"), ["a", "a_kind"]).join(side("b"), ["b", "b_kind"]).select("kind", "a", "a_name", "b", "b_name", "props")


def unresolved(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, n``: edges of each kind that lack an end of the right kind."""
    side = lambda c: vertices.select(F.col("node").alias(c), F.col("kind").alias(f"{c}_kind")).distinct()
    own = edges.select("kind", "a", "b", _ends(F.col("kind"), 0).alias("a_kind"), _ends(F.col("kind"), 1).alias("b_kind"))
    lost = own.join(side("a"), ["a", "a_kind"], "left_anti").select("kind", "a", "b").unionByName(own.join(side("a"), ["a", "a_kind"], "left_semi").join(side("b"), ["b", "b_kind"], "left_anti").select("kind", "a", "b"))
    return lost.groupBy("kind").agg(F.count("*").alias("n"))


def concept_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``from_name, predicate, tolerance, to_name``: how concepts relate."""
    found = matched(vertices, edges, PREDICATES)
    return found.select(F.col("a_name").alias("from_name"), F.col("kind").alias("predicate"), F.expr("try_cast(props['tolerance'] AS double)").alias("tolerance"), F.col("b_name").alias("to_name"))


def column_uses(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``concept, grounding, role, column, table``: the columns that each concept's groundings use; a grounding without a concept has null there."""
    uses = matched(vertices, edges, ("uses",)).select(F.col("a").alias("g"), F.col("a_name").alias("grounding"), F.col("b").alias("col"), F.col("b_name").alias("column"), F.col("props")["role"].alias("role"))
    grounds = matched(vertices, edges, ("grounded_by",)).select(F.col("b").alias("g"), F.col("a_name").alias("concept")).distinct()
    homes = matched(vertices, edges, ("belongs_to",)).select(F.col("a").alias("col"), F.col("b_name").alias("table")).distinct()
    return uses.join(grounds, "g", "left").join(homes, "col", "left").select("concept", "grounding", "role", "column", "table")


def table_references(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``from_table, from_column, to_table, to_column, cardinality, introduces_duplicates`` of references between columns."""
    homes = matched(vertices, edges, ("belongs_to",)).select(F.col("a").alias("col"), F.col("b_name").alias("table")).distinct()
    home = lambda c: homes.select(F.col("col").alias(c), F.col("table").alias(f"{c}_table"))
    refs = matched(vertices, edges, ("references",)).join(home("a"), "a").join(home("b"), "b")
    return refs.select(F.col("a_table").alias("from_table"), F.col("a_name").alias("from_column"), F.col("b_table").alias("to_table"), F.col("b_name").alias("to_column"), F.col("props")["cardinality"].alias("cardinality"), F.expr("try_cast(props['introduces_duplicates'] AS boolean)").alias("introduces_duplicates"))


def conformed_dimensions(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``table_a, table_b, dimension, attribute``: what two tables can be compared by, once per pair whatever the direction."""
    found = matched(vertices, edges, ("conforms",)).where("a <> b")
    return found.select(F.least("a_name", "b_name").alias("table_a"), F.greatest("a_name", "b_name").alias("table_b"), F.col("props")["dimension"].alias("dimension"), F.col("props")["attribute"].alias("attribute")).distinct()


def derivations(vertices: DataFrame, edges: DataFrame, role: str = "dimension") -> DataFrame:
    """``view, bases``: the tables that a view is derived from in one role, by name."""
    found = matched(vertices, edges, ("derived_from",)).where(F.col("props")["base_role"] == role)
    return found.groupBy(F.col("a_name").alias("view")).agg(F.array_sort(F.collect_set("b_name")).alias("bases"))
