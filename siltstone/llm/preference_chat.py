"""Preference formatting: the shared turns once as prompt, then two masked completions.

The chosen and the rejected conversation of a pair are compared turn by turn.  The longest
common prefix of turns is rendered once; what follows on either side is rendered as a completion
in which only assistant turns, with their end mark, count for the loss.

Defined results: null roles and texts count as empty strings; turns order by ``turn`` (nulls first),
then role and text, so repeated rows are repeated turns; two equal conversations give
empty completions and ``tie`` true; a pair that only one side has is left out; a null pair_id is
left out; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"


def _turns(side: DataFrame, name: str) -> DataFrame:
    rows = side.where(F.col("pair_id").isNotNull()).select("pair_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("pair_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("pair_id", F.row_number().over(order).alias("at"), F.struct("role", "text").alias(name))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn.role, F.lit("|>\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn), turn.text, F.lit(END + "\n"))


def _joined(parts: Column) -> Column:
    """Text of collected ``struct(at, piece)`` in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p.piece), "")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask, n_shared, tie``.

    chosen, rejected: turns with ``pair_id, turn, role, text``.  A mask lists the trained
    characters of its completion as ``start:length`` spans, joined by commas.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), ["pair_id", "at"], "full")
    per_pair = Window.partitionBy("pair_id")
    both = both.select(
        "*",
        F.min(F.when(F.col("c").eqNullSafe(F.col("r")), None).otherwise(F.col("at"))).over(per_pair).alias("split"),
        (F.count("c").over(per_pair) > 0).alias("has_c"), (F.count("r").over(per_pair) > 0).alias("has_r"),
    ).where("has_c and has_r")
    both = both.withColumn("shared", F.col("split").isNull() | (F.col("at") < F.col("split")))
    up_to = Window.partitionBy("pair_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    for side in ("c", "r"):
        turn = F.col(side)
        piece = F.when(~F.col("shared") & turn.isNotNull(), _rendered(turn))
        both = both.withColumn(f"{side}_piece", piece)
        start = F.coalesce(F.sum(F.length(F.col(f"{side}_piece"))).over(up_to), F.lit(0)) + F.length(_head(turn))
        span = F.concat_ws(":", start.cast("string"), (F.length(turn.text) + len(END)).cast("string"))
        both = both.withColumn(f"{side}_span", F.when(F.col(f"{side}_piece").isNotNull() & (turn.role == "assistant"), span))
    part = lambda value, when: F.collect_list(F.when(when, F.struct("at", value.alias("piece"))))
    out = both.groupBy("pair_id").agg(
        part(_rendered(F.col("c")), F.col("shared")).alias("p"),
        *[part(F.col(f"{s}_{x}"), F.col(f"{s}_{x}").isNotNull()).alias(f"{s}_{x}s") for s in ("c", "r") for x in ("piece", "span")],
        F.count_if("shared").alias("n_shared"), F.count_if(~F.col("shared")).alias("n_other"),
    )
    mask = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda p: p.piece), ",")
    return out.select(
        "pair_id", _joined(F.col("p")).alias("prompt"), _joined(F.col("c_pieces")).alias("chosen"), _joined(F.col("r_pieces")).alias("rejected"),
        mask(F.col("c_spans")).alias("chosen_mask"), mask(F.col("r_spans")).alias("rejected_mask"), "n_shared", (F.col("n_other") == 0).alias("tie"),
    )


def stale_reply(conversations: DataFrame) -> DataFrame:
    """A rejected side for every conversation: its last assistant turn answers as its first one did.

    Conversations with one assistant turn get an empty answer there; others without any stay.  A null role is no
    assistant's, a null turn comes first, a null text stays null, and a repeated last turn is answered each time.
    """
    conv = Window.partitionBy("conv_id")
    is_reply = F.col("role") == "assistant"
    key = F.when(is_reply, F.struct("turn", "text"))
    rows = conversations.select("conv_id", "turn", "role", "text", F.min(key).over(conv).alias("first"), F.max(key).over(conv).alias("last"))
    last = is_reply & (F.struct("turn", "text") == F.col("last"))
    reply = F.when(F.col("first") == F.col("last"), F.lit("")).otherwise(F.col("first.text"))
    return rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(last, reply).otherwise(F.col("text")).alias("text"))


STALE_REPLY_SQL = """
WITH t AS (
  SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, turn, role, coalesce(text, '') AS text,
    min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS first_turn,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn
  FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT pair_id, any_value(text) AS first_text FROM t WHERE turn = first_turn GROUP BY pair_id),
b AS (
  SELECT t.pair_id, pos, role, text AS c_text,
    CASE WHEN turn = last_turn THEN CASE WHEN first_turn = last_turn THEN '' ELSE first_text END ELSE text END AS r_text
  FROM t LEFT JOIN f ON t.pair_id = f.pair_id),
s AS (SELECT *, min(CASE WHEN c_text <> r_text THEN pos END) OVER (PARTITION BY pair_id) AS split FROM b),
p AS (
  SELECT pair_id, pos, role, c_text, r_text, split IS NULL OR pos < split AS shared,
    '<|' || role || '|>' || chr(10) || c_text || '<|end|>' || chr(10) AS c_piece, '<|' || role || '|>' || chr(10) || r_text || '<|end|>' || chr(10) AS r_piece
  FROM s),
q AS (
  SELECT *, coalesce(sum(CASE WHEN NOT shared THEN length(c_piece) END) OVER w, 0) + length(role) + 5 AS c_at,
    coalesce(sum(CASE WHEN NOT shared THEN length(r_piece) END) OVER w, 0) + length(role) + 5 AS r_at
  FROM p WINDOW w AS (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id, coalesce(string_agg(c_piece, '' ORDER BY pos) FILTER (WHERE shared), '') AS prompt,
  coalesce(string_agg(c_piece, '' ORDER BY pos) FILTER (WHERE NOT shared), '') AS chosen,
  coalesce(string_agg(r_piece, '' ORDER BY pos) FILTER (WHERE NOT shared), '') AS rejected,
  coalesce(string_agg(CAST(c_at AS BIGINT) || ':' || (length(c_text) + 7), ',' ORDER BY pos) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(r_at AS BIGINT) || ':' || (length(r_text) + 7), ',' ORDER BY pos) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (WHERE shared) AS n_shared, bool_and(shared) AS tie
FROM q GROUP BY pair_id
"""
