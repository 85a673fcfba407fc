"""Chat logs: one rendered text per conversation that no longer one contains.

Loggers that write a snapshot after each turn leave every conversation many times,
each a beginning of the next. A conversation's beginnings are known by rolling
hashes, sums of a hash of each turn and its place, so that the hash after a turn is
the one before it plus the turn's. Conversations that are a beginning of another are
removed by anti-join, of equal ones the smallest id stays, and what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_PREFIX = ["n", "hash_a", "hash_b"]


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns by place, with the two rolling hashes after each and whether it is the last.

    A turn logged twice alike counts once; turns of equal number go by role and text.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.where(F.col("conv_id").isNotNull()).distinct()
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)

    def rolling(seed: int) -> Column:
        turn = F.xxhash64(F.lit(seed), "n", "role", "text").cast("decimal(38,0)")
        return F.sum(turn).over(so_far)

    placed = rows.withColumn("n", F.row_number().over(in_order))
    return placed.select(
        "conv_id", "n", "role", "text", rolling(1).alias("hash_a"), rolling(2).alias("hash_b"),
        F.lead("n").over(in_order).isNull().alias("is_last"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``n`` of the conversations that are no beginning of another."""
    whole = turns.where("is_last").groupBy(*_PREFIX).agg(F.min("conv_id").alias("conv_id"))
    begun = turns.where("not is_last").select(*_PREFIX).distinct()
    return whole.join(begun, _PREFIX, "left_anti").select("conv_id", "n")


def _plain(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id``, ``n_turns``, ``rendered`` of each maximal conversation.

    NULL roles are ``unknown``, NULL texts empty; rows without a conversation's id are
    no conversation's and are left out. Other columns are not read. An empty table
    gives an empty result.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    kept = maximal(turns).select("conv_id")
    turn = F.concat(F.lit(START), _plain(F.col("role")), F.lit("\n"), _plain(F.col("text")), F.lit(f"{END}\n"))
    parts = turns.join(kept, "conv_id", "left_semi").select("conv_id", F.struct("n", turn.alias("text")).alias("part"))
    # A conversation is one row of the result, so its turns have to meet.
    return parts.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"])).alias("rendered"),
    )


SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS n,
         '<|im_start|>' || replace(role, '<|', '< |') || chr(10)
           || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS part
  FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(part, '' ORDER BY n) AS rendered
  FROM placed GROUP BY conv_id
), begun AS (
  SELECT DISTINCT a.rendered
  FROM (SELECT p.conv_id, q.n AS last, string_agg(p.part, '' ORDER BY p.n) AS rendered
        FROM placed p JOIN placed q ON p.conv_id = q.conv_id AND p.n <= q.n
        GROUP BY p.conv_id, q.n) a
  JOIN whole w ON a.conv_id = w.conv_id AND a.last < w.n_turns
)
SELECT min(conv_id) AS conv_id, n_turns, rendered
FROM whole WHERE rendered NOT IN (SELECT rendered FROM begun)
GROUP BY n_turns, rendered
"""
