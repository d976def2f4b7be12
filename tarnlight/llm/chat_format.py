"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions only.

A log often holds a conversation again and again, each time with more turns. Every turn gets a 128-bit digest of its
role and text; a conversation's prefixes get rolling hashes of their turns' digests and positions. A conversation whose
whole hash is some longer conversation's prefix hash is a snapshot and goes (an anti-join); of equal ones the smallest
conv_id stays. Only hashes are shuffled for that; the texts of the conversations that stay are then rendered.

Equality is equality of the number of turns and 128 hash bits. Each conversation is rendered into one row, so a
conversation is the unit of work: its turns meet in one task, after all others that it does not need are gone.

Defined results: null role or text counts as empty; null turn comes first; turns of one number are ordered by their
digest; repeated rows are turns of their own; null conv_id is a conversation, and is kept before others equal to it;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: The template of a turn.
BEFORE, BETWEEN, AFTER = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumns({"d1": F.xxhash64("role", "text"), "d2": F.xxhash64(F.lit(11), "text", F.length("role"), "role")})


def prefixes(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, k, p1, p2, last: the hash of the first k turns, for every k."""
    rows = _turns(conversations, conv_id, turn, role, text).drop("role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "d1", "d2")
    rows = rows.withColumn("k", F.row_number().over(order))
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p1 = F.bit_xor(F.xxhash64("k", "d1", "d2")).over(sofar)
    p2 = F.bit_xor(F.xxhash64(F.lit(13), "d2", "k", "d1")).over(sofar)
    return rows.select("conv_id", "k", p1.alias("p1"), p2.alias("p2"), F.lead("k").over(order).isNull().alias("last"))


def maximal(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies of each conversation that is no snapshot of another."""
    found = saved(prefixes(conversations, conv_id, turn, role, text), "turn-prefixes")
    whole = found.filter("last").groupBy("k", "p1", "p2").agg(F.min(F.struct("conv_id")).alias("least"), F.count(F.lit(1)).alias("n_copies"))
    longer = found.filter("not last").select("k", "p1", "p2").distinct()
    return whole.join(longer, ["k", "p1", "p2"], "left_anti").select(F.col("least.conv_id").alias("conv_id"), F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each maximal conversation: conv_id, n_turns, n_copies, text (all turns rendered)."""
    kept = maximal(conversations, conv_id, turn, role, text).withColumnRenamed("conv_id", "_of")
    turns = _turns(conversations, conv_id, turn, role, text)
    turns = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_of")))
    rendered = F.concat(F.lit(BEFORE), "role", F.lit(BETWEEN), "text", F.lit(AFTER))
    one = F.struct("turn", "d1", "d2", rendered.alias("rendered"))
    whole = turns.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(one)).alias("all"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("all", lambda t: t["rendered"]), "").alias("text"))


SQL = """
WITH c AS (
  SELECT conv_id, count(*) AS n, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS whole
  FROM conversations GROUP BY conv_id),
d AS (SELECT min(conv_id) AS conv_id, n, turns, whole, count(*) AS n_copies FROM c GROUP BY n, turns, whole)
SELECT d.conv_id, d.n AS n_turns, d.n_copies, d.whole AS text
FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS e WHERE e.turns[1] = d.turns[1] AND e.n > d.n AND e.turns[1:d.n] = d.turns)
"""
