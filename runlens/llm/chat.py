"""Chat formatting: every participant's turn at being the assistant.

A dialogue is rendered once per participant: that speaker's turns as the
assistant's, all others as named users', system turns as they are. Loss masks
cover what the assistant says and its end mark. Long dialogues are rendered in
parts of PART_TURNS turn numbers, so that one whose turns are numbered is never
gathered in one place; the parts in order make up the whole. Turns without a
number, or with the same one, are of one part, however many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import stored

#: Turn numbers in one part.
PART_TURNS = 64
SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"


def _head(role: Column, perspective: Column) -> Column:
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == perspective, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user "), role, F.lit("|>\n")))


def perspectives(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_own, chars_before, text, masks): masks are [start, end) in characters of the part's text.

    Turns are ordered by number, role and text; rows that repeat all of these
    are one turn. A null role is a participant named unknown, a null text is
    empty, a null turn comes first, a null conv_id is a dialogue of its own.
    Marks in a text lose their meaning: "<|" becomes "< |". A dialogue of
    system turns only has no participant and gives no row, like an empty
    table. Further columns are not read.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    rows = conversations.select("conv_id", turn.alias("t")).distinct()
    part = F.coalesce(F.floor(F.col("t.turn") / PART_TURNS), F.lit(-1)).cast("long")
    parts = rows.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    speakers = rows.select(F.col("conv_id").alias("_conv"), F.col("t.role").alias("perspective")).where(F.col("perspective") != SYSTEM).distinct()
    both = parts.join(speakers, parts.conv_id.eqNullSafe(speakers._conv)).drop("_conv")

    own = lambda t: (t["role"] == F.col("perspective")) & (t["role"] != SYSTEM)
    pieces = F.transform("turns", lambda t: F.struct(_head(t["role"], F.col("perspective")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), own(t).alias("own")))
    both = both.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + F.length(p["head"])
        last = first + F.length(p["body"])
        mask = F.struct(first.alias("start"), last.alias("end"))
        return F.struct(last.alias("at"), F.when(p["own"], F.concat(acc["masks"], F.array(mask))).otherwise(acc["masks"]).alias("masks"))

    both = both.withColumn("laid", F.aggregate("pieces", start, step))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    laid = stored(both.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), F.size("laid.masks").cast("long").alias("n_own"), F.col("laid.at").cast("long").alias("n_chars"), text.alias("text"), F.col("laid.masks").alias("masks")), "laid")
    # Only numbers go through the window over the parts of a dialogue.
    before = F.sum("n_chars").over(Window.partitionBy("conv_id", "perspective").orderBy("part")) - F.col("n_chars")
    ahead = laid.select("conv_id", "perspective", "part", before.alias("chars_before")).withColumnsRenamed({"conv_id": "_conv", "perspective": "_who", "part": "_part"})
    out = laid.join(ahead, laid.conv_id.eqNullSafe(ahead._conv) & (laid.perspective == ahead._who) & (laid.part == ahead._part))
    return out.select("conv_id", "perspective", "part", "n_turns", "n_own", "chars_before", "text", "masks")


SQL = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
r AS (SELECT t.conv_id, perspective, coalesce(floor(turn / {PART_TURNS}), -1)::bigint AS part, turn, role, text, role = perspective AS own,
      CASE WHEN role = '{SYSTEM}' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user ' || role || '|>' END || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM t JOIN p USING (conv_id)),
s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM r),
g AS (SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own, max(stop) AS n, string_agg(head || body, '' ORDER BY turn, role, text) AS text,
      coalesce(string_agg((stop - length(body))::bigint || '-' || stop::bigint, ',' ORDER BY turn, role, text) FILTER (own), '') AS masks FROM s GROUP BY conv_id, perspective, part)
SELECT conv_id, perspective, part, n_turns, n_own, (sum(n) OVER (PARTITION BY conv_id, perspective ORDER BY part) - n)::bigint AS chars_before, text, masks FROM g
"""
