"""Preference formatting: one prompt and two completions of a pair of conversations.

The longest common prefix of turns is the prompt, rendered once; what follows
it on either side is that side's completion, in which assistant turns are
trained and all others masked.  Results are rows of rendered turns, not one
row per conversation, so no conversation has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark.llm.common import table

# fixed values: the rendering of a turn
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
# end of fixed values


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(CLOSE), F.coalesce(text, F.lit("")), F.lit(END))


def preference_rows(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows (pair, part, turn, role, rendered, trained); part is prompt, chosen or rejected.

    Both inputs have pair, turn, role, text.  The prompt is the turns before
    the first turn number at which the sides differ, taken from ``chosen``.
    Null roles and texts count as values and are rendered empty; a null turn
    comes before all others.  Equal rows count once; different rows of one turn
    number are one turn, each rendered on its own.  A pair that one side lacks
    has an empty prompt and the other side's completion; equal sides are all
    prompt.  Rows without a pair are left out: they have no partner.  Other
    columns are ignored; no rows give no rows.

    Turns are compared by counts and sums of 64-bit hashes of their rows, one
    per (pair, turn), so a pair with a third of all turns is spread over tasks.
    """
    cols = ["pair", "turn", "role", "text"]
    sides = chosen.select(*cols).withColumn("_side", F.lit("chosen")).union(
        rejected.select(*cols).withColumn("_side", F.lit("rejected"))).filter("pair IS NOT NULL").distinct()
    # a null differs from an empty string; nulls in turn sort first
    mark = F.xxhash64(F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    part = lambda side: F.when(F.col("_side") == side, mark.cast("decimal(20,0)"))
    turns = sides.groupBy("pair", "turn").agg(
        F.count(part("chosen")).alias("_nc"), F.count(part("rejected")).alias("_nr"),
        F.sum(part("chosen")).alias("_hc"), F.sum(part("rejected")).alias("_hr"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    same = (F.col("_nc") == F.col("_nr")) & F.col("_hc").eqNullSafe(F.col("_hr"))
    first = turns.filter(~same).groupBy(F.col("pair").alias("_pair")).agg(F.min(order).alias("_first"))
    placed = sides.join(first, F.col("pair") == F.col("_pair"), "left")
    in_prompt = F.col("_first").isNull() | (order < F.col("_first"))
    out = placed.filter(~(in_prompt & (F.col("_side") == "rejected"))).select(
        "pair", F.when(in_prompt, "prompt").otherwise(F.col("_side")).alias("part"), "turn", "role",
        rendered(F.col("role"), F.col("text")).alias("rendered"))
    return out.withColumn("trained", (F.col("part") != "prompt") & F.coalesce(F.col("role") == TRAINED, F.lit(False)))


def swapped_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from plain conversations, by borrowed answers.

    Chosen is a conversation as it is; rejected is the same with its last
    assistant turn replaced by that of its neighbour (ids 2k and 2k + 1).
    Without a neighbour that has one, the turn is missing on the rejected side.
    """
    base = conversations.select(F.col("conv_id").alias("pair"), "turn", "role", "text").filter("pair IS NOT NULL")
    last = base.filter(F.col("role") == TRAINED).groupBy("pair").agg(
        F.max(F.struct("turn", "text")).alias("last")).select(
        F.col("pair").alias("_pair"), F.col("last.turn").alias("_turn"), F.col("last.text").alias("_text"))
    place = last.select("_pair", "_turn")
    kept = base.join(place, (F.col("pair") == F.col("_pair")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("role") == TRAINED), "left_anti")
    other = last.select(F.col("_pair").bitwiseXOR(F.lit(1).cast("long")).alias("_to"), F.col("_text").alias("text"))
    borrowed = place.join(other, F.col("_pair") == F.col("_to")).select(
        F.col("_pair").alias("pair"), F.col("_turn").alias("turn"), F.lit(TRAINED).alias("role"), "text")
    return base, kept.unionByName(borrowed)


def op10_preference_formatting(spark, sf_dir: str) -> DataFrame:
    chosen, rejected = swapped_pairs(table(spark, sf_dir, "conversations"))
    return preference_rows(chosen, rejected).withColumnRenamed("pair", "conv_id")


OP10_SQL = """
WITH b AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, turn, text FROM b WHERE role = 'assistant'
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1),
r AS (SELECT b.conv_id, b.turn, b.role, b.text FROM b LEFT JOIN l ON b.conv_id = l.conv_id AND b.turn = l.turn AND b.role = 'assistant'
      WHERE l.conv_id IS NULL
      UNION SELECT l.conv_id, l.turn, 'assistant', o.text FROM l JOIN l o ON o.conv_id = xor(l.conv_id, 1)),
d AS (SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, min(coalesce(x.turn, y.turn)) AS f
      FROM b x FULL JOIN r y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.role IS NOT DISTINCT FROM y.role AND x.text IS NOT DISTINCT FROM y.text
      WHERE x.conv_id IS NULL OR y.conv_id IS NULL GROUP BY 1),
s AS (SELECT b.*, CASE WHEN f IS NULL OR turn < f THEN 'prompt' ELSE 'chosen' END AS part FROM b LEFT JOIN d USING (conv_id)
      UNION ALL SELECT r.*, 'rejected' FROM r JOIN d USING (conv_id) WHERE turn >= f)
SELECT conv_id, part, turn, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND coalesce(role = 'assistant', false) AS trained FROM s
"""
