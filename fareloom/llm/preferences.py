"""Preference formatting: the common turns of a chosen and a rejected conversation once, then both completions.

Turns stay rows all the way, so a conversation of any length is spread over tasks. A turn that both sides have at the
same number is shared; the prompt is all shared turns before the first number at which the sides differ. Every later
turn belongs to the completion of its side, where turns of the trained role carry a mask: the characters of the
rendered turn that a loss counts (text and end mark, not the header).

Rows that repeat a turn exactly are one turn; different turns of one number are all kept, in the order of role and
text. A null turn number comes last, null role and text count as empty. A conversation without its partner has no
prompt. Rows without a conversation belong to none and give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"
LAST = (1 << 63) - 1


def format_preferences(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Rendered turns of `turns` (pair_id, rejected boolean, turn, role, text).

    Returns pair_id, part (prompt, chosen, rejected), turn, role, rendered, mask_start, mask_end; an empty mask is
    0 to 0.
    """
    side = turns.where("pair_id is not null and rejected is not null").select(
        "pair_id",
        "rejected",
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("place"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = side.groupBy("pair_id", "place", "role", "text").agg(
        F.max(~F.col("rejected")).alias("in_chosen"), F.max("rejected").alias("in_rejected")
    )
    shared: Column = F.col("in_chosen") & F.col("in_rejected")
    split = whole.where(~shared).groupBy("pair_id").agg(F.min("place").alias("split"))
    placed = whole.join(split, "pair_id", "left")
    common = shared & (F.col("split").isNull() | (F.col("place") < F.col("split")))
    parts = F.when(common, F.array(F.lit("prompt"))).otherwise(
        F.filter(
            F.array(F.when(F.col("in_chosen"), "chosen"), F.when(F.col("in_rejected"), "rejected")), lambda p: p.isNotNull()
        )
    )
    header = F.concat(F.lit(HEAD), "role", F.lit(MIDDLE))
    rows = placed.select(
        "pair_id", "place", "role", header.alias("header"), F.concat(header, "text", F.lit(TAIL)).alias("rendered"), F.explode(parts).alias("part")
    )
    counted = (F.col("part") != "prompt") & (F.col("role") == trained)
    return rows.select(
        "pair_id",
        "part",
        F.when(F.col("place") != LAST, F.col("place")).alias("turn"),
        "role",
        "rendered",
        F.when(counted, F.length("header")).otherwise(0).cast("long").alias("mask_start"),
        F.when(counted, F.length("rendered")).otherwise(0).cast("long").alias("mask_end"),
    )


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k is the chosen one of pair k, conversation 2k + 1 the rejected one."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pair, odd = F.floor(F.col("conv_id") / F.lit(2)).cast("long"), F.pmod(F.col("conv_id"), F.lit(2)) == 1
    return format_preferences(turns.select(pair.alias("pair_id"), odd.alias("rejected"), "turn", "role", "text"))


OP8_SQL = """
WITH whole AS (
  SELECT conv_id // 2 AS pair_id, coalesce(turn, 9223372036854775807) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text,
    bool_or(conv_id % 2 = 0) AS in_chosen, bool_or(conv_id % 2 = 1) AS in_rejected
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
split AS (SELECT pair_id, min(place) AS split FROM whole WHERE NOT (in_chosen AND in_rejected) GROUP BY pair_id),
placed AS (
  SELECT w.*, in_chosen AND in_rejected AND (split IS NULL OR place < split) AS common FROM whole w LEFT JOIN split USING (pair_id)),
parts AS (
  SELECT 'prompt' AS part, * FROM placed WHERE common
  UNION ALL SELECT 'chosen', * FROM placed WHERE NOT common AND in_chosen
  UNION ALL SELECT 'rejected', * FROM placed WHERE NOT common AND in_rejected),
shown AS (
  SELECT *, '<|im_start|>' || role || chr(10) AS header, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
    part <> 'prompt' AND role = 'assistant' AS counted FROM parts)
SELECT pair_id, part, nullif(place, 9223372036854775807) AS turn, role, rendered,
  CASE WHEN counted THEN length(header) ELSE 0 END AS mask_start, CASE WHEN counted THEN length(rendered) ELSE 0 END AS mask_end
FROM shown
"""
