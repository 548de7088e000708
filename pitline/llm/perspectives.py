"""Multi-party perspective rotation: every participant's view of a dialogue, in DataFrame functions only.

In the view of a participant, that speaker's turns are the assistant's and carry the training mask; the other participants
are users named by their role; system turns stay as they are. A view is kept as its turns in order, with the place each
takes in the rendered text, so that no dialogue has to fit into one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitline.session import read_table

#: Roles that take part in no view of their own and are shown as they are.
SYSTEM = "system"
#: A turn is rendered as the opening with its speaker, a newline, the text and the closing.
OPEN, CLOSE = "<|{}|>", "<|end|>\n"
#: Consecutive turns whose offsets are summed together before the blocks' sums are.
BLOCK = 256


def _heading(who: Column) -> Column:
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), who, F.lit(after + "\n"))


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per participant's view and turn of ``turns(conv_id, turn, role, text)``; other columns are not looked at.

    Columns: conv_id, speaker (whose view it is), seq (place in the dialogue from 0), turn, role (assistant, user or
    system), name (null but for users), content (the rendered turn), start and stop (its characters in the rendered view),
    mask_start and mask_stop (the trained characters: the speaker's text and closing; null in other turns).

    Turns come in order of turn, then role, then text; a null turn is first, a null text is empty, and a null role is a
    participant named "unknown". Repeated rows are turns of their own. A conversation without participants, with system
    turns only, has no view; conversations with a null conv_id are one conversation. An empty table gives no rows.

    Offsets are sums over blocks of consecutive turns first and over the blocks then, so a very long conversation is spread
    over many tasks; its participants are found by a map-side combined distinct.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("who"), F.coalesce("text", F.lit("")).alias("said"))
    speakers = clean.where(F.col("who") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("who").alias("speaker")).distinct()
    seen = clean.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    own = F.col("who") == F.col("speaker")
    role = F.when(own, "assistant").when(F.col("who") == SYSTEM, SYSTEM).otherwise("user")
    shown = F.when(own, F.lit("assistant")).when(F.col("who") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), F.col("who")))
    rendered = seen.select(
        "conv_id", "speaker", "turn", "who", "said", role.alias("role"), F.when(role == "user", F.col("who")).alias("name"),
        F.length(_heading(shown)).cast("long").alias("head"), F.concat(_heading(shown), F.col("said"), F.lit(CLOSE)).alias("content"),
        F.floor(F.col("turn") / block).cast("long").alias("block"),
    )

    size = F.length("content").cast("long")
    sums = rendered.groupBy("conv_id", "speaker", "block").agg(F.sum(size).alias("chars"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("conv_id", "speaker", "block").orderBy("turn", "who", "said")
    placed = rendered.select(
        "*", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(inside).cast("long").alias("at")
    )
    joined = placed.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & F.col("block").eqNullSafe(F.col("b")))
    stop = F.col("chars_before") + F.col("upto")
    start = stop - size
    masked = F.col("role") == "assistant"
    return joined.select(
        "conv_id", "speaker", (F.col("rows_before") + F.col("at") - 1).alias("seq"), "turn", "role", "name", "content",
        start.alias("start"), stop.alias("stop"), F.when(masked, start + F.col("head")).alias("mask_start"), F.when(masked, stop).alias("mask_stop"),
    )


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant's view of all ``conversations``, turn by turn."""
    return rotate(read_table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, who AS speaker FROM clean WHERE who <> 'system'
), shown AS (
  SELECT c.conv_id, speaker, turn, who, said,
    CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user' END AS role,
    '<|' || CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || who END || '|>' || chr(10) AS head
  FROM clean c JOIN speakers s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, head || said || '<|end|>' || chr(10) AS content,
    CAST(sum(length(head || said || '<|end|>' || chr(10))) OVER w AS BIGINT) AS stop, row_number() OVER w - 1 AS seq
  FROM shown WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, said ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, speaker, seq, turn, role, CASE WHEN role = 'user' THEN who END AS name, content, stop - length(content) AS start, stop,
  CASE WHEN role = 'assistant' THEN stop - length(content) + length(head) END AS mask_start, CASE WHEN role = 'assistant' THEN stop END AS mask_stop
FROM placed
"""
