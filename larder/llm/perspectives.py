"""Dialogues of several parties, once from the view of each.

For every participant the dialogue is rendered with that speaker as the assistant and all
others as named users, in the order of turns; system turns stay system turns. The mask lists
the code points that the assistant is trained on: what it says and the end mark behind it.

Long dialogues are rendered in parts of PART_TURNS turn numbers, so a dialogue of any length
is spread; each participant has every part, also those in which it is silent. A null role
is the participant UNKNOWN, a null text is empty, null turns come first, repeated rows are
said as often as they occur, null conv_ids form one dialogue. A dialogue of system turns
alone has no participant and no row. Marks inside texts are broken up by a zero-width space,
white space in names becomes `_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 500
UNKNOWN = "unknown"
# The marks of the format.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _head(speaker: Column, view: Column) -> Column:
    user = F.concat(F.lit("user name="), F.regexp_replace(speaker, r"\s+", "_"))
    return F.concat(
        F.lit(BEGIN),
        F.when(speaker == "system", "system").when(speaker == view, "assistant").otherwise(user),
        F.lit("\n"),
    )


def _masks(said: Column) -> Column:
    """The spans of the assistant's turns, from (head, body, own) of each turn."""
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        spans = F.when(s["own"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(said, seed, step, lambda state: F.array_join(state["spans"], ","))


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, part, speaker, n_turns, n_own, text, mask: a row per participant and part."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|", "<\u200b|").alias("said"),
        F.floor(F.coalesce("turn", F.lit(0)) / PART_TURNS).alias("part"),
    )
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "said"))).alias("turns"))
    views = rows.filter("speaker != 'system'").select(F.col("conv_id").alias("of"), F.col("speaker").alias("view")).distinct()
    seen = parts.join(views, F.col("conv_id").eqNullSafe(F.col("of")))
    told = F.transform(
        "turns",
        lambda t: F.struct(
            _head(t["speaker"], F.col("view")).alias("head"), F.concat(t["said"], F.lit(END)).alias("body"),
            (t["speaker"] == F.col("view")).alias("own"),
        ),
    )
    seen = seen.select("conv_id", "part", F.col("view").alias("speaker"), told.alias("told"))
    return seen.select(
        "conv_id", "part", "speaker", F.size("told").cast("long").alias("n_turns"),
        F.size(F.filter("told", lambda s: s["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("told", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"),
        _masks(F.col("told")).alias("mask"),
    )


ORACLE_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
    replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') || '<|im_end|>' AS body,
    CAST(floor(coalesce(turn, 0) / 500) AS BIGINT) AS part
  FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS view FROM rows WHERE speaker <> 'system'),
told AS (
  SELECT r.conv_id, r.part, v.view, r.turn, r.speaker, r.body, r.speaker = v.view AS own,
    '<|im_start|>' || CASE WHEN r.speaker = 'system' THEN 'system' WHEN r.speaker = v.view THEN 'assistant'
      ELSE 'user name=' || regexp_replace(r.speaker, '\\s+', '_', 'g') END || chr(10) AS head
  FROM rows r JOIN views v ON r.conv_id IS NOT DISTINCT FROM v.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, part, view ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id, part, view ORDER BY turn NULLS FIRST, speaker, body) AS place
  FROM told)
SELECT conv_id, part, view AS speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(CAST(CAST(upto - 1 - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY place)
    FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, part, view
"""
