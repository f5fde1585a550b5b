"""Operator 6: chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as
the assistant and the others as named users; the spans that the assistant says are the
ones to learn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Speakers that set the scene: rendered as such for everyone, never as the assistant.
CONTEXT = ("system",)
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    """A text in which no mark begins: a backslash stands inside of what would be one."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", context: tuple[str, ...] = CONTEXT, *, chunk_turns: int) -> DataFrame:
    """conv_id, perspective, chunk, next_chunk, n_turns, n_masked, rendered, mask (array of start and length in characters).

    A turn is rendered as ``<|assistant|>``, ``<|system|>`` or ``<|user:NAME|>``, a line end, its
    text and ``<|end|>``; mask has the text and end mark of each assistant turn. Texts and
    names can't forge a turn: their ``<|`` become ``<\\|``, and ``|>`` in a name ``|\\>``. Turns stand
    by turn, then speaker, then text; equal rows are one turn. A null turn comes first, a
    null text is empty, a null speaker is named ``unknown``, and rows without a conversation
    are left out. Conversations of context turns only, and empty tables, give no rows. A
    chunk holds the turns numbered k * chunk_turns to (k + 1) * chunk_turns - 1, and has the
    perspectives of all the conversation's speakers, so no row grows with a conversation's
    length; the chunks of a perspective, in order, are its rendering, and a mask counts from
    its chunk's start. next_chunk says where a dialogue goes on, null for its last chunk. The caller says how long a chunk is: a dialogue of up to
    chunk_turns turns numbered from 0 is one row.
    """
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn_col) / chunk_turns), F.lit(0)).cast("long").alias("chunk"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    chunks = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    speakers = turns.where(~F.col("t.speaker").isin(*context)).select("conv_id", F.col("t.speaker").alias("perspective")).distinct()
    follows = turns.select("conv_id", "chunk").distinct().withColumn("next_chunk", F.lead("chunk").over(Window.partitionBy("conv_id").orderBy("chunk")))
    rows = chunks.join(follows, ["conv_id", "chunk"]).join(speakers, "conv_id")
    mine = lambda t: t["speaker"] == F.col("perspective")
    name = lambda t: F.when(mine(t), F.lit("<|assistant|>\n")).when(t["speaker"].isin(*context), F.concat(F.lit("<|"), t["speaker"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user:"), F.replace(escaped(t["speaker"]), F.lit("|>"), F.lit("|\\>")), F.lit("|>\n")))
    rows = rows.withColumn("parts", F.transform("turns", lambda t: F.struct(name(t).alias("head"), F.concat(escaped(t["text"]), F.lit(END)).alias("body"), mine(t).alias("mine"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    spans = F.aggregate(
        "parts",
        start,
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["mine"], F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["mask"]).alias("mask"),
        ),
    )["mask"]
    return rows.select(
        "conv_id",
        "perspective",
        "chunk",
        "next_chunk",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["mine"])).cast("long").alias("n_masked"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        spans.alias("mask"),
    )


def render(conversations: DataFrame, chunk_turns: int) -> DataFrame:
    """rotate() with the mask as text: start+length, joined by commas."""
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("+", m["start"].cast("string"), m["length"].cast("string"))), ",")
    return rotate(conversations, chunk_turns=chunk_turns).withColumn("mask", mask)


ORACLE = r"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(floor(turn / 512), 0)::BIGINT AS chunk, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT conv_id, chunk, lead(chunk) OVER (PARTITION BY conv_id ORDER BY chunk) AS next_chunk FROM (SELECT DISTINCT conv_id, chunk FROM t)),
s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
p AS (
  SELECT t.*, s.perspective, speaker = perspective AS mine, replace(text, '<|', '<\|') || '<|end|>' || chr(10) AS body,
    CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>' ELSE '<|user:' || replace(replace(speaker, '<|', '<\|'), '|>', '|\>') || '|>' END || chr(10) AS head
  FROM t JOIN s USING (conv_id)
), q AS (
  SELECT *, row_number() OVER w AS k, sum(length(head) + length(body)) OVER w - length(body) AS body_start
  FROM p WINDOW w AS (PARTITION BY conv_id, perspective, chunk ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, chunk, any_value(next_chunk) AS next_chunk, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE mine)::BIGINT AS n_masked,
  string_agg(head || body, '' ORDER BY k) AS rendered,
  coalesce(string_agg(body_start::BIGINT::VARCHAR || '+' || length(body)::VARCHAR, ',' ORDER BY k) FILTER (WHERE mine), '') AS mask
FROM q JOIN n USING (conv_id, chunk) GROUP BY conv_id, perspective, chunk
"""
