"""Chat formatting: the dialogue once from each participant's side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Turns in a part of a rendering: turns t with the same t // PART_TURNS. Only a dialogue with later turns has more parts than one.
PART_TURNS = 512
UNNAMED = "anonymous"
#: What stands around a text; a user's name and a line feed follow USER.
ASSISTANT, USER, END = "<|im_start|>assistant\n", "<|im_start|>user name=", "<|im_end|>"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each dialogue, participant and part: conv_id, assistant, part, starts_at, n_turns, rendered, mask, n_masked.

    A participant is a distinct role of the dialogue. In that participant's rendering its turns are the assistant's, and all
    others' are users' with their names: <|im_start|>assistant\\nTEXT<|im_end|>\\n and <|im_start|>user name=NAME\\nTEXT<|im_end|>\\n.
    mask lists, as start-end in characters of the whole rendering, what is to be learned: each of the assistant's texts with its
    <|im_end|>; n_masked is their number. Turns stand in the order of turn, then role, then text; nulls come first.

    The rendering is one text: its parts in order, each of which starts at starts_at. A part has the turns with the same turn // part_turns (null or
    negative turns: part 0), so any dialogue of fewer turns is one row, and one that holds a third of all rows is put together part by part and not in one
    task. A null role is the participant "anonymous", a null text is empty, a null conv_id is a dialogue of its own; repeated rows
    are said twice; of an empty table nothing comes. Texts of any length stay whole, and further columns are not looked at, whatever their names. A text or role may hold
    the marks itself: nothing is escaped, and masks tell by place what the assistant says.
    """
    said = turns.select(
        "conv_id",
        F.greatest(F.lit(0), F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0))).cast("long").alias("part"),
        F.struct("turn", F.coalesce("role", F.lit(UNNAMED)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
    )
    parts = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("said")).alias("said"))
    # Where each part starts in each rendering, from lengths alone.
    spoken = said.groupBy("conv_id", "part", F.col("said.role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("said.text") + len(END) + 1).alias("chars"))
    user, own = len(USER) + 1 + F.length("role"), len(ASSISTANT)
    lengths = spoken.groupBy("conv_id", "part").agg(F.sum(F.col("chars") + F.col("n") * user).alias("chars"))
    people = spoken.select("conv_id", F.col("role").alias("assistant")).distinct()
    mine = spoken.select("conv_id", "part", F.col("role").alias("assistant"), (F.col("n") * (own - user)).alias("less"))
    grid = lengths.alias("l").join(people.alias("w"), F.expr("l.conv_id <=> w.conv_id")).select("l.conv_id", "part", "chars", "assistant")
    placed = grid.alias("g").join(mine.alias("m"), F.expr("g.conv_id <=> m.conv_id AND g.part = m.part AND g.assistant = m.assistant"), "left").select("g.conv_id", "g.part", "g.assistant", (F.col("chars") + F.coalesce("less", F.lit(0))).alias("chars"))
    before = Window.partitionBy("conv_id", "assistant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("starts_at", F.coalesce(F.sum("chars").over(before), F.lit(0)).cast("long"))
    both = parts.alias("p").join(placed.alias("w"), F.expr("p.conv_id <=> w.conv_id AND p.part = w.part")).select("p.conv_id", "p.part", "said", "assistant", "starts_at")

    head = lambda x: F.when(x["role"] == F.col("assistant"), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), x["role"], F.lit("\n")))
    pieces = both.withColumn("pieces", F.transform("said", lambda x: F.struct((x["role"] == F.col("assistant")).alias("own"), head(x).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"))))
    spans = F.aggregate(
        "pieces",
        F.struct(F.col("starts_at").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + 1).alias("at"),
            F.when(
                x["own"],
                F.concat(acc["spans"], F.array(F.concat_ws("-", (acc["at"] + F.length(x["head"])).cast("string"), (acc["at"] + F.length(x["head"]) + F.length(x["body"])).cast("string")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return pieces.select(
        "conv_id",
        "assistant",
        "part",
        "starts_at",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        spans.alias("spans"),
    ).select("conv_id", "assistant", "part", "starts_at", "n_turns", "rendered", F.array_join("spans", ",").alias("mask"), F.size("spans").cast("long").alias("n_masked"))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rotate() of all conversations."""
    return rotate(table(spark, sf_dir, "conversations"))


OP4_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, greatest(0, coalesce(CAST(floor(turn / {PART_TURNS}.0) AS BIGINT), 0)) AS part,
         coalesce(role, '{UNNAMED}') AS role, coalesce(text, '') AS text
  FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS assistant FROM said),
pieces AS (
  SELECT s.conv_id, w.assistant, s.part, s.turn, s.role, s.text, s.role = w.assistant AS own,
         CASE WHEN s.role = w.assistant THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || s.role || chr(10) END AS head,
         s.text || '<|im_end|>' AS body
  FROM said s JOIN people w ON s.conv_id IS NOT DISTINCT FROM w.conv_id),
placed AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (
              PARTITION BY conv_id, assistant ORDER BY part, turn NULLS FIRST, role, text
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM pieces)
SELECT conv_id, assistant, part, min(begins) AS starts_at, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg(CAST(begins + length(head) AS VARCHAR) || '-' || CAST(begins + length(head) + length(body) AS VARCHAR), ',' ORDER BY begins)
                FILTER (WHERE own), '') AS mask,
       count(*) FILTER (WHERE own) AS n_masked
FROM placed GROUP BY conv_id, assistant, part
"""
