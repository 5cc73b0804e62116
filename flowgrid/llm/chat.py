"""Chat formatting by perspective rotation: each participant of a dialogue gets it with themselves as the assistant.

The others become users under their names, turns of context roles stay what they are, and the loss mask covers
what the chosen participant says. All of it is column expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.shared import pick

#: Roles that set the scene and don't take part.
CONTEXT = ("system",)
#: Turn numbers that one row may span: a longer dialogue is rendered in parts, so no row grows without bound.
PART = 1024
#: Where turns without a number are dealt to, as parts below zero.
LOOSE = 16
OPEN, CLOSE = "<|", "|>"


def _segment(speaker: Column, turn: Column, context: tuple[str, ...]) -> Column:
    """One turn as seen by ``speaker``; marks in the text are broken up so that they can't pose as turns."""
    body = F.replace(turn.text, F.lit(OPEN), F.lit("< |"))
    head = F.when(turn.role == speaker, "assistant").when(turn.role.isin(*context), turn.role).otherwise(F.concat(F.lit("user:"), turn.role))
    return F.concat(F.lit(OPEN), head, F.lit(f"{CLOSE}\n"), body, F.lit(f"\n{OPEN}end{CLOSE}\n"))


def rotate(conversations: DataFrame, context: tuple[str, ...] = CONTEXT, part_turns: int = PART) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, spans: each dialogue once for every role in it that isn't context.

    ``spans`` are the [begin, end) places in text, in code points, of what the speaker says with its end mark: the loss
    mask. Turns follow their numbers, then role and text. Part k holds turn numbers from k * ``part_turns`` on;
    every part is rendered for all participants of the whole dialogue. A null role is "unknown", a null text empty, a
    null conv_id a dialogue of its own; turns without a number have no order and go to parts below zero. Repeated
    rows are repeated turns. A dialogue of context only has no participant and no row. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = pick(conversations, "conv_id", "turn", "role", "text").select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)
    loose = -1 - F.pmod(F.xxhash64("role", "text"), F.lit(LOOSE))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / F.lit(part_turns)), loose))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    people = rows.filter(~F.col("role").isin(*context)).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    seen = seen.withColumn("segments", F.transform("turns", lambda t: F.struct(_segment(F.col("speaker"), t, context).alias("s"), (t.role == F.col("speaker")).alias("own"), F.length(F.concat(F.lit(f"{OPEN}assistant{CLOSE}\n"))).alias("head"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        end = s.at + F.length(x.s)
        return F.struct(end.alias("at"), F.when(x.own, F.concat(s.spans, F.array(F.struct((s.at + x["head"]).alias("begin"), (end - 1).alias("end"))))).otherwise(s.spans).alias("spans"))

    spans = F.aggregate("segments", start, step, lambda s: s.spans)
    return seen.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("segments.s"), "").alias("text"), spans.alias("spans"))
