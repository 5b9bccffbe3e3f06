"""Preference formatting of conversations, in DataFrame functions only.

A pair has a chosen and a rejected conversation.  The longest common prefix of their turns is rendered once as the
prompt; what follows is rendered for each side, with the intervals that training should count: the assistant's own
words and the end mark after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def head(turn: Column) -> Column:
    """The mark of a turn's role, in which nothing else looks like a mark."""
    role = F.replace(F.replace(turn["role"], F.lit(OPEN), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE))


def body(turn: Column) -> Column:
    """A turn's text, in which nothing looks like a mark of the format, and the end mark."""
    return F.concat(F.replace(turn["text"], F.lit(OPEN), F.lit("< |")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t))), "")


def counted(turns: Column) -> Column:
    """array<struct<start, stop>>: the intervals of the rendered turns that are the assistant's."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(head(t))
        stop = start + F.length(body(t))
        mine = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
        return F.struct(stop.alias("at"), F.concat(state["spans"], mine).alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_pairs(turns: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """(pair, prompt, prompt_turns, chosen, rejected, chosen_spans, rejected_spans) from (pair, side, turn, role, text).

    side is ``chosen`` or ``rejected``.  Turns stand in the order of (turn, role, text), nulls first; a null role is
    rendered as ``unknown``, a null text as empty.  Equal sides, or a side that is the other's prefix, leave an empty
    completion; a missing side is an empty conversation.  Rows with a null pair belong to no conversation and give no
    result; repeated turns are turns like others; an empty table gives an empty result; other columns are ignored.
    """
    rows = turns.where(F.col(pair_col).isNotNull()).select(
        F.col(pair_col).alias("_pair"),
        F.col("side").alias("_side"),
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("_turn"),
    )
    side = lambda name: F.coalesce(F.array_sort(F.collect_list(F.when(F.col("_side") == name, F.col("_turn")))), F.array())
    pairs = rows.groupBy("_pair").agg(side("chosen").alias("_c"), side("rejected").alias("_r"))
    c, r = F.col("_c"), F.col("_r")
    shorter = F.least(F.size(c), F.size(r))
    same = lambda i: (F.get(c, i)["role"] == F.get(r, i)["role"]) & (F.get(c, i)["text"] == F.get(r, i)["text"])
    apart = F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))), lambda i: (i < shorter) & ~same(i)))
    pairs = pairs.withColumn("_n", F.coalesce(apart, shorter))
    after = lambda x: F.slice(x, F.col("_n") + 1, F.greatest(F.size(x) - F.col("_n"), F.lit(0)))
    return pairs.select(
        F.col("_pair").alias(pair_col),
        render(F.slice(c, F.lit(1), F.col("_n"))).alias("prompt"),
        F.col("_n").alias("prompt_turns"),
        render(after(c)).alias("chosen"),
        render(after(r)).alias("rejected"),
        counted(after(c)).alias("chosen_spans"),
        counted(after(r)).alias("rejected_spans"),
    )


def with_stale_replies(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(pair_id, side, turn, role, text): each conversation is chosen over itself with an outdated last reply.

    On the rejected side the assistant's last turn repeats its turn before (or says nothing where there is none).  All
    other turns, those after it and those without a number too, stand on both sides.  A conversation without a numbered
    reply is both sides of its pair.  Of turns with the same number, the greatest text is the one repeated.
    """
    by = Window.partitionBy(id_col)
    mine = F.col("role") == "assistant"
    rows = conversations.where(F.col(id_col).isNotNull()).withColumn("_last", F.max(F.when(mine, F.col("turn"))).over(by))
    rows = rows.withColumn("_before", F.max_by(F.when(mine, F.col("text")), F.when(mine & (F.col("turn") < F.col("_last")), F.struct("turn", "text"))).over(by))
    stale = mine & (F.col("turn") == F.col("_last"))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.when(stale, F.coalesce("_before", F.lit(""))).otherwise(F.col("text")).alias("text"))))
    return rows.select(F.col(id_col).alias("pair_id"), "turn", "role", sides.alias("_s")).select("pair_id", "_s.side", "turn", "role", "_s.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_chat_preferences; spans as text, like 3-17;20-31."""
    pairs = format_pairs(with_stale_replies(table(spark, sf_dir, "conversations")))
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ";")
    return pairs.withColumnsRenamed({"pair_id": "conv_id"}).withColumns({"chosen_spans": as_text(F.col("chosen_spans")), "rejected_spans": as_text(F.col("rejected_spans"))})
