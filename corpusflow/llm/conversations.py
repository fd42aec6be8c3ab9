"""Conversations without their own earlier snapshots (operator 6).

Chat logs often hold the same conversation several times, once after each
turn.  Every conversation gets a rolling digest after each of its turns; one
whose last digest is a digest inside a longer conversation is a snapshot of
it.  An anti-join keeps the maximal conversations, of equal ones the smallest
identifier, and these are rendered for a chat model.  Digests are SHA-256 of
the digest before and the turn's role and text, lengths included, so equal
digests mean equal turns.

Defined results: turns are ordered by turn number, then role and text; null
role or text counts as empty; a null turn sorts first; rows that repeat
identifier, turn, role and text count once; rows with a null identifier form
one conversation; an empty table gives an empty table; other columns never
matter.  A conversation is one row of the result, so it must fit a task; a
prefix or conversation that many share is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.store import stored

#: Delimiters of the rendered text.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _digest(before: Column, role: Column, text: Column) -> Column:
    sized = F.concat(before, F.octet_length(role).cast("string"), F.lit(":"), role, F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.sha2(sized, 256)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (ordered), digests (after each turn)."""
    rows = turns.select(
        "conv_id", F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    # an array that grows by one digest per turn; the seed entry is cut off
    rolled = F.aggregate(
        "turns", F.array(F.lit("")),
        lambda acc, t: F.concat(acc, F.array(_digest(F.element_at(acc, -1), t["role"], t["text"]))))
    return whole.select("conv_id", "turns", F.slice(rolled, 2, F.size("turns")).alias("digests"))


def rendered(turns: Column) -> Column:
    one = F.transform(turns, lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit("\n"), t["text"], F.lit(TURN_END), F.lit("\n")))
    return F.array_join(one, "")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included) and the
    rendered text of the conversations that no longer one begins with."""
    convs = stored(conversations(turns).withColumn("whole", F.element_at("digests", -1)), "conversations")
    inner = convs.select(F.explode(F.slice("digests", 1, F.size("digests") - 1)).alias("whole")).where("whole is not null").distinct()
    first = convs.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    stay = first.join(inner, "whole", "left_anti")
    return convs.select("conv_id", "turns", "whole").alias("c").join(
        stay.alias("s"), (F.col("c.whole") == F.col("s.whole")) & F.col("c.conv_id").eqNullSafe(F.col("s.conv_id"))).select(
        "c.conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", rendered(F.col("turns")).alias("text"))
