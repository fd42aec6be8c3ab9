"""Synthetic examples from landed model responses.

responses -> content -> fence -> JSON or fallback takes -> takes in order
-> first N, if a target is given -> seeded user prompt -> chat examples (+ quarantine).

The original asks for batches, each about a topic drawn from a list, until it
has as many takes as it wants (:func:`request_loop`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.rand import seeded_index
from corpusflow.operators.prefix import running_before
from corpusflow.operators.synth import format_synthetic, take_quarantine, take_rows, trim_takes


@dataclass
class SyntheticResult:
    examples: DataFrame   # batch, pos, take, user, messages, ord
    quarantine: DataFrame


def build_synthetic(responses: DataFrame, system_prompt: str = K.DEFAULT_SYSTEM_PROMPT,
                    target: int | None = None, seed: int = K.SEED) -> SyntheticResult:
    rows = take_rows(responses).drop("status")
    first = rows if target is None else trim_takes(rows, target)
    ex = format_synthetic(first, system_prompt=system_prompt, seed=seed)
    ex = ex.withColumn("ord", F.col("batch") * F.lit(1 << 20) + F.col("pos"))
    return SyntheticResult(examples=ex, quarantine=take_quarantine(responses))


def numbered_topics(topics: DataFrame, order: str, topic: str = "topic") -> DataFrame:
    """``(idx, topic)``: the topics a request may draw, in a fixed order."""
    distinct = topics.select(F.col(order).cast("long").alias("_at"), F.col(topic).alias("topic"))
    return running_before(distinct, "_at", F.lit(1), "idx").select("idx", "topic")


def request_loop(responses: DataFrame, topics: DataFrame, target: int = K.SYNTHETIC_TARGET, seed: int = K.SEED) -> DataFrame:
    """E3's loop as one job: per landed response ``batch, topic, n_takes,
    n_before, n_used, asked``.

    Request ``batch`` is about the topic that a seeded draw picks from
    ``topics`` (idx, topic).  ``n_before`` is the running total of takes of the
    responses before it (a failed response has none); requests are ``asked``
    until the total reaches ``target``, and the last one gives only the takes
    that are still wanted (``n_used``).
    """
    n_topics = topics.count()
    takes = take_rows(responses).groupBy("batch").agg(F.count(F.lit(1)).alias("n_takes"))
    per = responses.select("batch").join(takes, "batch", "left").withColumn("n_takes", F.coalesce("n_takes", F.lit(0)))
    total = running_before(per, "batch", "n_takes", "n_before")
    drawn = total.withColumn("idx", seeded_index(seed, "topic", F.col("batch"), n_topics).cast("long"))
    left = F.greatest(F.lit(0).cast("long"), F.lit(target) - F.col("n_before"))
    return drawn.join(topics, "idx", "left").select(
        "batch", "topic", "n_takes", "n_before", F.least("n_takes", left).alias("n_used"), (F.col("n_before") < target).alias("asked"))
