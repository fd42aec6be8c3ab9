"""Synthetic examples from landed model responses (E3 pieces: F7, L1, U2).

One job over all landed responses: content extraction, fence handling, JSON
or fallback parsing, explode in order, trim to the target count, format.
Responses that would have raised in the original (fence without newline,
a bare scalar) go to a quarantine frame instead of stopping the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.chat import to_messages
from corpusflow.functions.rand import seeded_index
from corpusflow.functions.takes import NO_NEWLINE, NOT_ITERABLE, parsed_responses, status_of, takes_of


def take_rows(responses: DataFrame, response: str = "response", order_cols=("batch",),
              min_chars: int = K.MIN_TAKE_CHARS) -> DataFrame:
    """S7 + C10..C12 + F7: one row per take, ``pos`` = position in its response."""
    rows = parsed_responses(responses, response, order_cols)
    part = (F.col("text"), F.col("bad_fence"), F.col("v"))
    return rows.select(*order_cols, status_of(*part).alias("status"), F.posexplode(takes_of(*part, min_chars)).alias("pos", "take"))


def take_quarantine(responses: DataFrame, response: str = "response") -> DataFrame:
    """Responses the original would have failed on."""
    rows = parsed_responses(responses, response, responses.columns)
    status = status_of(F.col("text"), F.col("bad_fence"), F.col("v"))
    return rows.select(*responses.columns, "content", F.explode(F.array(status)).alias("status")).where(
        F.col("status").isin(NO_NEWLINE, NOT_ITERABLE) | F.col("content").isNull()
    ).drop("content")


def trim_takes(rows: DataFrame, target: int = K.SYNTHETIC_TARGET, order_cols=("batch", "pos")) -> DataFrame:
    """L1: the first ``target`` takes in collection order (a top-k, not a sort
    of everything: Spark plans ``orderBy().limit()`` as TakeOrderedAndProject)."""
    return rows.orderBy(*order_cols).limit(target)


def format_synthetic(takes_df: DataFrame, system_prompt: str = K.DEFAULT_SYSTEM_PROMPT,
                     prompts=K.SYNTHETIC_USER_PROMPTS, key_cols=("batch", "pos"), seed: int = K.SEED) -> DataFrame:
    """R3 + P5: a seeded user prompt per take."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in key_cols])
    idx = seeded_index(seed, "prompt", key, len(prompts))
    user = F.element_at(F.array(*[F.lit(p) for p in prompts]), idx + 1)
    return takes_df.withColumn("user", user).withColumn(
        "messages", to_messages(F.lit(system_prompt), F.col("user"), F.col("take"))
    )
