"""Chat-format expressions: message arrays and rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusflow import constants as K

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x)


def _lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), _lit_or_col(content).cast("string").alias("content"))


def to_messages(system, user, assistant) -> Column:
    """P5: ``[system, user, assistant]`` messages."""
    return F.array(message("system", system), message("user", user), message("assistant", assistant))


def to_prompt_messages(system, user) -> Column:
    """``[system, user]`` messages for a prompt table."""
    return F.array(message("system", system), message("user", user))


def render_chat(messages, prefix: str = K.CHAT_PREFIX, suffix: str = K.CHAT_SUFFIX,
                generation_prompt: str | None = None) -> Column:
    """One training string from a message array.

    ``prefix`` may hold ``{role}``; every message becomes
    ``prefix(role) + content + suffix``; the pieces are joined without a
    separator.  A null role or content counts as empty.  ``generation_prompt``
    (e.g. the assistant prefix) is appended when given.
    """
    pre_parts = prefix.split("{role}")

    def piece(m):
        head = F.lit(pre_parts[0])
        for part in pre_parts[1:]:
            head = F.concat(head, F.coalesce(m["role"], F.lit("")), F.lit(part))
        return F.concat(head, F.coalesce(m["content"], F.lit("")), F.lit(suffix))

    out = F.array_join(F.transform(_c(messages), piece), "")
    if generation_prompt:
        out = F.concat(out, F.lit(generation_prompt))
    return out


#: Rows a renderer is given at a time.
RENDER_BATCH = 1000

Messages = list[dict[str, str | None]]


def render_with(df: DataFrame, renderer: Callable[[list[Messages]], list[str]], messages: str = "messages",
                batch_rows: int = RENDER_BATCH) -> DataFrame:
    """The rows of ``df`` with ``text``, rendered by a caller's function.

    ``renderer`` takes a list of conversations (each a list of ``role`` and
    ``content``) and returns one string for each, like a tokenizer's own chat
    template.  A batch that it fails on, or for which it returns anything but as
    many strings, is rendered row by row; a row that fails then has a null
    ``text`` and the reason in ``render_error`` (null for all others).  A null
    ``messages`` is such a row.  ``render_quarantine`` splits the two.
    """
    def checked(some: list[Messages]) -> list[str]:
        out = list(renderer(some))
        if len(out) != len(some) or not all(isinstance(x, str) for x in out):
            raise TypeError(f"the renderer returned no {len(some)} strings")
        return out

    def one(conversation: Messages | None) -> tuple[str | None, str | None]:
        if conversation is None:
            return None, "no messages"
        try:
            return checked([conversation])[0], None
        except Exception as e:  # the caller's code: whatever it raises is the row's error
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[tuple[str | None, str | None]] = []
            for lo in range(0, len(frame), batch_rows):
                some = [None if m is None else [x if isinstance(x, dict) else x.asDict() for x in m]
                        for m in frame[messages].iloc[lo: lo + batch_rows]]
                try:
                    if any(m is None for m in some):
                        raise TypeError("no messages")
                    found += [(x, None) for x in checked(some)]
                except Exception:
                    found += [one(m) for m in some]
            frame["text"] = [t for t, _ in found]
            frame["render_error"] = [e for _, e in found]
            yield frame

    clash = {"text", "render_error"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("text", StringType()), StructField("render_error", StringType())]))


def render_quarantine(rendered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rendered rows, rows that the renderer failed on) of :func:`render_with`."""
    return rendered.where("render_error IS NULL").drop("render_error"), rendered.where("render_error IS NOT NULL").drop("text")


def flatten_messages(messages, sep: str = "␞") -> Column:
    """``role:content`` pairs joined by a separator: a flat, hashable form."""
    return F.array_join(
        F.transform(_c(messages), lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("")))),
        sep,
    )
