"""Item projections and quality gates (P1..P4, F3..F9).

Items are forum posts and comments in one wide row type
(``id, type, title, selftext, post_title, body, score, ...``).  Anything
whose ``type`` is not ``post`` is treated as a comment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.text import clean_text, lower_contains_any, ustrip


def _is_post() -> Column:
    return F.col("type") == "post"


def _s(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def filter_text(selftext_default: str = "") -> Column:
    """The text the gates measure: title + space + selftext, or body; cleaned."""
    post = F.concat(_s("title"), F.lit(" "), F.coalesce(F.col("selftext"), F.lit(selftext_default)))
    return clean_text(F.when(_is_post(), post).otherwise(_s("body")))


def main_text(min_selftext: int = K.MIN_SELFTEXT_CHARS) -> Column:
    """The text that becomes the answer.

    Posts: the stripped selftext; shorter than ``min_selftext`` code points
    means the title alone, else title, blank line, selftext.  Comments: body.
    Then cleaned.
    """
    st = ustrip(_s("selftext"))
    post = F.when(F.length(st) < min_selftext, _s("title")).otherwise(
        F.concat(_s("title"), F.lit("\n\n"), st)
    )
    return clean_text(F.when(_is_post(), post).otherwise(_s("body")))


def topic() -> Column:
    """Stripped title (posts) or parent title (comments); not cleaned."""
    return ustrip(F.when(_is_post(), _s("title")).otherwise(_s("post_title")))


def tag_source(df: DataFrame, source: str) -> DataFrame:
    """Constant provenance column."""
    return df.withColumn("source", F.lit(source))


def score_gate(min_post: int = K.MIN_POST_SCORE, min_comment: int = K.MIN_COMMENT_SCORE) -> Column:
    """posts need ``min_post``, everything else ``min_comment``; a missing
    score fails both.  Written on the raw columns so it reaches the scan."""
    return ((F.col("type") == "post") & (F.col("score") >= min_post)) | (
        ((F.col("type") != "post") | F.col("type").isNull()) & (F.col("score") >= min_comment)
    )


def length_gate(text: Column, lo: int = K.MIN_CHARS, hi: int = K.MAX_CHARS) -> Column:
    """inclusive bounds on code points."""
    return F.length(text).between(lo, hi)


def bot_gate(text: Column, markers=tuple(K.BOT_MARKERS)) -> Column:
    """true when the text is *not* bot-like."""
    return ~lower_contains_any(text, markers)


def text_gates(text: Column) -> Column:
    """F4 and F6 on one text."""
    return length_gate(text) & bot_gate(text)


def passes_filter(df: DataFrame, text_col: str = "filter_text") -> DataFrame:
    """score gate first (plain column predicate, pushed to the scan), then
    length and bot gates on the cleaned filter text.  Adds ``filter_text``.

    The cleaned text is bound once: exploding a one-element array that is
    filtered by the gates yields the row (with its text) or nothing.  A plain
    ``where`` on a derived column would be pushed below the projection and
    the optimizer would paste the cleaning chain into every comparison.
    """
    kept = F.filter(F.array(filter_text()), text_gates)
    return df.where(score_gate()).select("*", F.explode(kept).alias(text_col))


def main_text_from_filter(filter_col: str = "filter_text", min_selftext: int = K.MIN_SELFTEXT_CHARS) -> Column:
    """P1 computed from P2 without cleaning again.

    For comments both are ``clean(body)``.  For a post whose stripped
    selftext has at least ``min_selftext`` code points, P1 is
    ``clean(title + blank line + stripped selftext)`` and P2 is
    ``clean(title + space + selftext)``: the inputs differ only in whitespace
    next to the separator, and no cleaning pattern but the final collapse
    can match across whitespace, so the results are equal.  Short-selftext
    posts use the cleaned title.
    """
    st = ustrip(_s("selftext"))
    short_post = _is_post() & (F.length(st) < min_selftext)
    return F.when(short_post, clean_text(_s("title"))).otherwise(F.col(filter_col))


def with_texts(df: DataFrame) -> DataFrame:
    """P1 + P3 columns ``text`` and ``topic`` (P1 from ``filter_text`` when
    the frame has it)."""
    text = main_text_from_filter() if "filter_text" in df.columns else main_text()
    return df.withColumn("text", text).withColumn("topic", topic())
