"""Text cleaning and n-gram expressions (Column -> Column).

All of these are built-in Spark expressions and run in the JVM; the regular
expressions are generated code, the higher-order functions are interpreted.  Regular expressions are spelled with explicit code-point classes
(see ``constants.WS_CLASS``) so the result equals a Python ``re`` based
cleaner, not Java's narrower ``\\s``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import constants as K

WS = f"[{K.WS_CLASS}]"
NON_WS = f"[^{K.WS_CLASS}]"

URL_RE = f"https?://{NON_WS}+"
MENTION_RE = f"/?[ur]/[{K.WORD_CLASS}]+"
TOMBSTONE_RE = "|".join(re.escape(t) for t in K.TOMBSTONES)
# (?u) makes the case folding Unicode-aware (dotted / dotless i), like Python.
EDIT_RE = "(?isu)edit:.*"
STRIP_RE = f"^{WS}+|{WS}+\\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_urls(x) -> Column:
    """Remove ``http(s)://`` up to the next whitespace."""
    return F.regexp_replace(_c(x), URL_RE, "")


def strip_mentions(x) -> Column:
    """Remove ``/u/name``, ``r/name`` and the like (unanchored)."""
    return F.regexp_replace(_c(x), MENTION_RE, "")


def strip_tombstones(x) -> Column:
    """Remove the literal markers ``[removed]`` and ``[deleted]``."""
    return F.regexp_replace(_c(x), TOMBSTONE_RE, "")


def cut_edit(x) -> Column:
    """C4: drop the first ``edit:`` (any case) and everything after it."""
    return F.regexp_replace(_c(x), EDIT_RE, "")


def collapse_ws(x) -> Column:
    """Whitespace runs become one space, then both ends are stripped.

    After the collapse only plain spaces can remain at the ends, so ``trim``
    is exact here.
    """
    return F.trim(F.regexp_replace(_c(x), f"{WS}+", " "))


def clean_text(x) -> Column:
    """C1..C5 in order."""
    return collapse_ws(cut_edit(strip_tombstones(strip_mentions(strip_urls(_c(x))))))


def ustrip(x) -> Column:
    """Strip Unicode whitespace from both ends (Python ``str.strip``)."""
    return F.regexp_replace(_c(x), STRIP_RE, "")


def lower_contains_any(x, markers) -> Column:
    """Lower-cased text contains any of the markers."""
    low = F.lower(_c(x))
    cond = F.lit(False)
    for m in markers:
        cond = cond | low.contains(m)
    return cond


def char_ngrams(x, n: int = K.NGRAM) -> Column:
    """The list ``s[i:i+n]`` for every start ``i`` over the lower-cased text.

    Empty when the text has fewer than ``n`` code points.
    """
    low = F.lower(_c(x))
    return F.when(
        F.length(low) >= n,
        F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, n)),
    ).otherwise(F.array().cast("array<string>"))


def fill_template(template, placeholder: str, value) -> Column:
    """Put a value into a placeholder (every occurrence)."""
    return F.replace(_c(template), F.lit(placeholder), _c(value))
