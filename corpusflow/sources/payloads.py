"""Flattening landed API payloads (S5, S6, S7 with F1 and W1).

Fetching is outside the engine: pages land as JSON text in a table, and
these functions turn them into item rows.  Everything happens inside the
row (``from_json`` + ``filter`` + ``slice`` + ``posexplode``), so no
shuffle is needed to flatten, whatever the number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def listing_children(payload) -> Column:
    return F.from_json(_c(payload), S.LISTING_PAGE)["data"]["children"]


def listing_after(payload) -> Column:
    return F.from_json(_c(payload), S.LISTING_PAGE)["data"]["after"]


def explode_listing(pages: DataFrame, payload: str = "payload", keep=()) -> DataFrame:
    """S5 + F1: one post row per ``t3`` child of each listing page.

    Missing keys get the defaults ``'' / 0``; ``pos`` is the child's position
    on the page (all kinds counted, as served).  ``keep`` names page columns
    to carry along.
    """
    kids = pages.select(*keep, F.posexplode(listing_children(payload)).alias("pos", "child"))
    d = F.col("child.data")
    return kids.where(F.col("child.kind") == K.POST_KIND).select(
        *keep,
        "pos",
        d["id"].alias("id"),
        F.lit("post").alias("type"),
        F.coalesce(d["title"], F.lit("")).alias("title"),
        F.coalesce(d["selftext"], F.lit("")).alias("selftext"),
        F.coalesce(d["score"], F.lit(0)).alias("score"),
        F.coalesce(d["num_comments"], F.lit(0)).alias("num_comments"),
        F.coalesce(d["created_utc"], F.lit(0.0)).alias("created_utc"),
    )


def explode_comments(pages: DataFrame, payload: str = "payload", keep=("post_id",),
                     limit: int = K.COMMENTS_PER_POST) -> DataFrame:
    """S6 + F1 + W1: the first ``limit`` ``t1`` children of element 1 of a
    two-element comment payload.  Shorter payloads give no rows.

    The top-N cut happens inside the row (``filter`` then ``slice``), so it
    needs no window and no shuffle.
    """
    listing = F.get(F.from_json(_c(payload), S.COMMENT_PAGE), 1)
    t1 = F.filter(listing["data"]["children"], lambda c: c["kind"] == K.COMMENT_KIND)
    top = F.slice(t1, 1, limit)
    rows = pages.select(*keep, F.posexplode(top).alias("cpos", "child"))
    d = F.col("child.data")
    return rows.select(
        *keep,
        "cpos",
        d["id"].alias("id"),
        F.lit("comment").alias("type"),
        F.coalesce(d["body"], F.lit("")).alias("body"),
        F.coalesce(d["score"], F.lit(0)).alias("score"),
        F.coalesce(d["created_utc"], F.lit(0.0)).alias("created_utc"),
    )
