"""Collection-side operators.

The original collects page by page with an in-memory id set; here the same
rules are set operations over landed pages, so a whole landing folder is
processed in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow import schemas as S


def engagement_gate(min_comments: int = K.MIN_COMMENTS_GENERAL) -> Column:
    """comments are wanted only for posts with enough of them."""
    return F.coalesce(F.col("num_comments"), F.lit(0)) >= min_comments


def page_cutoff(pages: DataFrame, max_pages: int = K.MAX_PAGES_GENERAL, query_cols=("scope", "query"),
                page_col: str = "page_no", payload: str = "payload") -> DataFrame:
    """F8: the pages a paginated walk would have used.

    Per query, pages ``0 .. max_pages-1`` in order; the walk stops before an
    empty page or a gap, and after a page without a cursor.  A page that
    landed more than once counts once: the copy with the largest payload text
    in order stays.  The walk is settled per page number below the
    maximum, of which a query has few.
    """
    key = [*query_cols, page_col]
    p = pages.where(F.col(page_col) < max_pages)
    # one parse of the payload, bound in a one-element array
    shape = F.transform(F.array(F.from_json(payload, S.LISTING_PAGE)["data"]), lambda d: F.struct(
        F.coalesce(F.size(d["children"]), F.lit(0)).alias("n"), d["after"].alias("after")))[0]
    rest = [c for c in pages.columns if c not in key]
    one = p.select(*key, F.struct(payload, *[c for c in rest if c != payload], shape.alias("_s")).alias("_r"))
    one = one.groupBy(*key).agg(F.max("_r").alias("_r"))
    ends = one.groupBy(*query_cols).agg(
        F.min(F.when(F.col("_r._s.n") == 0, F.col(page_col))).alias("_stop"),              # the walk ends before it
        F.min(F.when(F.col("_r._s.after").isNull(), F.col(page_col) + 1)).alias("_last"),  # the walk ends after it
        F.array_sort(F.collect_set(page_col)).alias("_nos"),  # fewer than max_pages numbers
    )
    # without a gap the sorted numbers are 0, 1, 2, ...
    gap = F.size(F.filter("_nos", lambda x: F.array_position("_nos", x) == x + 1)).cast("long")
    top = F.lit(max_pages).cast("long")
    reach = ends.select(*query_cols, F.least(F.coalesce("_stop", top), F.coalesce("_last", top), gap).alias("_reach"))
    kept = one.join(reach, list(query_cols)).where(F.col(page_col) < F.col("_reach"))
    return kept.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*pages.columns)


def seen_anti(df: DataFrame, seen: DataFrame, id_col: str = "id") -> DataFrame:
    """Drop ids collected before (posts and comments share one id set)."""
    return df.join(seen.select(F.col(id_col)).distinct(), id_col, "left_anti")


def comment_title_join(comments: DataFrame, posts: DataFrame, min_comments: int = K.MIN_COMMENTS_GENERAL,
                       post_key: str = "post_id") -> DataFrame:
    """J2 + F2: comments of posts that pass the engagement gate carry the
    post's title as ``post_title``."""
    gated = posts.where(engagement_gate(min_comments)).select(
        F.col("id").alias(post_key), F.col("title").alias("post_title"), F.col("ord").alias("post_ord")
    )
    return comments.join(gated, post_key)


def worklist_anti(work: DataFrame, completed: DataFrame, label: str = "label") -> DataFrame:
    """Queries not finished in an earlier run."""
    return work.join(completed.select(label).distinct(), label, "left_anti")


def distinct_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """A2: number of distinct ids collected (exact)."""
    return df.agg(F.count_distinct(id_col).alias("n_ids"))
