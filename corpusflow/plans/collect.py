"""Collection from landed pages.

landed listing pages -> page walk cut-off (F8) -> posts (S5, F1) ->
not seen before (J1) -> first occurrence per id (D4) -> engagement gate (F2)
-> comment pages of those posts (S6, F1, W1) with the post title (J2) ->
posts and comments in walk order, first occurrence per id, not seen before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.operators.dedup import id_first_wins
from corpusflow.operators.ingest import comment_title_join, page_cutoff, seen_anti
from corpusflow.sources.payloads import explode_comments, explode_listing

def walk_order(query_ord, page_no, pos, sub) -> F.Column:
    """Walk order: query, page, child position; a post's comments follow it."""
    return F.struct(
        query_ord.cast("long").alias("q"), page_no.cast("long").alias("page_no"),
        pos.cast("long").alias("pos"), sub.cast("long").alias("sub"))


def collect_posts(pages: DataFrame, seen: DataFrame | None = None, max_pages: int = K.MAX_PAGES_GENERAL,
                  query_ord: str = "q", query_cols=("scope", "query")) -> DataFrame:
    """Posts a page walk would have written, in walk order (``ord``)."""
    walked = page_cutoff(pages, max_pages=max_pages, query_cols=query_cols)
    posts = explode_listing(walked, keep=(query_ord, "page_no", *query_cols))
    posts = posts.withColumn("ord", walk_order(F.col(query_ord), F.col("page_no"), F.col("pos"), F.lit(0)))
    if seen is not None:
        posts = seen_anti(posts, seen)
    return id_first_wins(posts.drop(query_ord, "page_no", "pos", *query_cols))


def collect_items(pages: DataFrame, comment_pages: DataFrame, seen: DataFrame | None = None,
                  max_pages: int = K.MAX_PAGES_GENERAL, min_comments: int = K.MIN_COMMENTS_GENERAL,
                  source: str | None = None, query_ord: str = "q", query_cols=("scope", "query")) -> DataFrame:
    """New posts and their comments, ordered by ``ord``, ids unique."""
    posts = collect_posts(pages, seen, max_pages, query_ord, query_cols)
    comments = explode_comments(comment_pages, keep=("post_id",))
    comments = comment_title_join(comments, posts, min_comments)
    comments = comments.withColumn("ord", F.col("post_ord").withField("sub", F.col("cpos").cast("long") + 1)).drop("post_ord", "cpos", "post_id")
    both = posts.unionByName(comments, allowMissingColumns=True)
    if seen is not None:
        both = seen_anti(both, seen)
    out = id_first_wins(both)
    if source is not None:
        out = out.withColumn("source", F.lit(source))
    return out
