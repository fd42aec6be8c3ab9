"""E2 as a run that goes on where the last one ended.

Listing pages and comment pages land in two folders in any order, over any
number of runs.  A run is two streams over what is new:

1. **The walks.**  Per query, a state machine takes the pages in their order:
   it holds back pages that landed before their turn, stops before an empty
   page, after a page without a cursor and at the maximum, and emits each page
   that the walk uses once.  Only when a walk has ended is its label recorded
   as completed; a walk that waits for a page, or whose next page landed broken,
   stays open, and a later run goes on from there.
2. **The items.**  Used pages become posts, whose identifiers are remembered,
   and are joined as a stream with the comment pages: a post finds its comments
   whichever of the two lands first, as long as they land within ``lag`` of each
   other; beyond it the watermarks let the join forget.  Posts and comments
   share one set of identifiers.

Both streams append a batch once (:mod:`corpusflow.streaming.appends`), so a
run that dies anywhere can be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow import constants as K
from corpusflow import schemas as S
from corpusflow.operators.ingest import engagement_gate, seen_anti
from corpusflow.sources.payloads import explode_comments, explode_listing
from corpusflow.streaming.appends import append_once, read_appended
from corpusflow.streaming.ingest import item_stream, run_available, state_settings

PAGES = "scope string, query string, q long, page_no long, payload string, landed_at timestamp"
COMMENT_PAGES = "post_id string, payload string, landed_at timestamp"
USED = "scope string, query string, q long, page_no long, payload string, used_at timestamp"
COMPLETED = "label string, reason string, run long"
ITEMS = ("id string, type string, title string, selftext string, score long, num_comments long, created_utc double, "
         "post_title string, body string, q long, page_no long, pos int, sub int")

EMPTY, LAST, MAXIMUM = "empty", "last_page", "max_pages"
_EVENTS = ("kind string, scope string, query string, q long, page_no long, payload string, used_at timestamp, reason string")
_STATE = "next long, ended boolean, waiting string, latest timestamp"


def page_shape(payload: str | None) -> tuple[int, bool] | None:
    """(children, has a cursor) of a landed page; None if it is broken."""
    try:
        data = json.loads(payload or "")["data"]
        return len(data.get("children") or []), data.get("after") is not None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def walker(max_pages: int) -> Callable:
    """The state machine of one query for ``applyInPandasWithState``.

    State: the page whose turn it is, whether the walk has ended, the pages that
    wait for their turn (fewer than ``max_pages``), the latest landing time.
    """
    def walk(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, ended, waiting, latest = state.get if state.exists else (0, False, "{}", None)
        held = {int(k): v for k, v in json.loads(waiting).items()}
        for pdf in frames:
            for q, no, payload, at in zip(pdf["q"], pdf["page_no"], pdf["payload"], pdf["landed_at"]):
                latest = at if latest is None or pd.isna(latest) else max(latest, at)
                if not ended and turn <= no < max_pages and page_shape(payload) is not None:
                    # a page that landed again counts once, by its largest payload
                    held[int(no)] = max([int(q), payload], held.get(int(no), [int(q), payload]), key=lambda x: x[1])
        out = []

        def event(kind: str, q: int, no: int, payload: str | None, reason: str | None) -> None:
            out.append((kind, key[0], key[1], q, no, payload, latest, reason))

        while not ended and turn in held:
            q, payload = held.pop(turn)
            children, cursor = page_shape(payload)
            reason = EMPTY if not children else LAST if not cursor else MAXIMUM if turn + 1 >= max_pages else None
            if children:
                event("page", q, turn, payload, None)
            if reason:
                ended, held = True, {}
                event("end", q, turn, None, reason)
            turn += 1
        state.update((turn, ended, json.dumps(held), latest))
        if out:
            yield pd.DataFrame(out, columns=["kind", "scope", "query", "q", "page_no", "payload", "used_at", "reason"])

    return walk


def walk_events(pages: DataFrame, max_pages: int = K.MAX_PAGES_GENERAL) -> DataFrame:
    """The used pages and the ends of the walks over a stream of landed pages."""
    return pages.groupBy("scope", "query").applyInPandasWithState(
        walker(max_pages), _EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def new_items(used: DataFrame, comment_pages: DataFrame, seen: DataFrame | None, min_comments: int, lag: str) -> DataFrame:
    """Posts and comments that no earlier batch had, from streams of used pages
    and comment pages."""
    posts = explode_listing(used.withWatermark("used_at", lag), keep=("q", "page_no", "used_at"))
    posts = (posts if seen is None else seen_anti(posts, seen)).dropDuplicates(["id"])
    comments = explode_comments(comment_pages.withWatermark("landed_at", lag), keep=("post_id", "landed_at"))
    if seen is not None:
        comments = seen_anti(comments, seen)
    gated = posts.where(engagement_gate(min_comments)).select(
        F.col("id").alias("p_id"), F.col("title").alias("post_title"), "q", "page_no", "pos", "used_at")
    near = (F.col("landed_at") >= F.col("used_at") - F.expr(f"INTERVAL {lag}")) & (
        F.col("landed_at") <= F.col("used_at") + F.expr(f"INTERVAL {lag}"))
    found = comments.join(gated, (F.col("post_id") == F.col("p_id")) & near)
    columns = ["id", "type", "title", "selftext", "score", "num_comments", "created_utc", "post_title", "body", "q", "page_no", "pos", "sub"]
    none = {c: F.lit(None).cast(t) for c, t in (("title", "string"), ("selftext", "string"), ("num_comments", "long"))}
    rows = posts.withColumns({"post_title": F.lit(None).cast("string"), "body": F.lit(None).cast("string"), "sub": F.lit(0)}).select(*columns)
    rows = rows.unionByName(found.withColumns({**none, "sub": F.col("cpos") + 1}).select(*columns))
    return rows.dropDuplicates(["id"])


@dataclass
class Collection:
    """A collection in a folder: its two streams' checkpoints and its tables."""

    spark: SparkSession
    folder: str
    pages: str
    comment_pages: str
    max_pages: int = K.MAX_PAGES_GENERAL
    min_comments: int = K.MIN_COMMENTS_GENERAL
    lag: str = "30 days"

    def walk(self, number: int, after_append: Callable[[str, int], None] | None = None) -> None:
        """The first of a run's two streams."""
        with state_settings(self.spark):
            pages = item_stream(self.spark, self.pages, fmt="parquet", schema=PAGES)
            run_available(walk_events(pages, self.max_pages), None, f"{self.folder}/walk-state", foreach_batch=self._keep_walk(number, after_append))

    def run(self, number: int, seen: DataFrame | None = None, after_append: Callable[[str, int], None] | None = None) -> None:
        """Take in all that has landed since the last run.

        ``after_append(table, batch)`` is called when a batch has been appended
        and before its checkpoint is written (tests let a run die there).
        """
        self.walk(number, after_append)
        with state_settings(self.spark):
            used = item_stream(self.spark, f"{self.folder}/used/data", fmt="parquet", schema=USED)
            comments = item_stream(self.spark, self.comment_pages, fmt="parquet", schema=COMMENT_PAGES)
            items = new_items(used, comments, seen, self.min_comments, self.lag)
            run_available(items, None, f"{self.folder}/item-state", foreach_batch=self._keep_items(after_append))

    def _keep_walk(self, number: int, after_append) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, epoch: int) -> None:
            batch = batch.persist()  # two tables of one pass over the state
            batch.count()
            append_once(batch.where("kind = 'page'").select("scope", "query", "q", "page_no", "payload", "used_at"), f"{self.folder}/used", epoch)
            label = F.concat_ws(":", "scope", "query").alias("label")
            append_once(batch.where("kind = 'end'").select(label, "reason", F.lit(number).cast("long").alias("run")), f"{self.folder}/completed", epoch)
            batch.unpersist()
            if after_append:
                after_append("used", epoch)

        return write

    def _keep_items(self, after_append) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, epoch: int) -> None:
            if not append_once(batch, f"{self.folder}/items", epoch):
                batch.write.format("noop").mode("overwrite").save()  # a replay has its state to bring up all the same
            if after_append:
                after_append("items", epoch)

        return write

    def items(self) -> DataFrame:
        return read_appended(self.spark, f"{self.folder}/items", ITEMS)

    def completed(self) -> DataFrame:
        """The labels of the walks that have ended, why, and in which run."""
        return read_appended(self.spark, f"{self.folder}/completed", COMPLETED)
