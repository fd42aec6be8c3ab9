"""Reference-shaped inputs derived from the driver's tables.

The original reads forum items, listing payloads, comment payloads and
model responses.  The test tables hold prose (``documents``), a second text
source (``benchmark``), labels and conversations instead, so these views
derive the reference's record types from them.  Every view reads whole
tables and whole texts; nothing is sampled or cut.  Row attributes that the
prose lacks (type, score, comment counts, forum artefacts) are derived from
``doc_id`` so that every gate and cleaning rule meets real cases.

Each view has an SQL twin in :mod:`corpusflow.sql_oracle`; keep them equal.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import constants as K

SECOND_SOURCE_BASE = 1 << 40  # ord offset of the second item file


def path(sf_dir: str, name: str) -> str:
    """Where a table lies: a file, or a folder of part files."""
    return os.path.join(sf_dir, f"{name}.parquet")


def stream_path(sf_dir: str, name: str) -> str:
    """The same as a pattern that only the table matches: a file stream takes a
    plain path for a folder, and a pattern for either."""
    whole = path(sf_dir, name)
    return f"{whole[:-1]}[{whole[-1]}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(path(sf_dir, name))


def artefact(doc_id: Column) -> Column:
    """Forum artefacts appended to a text (fixture wording, by doc_id)."""
    m7 = doc_id % 7
    art = (
        F.when(m7 == 0, F.lit(" see https://ex.org/a/b) "))
        .when(m7 == 1, F.lit(" by u/some_user and r/sub_1 "))
        .when(m7 == 2, F.lit(" [deleted] "))
        .when(m7 == 3, F.lit(" Edit: later note"))
        .when(m7 == 4, F.lit(" credit: desk"))
        .when(m7 == 5, F.lit(" your/their\u00a0"))
        .otherwise(F.lit(""))
    )
    return F.concat(art, F.when(doc_id % 11 == 0, F.lit(" Beep boop")).otherwise(F.lit("")))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def rest_after_first_line(text: Column) -> Column:
    return F.substr(text, F.length(first_line(text)) + 2, F.greatest(F.length(text), F.lit(1)))


def items_from_documents(docs: DataFrame) -> DataFrame:
    """Forum items, one per document, in ``doc_id`` order.

    Posts: title = first line, selftext = the rest (+ artefact).
    Comments (``doc_id % 3 = 0``): body = whole text (+ artefact), parent
    title = first line (empty for ``doc_id % 5 = 0``).
    """
    d = F.col("doc_id")
    title = first_line(F.col("text"))
    return docs.select(
        F.concat(F.lit("d"), d.cast("string")).alias("id"),
        F.when(d % 3 == 0, F.lit("comment")).otherwise(F.lit("post")).alias("type"),
        title.alias("title"),
        F.concat(rest_after_first_line(F.col("text")), artefact(d)).alias("selftext"),
        F.when(d % 5 == 0, F.lit("")).otherwise(title).alias("post_title"),
        F.concat(F.col("text"), artefact(d)).alias("body"),
        ((d * 37) % 60).alias("score"),
        ((d * 7) % 20).alias("num_comments"),
        (d * 60).cast("double").alias("created_utc"),
        F.lit(None).cast("string").alias("source"),
        d.alias("ord"),
    )


def items_from_benchmark(bench: DataFrame) -> DataFrame:
    """The second item source: targeted posts (``source='kd_scrape'``) whose
    selftext is a benchmark passage; they come after every document item."""
    i = F.col("item_id")
    return bench.select(
        F.concat(F.lit("b"), i.cast("string")).alias("id"),
        F.lit("post").alias("type"),
        F.lit("").alias("title"),
        F.col("text").alias("selftext"),
        F.lit(None).cast("string").alias("post_title"),
        F.lit(None).cast("string").alias("body"),
        F.lit(100).cast("long").alias("score"),
        F.lit(0).cast("long").alias("num_comments"),
        (i * 60).cast("double").alias("created_utc"),
        F.lit(K.TARGETED_SOURCE).alias("source"),
        (F.lit(SECOND_SOURCE_BASE) + i).alias("ord"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both item sources, document items first."""
    a = items_from_documents(table(spark, sf_dir, "documents"))
    b = items_from_benchmark(table(spark, sf_dir, "benchmark"))
    return a.unionByName(b)


# ---------------------------------------------------------------------------
# JSON payload fixtures; strings are escaped by hand (backslash, quote,
# newline) so the bytes are the same in every engine.
# ---------------------------------------------------------------------------

def json_str(x: Column) -> Column:
    esc = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def _ordered_join(key: Column, piece: Column, sep: str) -> Column:
    """``string_agg(piece, sep ORDER BY key)`` as an aggregate expression."""
    arr = F.array_sort(F.collect_list(F.struct(key.alias("k"), piece.alias("v"))))
    return F.array_join(F.transform(arr, lambda s: s["v"]), sep)


PAGE_SIZE = 10        # children per listing page
PAGES_PER_QUERY = 6   # pages landed per query (more than the maximum kept)


def listing_pages(docs: DataFrame) -> DataFrame:
    """Landed search pages: ``scope, query, page_no, payload``.

    Query ``q = doc_id div 60`` holds six pages of ten children, and every
    document is a child with its whole text.  Children of ``doc_id % 13 = 0``
    are not posts (``kind='more'``); the key ``selftext`` is missing where
    there is no second line.  An extra empty page stands before the second one
    of ``q % 7 = 3``, whose later pages follow it; page 2 of ``q % 5 = 0`` has
    no cursor, and the last page never has one.
    """
    d = F.col("doc_id")
    title = first_line(F.col("text"))
    selftext = F.nullif(rest_after_first_line(F.col("text")), F.lit(""))
    data = F.concat(
        F.lit('{"id": '), json_str(F.concat(F.lit("d"), d.cast("string"))),
        F.lit(', "title": '), json_str(title),
        F.when(selftext.isNull(), F.lit("")).otherwise(F.concat(F.lit(', "selftext": '), json_str(selftext))),
        F.lit(', "score": '), ((d * 37) % 60).cast("string"),
        F.lit(', "num_comments": '), ((d * 7) % 20).cast("string"),
        F.lit(', "created_utc": '), (d * 60).cast("string"),
        F.lit("}"),
    )
    kind = F.when(d % 13 == 0, F.lit("more")).otherwise(F.lit(K.POST_KIND))
    child = F.concat(F.lit('{"kind": "'), kind, F.lit('", "data": '), data, F.lit("}"))
    pages = docs.groupBy(
        (d / (PAGE_SIZE * PAGES_PER_QUERY)).cast("long").alias("q"),
        ((d % (PAGE_SIZE * PAGES_PER_QUERY)) / PAGE_SIZE).cast("long").alias("page_no"),
    ).agg(_ordered_join(d, child, ", ").alias("children"))
    q = F.col("q")
    moved = q % 7 == 3
    pages = pages.withColumn("page_no", F.col("page_no") + F.when(moved & (F.col("page_no") >= 1), 1).otherwise(0))
    extra = pages.where(moved & (F.col("page_no") == 0)).select(
        "q", F.lit(1).cast("long").alias("page_no"), F.lit("").alias("children"))
    pages = pages.unionByName(extra)
    p = F.col("page_no")
    last = PAGES_PER_QUERY - 1 + F.when(moved, 1).otherwise(0)
    no_cursor = ((q % 5 == 0) & (p == 2)) | (p == last)
    after = F.when(no_cursor, F.lit("null")).otherwise(F.concat(F.lit('"t3_q'), q.cast("string"), F.lit("p"), (p + 1).cast("string"), F.lit('"')))
    payload = F.concat(F.lit('{"data": {"after": '), after, F.lit(', "children": ['), F.col("children"), F.lit("]}}"))
    return pages.select(
        F.lit("nba").alias("scope"),
        F.concat(F.lit("query "), q.cast("string")).alias("query"),
        q.alias("q"), p.alias("page_no"), payload.alias("payload"),
    )


COMMENT_BLOCK = 12


def comment_pages(docs: DataFrame) -> DataFrame:
    """Landed comment pages: ``post_id, payload``.

    Block ``b = doc_id div 12`` is the comment page of post ``'d' || 12 b``;
    its children are the block's documents as comments (``kind='more'`` for
    ``doc_id % 13 = 0``).  Beside those, one-element payloads (no comment
    listing) landed for posts ``'x' || b`` with ``b % 6 = 5``.
    """
    d = F.col("doc_id")
    data = F.concat(
        F.lit('{"id": '), json_str(F.concat(F.lit("c"), d.cast("string"))),
        F.lit(', "body": '), json_str(F.col("text")),
        F.lit(', "score": '), ((d * 41) % 60).cast("string"),
        F.lit(', "created_utc": '), (d * 60).cast("string"),
        F.lit("}"),
    )
    kind = F.when(d % 13 == 0, F.lit("more")).otherwise(F.lit(K.COMMENT_KIND))
    child = F.concat(F.lit('{"kind": "'), kind, F.lit('", "data": '), data, F.lit("}"))
    blocks = docs.groupBy((d / COMMENT_BLOCK).cast("long").alias("b")).agg(
        _ordered_join(d, child, ", ").alias("children")
    )
    b = F.col("b")
    head = F.lit('{"data": {"after": null, "children": []}}')
    second = F.concat(F.lit('{"data": {"after": null, "children": ['), F.col("children"), F.lit("]}}"))
    payload = F.concat(F.lit("["), head, F.lit(", "), second, F.lit("]"))
    whole = blocks.select(F.concat(F.lit("d"), (b * COMMENT_BLOCK).cast("string")).alias("post_id"), payload.alias("payload"))
    short = blocks.where(b % 6 == 5).select(
        F.concat(F.lit("x"), b.cast("string")).alias("post_id"), F.concat(F.lit("["), head, F.lit("]")).alias("payload"))
    return whole.unionByName(short)


TAKE_BATCH = 10


def completions(docs: DataFrame) -> DataFrame:
    """Landed model responses: ``batch, topic, response``.

    Batch ``doc_id div 10`` holds its documents' texts as takes, in one of
    six shapes by ``batch % 6``: 0 an array with a number, an object and a
    null in front; 1 the array in a ``json`` code fence; 2 a fence without a
    newline; 3 the array inside prose (not JSON, so the fallback applies);
    4 an object whose keys are the texts; 5 the plain array.  Beside those, a
    bare number landed as batch ``-1 - batch`` where ``batch % 6 = 5``.
    """
    d = F.col("doc_id")
    g = docs.groupBy((d / TAKE_BATCH).cast("long").alias("batch")).agg(
        _ordered_join(d, json_str(F.col("text")), ", ").alias("items"),
        _ordered_join(d, F.concat(json_str(F.concat(F.col("text"), F.lit(" #"), d.cast("string"))), F.lit(": 1")), ", ").alias("keys"),
        F.min(d).alias("first_doc"),
        F.count(F.lit(1)).alias("n"),
    )
    bare = g.where(F.col("batch") % 6 == 5).withColumn("batch", -1 - F.col("batch"))
    g = g.unionByName(bare)
    arr = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    m = F.when(F.col("batch") >= 0, F.col("batch") % 6)
    content = (
        F.when(m == 0, F.concat(F.lit('[1, {"x": 2}, null, '), F.col("items"), F.lit("]")))
        .when(m == 1, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
        .when(m == 2, F.concat(F.lit("```"), arr))
        .when(m == 3, F.concat(F.lit("Here are the takes: "), arr, F.lit(" Enjoy!")))
        .when(m == 4, F.concat(F.lit("{"), F.col("keys"), F.lit("}")))
        .when(F.col("batch") < 0, F.col("n").cast("string"))
        .otherwise(arr)
    )
    response = F.concat(F.lit('{"choices": [{"message": {"role": "assistant", "content": '), json_str(content), F.lit("}}]}"))
    return g.select(
        "batch",
        F.concat(F.lit("topic "), F.pmod(F.col("batch"), F.lit(30)).cast("string")).alias("topic"),
        response.alias("response"),
    )


def conversation_examples(conv: DataFrame, system_prompt: str = K.DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """Preformatted chat examples: one per conversation, turns in order.

    Conversations without a system turn get ``system_prompt`` in front.
    """
    msgs = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"),
        F.max(F.when(F.col("role") == "system", 1).otherwise(0)).alias("has_system"),
    )
    as_msgs = F.transform(F.col("t"), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content")))
    sys_msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
    messages = F.when(F.col("has_system") == 1, as_msgs).otherwise(F.concat(sys_msg, as_msgs))
    return msgs.select(F.col("conv_id"), messages.alias("messages"))


def seen_ids(labels: DataFrame) -> DataFrame:
    """Ids collected in an earlier run: every labelled document."""
    return labels.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))


def worklist(docs: DataFrame) -> DataFrame:
    """Work list: one search per (source, lang) and the two sort listings."""
    searches = docs.select(F.concat(F.col("source"), F.lit(":"), F.col("lang")).alias("label")).distinct()
    listings = docs.sparkSession.createDataFrame([(x,) for x in K.SORT_LABELS], "label string")
    return searches.unionByName(listings)


def completed_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels finished in an earlier run: searches whose documents include a
    toxic-labelled one, and the first sort listing."""
    tox = labels.where(F.col("toxic") == 1).select("doc_id")
    searches = docs.join(tox, "doc_id", "left_semi").select(
        F.concat(F.col("source"), F.lit(":"), F.col("lang")).alias("label")
    ).distinct()
    return searches.unionByName(docs.sparkSession.createDataFrame([(K.SORT_LABELS[0],)], "label string"))
