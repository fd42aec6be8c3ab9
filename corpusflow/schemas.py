"""Record and payload schemas (explicit; no inference on large inputs)."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt"

ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("post_title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("source", T.StringType()),
])

ITEM_WITH_CORRUPT = T.StructType(ITEM.fields + [T.StructField(CORRUPT, T.StringType())])

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CHAT = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])
CHAT_WITH_CORRUPT = T.StructType(CHAT.fields + [T.StructField(CORRUPT, T.StringType())])

POST_DATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("created_utc", T.DoubleType()),
])

COMMENT_DATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created_utc", T.DoubleType()),
])


def listing(child_data: T.StructType) -> T.StructType:
    child = T.StructType([T.StructField("kind", T.StringType()), T.StructField("data", child_data)])
    return T.StructType([
        T.StructField("data", T.StructType([
            T.StructField("after", T.StringType()),
            T.StructField("children", T.ArrayType(child)),
        ]))
    ])


# one search/listing page: {"data": {"after": .., "children": [{"kind": "t3", "data": {..}}]}}
LISTING_PAGE = listing(POST_DATA)
# a comment page is a two-element array; element 1 is the comment listing
COMMENT_PAGE = T.ArrayType(listing(COMMENT_DATA))

COMPLETION = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))
    ])))
])
