"""Paths off the registered queries: given templates, odd chats, landed twice, large ordinals."""

import pytest
from pyspark.errors import PySparkException

from corpusflow import constants as K
from corpusflow.operators.chatfmt import choose_templates, format_examples
from corpusflow.operators.ingest import page_cutoff
from corpusflow.operators.split import global_position, seeded_order
from corpusflow.plans.collect import collect_items
from corpusflow.plans.corpus import build_corpus, write_corpus
from corpusflow.session import ensure_checkpoint_dir, scratch_path
from corpusflow.sources import tables as TB
from corpusflow.sources.readers import read_items, split_quarantine
from corpusflow.streaming.ingest import completed_sink
from pyspark.sql import functions as F


def test_given_templates_lose_no_example(spark):
    df = spark.createDataFrame([(i, "topic" if i % 2 else None) for i in range(100)], "rk long, topic string")
    tpl = spark.createDataFrame([("direct", 7, "d"), ("topic", 3, "about {topic}"), ("debate", 9, "x {topic}"), ("debate", 11, "y")],
                                "family string, idx int, template string")
    got = choose_templates(df, templates=tpl).collect()
    assert len(got) == 100 and {r.idx for r in got if r.family == "debate"} <= {9, 11}
    assert all(r.user is not None for r in got)
    assert all(r.user == "about topic" for r in got if r.family == "topic")


def test_a_family_without_template_is_an_error(spark):
    df = spark.createDataFrame([(i, "t") for i in range(50)], "rk long, topic string")
    tpl = spark.createDataFrame([("direct", 0, "d")], "family string, idx int, template string")
    with pytest.raises(PySparkException, match="no template"):
        choose_templates(df, templates=tpl).collect()


def test_null_topic_keeps_the_user_turn(spark):
    df = spark.createDataFrame([(i, "text", None) for i in range(20)], "rk long, text string, topic string")
    assert all(r.messages[1].content for r in format_examples(df).collect())


@pytest.mark.parametrize("landed,want", [
    ([0, 1, 1, 2, 3], [0, 1, 2, 3]), ([0, 2, 3], [0]), ([1, 2], []), ([0, 1, 2, 3, 4, 5], [0, 1, 2, 3]),
])
def test_pages_landed_twice_or_missing(spark, landed, want):
    page = '{"data": {"after": "n", "children": [{"kind": "t3", "data": {"id": "a"}}]}}'
    df = spark.createDataFrame([("s", "q", n, page) for n in landed], "scope string, query string, page_no long, payload string")
    got = page_cutoff(df, K.MAX_PAGES_GENERAL).collect()
    assert sorted(r.page_no for r in got) == want and all(r.payload == page for r in got)


def test_query_ordinals_and_positions_of_any_size(spark):
    page = '{"data": {"after": null, "children": [{"kind": "t3", "data": {"id": "%s", "title": "t", "num_comments": 50}}]}}'
    pages = spark.createDataFrame([("s", f"q{q}", q, 0, page % f"p{q}") for q in (2, 40_000, 2**40)],
                                  "scope string, query string, q long, page_no long, payload string")
    comments = spark.createDataFrame([], "post_id string, payload string")
    got = collect_items(pages, comments).orderBy("ord").collect()
    assert [r.id for r in got] == ["p2", "p40000", f"p{2**40}"]


def test_grouped_split_writes_and_takes_short_chats(spark):
    items = spark.createDataFrame(
        [(f"d{i}", "comment", None, None, "title", "a body that is long enough to pass the gate number %d" % i, 50, i) for i in range(30)],
        "id string, type string, title string, selftext string, post_title string, body string, score long, ord long")
    chats = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")]), (2, [("user", "hi")]), (3, [])],
                                  "ord long, messages array<struct<role:string,content:string>>")
    result = build_corpus(items, chats, split="grouped")
    out = scratch_path(spark, "grouped")
    write_corpus(result, out)
    n = sum(spark.read.json(f"{out}/{part}").count() for part in ("train", "val") if result.examples.where(F.col("split") == part).count())
    assert n == result.examples.count()


def test_fractional_scores_are_no_quarantine(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text('{"id": "a", "type": "comment", "body": "x", "score": 30.5}\n')
    good, bad = split_quarantine(read_items(spark, [str(tmp_path / "items.jsonl")]))
    assert [r.score for r in good.collect()] == [30.5] and bad.count() == 0


def test_positions_over_many_buckets(spark):
    df = seeded_order(spark.range(500).withColumnRenamed("id", "k"), F.col("k"))
    got = sorted((r.u, r.skey, r.pos) for r in global_position(df, 500, rows_per_bucket=7).collect())
    assert [p for _, _, p in got] == list(range(500))


def test_a_broken_completion_table_is_not_taken_for_a_missing_one(spark, tmp_path):
    path = tmp_path / "done"
    path.mkdir()
    (path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        completed_sink(str(path))(spark.createDataFrame([("a",)], "label string"), 0)


def test_cluster_sessions_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_every_document_is_a_child_and_a_take(spark):
    docs = TB.table(spark, "/root/testdata/sf0.001", "documents")
    n = docs.count()
    assert TB.listing_pages(docs).select(F.explode(F.from_json("payload", "data struct<children: array<string>>")["data"]["children"])).count() == n
    assert TB.comment_pages(docs).where("post_id LIKE 'd%'").select(
        F.explode(F.from_json("payload", "array<struct<data: struct<children: array<string>>>>")[1]["data"]["children"])).count() == n
