"""Readers, payload flattening, collection rules and take parsing (S1..S7, F1, F2, F7, F8, J1, J2, W1, C10..C12)."""

import json

from pyspark.sql import functions as F

from corpusflow.functions.takes import take_status, takes
from corpusflow.operators.ingest import page_cutoff
from corpusflow.plans.collect import collect_items
from corpusflow.sources.payloads import explode_comments, explode_listing
from corpusflow.sources.readers import read_items, split_quarantine


def test_read_items_order_missing_file_and_quarantine(spark, tmp_path):
    a = tmp_path / "a.jsonl"
    lines = [json.dumps({"id": f"p{i}", "type": "post", "title": "t", "score": i}) for i in range(300)]
    lines.insert(5, "{not json")
    lines.insert(9, "   ")
    lines.append(json.dumps({"id": "x", "title": "no type"}))
    lines.append(json.dumps({"id": "y", "type": "post", "score": 3.5}))
    a.write_text("\n".join(lines) + "\n")
    b = tmp_path / "b.jsonl"
    b.write_text(json.dumps({"id": "q", "type": "comment", "body": "b", "score": 30}) + "\n")
    # small splits, so line numbers must be stitched across several of them
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = read_items(spark, [str(a), str(tmp_path / "missing.jsonl"), str(b)])
        got = df.select("id", "ord", "file_ord", "_corrupt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_line = sorted(got, key=lambda r: r.ord)
    first = [r.id for r in by_line if r.file_ord == 0]
    assert first[:5] == ["p0", "p1", "p2", "p3", "p4"] and first[5] is None
    lines_a = [r.ord for r in by_line if r.file_ord == 0]
    assert lines_a == list(range(len(lines_a)))  # blank line dropped, numbering dense
    assert [r.id for r in by_line if r.file_ord == 2] == ["q"]
    good, bad = split_quarantine(df)
    reasons = {r.reason for r in bad.collect()}
    assert reasons == {"malformed_json", "missing_type", "post_without_title"}  # a fractional score is fine


def listing(children, after="c"):
    return json.dumps({"data": {"after": after, "children": children}})


def post(i, **kw):
    d = {"id": f"p{i}", "title": f"title {i}", "selftext": "s", "score": 20, "num_comments": 12}
    d.update(kw)
    return {"kind": "t3", "data": d}


def test_explode_listing_kinds_and_defaults(spark):
    pages = spark.createDataFrame([(0, listing([post(1), {"kind": "t1", "data": {"id": "c"}}, {"kind": "t3", "data": {"id": "m"}}]))], "page_no int, payload string")
    got = explode_listing(pages).select("id", "title", "selftext", "score", "num_comments").collect()
    assert [tuple(r) for r in got] == [("p1", "title 1", "s", 20, 12), ("m", "", "", 0, 0)]


def test_page_cutoff_rules(spark):
    rows = []
    # q1: more pages than the maximum
    rows += [("s", "q1", p, listing([post(p)])) for p in range(6)]
    # q2: empty page 1 stops the walk
    rows += [("s", "q2", 0, listing([post(10)])), ("s", "q2", 1, listing([])), ("s", "q2", 2, listing([post(12)]))]
    # q3: page 1 has no cursor: it is used, the walk stops after it
    rows += [("s", "q3", 0, listing([post(20)])), ("s", "q3", 1, listing([post(21)], after=None)), ("s", "q3", 2, listing([post(22)]))]
    # q4: a gap (page 1 missing) stops the walk
    rows += [("s", "q4", 0, listing([post(30)])), ("s", "q4", 2, listing([post(32)]))]
    pages = spark.createDataFrame(rows, "scope string, query string, page_no int, payload string")
    got = sorted((r.query, r.page_no) for r in page_cutoff(pages, 4).collect())
    assert got == [("q1", 0), ("q1", 1), ("q1", 2), ("q1", 3), ("q2", 0), ("q3", 0), ("q3", 1), ("q4", 0)]


def comment_payload(n, kinds=None, one_element=False):
    kids = [{"kind": (kinds or {}).get(i, "t1"), "data": {"id": f"c{i}", "body": f"b{i}", "score": 30}} for i in range(n)]
    first = {"data": {"children": []}}
    return json.dumps([first] if one_element else [first, {"data": {"children": kids}}])


def test_explode_comments_top_ten_and_short_payload(spark):
    pages = spark.createDataFrame([
        ("p1", comment_payload(12, kinds={3: "more"})),
        ("p2", comment_payload(3, one_element=True)),
    ], "post_id string, payload string")
    got = explode_comments(pages).collect()
    assert [r.id for r in got] == ["c0", "c1", "c2", "c4", "c5", "c6", "c7", "c8", "c9", "c10"]
    assert [r.cpos for r in got] == list(range(10))


def test_collect_items_gates_seen_and_first_wins(spark):
    pages = spark.createDataFrame([
        ("s", "a", 0, 0, listing([post(1, num_comments=10), post(2, num_comments=9), post(3)])),
        ("s", "b", 1, 0, listing([post(1), post(4, num_comments=10)])),
    ], "scope string, query string, q int, page_no int, payload string")
    cpages = spark.createDataFrame([
        ("p1", comment_payload(2)), ("p2", comment_payload(2)), ("p4", comment_payload(3)), ("p3", comment_payload(1)),
    ], "post_id string, payload string")
    seen = spark.createDataFrame([("p3",)], "id string")
    got = collect_items(pages, cpages, seen).orderBy("ord").collect()
    # p3 seen; p2 below the gate; p4's c0/c1 repeat p1's comments (first wins)
    assert [(r.id, r.type, r.post_title) for r in got] == [
        ("p1", "post", None), ("c0", "comment", "title 1"), ("c1", "comment", "title 1"),
        ("p2", "post", None), ("p4", "post", None), ("c2", "comment", "title 4"),
    ]


def response(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def run_takes(spark, contents):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, content string")
    out = df.select("i", takes(F.col("content")).alias("t"), take_status(F.col("content")).alias("s")).orderBy("i")
    return [(r.t, r.s) for r in out.collect()]


def test_take_parsing_cases(spark):
    long1, long2 = "x" * 50, "  " + "y" * 60 + "  "
    cases = [
        json.dumps([long1, long2, "short"]),                       # clean array
        "```json\n" + json.dumps([long1]) + "\n```",               # fenced with tag
        "```" + json.dumps([long1]),                               # fence without newline
        "Sure: [\"" + "a\\\"b" * 20 + "\", \"tiny\"] done",        # broken, escaped quotes
        json.dumps([1, {"k": 2}, None, long1]),                    # mixed array
        json.dumps({long1: 1, "k": 2}),                            # object: keys
        "42",                                                      # scalar
        json.dumps(["z" * 49, "z" * 50]),                          # 49 / 50
        json.dumps(["w" * 50000]),                                 # long string
        "no array at all",
    ]
    got = run_takes(spark, cases)
    assert got[0] == ([long1, long2.strip()], "ok")
    assert got[1] == ([long1], "ok")
    assert got[2] == ([], "fence_without_newline")
    assert got[3] == (["a\\\"b" * 20], "fallback")
    assert got[4] == ([long1], "ok")
    assert got[5] == ([long1], "ok")
    assert got[6] == ([], "not_iterable")
    assert got[7] == (["z" * 50], "ok")
    assert got[8] == (["w" * 50000], "ok")
    assert got[9] == ([], "no_array")


def test_fallback_on_long_unparseable_text(spark):
    raw = "[\"" + "q" * 50000 + "\" trailing"  # not JSON; one long quoted run
    got = run_takes(spark, [raw + "]"])
    assert got[0][1] == "fallback" and got[0][0] == ["q" * 50000]


def test_read_chat_optional_file_and_order(spark, tmp_path):
    from corpusflow.sources.readers import read_chat

    missing = read_chat(spark, str(tmp_path / "none.jsonl"))
    assert missing.count() == 0
    p = tmp_path / "chat.jsonl"
    ex = [{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": f"u{i}"},
                        {"role": "assistant", "content": "a"}]} for i in range(5)]
    p.write_text("\n".join(json.dumps(e) for e in ex) + "\nnot json\n")
    df = read_chat(spark, str(p)).orderBy("ord").collect()
    assert [r.messages[1].content for r in df if r.messages] == [f"u{i}" for i in range(5)]
    assert df[-1]._corrupt == "not json"
