"""Incremental runs, running totals, renderer hook, refined groups of the dedup."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.functions.chat import render_chat, render_quarantine, render_with
from corpusflow.operators import dedup as D
from corpusflow.operators.counts import observed
from corpusflow.operators.prefix import running_before
from corpusflow.session import written
from corpusflow.sources.readers import read_items, read_prompt
from corpusflow.streaming.appends import append_once, committed, read_appended
from corpusflow.streaming.collect import page_shape, walker

# -- the walk of one query ---------------------------------------------------


class FakeState:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def page(children, after="x"):
    return json.dumps({"data": {"after": after, "children": [{"kind": "t3"}] * children}})


def feed(state, *pages, maximum=5):
    at = pd.Timestamp("2024-01-01")
    frame = pd.DataFrame([(0, no, payload, at) for no, payload in pages], columns=["q", "page_no", "payload", "landed_at"])
    out = [tuple(r) for f in walker(maximum)(("s", "q"), iter([frame]), state) for r in f[["kind", "page_no", "reason"]].itertuples(index=False)]
    return [(k, n) if k == "page" else (k, n, r) for k, n, r in out]


def test_pages_wait_for_their_turn_and_broken_ones_do_not_end_a_walk():
    state = FakeState()
    assert feed(state, (2, page(3)), (1, page(1))) == []
    assert feed(state, (0, '{"data": {"chil')) == []  # broken: the walk stays open
    assert feed(state, (0, None), (0, page(2))) == [("page", 0), ("page", 1), ("page", 2)]
    assert feed(state, (0, page(9)), (1, page(9))) == []  # used pages landed again
    assert feed(state, (3, page(2, None))) == [("page", 3), ("end", 3, "last_page")]
    assert feed(state, (4, page(2))) == []


def test_walks_end_before_an_empty_page_and_at_the_maximum():
    assert feed(FakeState(), (0, page(1)), (1, page(0)), (2, page(1))) == [("page", 0), ("end", 1, "empty")]
    assert feed(FakeState(), (1, page(1)), (0, page(1)), (2, page(1)), maximum=2) == [("page", 0), ("page", 1), ("end", 1, "max_pages")]
    assert page_shape("[1]") is None and page_shape("{}") is None and page_shape(page(0, None)) == (0, False)


def test_a_batch_is_appended_once(spark, tmp_path):
    table = str(tmp_path / "t")
    df = spark.createDataFrame([(1,), (2,)], "x long")
    assert append_once(df, table, 7) and not append_once(df, table, 7)
    df.write.parquet(f"{table}/data/batch=8")  # half-written
    assert sorted(r.x for r in read_appended(spark, table, df.schema).collect()) == [1, 2]
    assert append_once(df.limit(1), table, 8)  # its replay replaces it
    assert read_appended(spark, table, df.schema).count() == 3 and committed(spark, table).count() == 2
    assert read_appended(spark, str(tmp_path / "none"), df.schema).count() == 0


# -- readers -----------------------------------------------------------------


def test_byte_offsets_order_lines_without_a_shuffle(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for f in range(3):
        lines = []
        for i in range([700, 0, 400][f]):
            lines += ["  "] * (rng.random() < 0.05) + [json.dumps({"id": f"{f}-{i}", "title": "é" * rng.randint(0, 60)}, ensure_ascii=False)]
            want.append(f"{f}-{i}")
        (tmp_path / f"part-{f}.json").write_bytes((b"\r\n" if f == 2 else b"\n").join(x.encode() for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = read_items(spark, [str(tmp_path)], order="offset")
        got = df.select("id", "ord").collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.ord for r in got}) == len(got)
    assert [r.id for r in sorted(got, key=lambda r: r.ord)] == want


def test_a_prompt_of_several_lines(spark, tmp_path):
    p = tmp_path / "prompt.txt"
    p.write_text(" \n first\n\nsecond \n")
    assert read_prompt(spark, str(p)) == "first\n\nsecond"


# -- counts and totals -------------------------------------------------------


@pytest.mark.parametrize("fan", [3, 1 << 14])
def test_running_totals(spark, fan):
    rng = random.Random(fan)
    rows = [(o, rng.randint(0, 9)) for o in rng.sample(range(-50, 5000), 200)]
    got = running_before(spark.createDataFrame(rows, "o long, v long"), "o", "v", fan=fan).collect()
    assert all(r.before == sum(v for o, v in rows if o < r.o) for r in got) and len(got) == 200
    assert running_before(spark.createDataFrame([], "o long, v long"), "o", "v").count() == 0


def test_counts_come_with_the_job(spark):
    df, n = observed(spark.range(1000).where("id % 3 = 0"))
    df, odd = observed(df, F.col("id") % 2 == 1)
    assert written(df, "observed").count() == 334 and n.get["n"] == 334 and odd.get["n"] == 167


# -- X1 ----------------------------------------------------------------------


def test_renderer_errors_go_to_quarantine(spark):
    m = "array<struct<role:string,content:string>>"
    rows = [(i, [("user", f"t{i}"), (None, None)]) for i in range(25)] + [(90, None), (91, []), (92, [("user", "bad")]), (93, [("user", "none")])]
    df = spark.createDataFrame(rows, f"k long, messages {m}")

    def renderer(some):
        out = []
        for x in some:
            text = "".join(f"<{t['role'] or ''}>{t['content'] or ''}" for t in x)
            if "bad" in text:
                raise ValueError("no such role")
            out.append(None if "none" in text else text)
        return out

    good, bad = render_quarantine(render_with(df, renderer, batch_rows=4))
    assert {r.k: r.text for r in good.collect()} == {**{i: f"<user>t{i}<>" for i in range(25)}, 91: ""}
    why = {r.k: r.render_error for r in bad.collect()}
    assert set(why) == {90, 92, 93} and why[92] == "ValueError: no such role" and "render_error" not in good.columns
    native = df.where("k < 25").select("k", render_chat("messages", "<{role}>", "").alias("text"))
    assert {r.k: r.text for r in native.collect()} == {i: f"<user>t{i}<>" for i in range(25)}  # a null role is empty


# -- large groups of the similarity join -------------------------------------


def tokens(text):
    seen, out = {}, set()
    for i in range(len(text) - 2):
        g = text[i: i + 3]
        seen[g] = seen.get(g, 0) + 1
        out.add((g, seen[g]))
    return out


def first_wins_brute(texts):
    kept = []
    for rk, text in sorted(texts):
        t = tokens(text.lower())
        if not any(5 * len(t & k) > 4 * len(t | k) for k in kept) or not t:
            kept.append(t)
        else:
            yield rk


def test_large_groups_of_unlike_texts_and_of_near_copies(spark, monkeypatch):
    """Unlike texts that share half of their tokens, and clusters of near-copies."""
    rng = random.Random(3)
    common = "".join(rng.choice("abcdefghij") for _ in range(120))
    texts = []
    for _ in range(220):
        texts.append(common + "".join(rng.choice("klmnopqrstuvwxyz0123456789") for _ in range(120)))
    for c in range(3):
        base = common + "".join(rng.choice("klmnopqrstuvwxyz0123456789") for _ in range(120))
        for _ in range(40):
            at = rng.randrange(len(base))
            texts.append(base[:at] + rng.choice("!?#") + base[at + 1:])
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    rounds = []
    real = D._resolve_round
    monkeypatch.setattr(D, "_resolve_round", lambda *a: (rounds.append(1), real(*a)))
    monkeypatch.setattr(D, "SWEEP", 4)
    df = spark.createDataFrame(rows, "rk long, text string")
    got = sorted(r.rk for r in D.first_wins_bounded(df, fanout=25).collect())
    assert got == list(first_wins_brute(rows)) and len(got) > 50
    assert len(rounds) <= 6  # one by one: 340 / 25 rounds


def test_no_similar_pair_is_lost_to_the_bound_or_the_refinement(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = "".join(rng.choice("abcde ") for _ in range(rng.randint(3, 400)))
        rows += [(3 * i, base)] + [(3 * i + k, "".join(c for c in base if rng.random() > 0.03 * k)) for k in (1, 2)]
    rows.append((1000, "ab" * 70_000))  # counts beyond 16 bits
    rows.append((1001, "ab" * 70_001))
    low = spark.createDataFrame(rows, "rk long, low string")
    tok = {rk: tokens(t) for rk, t in rows}
    similar = {(a, b) for a in tok for b in tok if a < b and tok[a] and 5 * len(tok[a] & tok[b]) > 4 * len(tok[a] | tok[b])}
    pairs = spark.createDataFrame([(a, b) for a in tok for b in tok if a < b], "rk_a long, rk_b long")
    left = {(r.rk_a, r.rk_b) for r in D.possible(pairs, D.gram_histograms(low)).collect()}
    assert similar <= left and len(left) < len(tok) * (len(tok) - 1) / 4 and len(similar) > 30
    members = D.prefix_rows(low).where("rk < 1000").select("rk", "band", "up", F.lit(0).cast("long").alias("key")).distinct()
    groups = {}
    for r in D.refined_rows(low, members, 1).collect():
        groups.setdefault((r.band, r.tok), set()).add(r.rk)
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert {p for p in similar if p[1] < 1000} <= met
