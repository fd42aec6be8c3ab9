"""Template routing, chat messages and rendering, seeded split (R1..R3, P5, C13, L2, L3)."""

from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.chat import render_chat, to_messages
from corpusflow.functions.rand import seeded_uniform
from corpusflow.operators.chatfmt import DEBATE, DIRECT, TOPIC, choose_templates, route_family
from corpusflow.operators.split import split_exact, split_grouped, split_hash


def test_route_boundaries(spark):
    rows = [(0.3999, "t"), (0.40, "t"), (0.7499, "t"), (0.75, "t"), (0.5, ""), (0.9, None), (0.1, "")]
    df = spark.createDataFrame(rows, "roll double, topic string")
    got = [r[0] for r in df.select(route_family(F.col("roll"), F.col("topic"))).collect()]
    assert got == [DIRECT, TOPIC, TOPIC, DEBATE, DIRECT, DIRECT, DIRECT]


def test_seeded_uniform_is_deterministic_and_uniform(spark):
    df = spark.range(20000).select(seeded_uniform(42, "family", F.col("id")).alias("u"))
    stats = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0.0 <= stats[0] and stats[1] < 1.0 and abs(stats[2] - 0.5) < 0.01
    again = spark.range(20000).repartition(7).select("id", seeded_uniform(42, "family", F.col("id")).alias("u"))
    a = dict(spark.range(20000).select("id", seeded_uniform(42, "family", F.col("id"))).collect())
    assert a == dict(again.collect())


def test_family_shares_within_three_sigma(spark):
    n = 20000
    df = spark.range(n).select(F.col("id").alias("rk"), F.lit("some topic").alias("topic"))
    shares = {r.family: r["count"] / n for r in choose_templates(df).groupBy("family").count().collect()}
    for fam, p in ((DIRECT, 0.40), (TOPIC, 0.35), (DEBATE, 0.25)):
        sigma = (p * (1 - p) / n) ** 0.5
        assert abs(shares[fam] - p) < 3 * sigma, (fam, shares[fam])
    # without a topic everything is direct
    none = spark.range(500).select(F.col("id").alias("rk"), F.lit("").alias("topic"))
    assert {r.family for r in choose_templates(none).collect()} == {DIRECT}


def test_template_fill_keeps_braces_in_topic(spark):
    df = spark.range(200).select(F.col("id").alias("rk"), F.lit("{weird} topic").alias("topic"))
    users = [r.user for r in choose_templates(df).where(F.col("family") != DIRECT).collect()]
    assert users and all("{weird} topic" in u for u in users)
    known = {t.replace("{topic}", "{weird} topic") for t in K.TOPIC_TEMPLATES + K.DEBATE_TEMPLATES}
    assert set(users) <= known


def test_messages_and_render(spark):
    df = spark.createDataFrame([("S", "U", "A")], "s string, u string, a string")
    m = df.select(to_messages(F.col("s"), F.col("u"), F.col("a")).alias("m"))
    assert [tuple(x) for x in m.first().m] == [("system", "S"), ("user", "U"), ("assistant", "A")]
    r = m.select(render_chat("m", prefix="<{role}>", suffix="</>\n", generation_prompt="<assistant>")).first()[0]
    assert r == "<system>S</>\n<user>U</>\n<assistant>A</>\n<assistant>"


def test_split_sizes(spark):
    for n, train in ((0, 0), (1, 0), (19, 18), (20, 19), (2563, 2434)):
        df = spark.range(n).select(F.col("id").alias("k"))
        out = split_exact(df, F.col("k"))
        got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
        assert got.get("train", 0) == train and got.get("val", 0) == n - train
        if n:
            pos = sorted(r.pos for r in out.collect())
            assert pos == list(range(n))


def test_split_positions_follow_draws_across_buckets(spark):
    from corpusflow.operators import split as S
    df = spark.range(3000).select(F.col("id").alias("k"))
    ordered = S.seeded_order(df, F.col("k"))
    small = S.global_position(ordered, rows_per_bucket=100).select("k", "pos").collect()
    exp = sorted(ordered.collect(), key=lambda r: (r.u, r.skey))
    assert {r.k: r.pos for r in small} == {r.k: i for i, r in enumerate(exp)}


def test_split_same_seed_same_output_and_disjoint(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    a = sorted(tuple(r) for r in split_exact(df, F.col("k")).select("k", "split").collect())
    b = sorted(tuple(r) for r in split_exact(df.repartition(5), F.col("k")).select("k", "split").collect())
    assert a == b and len(a) == 500 and len({k for k, _ in a}) == 500


def test_split_hash_and_grouped(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 50).alias("g"))
    h = split_hash(df, F.col("k"))
    share = h.where(F.col("split") == "train").count() / 4000
    assert 0.93 < share < 0.97
    g = split_grouped(df, F.col("g").cast("string"))
    per_group = g.groupBy("g").agg(F.countDistinct("split").alias("n")).where(F.col("n") > 1).count()
    assert per_group == 0
