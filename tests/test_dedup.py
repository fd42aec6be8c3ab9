"""Near-duplicate removal against a brute-force first-wins scan (D1..D4)."""

import collections
import random
from fractions import Fraction

import pytest

from corpusflow.operators import dedup as D


def numbered(text):
    """Tokens of a text: every trigram with the number of its repeat."""
    seen, out = {}, set()
    low = text.lower()
    for k in range(2, len(low)):
        gram = low[k - 2] + low[k - 1] + low[k]
        seen[gram] = seen.get(gram, 0) + 1
        out.add((gram, seen[gram]))
    return out


def similarity(x, y):
    """Weighted trigram Jaccard as an exact fraction; 0 without trigrams."""
    p, q = numbered(x), numbered(y)
    return Fraction(len(p & q), len(p | q)) if p and q else Fraction(0)


def alike_pairs(texts):
    """Index pairs (i, j), i < j, above the threshold."""
    return {(i, j) for j in range(len(texts)) for i in range(j) if similarity(texts[i], texts[j]) > Fraction(4, 5)}


def survivors(texts):
    """Distinct texts in order of appearance that no surviving earlier one resembles."""
    texts = list(dict.fromkeys(texts))
    earlier = collections.defaultdict(set)
    for i, j in alike_pairs(texts):
        earlier[j].add(i)
    alive = set()
    for j in range(len(texts)):
        if not earlier[j] & alive:
            alive.add(j)
    return {texts[j] for j in alive}


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, text string")


def kept_by_spark(spark, texts, mode="reference"):
    out = D.dedup(frame(spark, texts), "text", "ord", mode=mode)
    return [r.text for r in out.orderBy("ord").collect()]


def test_jaccard_expression_matches_python(spark):
    pairs = [("abcdef", "abcdeg"), ("aaaa", "aaa"), ("ab", "abc"), ("Hello World", "hello world!"), ("", "abc")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(D.trigram_jaccard("a", "b")).collect()]
    exp = [float(similarity(a, b)) for a, b in pairs]
    assert [round(g, 12) for g in got] == [round(e, 12) for e in exp]


def test_multiset_differs_from_set(spark):
    # "aaaa" has trigram "aaa" twice, "aaa" once: multiset 1/2, set 1/1
    assert similarity("aaaa", "aaa") == Fraction(1, 2)
    assert kept_by_spark(spark, ["aaaa", "aaa"]) == ["aaaa", "aaa"]


def test_threshold_is_strict(spark):
    # 10 trigrams each; inter 9 -> 9/11 > 0.8 dropped; find an exactly-0.8 pair
    a = "abcdefghijkl"
    b = "abcdefghijkX"
    assert similarity(a, b) == Fraction(9, 11)
    assert kept_by_spark(spark, [a, b]) == [a]
    # inter 8, union 10 -> exactly 0.8: kept
    c, d = "abcdefghijk", "abcdefghijx"
    assert similarity(c, d) == Fraction(4, 5)
    assert kept_by_spark(spark, [c, d]) == [c, d]


def test_chain_is_first_wins_not_components(spark):
    base = "the quick brown fox jumps over the lazy dog"
    a = base
    b = base.replace("lazy", "lazz")
    c = b.replace("quick", "quicc")
    assert min(similarity(a, b), similarity(b, c)) > Fraction(4, 5) >= similarity(a, c)
    assert kept_by_spark(spark, [a, b, c]) == [a, c]


def test_exact_copies_reference_vs_strict(spark):
    t = "an exact copy of a text that appears twice"
    near = t + "!"
    assert kept_by_spark(spark, [t, near, t]) == [t, t]
    assert kept_by_spark(spark, [t, near, t], mode="strict") == [t]


def test_short_texts_never_similar(spark):
    assert kept_by_spark(spark, ["ab", "ab ", "a"]) == ["ab", "ab ", "a"]


def test_random_against_brute_force(spark):
    rnd = random.Random(11)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consect", "adipis", "elit"]
    texts = []
    for _ in range(120):
        if texts and rnd.random() < 0.5:
            src = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 4)):
                src[rnd.randrange(len(src))] = rnd.choice("abcxyz ")
            texts.append("".join(src))
        else:
            texts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))))
    kept = survivors(texts)
    exp = [t for t in texts if t in kept]
    assert kept_by_spark(spark, texts) == exp


def test_pairs_independent_of_partitioning(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcab ") for _ in range(rnd.randint(3, 30))) for _ in range(80)]
    texts = list(dict.fromkeys(texts))
    base = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rk long, text string")
    for n in (1, 2, 8):
        p = D.near_dup_pairs(base.repartition(n)).collect()
        assert {(r.rk_a, r.rk_b) for r in p} == alike_pairs(texts)
        for r in p:
            x, y = numbered(texts[r.rk_a]), numbered(texts[r.rk_b])
            assert (r.inter, r.sz_a, r.sz_b) == (len(x & y), len(x), len(y))


@pytest.mark.parametrize("a,b,value", [
    ("abcde", "abcdf", Fraction(2, 4)),          # abc bcd | cde cdf
    ("ABCDE", "abcde", Fraction(1)),
    ("abab", "ababab", Fraction(2, 4)),          # aba bab against both twice
    ("\U0001F600bc", "\U0001F600bd", Fraction(0)),
])
def test_golden_pairs(spark, a, b, value):
    assert similarity(a, b) == value
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(D.trigram_jaccard("a", "b")).first()[0] == float(value)


def test_id_first_wins_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(500, 0, -1)] + [("cold", 7, "c")]
    df = spark.createDataFrame(rows, "id string, ord long, v string")
    got = sorted(tuple(r) for r in D.id_first_wins(df).collect())
    assert got == [("cold", 7, "c"), ("hot", 1, "v1")]
    # the hot id is cut to one row per task before the exchange
    plan = D.id_first_wins(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


def test_bounded_fanout_matches_brute_force(spark):
    # a tiny fan-out forces many rounds and incomplete texts
    rnd = random.Random(5)
    base = "abcdefghij klmnopqrst uvwxyz"
    texts = []
    for _ in range(60):
        src = list(rnd.choice(texts) if texts and rnd.random() < 0.7 else base)
        for _ in range(rnd.randint(0, 3)):
            src[rnd.randrange(len(src))] = rnd.choice("abcxyz ")
        texts.append("".join(src))
    kept = survivors(texts)
    exp = [t for t in texts if t in kept]
    for fanout in (1, 2, 5):
        out = D.dedup(frame(spark, texts), "text", "ord", fanout=fanout)
        assert [r.text for r in out.orderBy("ord").collect()] == exp, fanout


def test_first_members_salted(spark):
    rows = [("g", 0, r) for r in range(1000, 0, -1)] + [("h", 0, 5), ("h", 0, 3)]
    df = spark.createDataFrame(rows, "gram string, k int, rk long")
    got = sorted(tuple(r) for r in D.first_members(df, 3, group=("gram", "k"), rows_per_task=50).select("gram", "rk").collect())
    assert got == [("g", 1), ("g", 2), ("g", 3), ("h", 3), ("h", 5)]


def test_group_far_beyond_the_fanout(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away again"
    texts = [base + f" {i:03d}" for i in range(120)] + ["something else entirely, said nobody at all today"]
    out = D.dedup(frame(spark, texts), "text", "ord", fanout=3)
    assert {r.text for r in out.collect()} == survivors(texts)


def test_long_chain_of_near_copies(spark):
    text = list("abcdefghijklmnopqrstuvwxyz" * 3)
    texts = []
    for i in range(40):  # each resembles its neighbours only
        text[(i * 5) % len(text)] = "0123456789"[i % 10]
        texts.append("".join(text))
    out = D.dedup(frame(spark, texts), "text", "ord", fanout=4)
    assert {r.text for r in out.collect()} == survivors(texts)


def test_hot_dissimilar_texts(spark):
    rnd = random.Random(2)
    texts = list(dict.fromkeys("".join(rnd.choice("ab ") for _ in range(40)) for _ in range(70)))
    out = D.dedup(frame(spark, texts), "text", "ord", fanout=5)
    assert {r.text for r in out.collect()} == survivors(texts)


def test_candidates_are_selective(spark):
    # far fewer candidates than pairs, and none of the similar pairs lost
    from corpusflow.queries import _passing
    from corpusflow.session import materialize
    from tests.conftest import SF_MID

    texts = materialize(D.distinct_texts(_passing(spark, SF_MID)))
    n = texts.count()
    rows = D.prefix_rows(D._lowered(texts))
    assert D._candidates(rows, rows).count() < 0.1 * n * (n - 1) / 2


def test_a_round_of_first_wins_takes_few_jobs(spark):
    rows = [(k, f"text number {k} " + "abcdefghij klmnop " * 8 + str(k // 3) * 30) for k in range(40)]
    texts = spark.createDataFrame(rows, "rk long, text string")
    spark.sparkContext.setJobGroup("first-wins-jobs", "first-wins-jobs")
    try:
        got = sorted(r.rk for r in D.first_wins_bounded(texts).collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert {text for k, text in rows if k not in got} == survivors([text for _, text in rows])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("first-wins-jobs"))
    assert jobs < 48  # 53 when every step was persisted and checkpointed


def shifting(n, at=0):
    """A text of ``n`` distinct letters whose first ``at`` are others."""
    return "".join(chr((0x4E00 if k >= at else 0x5E00) + k) for k in range(n))


@pytest.mark.parametrize("fanout,copies", [(2, 6), (1000, 20)])
def test_a_text_meets_the_kept_ones_beyond_its_first_partners(spark, fanout, copies):
    # the copies in the middle resemble the first text, which drops them; the last
    # text resembles them and, beyond its first partners, the one kept before it
    base, middle, far, last = shifting(200), shifting(200, 18), shifting(200, 54), shifting(200, 36)
    texts = [base, *[middle + chr(0x6E00 + k) for k in range(copies)], far, last]
    alike = alike_pairs(texts)
    n = len(texts) - 1
    assert {a for a, b in alike if b == n} == set(range(1, n)) and not [a for a, b in alike if b == n - 1]
    assert survivors(texts) == {base, far}
    out = D.dedup(frame(spark, texts), "text", "ord", fanout=fanout)
    assert {r.text for r in out.collect()} == {base, far}


def test_kept_and_undecided_partners_over_many_rounds(spark):
    rnd = random.Random(17)
    texts = []
    for _ in range(90):  # texts around the threshold, alike in all ways
        cut = rnd.sample(range(120), rnd.randint(0, 9))
        text = list(shifting(120, rnd.choice([0, 8, 16, 24, 32])))
        for k in cut:
            text[k] = chr(0x7E00 + rnd.randrange(40))
        texts.append("".join(text))
    out = D.dedup(frame(spark, texts), "text", "ord", fanout=3)
    assert {r.text for r in out.collect()} == survivors(texts)
