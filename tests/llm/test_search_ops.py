"""Operators 11, 12 and 13 against brute force."""

import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusflow.llm import hard_negatives, lexical_search, queries, simhash
from tests.conftest import SF_SMALL
from tests.llm import cases
from tests.llm.test_dedup_ops import lower_ascii

# -- operator 11 ------------------------------------------------------------


def search_brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) over lists of (id, text)."""
    terms = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = []
    for i, text in docs:
        bag = {}
        for t in terms.findall(lower_ascii(text or "")):
            bag[t] = bag.get(t, 0) + 1
        bags.append((i, bag))
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item, text in items:
        asked = terms.findall(lower_ascii(text or ""))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in b for _, b in bags) + 1))) for t in set(asked)}
        found = []
        for i, bag in bags:
            if not bag:
                continue
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // n_terms
            score = sum(weight[t] * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in asked if t in bag)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("repeated", [False, True])
def test_search_on_odd_rows(spark, repeated, monkeypatch):
    rng = random.Random(3)
    rows = cases.documents(repeated_ids=repeated)
    rows += [(1000 + i, " ".join(rng.choice(cases.WORDS) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    rows += [(2000 + i, "tie tie words") for i in range(15)]
    items = [(1, "alpha beta, GAMMA gamma?"), (2, None), (3, ""), (4, "unheard-of"), (5, "tie words"), (6, "漢字 Ärger über ÄRGER"),
             (7, " ".join(rng.choice(cases.WORDS) for _ in range(30))), (8, rows[0][1]), (9, "changed " * 3 + "one two")]
    items += [(None, "alpha one"), (7, "delta")] if repeated else []
    asked = spark.createDataFrame([(i, t, 3, 4, 5.0) for i, t in items], "item_id long, text string, row long, rank int, score double")
    docs = cases.frame(spark, rows)
    want = search_brute(rows, items)
    got = lexical_search.search(docs, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    monkeypatch.setattr(lexical_search, "ITEM_CHARS", 60)  # several passes
    assert sorted((tuple(r) for r in lexical_search.search(docs, asked).collect()), key=repr) == want


def test_search_of_nothing(spark):
    asked = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical_search.search(cases.empty(spark), asked).count() == 0
    assert lexical_search.search(cases.frame(spark, [(1, "alpha beta"), (2, None)]), asked.limit(0)).count() == 0


def test_string_identifiers_in_search(spark):
    docs = spark.createDataFrame([("b", "alpha"), ("a", "alpha"), (None, "alpha")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "alpha")], "item_id string, text string")
    got = [(r.rank, r.doc_id) for r in lexical_search.search(docs, asked, k=3).orderBy("rank").collect()]
    assert got in ([], [(1, "a"), (2, "b"), (3, None)])  # the weight of a term of all documents may be zero


def test_search_over_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = queries.op11_lexical_search(spark, SF_SMALL)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == search_brute(docs, items)


# -- operator 12 ------------------------------------------------------------


def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_brute(prints):
    """Smallest identifier reachable over pairs within three bits; {id: fp}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 3:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_WORDS", 7)
    rng = random.Random(11)
    rows = cases.documents()
    base = cases.prose(rng, 400)
    rows += [(500 + i, cases.changed(rng, base, 1 + i % 3)) for i in range(40)]
    got = {r.doc_id: r for r in simhash.simhash_dedup(cases.frame(spark, rows)).collect()}
    prints = {i: simhash_brute(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == classes_brute(prints)


def test_simhash_without_or_with_repeated_identifiers(spark):
    rows = cases.documents(repeated_ids=True)
    got = simhash.simhash_dedup(cases.frame(spark, rows)).collect()
    prints = dict(enumerate(simhash_brute(t) for _, t in rows))
    of = classes_brute(prints)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(of[k], []).append(i)
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in least.items()}
    want = sorted(((i, f"{prints[k]:016x}", least[of[k]]) for k, (i, _) in enumerate(rows)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert simhash.simhash_dedup(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("direct", [0, 3, 10_000])
def test_components_do_not_depend_on_the_bucket_limit(spark, monkeypatch, direct):
    """Dense groups of fingerprints, matched one by one or through hubs."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(5)
    prints = {}
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fp = centre
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6, 9])):
                fp ^= 1 << b
            prints[len(prints) * 2 + 1] = fp
    for b in (3, 2, 1, 0, 4, 5):  # exactly at and beside the limit, in one segment and over both
        prints[len(prints) * 2 + 1] = 0xFFFF0000FFFF0000 ^ ((1 << b) - 1)
        prints[len(prints) * 2 + 1] = 0x0F0F00000F0F0000 ^ ((1 << b) - 1) << 31
    rows = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in prints.items()]
    distinct = spark.createDataFrame(rows, "rep long, fp long").groupBy("fp").agg(F.min("rep").alias("rep"))
    got = {r.node: r.root for r in simhash.components(simhash.links(distinct)).collect()}
    of = {fp: i for i, fp in sorted(prints.items(), reverse=True)}
    want = classes_brute(prints)
    assert all(got.get(of[fp], of[fp]) == want[i] for i, fp in prints.items())


def test_simhash_over_the_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    prints = {r.doc_id: simhash_brute(r.text) for r in docs}
    of = classes_brute(prints)
    got = queries.op12_simhash(spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{p:016x}", of[i]) for i, p in prints.items())


# -- operator 13 ------------------------------------------------------------


def negatives_brute(rows, every=100, k_pos=5, k_neg=10):
    """Over lists of (vec_id, label, vector)."""
    keep = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in range(len(keep)):
        i, lab, v = keep[a]
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, b, lb) for b, (j, lb, w) in enumerate(keep))
        for s, j, _, _ in [x for x in scored if x[3] == lab and x[2] != a][:k_pos]:
            neg = [x for x in scored if x[3] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:k_neg]
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m, _, _) in enumerate(neg)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, row long, slot long, score int, rank int"


def _vectors(rng, n, d, labels=4):
    centre = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    return [(i, rng.randrange(labels), [f32(c + rng.gauss(0, .5)) for c in rng.choice(centre)]) for i in range(n)]


@pytest.mark.parametrize("anchors", [4096, 3])
def test_negatives_on_odd_rows(spark, monkeypatch, anchors):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "_STEP", 16)
    rng = random.Random(9)
    rows = _vectors(rng, 600, 6)
    odd = [(700, None, [1.0] * 6), (None, 1, [1.0] * 6), (800, 1, None), (900, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, 2, [float("nan")] * 6),
           (1100, 2, [float("inf")] * 6), (1200, 0, [0.0] * 6), (1300, 0, [1.0, 2.0]), (1400, 1, []), (1500, 99, [5.0] * 6), (-100, 1, [2.0] * 6)]
    rows += odd + [(2000 + i, 1, rows[200][2]) for i in range(30)] + [(2050 + i, 2, rows[200][2]) for i in range(30)]  # ties
    rng.shuffle(rows)
    extra = (1, 2, 3, 4)
    docs = spark.createDataFrame([(i, lab, v, *extra) for i, lab, v in rows], VECTORS).repartition(5)
    got = hard_negatives.hard_negatives(docs)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == negatives_brute(rows)


def test_negatives_with_repeated_rows_large_components_and_nothing(spark):
    rng = random.Random(2)
    rows = [(i % 150 * 4, lab, [x * 1e6 for x in v]) for i, lab, v in _vectors(rng, 300, 3)]  # sums leave the doubles' integers
    rows = [(i, lab, [float(round(x)) for x in v]) for i, lab, v in rows]
    docs = spark.createDataFrame([(i, lab, [float(x) for x in v]) for i, lab, v in rows], "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives.hard_negatives(docs).collect())) == negatives_brute(rows)
    assert hard_negatives.hard_negatives(docs.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(docs.where("vec_id % 100 <> 0")).count() == 0


def test_the_walk_ends_early_and_loses_nothing():
    rng = random.Random(4)
    rows = _vectors(rng, 4000, 16)
    vec = np.array([[math.floor(256 * x) for x in v] for _, _, v in rows], dtype=np.int64)
    label, ids = np.array([r[1] for r in rows]), np.arange(len(rows))
    own = ids[::50]
    wants = hard_negatives.Wants(vec[own], own, label[own], np.arange(len(own)), np.full(len(own), -(2**62)), np.full(len(own), 2**62), 5, True)
    best = hard_negatives.Best(wants)
    formed = hard_negatives.walk(best, hard_negatives.clusters(wants.anchors), vec, ids, ids, label)
    assert formed < 0.8 * len(own) * len(rows)
    full = vec[own] @ vec.T
    for a, o in enumerate(own):
        fits = (label == label[o]) & (ids != o)
        want = sorted(zip(-full[a][fits], ids[fits]))[:5]
        assert sorted(zip(-best.score[best.slot == a], best.ident[best.slot == a])) == want
