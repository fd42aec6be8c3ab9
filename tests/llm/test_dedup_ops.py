"""Operators 1, 7, 8 and 9 against brute force."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import byte_repeats, exact_dedup, near_dedup, passages, queries
from corpusflow.llm.store import components, new_folder
from corpusflow.llm.words import Block, utf8
from tests.conftest import SF_SMALL
from tests.llm import cases


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- operator 7 -------------------------------------------------------------

def exact_brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower_ascii(t)].append(i)
    return sorted(((i, max((x for x in groups[lower_ascii(t)] if x is not None), default=None), len(groups[lower_ascii(t)]),
                    hashlib.sha256(lower_ascii(t).encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("digest", ["sha256", "weak"])
def test_exact_dedup(spark, repeated, digest):
    rows = cases.documents(repeated_ids=repeated)
    fn = exact_dedup.sha256 if digest == "sha256" else (lambda c: F.substring(F.sha2(c, 256), 1, 1))  # collides
    out = exact_dedup.exact_dedup(cases.frame(spark, rows), digest=fn)
    got = out.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == exact_brute(rows)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({lower_ascii(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("repeated", [False, True])
def test_keep_exact_returns_whole_rows(spark, repeated):
    rows = cases.documents(repeated_ids=repeated)
    docs = cases.frame(spark, rows)
    out = exact_dedup.keep_exact(docs)
    assert out.schema.names == docs.schema.names
    got = collections.Counter(lower_ascii(r.text) for r in out.collect())
    assert got == collections.Counter({lower_ascii(t) for _, t in rows})


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(cases.empty(spark)).count() == 0
    assert exact_dedup.keep_exact(cases.empty(spark)).count() == 0


def test_exact_state_goes_on_in_later_runs(spark):
    state = exact_dedup.DedupState(spark, new_folder(spark, "test-state"))
    state.add(spark.createDataFrame([(1, "A"), (2, "b")], "doc_id long, text string"))
    state.add(spark.createDataFrame([(3, "a"), (0, "B"), (4, None)], "doc_id long, text string"))
    again = exact_dedup.DedupState(spark, state.path)  # a new process would start here
    again.add(spark.createDataFrame([(5, "")], "doc_id long, text string"))
    got = {(r.keep_id, r.group_size) for r in again.groups().collect()}
    assert got == {(3, 2), (2, 2), (5, 2)}
    places = [(r.file, r.row) for r in again.landed().collect()]
    assert len(places) == len(set(places)) == 6


@pytest.mark.parametrize("in_files", [False, True])
def test_exact_hits_of_earlier_runs_are_checked_on_bytes(spark, in_files):
    clash = lambda c: F.substring(c, 1, 1)  # noqa: E731 - the first letter: many texts share it
    state = exact_dedup.DedupState(spark, new_folder(spark, "test-state"), clash)
    runs = [[("a", "xa"), ("b", "y")], [("c", "xb"), ("d", "Y")], [("e", "XA"), ("f", "xb"), ("f", "xb"), (None, "z")], [("g", "Z")]]
    for rows in runs:
        docs = spark.createDataFrame(rows, "doc_id string, text string")
        if in_files:
            path = new_folder(spark, "test-rows")
            docs.repartition(2).write.parquet(path)
            docs = spark.read.parquet(path)
        state.add(docs)
    got = [(r.doc_id, r.keep_id, r.group_size) for r in state.decisions().collect()]
    assert sorted(got, key=repr) == sorted([
        ("a", "e", 2), ("e", "e", 2), ("c", "f", 3), ("f", "f", 3), ("f", "f", 3), ("b", "d", 2), ("d", "d", 2),
        (None, "g", 2), ("g", "g", 2)], key=repr)
    assert collections.Counter(r.keep_id for r in state.decisions().where("kept").collect()) == {"e": 1, "f": 1, "d": 1, "g": 1}
    assert {r.digest for r in state.collided().collect()} == {"x"}
    assert in_files != os.path.exists(state.path.removeprefix("file://") + "/content")


def test_exact_locators_find_the_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    state = exact_dedup.DedupState(spark, new_folder(spark, "test-state"))
    state.add(docs)
    found = state.fetch(state.landed())
    wrong = found.where(exact_dedup.sha256(F.col("text")) != F.col("text_sha256")).count()
    assert (found.count(), wrong) == (docs.count(), 0)


def test_exact_dedup_of_string_identifiers(spark):
    rows = cases.documents(repeated_ids=True)
    named = [(None if i is None else f"id-{i:05d}", t) for i, t in rows]
    docs = spark.createDataFrame(named, "doc_id string, text string").withColumn("_metadata", F.lit(1))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()), key=repr)
    name = lambda i: None if i is None else f"id-{i:05d}"
    assert got == sorted(((name(i), name(k), n, h) for i, k, n, h in exact_brute(rows)), key=repr)
    assert exact_dedup.keep_exact(docs).count() == len({lower_ascii(t) for _, t in rows})


# -- operator 8 -------------------------------------------------------------

def repeats_brute(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p: p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if seen[b[p: p + length]] > 1:
                mask[p: p + length] = True
        spans = int(len(b) > 0 and mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("repeated", [False, True])
def test_byte_repeats_on_odd_documents(spark, repeated):
    rows = [(i, t[:9000] if t else t) for i, t in cases.documents(repeated_ids=repeated)]
    assert sorted_rows(byte_repeats.remove_repeats(cases.frame(spark, rows))) == repeats_brute(rows, 400)


@pytest.mark.parametrize("length,window,letters", [(40, 12, "ab"), (40, 12, "abcdefgé"), (30, 16, "a"), (60, 20, "abcdefghijklmnop ")])
def test_byte_repeats_on_recombined_pieces(spark, length, window, letters):
    rng = random.Random(length + len(letters))
    base = ["".join(rng.choice(letters) for _ in range(200)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                s = rng.randint(0, 150)
                text += rng.choice(base)[s: s + rng.randint(5, 120)]
            else:
                text += "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        rows.append((i, text))
    rows += [(90, rows[7][1]), (91, rows[7][1])]
    assert sorted_rows(byte_repeats.remove_repeats(cases.frame(spark, rows), length=length, window=window)) == repeats_brute(rows, length)


def test_byte_repeats_carry_state_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_byte_repeats_on_recombined_pieces(spark, 40, 12, "ab")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_byte_repeats_of_nothing(spark):
    assert byte_repeats.remove_repeats(cases.empty(spark)).count() == 0


def test_byte_repeats_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted_rows(queries.op8_byte_repeats(spark, SF_SMALL)) == repeats_brute(rows, 400)


# -- operator 1 -------------------------------------------------------------

def test_compact_windows_are_the_large_nodes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 60))
        h = rng.integers(0, 15, n).astype(np.uint64)
        cut = np.unique(np.append(rng.integers(0, n + 1, 2), [0, n]))
        least = int(rng.integers(1, 9))
        want = []
        for s, e in zip(cut, cut[1:]):
            for p in range(s, e):
                lo, hi = p, p
                while lo > s and h[lo - 1] > h[p]:
                    lo -= 1
                while hi + 1 < e and h[hi + 1] >= h[p]:
                    hi += 1
                if hi - lo + 1 >= least:
                    want.append((lo, p, hi))
        assert sorted(zip(*map(np.ndarray.tolist, passages.compact_windows(h, cut[:-1], cut[1:], least)))) == sorted(want)


def grams_of(rows):
    block = Block(*utf8(pa.array([t for _, t in rows], pa.string())))
    gram, _, _ = passages.shingle_rows(block)
    off = block.word_off
    return [gram[off[k]: max(off[k], off[k + 1] - 4)].view(np.int64) for k in range(len(rows))]


def passage_words_brute(rows):
    """Words that an earlier document's passage covers, by comparing all pairs."""
    rows = sorted(rows)
    grams = grams_of(rows)
    out = collections.defaultdict(set)
    for x in range(len(rows)):
        for y in range(x):
            for s, e, _, _, _ in passages.shared_runs(grams[x], grams[y]):
                out[rows[x][0]].update(range(s, e + 5))
    return {k: v for k, v in out.items() if v}


def covered(found):
    out = collections.defaultdict(set)
    for r in found:
        out[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    return dict(out)


def test_passages_on_odd_documents(spark):
    rows = cases.documents()
    found = passages.passages(cases.frame(spark, rows)).collect()
    assert covered(found) == passage_words_brute(rows)
    assert all(r.other_id < r.doc_id and r.similarity >= 0.8 and r.n_words >= 50 for r in found)


def test_passages_query_finds_what_all_pairs_find(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got, want = covered(queries.op1_passages(spark, SF_SMALL).collect()), passage_words_brute(rows)
    assert set(got) <= set(want)
    n_got, n_want = sum(len(got.get(k, set()) & v) for k, v in want.items()), sum(map(len, want.values()))
    assert n_got >= 0.97 * n_want


def test_a_passage_that_many_documents_share(spark):
    rng = random.Random(5)
    common = cases.prose(rng, 60)
    rows = [(i, cases.prose(rng, 40 + i) + " " + common + " " + cases.prose(rng, 30)) for i in range(40)]
    found = covered(passages.passages(cases.frame(spark, rows)).collect())
    assert set(found) == set(range(1, 40))
    for i in range(1, 40):
        assert found[i] >= set(range(40 + i, 100 + i))


def test_passages_whose_minima_may_all_lie_in_a_line_that_many_documents_hold(spark):
    # 42 of a passage's 50 words are a line that others hold too; the first and the
    # preceding holder share nothing else with it, one between them the whole passage
    rng = random.Random(12)
    new = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    line, tails, texts, sought = new(42), [new(8) for _ in range(24)], [], {}

    def add(*parts):
        texts.append(" ".join(new(20) + sum(parts, []) + new(20)))

    def minima(words):
        gram = grams_of([(0, " ".join(words))])[0].view(passages.U)
        return [passages.sliding_minima(passages.mix(gram, 100 + fn))[0] for fn in range(passages.HASHES)]

    for _ in range(4):
        add(line)
    for tail in tails:
        add(line, tail)
    for k, tail in enumerate(tails):
        edited = line[: 5 + k] + new(1) + line[6 + k:]
        if sum(x == y for x, y in zip(minima(line + tail), minima(edited + tail))) >= passages.AGREE:
            sought[len(texts)] = set(range(20, 70))
        add(edited, tail)
        add(line)
    found = covered(passages.passages(cases.frame(spark, list(enumerate(texts)))).collect())
    lost = [k for k, words in sought.items() if not words <= found.get(k, set())]
    assert not lost and len(sought) > 12


@pytest.mark.parametrize("holders", [60, 600])
def test_passages_made_half_of_a_line_that_many_documents_hold(spark, holders):
    rng = random.Random(13)
    line = cases.prose(rng, 30)
    rows = [(i, f"{cases.prose(rng, 40)} {line} {cases.prose(rng, 40)}") for i in range(holders)]
    for k in range(40):  # 30 words of the line and 22 of their own, in two documents among the others
        own = cases.prose(rng, 22)
        both = f"{line} {own}" if k % 2 else f"{own} {line}"
        first, second = holders + 2 * k, holders + 2 * k + 1
        rows += [(first, f"{cases.prose(rng, 35)} {both} {cases.prose(rng, 30)}"), (second, f"{cases.prose(rng, 50)} {both} {cases.prose(rng, 30)}")]
    order = list(range(len(rows)))
    rng.shuffle(order)  # identifiers in any order: a pair's documents are neither first nor neighbours
    named = {old: new for old, new in zip(range(len(rows)), order)}
    found = covered(passages.passages(cases.frame(spark, [(named[i], t) for i, t in rows])).collect())
    lost = []
    for k in range(40):
        one, two = holders + 2 * k, holders + 2 * k + 1
        later, start = (two, 50) if named[one] < named[two] else (one, 35)
        if not found.get(named[later], set()) >= set(range(start, start + 52)):
            lost.append(k)
    assert not lost, f"{len(lost)} of 40"


def verbatim_words_brute(a, b):
    """Words of ``a`` in runs of 50 or more equal words, by a table over all word pairs."""
    run, out = [0] * (len(b) + 1), set()
    for i, w in enumerate(a):
        new = [0] * (len(b) + 1)
        for j, v in enumerate(b):
            if w == v:
                new[j + 1] = run[j] + 1
                if new[j + 1] >= 50:
                    out.update(range(i - new[j + 1] + 1, i + 1))
        run = new
    return out


def runs_of(a, b):
    x, y = grams_of([(0, a), (1, b)])
    return passages.shared_runs(x, y)


def test_parts_of_a_run_that_is_unlike_as_a_whole():
    rng = random.Random(11)
    p1, p2, other = cases.prose(rng, 60), cases.prose(rng, 60), cases.prose(rng, 20)
    for b in (f"{p1} {other} {p2}", f"{p2} {other} {p1}", f"{p2} {other} {other} {p1}"):
        words = {w for s, e, _, _, _ in runs_of(f"{p1} {p2}", b) for w in range(s, e + 5)}
        assert words >= set(range(120)), b
    # a verbatim paragraph, and one with a single edit, in a region edited every 12 words
    for edits in (0, 1):
        a = cases.prose(rng, 300).split(" ")
        b = [f"new{i}" if i % 12 == 0 and not 120 <= i < 190 or edits and i == 155 else w for i, w in enumerate(a)]
        words = {w for s, e, _, _, _ in runs_of(" ".join(a), " ".join(b)) for w in range(s, e + 5)}
        assert words >= set(range(121, 190))
        assert len(words) < 150


def test_shared_runs_hold_every_verbatim_run():
    rng = random.Random(12)
    for case in range(60):
        parts = [cases.prose(rng, rng.randint(20, 90)) for _ in range(4)] + [" ".join(["same line again"] * rng.randint(5, 30))]
        a, b = (" ".join(rng.choice(parts) for _ in range(rng.randint(1, 6))).split(" ") for _ in range(2))
        for text in (a, b):
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = f"new{rng.randint(0, 99)}"
        found = runs_of(" ".join(a), " ".join(b))
        fold = lambda words: [lower_ascii(w) for w in words]
        assert {w for s, e, _, _, _ in found for w in range(s, e + 5)} >= verbatim_words_brute(fold(a), fold(b)), case
        x, y = grams_of([(0, " ".join(a)), (1, " ".join(b))])
        for s, e, o, p, sim in found:
            one, two = set(x[s: e + 1].tolist()), set(y[o: p + 1].tolist())
            assert e - s + 1 >= 46 and sim >= 0.8 and sim == len(one & two) / len(one | two)


def test_sent_shingles_are_short_and_tell_themselves_apart():
    gram = np.random.default_rng(3).integers(0, 2**64, 1000, dtype=np.uint64)
    gram[500:] = gram[:500]
    raw = passages.packed(gram)
    back = passages.unpacked(raw)
    assert len(raw) == 6 * len(gram)
    assert (back[500:] == back[:500]).all() and len(set(back.tolist())) == 500
    assert len(passages.unpacked(passages.packed(gram[:0]))) == 0


def test_stretches_are_sent_once_with_their_sides(spark):
    from pyspark.sql import functions as F

    docs = cases.frame(spark, [(1, " ".join(f"w{i}" for i in range(80)))])
    side = lambda own, s: spark.createDataFrame([(1, s, s + 50)], "doc_id long, s int, e int").withColumn(
        "own", F.lit(own)).withColumn("theirs", F.lit(not own))
    spans = side(True, 0).unionByName(side(False, 0)).unionByName(side(False, 3)).unionByName(side(False, 3))
    got = {(r.s, r.own, r.theirs, len(r.grams)) for r in passages._slices(docs, spans, "doc_id", "text").collect()}
    assert got == {(0, True, True, 6 * 51), (3, False, True, 6 * 51)}


def test_cut_passages_keeps_the_rest(spark):
    rng = random.Random(6)
    common = cases.prose(rng, 70)
    before, after = cases.prose(rng, 60), cases.prose(rng, 50)
    rows = [(1, common), (2, before + "\n" + common + "\n" + after), (3, None), (4, ""), (5, cases.prose(rng, 30)), (6, common)]
    docs = cases.frame(spark, rows)
    out = passages.cut_passages(docs)
    assert out.schema.names == docs.schema.names
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 6 and got[1].text == common and got[3].text is None and got[5].text == rows[4][1]
    assert got[2].text == before + "\n\n" + after and got[2].n_chars == len(got[2].text) and got[6].text == ""


@pytest.mark.parametrize("fn", [passages.passages, passages.cut_passages])
def test_passages_without_or_with_repeated_identifiers(spark, fn):
    rows = cases.documents(repeated_ids=True)
    assert fn(cases.frame(spark, rows)).count() >= (0 if fn is passages.passages else len(rows))
    assert fn(cases.empty(spark)).count() == 0


# -- operator 9 -------------------------------------------------------------

def near_brute(rows, idf):
    """Classes by exact weighted Jaccard over all pairs, shingles counted anew."""
    grams = []
    block = Block(*utf8(pa.array([t for _, t in rows], pa.string())))
    doc, gram, count = near_dedup.shingles(block)
    sets = [{} for _ in rows]
    for d, g, c in zip(doc, gram, count):
        sets[d][int(g)] = c * float(idf[int(g) >> (64 - near_dedup.DF_BITS)])
    for (_, t), own in zip(rows, sets):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t))
        assert len(own) == len({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else ())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            common = sum(min(w, b[g]) for g, w in a.items() if g in b)
            total = sum(a.values()) + sum(b.values()) - common
            if total and common / total >= near_dedup.SIMILARITY:
                parent[find(x)] = find(y)
    return [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("repeated", [False, True])
def test_near_dedup_on_odd_documents(spark, repeated):
    rows = cases.documents(repeated_ids=repeated)
    docs = cases.frame(spark, rows)
    idf = near_dedup.inverse_frequency(near_dedup.document_frequency(docs, "text"))
    root = near_brute(rows, idf)
    members = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[root[k]].append(i)
    want = sorted(((i, min((x for x in members[root[k]] if x is not None), default=None), len(members[root[k]])) for k, (i, _) in enumerate(rows)), key=repr)
    got = near_dedup.near_dedup(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(members)
    stay = near_dedup.keep_near(docs)
    assert stay.schema.names == docs.schema.names and stay.count() == len(members)


def test_near_dedup_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    root = near_brute(rows, near_dedup.inverse_frequency(near_dedup.document_frequency(docs, "text")))
    want = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        want[root[k]].append(i)
    got = collections.defaultdict(list)
    for r in queries.op9_near_dedup(spark, SF_SMALL).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_dedup_of_nothing(spark):
    assert near_dedup.near_dedup(cases.empty(spark)).count() == 0
    assert near_dedup.keep_near(cases.empty(spark)).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(8)
    base = cases.prose(rng, 200)
    rows = [(i, cases.changed(rng, base, 1)) for i in range(60)] + [(100 + i, cases.prose(rng, 120)) for i in range(20)]
    got = near_dedup.near_dedup(cases.frame(spark, rows)).collect()
    assert {r.class_id for r in got if r.doc_id < 100} == {0}
    assert all(r.class_size == 1 for r in got if r.doc_id >= 100)


def test_samples_agree_as_often_as_the_weighted_jaccard():
    rng = np.random.default_rng(2)
    gram = near_dedup.mix(np.arange(400, dtype=np.uint64))
    w1, w2 = rng.uniform(0.5, 4, 400).astype(np.float32), rng.uniform(0.5, 4, 400).astype(np.float32)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    agree = []
    for k in range(40):
        g = near_dedup.mix(gram, 1000 + k)
        a = near_dedup.samples(np.zeros(400, int), g, w1)[0]
        b = near_dedup.samples(np.zeros(400, int), g, w2)[0]
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - want) < 0.04


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, x) for x in range(501, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in ab and ab[0] != ab[1] for ab in links)}
