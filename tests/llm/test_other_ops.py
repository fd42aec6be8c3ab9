"""Operators 5, 6 and 10, the pipeline and the registration."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import conversations, language_id, near_dedup, passages, quality_rules, queries
from tests.conftest import SF_MID, SF_SMALL
from tests.llm import cases
from tests.llm.test_dedup_ops import covered, lower_ascii, near_brute
from tests.llm.test_tokens import check_packing

# -- operator 10 ------------------------------------------------------------


def quality_brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)

    def windows(k):
        seen = collections.Counter(tuple(words[i: i + k]) for i in range(n - k + 1))
        cover = set()
        for i in range(n - k + 1):
            if seen[tuple(words[i: i + k])] > 1:
                cover.update(range(i, i + k))
        return cover

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    longest = 0
    while longest < n and len({tuple(words[i: i + longest + 1]) for i in range(n - longest)}) < n - longest:
        longest += 1
    repeat, cover = len(windows(5)), len(windows(quality_rules.MIN_REPEAT))
    failed = n < 10 or 100 * repeat > 20 * n
    kept = not failed and 100 * cover <= quality_rules.MAX_COVERED_PCT * n and longest <= quality_rules.MAX_REPEAT
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed, kept, cover, longest)


@pytest.mark.parametrize("repeated", [False, True])
def test_quality_figures(spark, repeated):
    rng = random.Random(2)
    rows = [(i, t if t is None or len(t) < 20000 else t[:4000]) for i, t in cases.documents(repeated_ids=repeated)]
    passage = cases.prose(rng, 70)
    rows += [(900, cases.prose(rng, 400) + " " + passage + " " + cases.prose(rng, 300) + " " + passage), (901, "a b\na b\n\n a b\n#<|>"),
             (902, "one two   three\x85 four"), (903, "w\r\nw\r\n")]
    docs = cases.frame(spark, rows)
    got = sorted(map(tuple, quality_rules.quality_rules(docs).collect()), key=repr)
    assert got == sorted(((i, *quality_brute(t)) for i, t in rows), key=repr)
    by_id = {r[0]: r for r in got}
    assert not by_id[900][6] and not by_id[900][7]  # a long repeat in a text that passes the base rule
    kept = quality_rules.keep_quality(docs)
    assert kept.schema.names == docs.schema.names
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in got if r[7]), key=repr)


def test_quality_of_nothing(spark):
    assert quality_rules.quality_rules(cases.empty(spark)).count() == 0
    assert quality_rules.keep_quality(cases.empty(spark)).count() == 0


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        size = rng.integers(0, 12, 5)
        doc = np.repeat(np.arange(5), size)
        sym = rng.integers(0, 3, len(doc)).astype(np.uint64)
        if not len(doc):
            continue
        order, levels = quality_rules.suffix_ranks(sym, doc)
        lcp = quality_rules.neighbour_lcp(order, levels, doc)
        end = np.searchsorted(doc, doc, side="right")
        suffix = [(doc[i], sym[i: end[i]].tolist()) for i in range(len(doc))]
        assert order.tolist() == sorted(range(len(doc)), key=lambda i: suffix[i])
        for k in range(1, len(order)):
            (d, a), (e, b) = suffix[order[k - 1]], suffix[order[k]]
            n = 0
            while d == e and n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


# -- operator 5 -------------------------------------------------------------

def test_phrases_are_greedy_longest_matches():
    rng = random.Random(2)
    taught = [["banana bandana", "nab"], ["cab dab ab ab"]]
    parser = language_id.CrossParser([("a", taught[0]), ("b", taught[1])])
    train = ["banana bandana nab ", "cab dab ab ab "]
    texts = ["".join(rng.choice("abndczé Q7") for _ in range(rng.randint(1, 40))) for _ in range(200)] + ["banana " * 300]
    codes = [language_id.folded(t) for t in texts]
    for own, got in zip(codes, parser.phrases(codes)):
        text = "".join(map(chr, own))
        for lang in range(2):
            n = 0
            for s in range(0, len(text), language_id.BLOCK):
                block, i = text[s: s + language_id.BLOCK], 0
                while i < len(block):
                    j = i + 1
                    while j < len(block) and block[i:j + 1] in train[lang] and block[i:j] in train[lang]:
                        j += 1
                    n, i = n + 1, j
            assert got[lang] == n


def test_language_of_odd_documents(spark):
    samples = [("de", ["der die und über straße"]), ("en", ["the and over street"])]
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "THE STREET!!"), (5, "die straße"), (6, "漢字"), (None, "the"), (4, "the and")]
    docs = cases.frame(spark, rows)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, samples).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "de"), (None, "en")}
    assert {r.lang_pred for r in language_id.identify(docs, []).collect()} == {"und"}
    assert language_id.identify(cases.empty(spark), samples).count() == 0
    assert language_id.training_sample(cases.empty(spark), "text", "lang") == []
    assert all(0 <= r.score <= 1 for r in language_id.identify(docs, samples).collect())


def test_training_sample_is_bounded_and_takes_copies_once(spark):
    rows = [(i, "copy of a text") for i in range(300)] + [(1000 + i, f"text number {'x' * i}") for i in range(50)]
    got = language_id.training_sample(cases.frame(spark, rows), "text", "lang", rows=10, chars=100)
    assert [lang for lang, _ in got] == ["en"] and sum(map(len, got[0][1])) <= 100 and len(set(got[0][1])) == len(got[0][1])


def test_a_language_of_copies_keeps_its_sample(spark):
    rng = random.Random(14)
    texts = ["copied text"] + [cases.prose(rng, 20) for _ in range(50)]
    copies = spark.range(100_000).select(F.lit("xx").alias("lang"), F.lit(texts[0]).alias("text"))
    rest = [("xx", t) for t in texts[1:]] + [("yy", cases.prose(rng, 20)) for _ in range(100)]
    got = dict(language_id.training_sample(copies.unionByName(spark.createDataFrame(rest, "lang string, text string")), "text", "lang"))
    assert sorted(got["xx"]) == sorted(texts) and len(got["yy"]) == 64


def test_language_query_on_the_held_out_fold(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op5_language_id(spark, SF_MID).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


# -- operator 6 -------------------------------------------------------------

def test_snapshots_collapse(spark):
    turns = {
        1: [("user", "a"), ("assistant", "b")],
        2: [("user", "a"), ("assistant", "b"), ("user", "c")],
        3: [("user", "a"), ("assistant", "b"), ("user", "c")],
        4: [("user", "a"), ("assistant", "bb")],
        5: [("user", "a")],
        6: [("usera", "")],
        7: [(None, None)],
        8: [("", ""), ("user", None)],
    }
    rows = [(c, k, r, t, 0) for c, own in turns.items() for k, (r, t) in enumerate(own)] + [(4, 1, "assistant", "bb", 1), (None, None, "user", "z", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns long").repartition(3)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in conversations.maximal_conversations(df).collect()}
    assert set(got) == {2, 4, 6, 8, None}
    assert got[2][:2] == (3, 2) and got[4][:2] == (2, 1)
    assert got[2][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert conversations.maximal_conversations(df.where("false")).count() == 0


# -- pipeline ---------------------------------------------------------------

def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if quality_brute(t)[6]]
    last = {lower_ascii(t): max(i for i, u in rows if lower_ascii(u) == lower_ascii(t)) for _, t in rows}
    rows = [(i, t) for i, t in rows if last[lower_ascii(t)] == i]
    idf = near_dedup.inverse_frequency(near_dedup.document_frequency(spark.createDataFrame(rows, "doc_id long, text string"), "text"))
    root = near_brute(rows, idf)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(i, least.get(root[k], i))
    rows = [(i, t) for k, (i, t) in enumerate(rows) if least[root[k]] == i]
    cuts = covered(passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    left = []
    for i, t in rows:
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        drop = set()
        for w in sorted(cuts.get(i, ())):
            end = at[w][1] if w + 1 not in cuts[i] else at[w + 1][0]
            drop.update(range(at[w][0], end))
        left.append((i, "".join(c for k, c in enumerate(t) if k not in drop)))
    check_packing(left, corpus_pipeline.run(spark, SF_SMALL).collect())


def test_stages_return_the_columns_of_documents(spark):
    rows = cases.documents(repeated_ids=True)
    for df in (cases.frame(spark, rows), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SF_SMALL).schema.names == df.schema.names, name
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF_SMALL).count() >= 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_a_large_alphabet_needs_little_memory():
    rng = random.Random(6)
    script = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    wide = "".join(rng.choice(script) for _ in range(40_000))
    latin = cases.prose(rng, 6000)
    parser = language_id.CrossParser([("la", [latin]), ("zh", [wide])])
    size = parser.next.keys.nbytes + parser.next.to.nbytes + parser.first.nbytes + parser.symbol.nbytes
    assert size < 100 << 20
    texts = [language_id.folded(t) for t in (wide[100:900], latin[50:700], wide[30_000:30_500])]
    assert parser.phrases(texts).argmin(axis=1).tolist() == [1, 0, 1]


def test_quality_of_words_of_much_symmetry(spark):
    a, b = cases.alternating(10)
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{a}"), (3, " ".join([a, b] * 20))]
    got = sorted(tuple(r) for r in quality_rules.quality_rules(cases.frame(spark, rows)).collect())
    assert got == [(i, *quality_brute(t)) for i, t in rows]
