"""What larger tables need: sketches that lose no similar pair, tiles, tables in part files."""

import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusflow import queries as Q
from corpusflow import session
from corpusflow.functions import grams as G
from corpusflow.functions.text import char_ngrams
from corpusflow.operators import dedup as D
from tests.conftest import SF_SMALL
from tests.test_dedup import alike_pairs, similarity, survivors


def near_texts(seed, n):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        src = list(rnd.choice(texts) if texts and rnd.random() < 0.6 else "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(3, 300))))
        for _ in range(rnd.randint(0, 1 + len(src) // 15)):
            src[rnd.randrange(len(src))] = rnd.choice("xyz")
        texts.append("".join(src))
    return list(dict.fromkeys(texts))


def test_sketches_bound_the_difference():
    texts = near_texts(4, 60)
    names = [G.token_names(G.packed_grams(t)) for t in texts]
    for bits in (64, 256, 1024):
        words = G.sketch_words([G.parity_sketch(x, bits) for x in names], bits // 64)
        assert (G.sketch_words([G.parity_sketch(x, 4 * bits) for x in names], bits // 64) == words).all()  # folded
        for i in range(0, len(texts), 7):
            for j in range(i):
                differ = int(np.bitwise_count(words[:, i] ^ words[:, j]).sum())
                assert differ <= len(np.setxor1d(names[i], names[j]))


@pytest.mark.parametrize("tile", [1 << 14, 5])
def test_tiles_lose_no_pair(spark, monkeypatch, tile):
    monkeypatch.setattr(D, "TILE_ROWS", tile)
    texts = near_texts(5, 120)
    low = D.sketch_rows(spark.createDataFrame(list(enumerate(texts)), "rk long, low string"))
    got = [(r.rk_a, r.rk_b) for r in D.close_pairs(low).collect()]
    alike = alike_pairs(texts)
    assert len(got) == len(set(got)) and alike <= set(got) and len(alike) > 30
    assert all(similarity(texts[a], texts[b]) > 0.5 for a, b in got)  # and only close ones come


def test_first_partners_and_the_note_that_there_are_more(spark):
    texts = ["the quick brown fox jumps over the lazy dog and runs away again" + f" {i:03d}" for i in range(30)]
    low = D.sketch_rows(spark.createDataFrame(list(enumerate(texts)), "rk long, low string"))
    got = D.close_pairs(low, 3).collect()
    assert {r.rk_b for r in got if r.rk_a is None} == set(range(4, 30))
    assert {(r.rk_a, r.rk_b) for r in got if r.rk_a is not None} == {(a, b) for b in range(30) for a in range(min(b, 3))}
    kept = D.kept_texts(spark.createDataFrame(list(enumerate(texts)), "ord long, text string"), fanout=2)
    assert {r.text for r in kept.collect()} == survivors(texts)


@pytest.mark.parametrize("parts", [True, False])
def test_streams_read_tables_as_a_file_or_in_part_files(spark, tmp_path, parts):
    docs = spark.createDataFrame([(i, f"s{i % 2}", "en") for i in range(8)], "doc_id long, source string, lang string")
    events = spark.createDataFrame([(i % 5, i) for i in range(20)], "user_id long, event_id long")
    for name, df in (("documents", docs), ("events", events)):
        if parts:
            df.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            pq.write_table(df.toArrow(), str(tmp_path / f"{name}.parquet"))
    assert sorted(r.label for r in Q.q_stream_completed(spark, str(tmp_path)).collect()) == ["s0:en", "s1:en"]
    assert sorted(r.user_id for r in Q.q_stream_new_ids(spark, str(tmp_path)).collect()) == list(range(5))


def test_gram_sizes_without_lists_of_grams(spark):
    texts = [None, "", "ab", "aBAb", "aaaa", "\U0001F600bc\U0001F600bc", "the cat, the hat"]
    df = spark.createDataFrame(list(enumerate(texts)), "rk long, text string")
    out = D.gram_sizes(df)
    g = char_ngrams(F.col("text"))
    exp = df.select("rk", F.size(g).alias("n_grams"), F.size(F.array_distinct(g)).alias("n_distinct"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, exp.collect())) and out.dtypes == exp.dtypes
    assert "transform" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_landed_pages_are_built_once(spark, monkeypatch):
    plans, real = [], Q._land_pages
    monkeypatch.setattr(Q, "_land_pages", lambda pages, *a: (plans.append(pages._jdf.queryExecution().optimizedPlan().toString()), real(pages, *a)))
    monkeypatch.setattr(Q.Collection, "run", lambda *a, **k: None)  # the landing alone
    Q.q_stream_collect(spark, SF_SMALL)
    assert len(plans) == 3 and not any("Aggregate" in p for p in plans)


def test_landed_pages_are_not_kept_beside_what_landed(spark, tmp_path, monkeypatch):
    paths = []
    real = Q.scratch_path
    for module in (Q, session):
        monkeypatch.setattr(module, "scratch_path", lambda s, name: paths.append(real(s, name)) or paths[-1])
    kept = []
    monkeypatch.setattr(Q.Collection, "run", lambda self, number, *a, **k: kept.append([p for p in paths if "-pages-" in p and os.path.exists(p.removeprefix("file:"))]))
    Q.q_stream_collect(spark, SF_SMALL)
    assert sum("-pages-" in p for p in paths) == 2 and len(kept[0]) == 2 and kept[-1] == []
