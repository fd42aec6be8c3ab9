"""Whole plans, streaming runs and the driver contract."""

import json
import os

from pyspark.sql import functions as F

from corpusflow.plans.corpus import build_corpus, write_corpus
from corpusflow.sources import tables
from corpusflow.streaming.ingest import completed_sink, item_stream, new_ids_only, run_available
from tests.conftest import SF_SMALL


def test_corpus_build_small(spark, tmp_path):
    items = tables.items(spark, SF_SMALL)
    res = build_corpus(items)
    ex = res.examples.collect()
    n = len(ex)
    train = [r for r in ex if r.split == "train"]
    assert len(train) == (n * 95) // 100
    assert sorted(r.pos for r in ex) == list(range(n))
    stages = {r.stage: r.n for r in res.stages.collect()}
    assert stages["raw"] >= stages["filtered"] >= stages["deduped"] == n
    assert stages["train"] + stages["val"] == n
    out = str(tmp_path / "corpus")
    write_corpus(res, out)
    back = spark.read.json(os.path.join(out, "train"))
    assert back.count() == len(train)


def test_two_stream_runs_emit_each_id_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def drop(name, ids):
        (land / name).write_text("\n".join(json.dumps({"id": i, "type": "post", "title": "t"}) for i in ids) + "\n")

    drop("a.json", ["1", "2", "2", "3"])
    run_available(new_ids_only(item_stream(spark, str(land))), out, ck)
    drop("b.json", ["3", "4", "1", "5"])
    run_available(new_ids_only(item_stream(spark, str(land))), out, ck)
    got = sorted(r.id for r in spark.read.parquet(out).collect())
    assert got == ["1", "2", "3", "4", "5"]


def test_completed_sink_records_labels_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    done, ck = str(tmp_path / "done"), str(tmp_path / "ck")
    schema = "label string"
    (land / "a.json").write_text('{"label": "q1"}\n{"label": "q2"}\n')
    stream = spark.readStream.schema(schema).json(str(land))
    run_available(stream, None, ck, foreach_batch=completed_sink(done))
    (land / "b.json").write_text('{"label": "q2"}\n{"label": "q3"}\n')
    stream = spark.readStream.schema(schema).json(str(land))
    run_available(stream, None, ck, foreach_batch=completed_sink(done))
    got = sorted(r.label for r in spark.read.parquet(done).collect())
    assert got == ["q1", "q2", "q3"]


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert {"corpus_build", "near_dup_pairs", "dedup_reference", "split_exact"} <= set(E.queries())
    assert F
