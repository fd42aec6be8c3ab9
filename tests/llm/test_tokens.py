"""Operators 2, 3 and 4 against the tokenizers library, on odd and whole texts."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusflow.llm import packing, queries, token_files
from corpusflow.llm.piece_table import batch_ids, gap_pieces, word_pieces
from corpusflow.llm.store import new_folder
from corpusflow.llm.tokens import encode_decode, library_bytes, library_words, word_bpe
from tests.conftest import SF_SMALL
from tests.llm import cases

WORD, BYTE = queries.WORD_BPE, queries.BYTE_BPE


def _library(path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _u32(ids):
    return np.array(ids, "<u4").tobytes()


def _all(table, texts, spans):
    out = []
    for _, _, ids, off in batch_ids(table, pa.array(texts, pa.string()), spans):
        out += [ids[a:b].tolist() for a, b in zip(off, off[1:])]
    return out


def test_encoders_agree_with_the_library_on_random_characters():
    rng = random.Random(4)
    pool = [*"abcXYZ'stve<|>!#129 \t\n\r", "Σ", "σ", "İ", "ı", "ß", "é", "É", "e̊", "̧", "½",
            "①", "Ⅷ", "٣", "あ", "아", "하", "ǅ", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​",
            "­", "﻿", "\U0001F600", "‍", "\U0001D400", "\x00", "᠎", "à", " ", "\n", " the", "'ll", "'RE",
            "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", "12", "ﬁ"]
    texts = [None, ""] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    word, byte = _library(WORD), _library(BYTE[0])
    want = [word.encode(t or "", add_special_tokens=False).ids for t in texts]
    own, table = word_bpe(WORD)
    assert _all(table, texts, word_pieces) == want
    assert _all(library_words(WORD), texts, word_pieces) == want
    assert [own.decode(ids) for ids in want] == [word.decode(ids, skip_special_tokens=False) for ids in want]
    assert _all(library_bytes(*BYTE), texts, gap_pieces) == [byte.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_latin_words_are_encoded_by_the_model_alone(monkeypatch):
    from corpusflow.llm import tokens

    monkeypatch.setattr(tokens, "_worker", {})
    rnd, tok = random.Random(11), _library(WORD)
    letters = "abcXYZ0189.,;:!?$#*%&|<>@[]\\^_`{}~()+-/='\"\u00c0\u00c9\u00df\u00f1\u00fc\u00d7\u00f7\u00ff\u00de\u00b5\u00aa\x7f\u0130\u0131\u017f\u212a\u0301"
    pieces = ["".join(rnd.choices(letters, k=rnd.randint(1, 14))) for _ in range(3000)] + ["it's", "<|ENDOFTEXT|>", "a<|endoftext|>b", "don't."]
    assert library_words(WORD).encode(pieces) == [tok.encode(p, add_special_tokens=False).ids for p in pieces]
    # the whole library, with its normaliser and pattern, is only called for other pieces
    assert tokens._plain.fullmatch("\u00dcber$$$,") and not any(map(tokens._plain.fullmatch, ("it's", "<|", "e\u0301", "a\u00d7")))


def test_piece_tables_start_afresh_when_full(monkeypatch):
    from corpusflow.llm import piece_table

    monkeypatch.setattr(piece_table, "MAX_PIECES", 5)
    monkeypatch.setattr(piece_table, "TABLE_BLOCK", 40)
    texts = ["one two three four five six seven", "eight nine ten eleven twelve", "one two thirteen"] * 3
    table = piece_table.PieceTable(word_bpe(WORD)[0].encode_pieces)
    assert _all(table, texts, word_pieces) == [word_bpe(WORD)[0].encode(t) for t in texts]


@pytest.mark.parametrize("repeated", [False, True])
def test_bpe_matches_library_on_odd_documents(spark, repeated):
    rows = cases.documents(repeated_ids=repeated)
    got = encode_decode(cases.frame(spark, rows), WORD, full=True).collect()
    tok = _library(WORD)
    want = sorted((str(i), tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(_u32(r.ids)).hexdigest()
        assert r.decoded == tok.decode(r.ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert encode_decode(cases.empty(spark), WORD).count() == 0


def test_bpe_query_matches_library(spark):
    tok = _library(WORD)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op2_bpe(spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = tok.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(_u32(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(rows, pieces, seq_len=packing.SEQ_LEN):
    """Each id in exactly one piece, sequences gapless and full but for a few."""
    tok = _library(BYTE[0])
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID])
    total = sum(len(x) for v in want.values() for x in v)
    assert sum(p.length for p in pieces) == total
    for p in pieces:
        fits = [x for x in want[p.doc_id] if len(x) == p.doc_tokens
                and zlib.crc32(_u32(x[p.start: p.start + p.length])) == p.ids_crc32]
        assert fits and p.length > 0
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
    for own in seqs.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= seq_len and all(p.padded_length == (at if at & (at - 1) == 0 else seq_len) for p in own)
    short = [s for s, own in seqs.items() if sum(p.length for p in own) < seq_len]
    assert len({s >> 32 for s in short}) == len(short)  # at most one a range
    for i, copies in want.items():
        if len(copies) == 1:
            spans = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("repeated", [False, True])
def test_packing_odd_documents(spark, repeated):
    rows = cases.documents(repeated_ids=repeated)
    check_packing(rows, packing.pack(cases.frame(spark, rows), BYTE).collect())
    check_packing(rows, packing.pack(cases.frame(spark, rows), BYTE, seq_len=64).collect(), 64)
    assert packing.pack(cases.empty(spark), BYTE).count() == 0


def test_packing_query_holds_every_id_once(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    pieces = queries.op3_packing(spark, SF_SMALL).collect()
    check_packing([(r.doc_id, r.text) for r in docs], pieces)


def test_hilbert_index_walks_the_grid():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert(points, 3)
    assert sorted(key) == list(range(side**3))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing_puts_alike_documents_together(spark):
    rng = random.Random(3)
    rows = [(i, cases.prose(rng, 60, ["der", "die", "und"]) if i % 2 else "1234 5678 " * rng.randint(20, 60)) for i in range(40)]
    keys = {}
    for _, _, key in packing.curve_keys(pa.array([t for _, t in rows])):
        keys = dict(zip([i for i, _ in rows], key.tolist()))
    order = sorted(keys, key=keys.get)
    changes = sum(a % 2 != b % 2 for a, b in zip(order, order[1:]))
    assert changes <= 5


def test_wavelet_matrix_access_count_select():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 4096, 4097, 20000):
        ids = (rng.zipf(1.4, n) % 49408).astype(np.uint16)
        m = token_files.WaveletMatrix.build(ids)
        shard = token_files.Shard(token_files.dump(m, [1], np.array([0, n])))
        m = shard.matrix
        assert (m.tokens() == ids).all()
        for i in rng.integers(0, n, 20) if n else []:
            t = int(ids[i])
            assert m.access(int(i)) == t
            assert m.count(t, int(i)) == int((ids[:i] == t).sum())
            where = np.flatnonzero(ids == t)
            k = int(rng.integers(0, len(where)))
            assert m.select(t, k) == where[k] and m.select(t, len(where)) == -1
        assert m.count(49000) == int((ids == 49000).sum())


@pytest.mark.parametrize("repeated", [False, True])
def test_token_files_odd_documents(spark, repeated):
    rows = cases.documents(repeated_ids=repeated)
    folder = new_folder(spark, "test-shards")
    manifest = token_files.write_shards(cases.frame(spark, rows), folder, WORD, shard_tokens=500)
    manifest.write.parquet(folder + "-manifest")
    manifest = spark.read.parquet(folder + "-manifest")
    assert manifest.count() > 3
    got = sorted(token_files.read_shards(spark, manifest, folder, with_ids=True).collect(), key=lambda r: r.start)
    tok = _library(WORD)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        at += len(ids)


def test_token_files_of_no_documents(spark):
    folder = new_folder(spark, "test-shards")
    token_files.write_shards(cases.empty(spark), folder, WORD).write.parquet(folder + "-manifest")
    assert token_files.read_shards(spark, spark.read.parquet(folder + "-manifest"), folder).count() == 0


def test_token_file_query(spark):
    tok = _library(WORD)
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(queries.op4_token_files(spark, SF_SMALL).collect())
    at, want = 0, []
    for i, t in docs:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(_u32(ids))))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def test_words_of_much_symmetry_and_long_white_space(spark):
    """Words that a plain polynomial hash cannot tell apart; runs of white space
    that one of the libraries cannot take in."""
    (a, b), (c, d) = cases.alternating(10), cases.alternating(11)
    texts = [f"{a} {b}", f"{b}\n{a}", f"{c} {d} {a}", b, d, " " * 1_200_000, "x\n" + "\n" * 1_200_000 + "y", "\t" * 300_000 + a]
    word, byte = _library(WORD), _library(BYTE[0])
    assert _all(word_bpe(WORD)[1], texts, word_pieces) == [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert _all(library_words(WORD), texts, word_pieces) == [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert _all(library_bytes(*BYTE), texts, gap_pieces) == [byte.encode(t, add_special_tokens=False).ids for t in texts]


def test_span_hashes_tell_symmetric_words_apart():
    from corpusflow.llm.words import blocks

    words = [w for bits in range(8, 15) for w in cases.alternating(bits)]
    seen = []
    for filler in ("", "filler " * 800):  # at other places of a block, over other chunks
        keys = []
        for _, _, block in blocks(pa.array([filler + " ".join(words)])):
            keys += block.word_hashes()[-len(words):].tolist()
        assert len(set(keys)) == len(words)
        seen.append(keys)
    assert seen[0] == seen[1]
