"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import sql
from corpusflow.llm.byte_repeats import remove_repeats
from corpusflow.llm.conversations import maximal_conversations
from corpusflow.llm.exact_dedup import exact_dedup
from corpusflow.llm.hard_negatives import hard_negatives, mined
from corpusflow.llm.language_id import held_out, identify, training_sample
from corpusflow.llm.lexical_search import search
from corpusflow.llm.near_dedup import near_dedup
from corpusflow.llm.packing import pack
from corpusflow.llm.passages import passages
from corpusflow.llm.quality_rules import quality_rules
from corpusflow.llm.simhash import simhash_dedup
from corpusflow.llm.store import new_folder
from corpusflow.llm.token_files import read_shards, write_shards
from corpusflow.llm.tokens import encode_decode

#: The byte-level vocabulary: tokenizers file, ranks of the same vocabulary, split pattern.
BYTE_BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: passages that an earlier document holds too."""
    return passages(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: BPE by a heap over linked symbols, and back."""
    return encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of every document, packed along the Hilbert curve."""
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: write wavelet-matrix shards, then read every document back."""
    folder = new_folder(spark, "token-files")
    write_shards(table(spark, sf_dir, "documents"), f"{folder}/shards", WORD_BPE).write.parquet(f"{folder}/manifest")
    return read_shards(spark, spark.read.parquet(f"{folder}/manifest"), f"{folder}/shards")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: the language of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    samples = training_sample(docs.where(~held_out()), "text", "lang")
    out = identify(docs, samples)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrases")


def op6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: rendered conversations that are no snapshot of a longer one."""
    return maximal_conversations(table(spark, sf_dir, "conversations"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: the group and the keeper of every document."""
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: what is left of every document without repeated 400-byte strings."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: the class of near-duplicates of every document."""
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: figures and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("covered_words", "longest_repeat")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: the ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: the fingerprint of every document and its component."""
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: the hard negatives of every anchor and positive."""
    return hard_negatives(mined(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_passages": op1_passages,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_language_id": op5_language_id,
    "op6_conversations": op6_conversations,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_repeats": op8_byte_repeats,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_simhash": op12_simhash,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op6_conversations": sql.OP6,
    "op7_exact_dedup": sql.OP7,
    "op10_quality_rules": sql.OP10,
    "op11_lexical_search": sql.OP11,
    "op13_hard_negatives": sql.OP13,
}
