"""The corpus build.

items -> quarantine -> score/length/bot gates -> main text + topic ->
first-wins near-duplicate removal -> templated chat examples -> union with
preformatted examples -> seeded shuffle -> exact 95/5 split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow import schemas as S
from corpusflow.operators.chatfmt import format_examples
from corpusflow.operators.counts import observed
from corpusflow.operators.dedup import dedup
from corpusflow.operators.quality import passes_filter, with_texts
from corpusflow.operators.split import global_position, seeded_order, split_grouped, split_of, train_rows
from corpusflow.session import written
from corpusflow.sources.readers import split_quarantine


@dataclass
class CorpusResult:
    examples: DataFrame      # origin, ord, messages, pos, split
    quarantine: DataFrame
    stages: DataFrame        # stage, n


def clean_filter(items: DataFrame) -> DataFrame:
    """F9 then P1/P3: passing items with ``text`` and ``topic``."""
    return with_texts(passes_filter(items))


def answer_text(messages: str) -> F.Column:
    """The last message's content: what a grouped split must not spread."""
    return F.try_element_at(F.col(messages), F.lit(-1))["content"]


def build_corpus(items: DataFrame, synthetic: DataFrame | None = None, system_prompt: str = K.DEFAULT_SYSTEM_PROMPT,
                 seed: int = K.SEED, mode: str = "reference", split: str = "exact") -> CorpusResult:
    # A1: every stage's rows are counted by the job that computes them
    raw, n_raw = observed(items)
    if S.CORRUPT in items.columns:
        good, bad = split_quarantine(raw)[0], split_quarantine(items)[1]
    else:
        good, bad = raw, items.limit(0).withColumn("reason", F.lit(None).cast("string"))

    # written once: it feeds the dedup and the formatting
    kept, n_kept = observed(clean_filter(good).select("id", "ord", "text", "topic"))
    kept = written(kept, "corpus-kept")
    deduped, n_deduped = observed(dedup(kept, "text", "ord", mode=mode))

    examples = format_examples(deduped, system_prompt=system_prompt, key="ord", seed=seed).select(
        F.lit("item").alias("origin"), "ord", "messages"
    )
    n_synthetic = None
    if synthetic is not None:
        synthetic, n_synthetic = observed(synthetic.select(F.lit("synthetic").alias("origin"), "ord", "messages"))
        examples = examples.unionByName(synthetic)

    key = F.concat_ws(":", F.col("origin"), F.col("ord").cast("string"))
    n_train = None
    if split == "grouped":  # by the answer; positions are numbered as in the exact split
        examples, n_train = observed(split_grouped(examples, answer_text("messages"), seed=seed), F.col("split") == "train")
    elif split != "exact":
        raise ValueError(f"unknown split {split!r}")
    ordered, n_all = observed(seeded_order(examples, key, seed))
    ordered = written(ordered, "corpus-ordered")
    total = n_all.get["n"]
    train = n_train.get["n"] if n_train else train_rows(total)
    out = global_position(ordered, total)
    out = out if n_train else out.withColumn("split", split_of(F.col("pos"), train))

    stages = [("raw", n_raw.get["n"]), ("filtered", n_kept.get["n"]), ("deduped", n_deduped.get["n"])]
    if n_synthetic is not None:
        stages.append(("synthetic", n_synthetic.get["n"]))
    # a split without rows has a count of zero
    stages += [("train", train), ("val", total - train)]
    return CorpusResult(examples=out, quarantine=bad, stages=items.sparkSession.createDataFrame(stages, "stage string, n long"))


def write_corpus(result: CorpusResult, out_dir: str, ascii_escape: bool = False) -> None:
    """K2: ``train`` and ``val`` JSONL folders in shuffled order.

    Rows are range-partitioned on the position and sorted inside each
    partition, so the part files read back in order.
    """
    for name in ("train", "val"):
        part = result.examples.where(F.col("split") == name)
        (
            part.repartitionByRange("pos").sortWithinPartitions("pos").select("messages")
            .write.mode("overwrite")
            .option("writeNonAsciiCharacterAsCodePoint", str(ascii_escape).lower())
            .json(f"{out_dir}/{name}")
        )
