"""Ranked lexical search with a limited set of accumulators (operator 11).

Terms are runs of ASCII letters and digits and of all other non-ASCII
characters; A-Z are folded.  One pass over the documents writes an index that
holds, per document, its length and its occurrences of the items' terms; the
counts of the whole corpus (documents, terms, documents of each term) follow
from it.  Each task then ranks its part of the documents term at a time:

* an item's terms go from the rarest to the most frequent;
* every posting adds to its document's accumulator, or creates it, until what
  the terms still to come can add at most is less than the k-th best partial
  score: a document without an accumulator can then not be among the first k,
  so no more are created;
* the accumulators there are get their exact sums from the remaining terms.

The k-th score that a task has reached in earlier documents bounds the later
ones too.  Each task sends its first k of each item, and Spark ranks those.
No postings are shuffled.  Items are taken in blocks of about
``ITEM_CHARS`` characters, each block a pass over the documents, so what is
collected and broadcast is bounded by the block (and by the longest item).

Scores are 64-bit integers.  Defined results: a null text has no terms; an item
without terms, or whose terms no document holds, returns nothing; each row of
the items and of the documents stands for itself, also where identifiers are
missing or repeat; documents of equal scores come by identifier (missing ones
last), then in the order of the index; other columns never matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusflow.llm.store import stored
from corpusflow.llm.words import Block, U, blocks

#: Characters of the items taken in one pass, about.
ITEM_CHARS = 4_000_000

_TERM = np.ones(256, dtype=bool)
_TERM[:128] = [chr(c).isalnum() for c in range(128)]


def term_counts(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term key, occurrences), distinct and sorted by text, and the number
    of terms of each text."""
    start, end = block.runs(_TERM[block.data])
    key = block.span_hash(block.running(True), start, end)
    doc = np.searchsorted(block.off, start, side="right") - 1
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(key))), np.bincount(doc, minlength=block.n_docs)


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    off = np.append(0, np.cumsum(np.bincount(owner, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(row, keys, counts): the distinct terms of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, block in blocks(batch.column(1)):
                doc, key, count, _ = term_counts(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), _lists(doc, end - row, key.view(np.int64), pa.int64()),
                     _lists(doc, end - row, count, pa.int64())], ["row", "keys", "counts"])

    return items.select("row", text_col).mapInArrow(run, "row long, keys array<long>, counts array<long>")


def term_index(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n_terms, terms, counts): per document its number of terms and
    its occurrences of the terms of a sorted vocabulary, by their place there."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of one block of items
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for row, end, block in blocks(batch.column(2)):
                doc, key, count, n = term_counts(block)
                at = np.searchsorted(known, key)
                at[at == len(known)] = 0
                hit = known[at] == key if len(known) else np.zeros(len(key), dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(n, pa.int64()),
                     _lists(doc[hit], end - row, at[hit], pa.int32()), _lists(doc[hit], end - row, count[hit], pa.int32())],
                    ["doc_id", "row", "n_terms", "terms", "counts"])

    numbered = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return numbered.mapInArrow(run, f"doc_id {kind}, row long, n_terms long, terms array<int>, counts array<int>")


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of a vocabulary of that size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    for row in index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


class Postings:
    """The inverted lists of a batch of index rows, with each posting's impact."""

    def __init__(self, batch: pa.RecordBatch, n_docs: int, n_terms: int, size: int):
        terms = batch.column("terms")
        term = terms.flatten().to_numpy(zero_copy_only=False)
        tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
        n = batch.column("n_terms").to_numpy(zero_copy_only=False).astype(np.int64)
        m = 100 - 75 + (75 * n * n_docs) // max(n_terms, 1)
        order = np.argsort(term, kind="stable")
        self.doc, tf = doc[order], tf[order]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        self.at = np.searchsorted(term[order], np.arange(size + 1))
        self.most = np.zeros(size, dtype=np.int64)  # the largest impact of each term
        used = np.flatnonzero(np.diff(self.at))
        if len(used):
            self.most[used] = np.maximum.reduceat(self.impact, self.at[used])
        self.rows = batch.num_rows

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.at[term], self.at[term + 1]
        return self.doc[lo:hi], self.impact[lo:hi]


def accumulate(post: Postings, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, exact scores) of all that may be among the first k with at
    least ``floor``; ``terms`` from the rarest, each with its weight."""
    bound = weights * post.most[terms]
    terms, weights, bound = terms[bound > 0], weights[bound > 0], bound[bound > 0]
    rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what the terms from each on can add at most
    acc = np.zeros(post.rows, dtype=np.int64)
    done = len(terms)
    for j, (term, w) in enumerate(zip(terms.tolist(), weights.tolist())):
        if rest[j] < floor or (j and rest[j] < acc.max() and rest[j] < _kth(acc, k)):
            done = j
            break
        doc, impact = post.of(term)
        acc[doc] += w * impact
    alive = np.flatnonzero(acc)
    score = acc[alive]
    if len(alive):
        for term, w in zip(terms[done:].tolist(), weights[done:].tolist()):
            doc, impact = post.of(term)
            at = np.searchsorted(doc, alive)
            at[at == len(doc)] = 0
            hit = doc[at] == alive
            score[hit] += w * impact[at[hit]]
    least = max(floor, _kth(score, k), 1)
    return alive[score >= least], score[score >= least]


def _kth(score: np.ndarray, k: int) -> int:
    """The k-th largest, 0 where there are fewer."""
    return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    asked = stored(items.select(F.col(item_col).alias("item_id"), F.monotonically_increasing_id().alias("row"),
                                F.col(item_text_col).alias("text")), "search-items")
    n_blocks = max(1, math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / ITEM_CHARS))
    found = []
    for b in range(n_blocks):
        some = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b)
        found.append(_search_block(docs, some, k, id_col, text_col))
    best = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select(F.col("row").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, doc_id, row, score): the first k of each task for each item."""
    spark = docs.sparkSession
    asked = [(r.row, np.array(r["keys"], dtype=np.int64).view(U), np.array(r["counts"], dtype=np.int64))
             for r in item_terms(items, "text").collect() if r["keys"]]
    vocabulary = np.unique(np.concatenate([key for _, key, _ in asked])) if asked else np.zeros(0, dtype=U)
    size = len(vocabulary)
    index = stored(term_index(docs, vocabulary, id_col, text_col), "search-index")
    total = index.agg(F.sum((F.col("n_terms") > 0).cast("long")).alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = total.docs or 0, total.terms or 0
    df = document_counts(index, size)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    plan = []
    for item, key, count in asked:
        term = np.searchsorted(vocabulary, key)
        order = np.argsort(df[term], kind="stable")
        plan.append((item, term[order], (weight[term] * count)[order]))
    sent = spark.sparkContext.broadcast(plan)  # the terms of one block of items
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {item: [] for item, _, _ in sent.value}
        for batch in batches:
            post = Postings(batch, n_docs, n_terms, size)
            ids, rows = batch.column("doc_id"), batch.column("row")
            for item, terms, weights in sent.value:
                have = best[item]
                doc, score = accumulate(post, terms, weights, k, -have[-1][0] if len(have) == k else 0)
                if len(doc):
                    at = pa.array(doc)
                    # missing identifiers come after all others
                    more = [(s, i is None, 0 if i is None else i, r)
                            for s, i, r in zip((-score).tolist(), ids.take(at).to_pylist(), rows.take(at).to_pylist())]
                    best[item] = heapq.nsmallest(k, have + more)
        flat = [(item, None if none else i, r, -s) for item, rows_ in best.items() for s, none, i, r in rows_]
        yield pa.RecordBatch.from_pydict(dict(zip(["item", "doc_id", "row", "score"], map(list, zip(*flat)) if flat else [[]] * 4)), schema)

    found = StructType.fromDDL(f"item long, doc_id {kind}, row long, score long")
    schema = to_arrow_schema(found)
    return index.mapInArrow(run, found)
