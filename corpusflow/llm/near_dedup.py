"""Near-duplicate documents by consistent weighted sampling (operator 9).

Shingles are five words (ASCII case folded); a text of one to four words is
one shingle.  A shingle's weight is its count times 1 plus a share of its
inverse document frequency, counted over all documents in a fixed table of
hashed buckets.  Improved consistent weighted sampling (Ioffe, 2010) draws ``SAMPLES``
shingle-and-level pairs per text so that two texts agree on each with
probability equal to their weighted Jaccard similarity; ``BANDS`` bands of
``SAMPLES / BANDS`` draws are the blocking keys.

Texts with equal words are collapsed first.  In each band bucket every text is
paired with two centres (random per bucket), and the pairs that pass the weight
bound are verified by exact weighted Jaccard on whole texts; a large group of
near copies costs two pairs per member.  Buckets whose texts then still lie in
different classes go on: over the texts in them, a shingle that only one text
holds can be in no intersection, so the weight of such shingles bounds every
similarity of its text.  Texts that the bound sets apart from all others leave;
the rest are compared with the bucket's text of least such weight.  As one minus
the weighted Jaccard similarity is a metric, two texts whose distances from that
middle differ by more than 0.2 cannot be similar; and a histogram of the shingles'
weights over hashed buckets bounds what two texts can have in common.  What is
left and still differs in class is compared across classes, each pair in the
first band it shares.  So
every candidate pair of different texts in one bucket is in one class already,
ruled out by an exact bound, or verified.  Classes are the connected components.

Defined results: a null or empty text, or one without words, is a class of its
own; ties keep the smallest identifier; where identifiers are missing or
repeat, every row is a document (of equal identifiers the row stored first
stays); an empty table gives an empty table; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.store import components, fresh, row_keyed, stored
from corpusflow.llm.words import Block, U, blocks, mix

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, BANDS = 30, 10
#: Share of the inverse frequency in a weight.  A larger share would make the few
#: words in which the members of a very large group differ outweigh all they share.
IDF_PART = 0.25
#: Document-frequency buckets (a fixed table of 2^20 counts, whatever the input).
DF_BITS = 20
_SLICE = 4096


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), distinct and sorted by text and hash."""
    words = block.word_hashes(fold_case=True)
    first, n_words = block.word_off[:-1], np.diff(block.word_off)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    padded = np.append(words, np.zeros(SHINGLE - 1, dtype=U))
    gram = np.zeros(len(words), dtype=U)
    for j in range(SHINGLE):
        gram *= U(0xA24BAED4963EE407)
        gram += padded[j: j + len(words)]
    doc = block.word_doc
    place = np.arange(len(words)) - first[doc]
    whole = place + SHINGLE <= n_words[doc]
    if len(short):  # the words there are, zeros for the rest
        some = np.zeros(len(short), dtype=U)
        for j in range(SHINGLE):
            some *= U(0xA24BAED4963EE407)
            fits = n_words[short] > j
            some[fits] += words[first[short][fits] + j]
        gram[first[short]] = some
        whole[first[short]] = True
    gram, doc = mix(gram[whole], SHINGLE), doc[whole]
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    fresh = np.ones(len(gram), dtype=bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], gram[at], np.diff(np.append(at, len(gram)))


def bucket(gram: np.ndarray) -> np.ndarray:
    return (gram >> U(64 - DF_BITS)).astype(np.int64)


def document_frequency(docs: DataFrame, text_col: str) -> np.ndarray:
    """Documents per shingle bucket over all rows; the last entry is their number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << DF_BITS) + _SLICE, dtype=np.int64)
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                doc, gram, _ = shingles(block)
                total[: 1 << DF_BITS] += np.bincount(bucket(gram), minlength=1 << DF_BITS)
                total[1 << DF_BITS] += len(np.unique(doc))
        salt = TaskContext.get().partitionId() % 64
        parts = total.reshape(-1, _SLICE)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), salt, np.int32)), pa.array([parts[k].tobytes() for k in used], pa.binary())],
            ["part", "salt", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in pdf["counts"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "salt": [0], "counts": [total.tobytes()]})

    schema = "part int, salt int, counts binary"
    counted = docs.select(text_col).mapInArrow(count, schema)
    summed = counted.groupBy("part", "salt").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema)
    out = np.zeros((1 << DF_BITS) + _SLICE, dtype=np.int64)
    for row in summed.collect():  # at most 257 slices of 32 KB
        out[row.part * _SLICE: (row.part + 1) * _SLICE] = np.frombuffer(row.counts, dtype=np.int64)
    return out[: (1 << DF_BITS) + 1]


def inverse_frequency(df: np.ndarray) -> np.ndarray:
    """Weight of one occurrence by bucket: 1 for a shingle of all documents,
    1 + IDF_PART for one of a single document."""
    n = max(int(df[-1]), 1)
    return (1 + IDF_PART * np.log1p(n / np.maximum(df[:-1], 1)) / np.log1p(n)).astype(np.float32)


def _gamma2_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at 2^16 midpoints."""
    x = np.concatenate([np.geomspace(1e-6, 1, 20000), np.linspace(1, 30, 200000)[1:]])
    p = 1 - np.exp(-x) * (1 + x)
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), p, x).astype(np.float32)


_tables: list[np.ndarray] = []


def samples(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of the texts that have shingles, one row each."""
    if not _tables:
        g = _gamma2_quantiles()
        _tables.extend([g, np.log(g)])
    gamma, log_gamma = _tables
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(doc)))
    owner = np.repeat(np.arange(len(start)), size)
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(start), SAMPLES), dtype=U)
    for j in range(SAMPLES):
        z = mix(gram, j + 1)
        r = gamma[(z & U(0xFFFF)).astype(np.int64)]
        log_c = log_gamma[((z >> U(16)) & U(0xFFFF)).astype(np.int64)]
        beta = (z >> U(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(log_a, start) if len(start) else np.zeros(0, np.float32)
        hit = np.flatnonzero(log_a == least[owner])
        hit = hit[np.unique(owner[hit], return_index=True)[1]]  # of ties, the smaller hash
        out[:, j] = mix(gram[hit] + t[hit].astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15), 5)
    return out


def signatures(docs: DataFrame, idf: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, c1, c2 (hash of the words in order), weight, bands; nulls without words."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)
    rows = SAMPLES // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf_ = sent.value
        for batch in batches:
            for row, end, block in blocks(batch.column(1)):
                doc, gram, count = shingles(block)
                weight = count * idf_[bucket(gram)]
                sig = samples(doc, gram, weight)
                have = np.unique(doc)
                key = np.zeros((len(have), BANDS), dtype=U)
                for b in range(BANDS):
                    for j in range(rows):
                        key[:, b] = mix(key[:, b] ^ sig[:, b * rows + j], b)
                words = block.word_hashes(fold_case=True)
                place = (np.arange(len(words)) - block.word_off[:-1][block.word_doc]).astype(U)
                total = np.bincount(doc, weights=weight, minlength=block.n_docs)
                n = block.n_docs
                mask = np.ones(n, dtype=bool)
                mask[have] = False
                content = []
                for seed in (11, 12):
                    run_ = np.zeros(len(words) + 1, dtype=U)
                    np.cumsum(mix(words ^ mix(place, seed), seed), out=run_[1:])
                    content.append(pa.array((run_[block.word_off[1:]] - run_[block.word_off[:-1]]).view(np.int64), mask=mask))
                ends = np.cumsum(~mask) * BANDS
                bands = pa.ListArray.from_arrays(
                    pa.array(np.append(0, ends).astype(np.int32)), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), *content, pa.array(total), bands], ["doc_id", "c1", "c2", "weight", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, c1 long, c2 long, weight double, bands array<long>")


def weighted_jaccard(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard of the texts of two columns, row by row."""
    out = np.zeros(len(left))
    row = 0
    while row < len(left):  # rows whose two texts fit a block
        size = 1
        room = len(left[row].as_py() or "") + len(right[row].as_py() or "")
        while row + size < len(left) and room < (1 << 20):
            room += len(left[row + size].as_py() or "") + len(right[row + size].as_py() or "")
            size += 1
        sides = []
        for col in (left, right):
            for _, _, block in blocks(col.slice(row, size), 1 << 62):
                doc, gram, count = shingles(block)
                sides.append((doc, gram, count * idf[bucket(gram)].astype(np.float64)))
        (d1, g1, w1), (d2, g2, w2) = sides
        doc, gram, w = np.concatenate([d1, d2]), np.concatenate([g1, g2]), np.concatenate([w1, w2])
        order = np.lexsort((gram, doc))
        doc, gram, w = doc[order], gram[order], w[order]
        same = (doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1])
        common = np.bincount(doc[1:][same], weights=np.minimum(w[1:], w[:-1])[same], minlength=size)
        total = np.bincount(doc, weights=w, minlength=size)
        out[row: row + size] = np.divide(common, total - common, out=np.zeros(size), where=total > common)
        out[row: row + size][(total > 0) & (total <= common * (1 + 1e-12))] = 1.0
        row += size
    return out


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts have at least that similarity, with it.

    ``texts`` holds rep and text of all texts in question.  The weight bound
    passed before, so a text that many pairs share is at most 1 / 0.8 times as
    heavy as each partner.
    """
    sent = texts.sparkSession.sparkContext.broadcast(idf)  # a fixed table
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = weighted_jaccard(batch.column("ta"), batch.column("tb"), sent.value)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim)], ["a", "b", "similarity"])
            yield out.filter(pa.array(sim >= least))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


#: Slack for sums of floats in the bounds.
_SLACK = 1e-6


def _bounded(pairs: DataFrame) -> DataFrame:
    """Pairs (a, wa, b, wb) whose weights allow the similarity: min / max bounds it."""
    return pairs.where((F.col("a") != F.col("b")) & (F.least("wa", "wb") >= SIMILARITY * (1 - _SLACK) * F.greatest("wa", "wb"))).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _own_weight(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(rep, u): weight of the shingles that no other of these texts holds."""
    sent = texts.sparkSession.sparkContext.broadcast(idf)  # a fixed table
    kind = texts.schema["rep"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, block in blocks(batch.column("text")):
                doc, gram, count = shingles(block)
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram.view(np.int64)), batch.column("rep").take(pa.array(row + doc)),
                    pa.array(count * sent.value[bucket(gram)], pa.float32())], ["gram", "rep", "w"])

    rows = texts.select("rep", "text").mapInArrow(split, f"gram long, rep {kind}, w float")
    alone = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.first("rep").alias("rep"), F.first("w").alias("w")).where("n = 1")
    return alone.groupBy("rep").agg(F.sum(F.col("w").cast("double")).alias("u"))


#: Buckets of a weight histogram: a fixed size, whatever the text.
HISTOGRAM = 256


def weight_histograms(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(rep, hist): the weight of each text's shingles per hashed bucket, rounded
    up.  Two texts have at most the sum of the smaller ones in common."""
    sent = texts.sparkSession.sparkContext.broadcast(idf)  # a fixed table
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, block in blocks(batch.column("text")):
                doc, gram, count = shingles(block)
                at = doc * HISTOGRAM + (gram & U(HISTOGRAM - 1)).astype(np.int64)
                hist = np.bincount(at, weights=count * sent.value[bucket(gram)].astype(np.float64), minlength=(end - row) * HISTOGRAM)
                off = np.arange(0, (end - row + 1) * HISTOGRAM, HISTOGRAM, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(row, end - row),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(hist * (1 + _SLACK), pa.float32()))], ["rep", "hist"])

    return texts.select("rep", "text").mapInArrow(run, f"rep {kind}, hist array<float>")


def _mixed(placed: DataFrame) -> DataFrame:
    """Buckets whose texts lie in several classes."""
    return placed.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "key")


def _placed(keys: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    return keys.drop("root").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _across(rest: DataFrame, reps: DataFrame, texts: DataFrame, idf: np.ndarray, tested: DataFrame) -> DataFrame:
    """All links, once buckets (band, key, rep, w, root) that hold several classes
    are settled; ``tested`` has the pairs compared so far."""
    # similarity s needs a common weight of s / (1 + s) of both weights together
    part = SIMILARITY / (1 + SIMILARITY) * (1 - _SLACK)
    own = _own_weight(texts.join(rest.select("rep").distinct(), "rep", "left_semi"), idf)
    free = rest.join(own, "rep", "left").withColumn("m", F.col("w") - F.coalesce("u", F.lit(0.0))).where(
        F.col("m") >= part * (1 + SIMILARITY) * F.col("w")).drop("u")
    free = stored(free.join(_mixed(free), ["band", "key"]), "near-free")

    def allowed(a: str, b: str) -> Column:
        return F.least(f"m{a}", f"m{b}") >= part * (F.col(f"w{a}") + F.col(f"w{b}"))

    middle = free.groupBy("band", "key").agg(F.min(F.struct((-F.col("m") / F.col("w")).alias("f"), "rep")).alias("c")).select(
        "band", "key", F.col("c.rep").alias("mid"))
    free = stored(free.join(middle, ["band", "key"]), "near-middle")
    pairs = free.where("rep <> mid").select(F.greatest("rep", "mid").alias("a"), F.least("rep", "mid").alias("b")).distinct()
    pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    known = stored(verified(pairs, texts, idf, least=0.0).unionByName(tested), "near-known")
    more = known.where(F.col("similarity") >= SIMILARITY)

    free = _placed(free, more).join(reps.select("rep", "bands"), "rep")
    far = known.select(F.col("a").alias("x"), F.col("b").alias("y"), (1 - F.col("similarity")).alias("d"))
    free = free.join(far, (F.greatest("rep", "mid") == F.col("x")) & (F.least("rep", "mid") == F.col("y")), "left").drop("x", "y")
    free = free.withColumn("d", F.coalesce("d", F.lit(0.0)))  # only the middle itself is in no pair
    free = stored(free.join(_mixed(free), ["band", "key"]), "near-free")
    if free.isEmpty():
        return more
    hist = weight_histograms(texts.join(free.select("rep").distinct(), "rep", "left_semi"), idf)
    free = stored(free.join(hist, "rep"), "near-histograms")
    one = free.select("band", "key", F.col("hist").alias("ha"), F.col("rep").alias("a"), F.col("w").alias("wa"), F.col("m").alias("ma"), F.col("d").alias("da"), "root", "bands")
    two = free.select("band", "key", F.col("hist").alias("hb"), F.col("rep").alias("b"), F.col("w").alias("wb"), F.col("m").alias("mb"), F.col("d").alias("db"),
                      F.col("root").alias("root_b"), F.col("bands").alias("bands_b"))
    shared = F.zip_with("bands", "bands_b", lambda x, y: x == y)
    common = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    cross = one.join(two, (one["band"] == two["band"]) & (one["key"] == two["key"]) & (F.col("root") > F.col("root_b"))
                     & allowed("a", "b") & (F.abs(F.col("da") - F.col("db")) <= 1 - SIMILARITY + _SLACK)
                     & (F.array_position(shared, True) == one["band"] + 1)
                     & (common >= part * (F.col("wa") + F.col("wb"))))
    cross = _bounded(cross).join(known.select("a", "b"), ["a", "b"], "left_anti")
    return more.unionByName(verified(cross, texts, idf))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest of the class),
    class_size, n_links (verified links of its words to other texts), kept."""
    keyed, key = row_keyed(docs.select(id_col, text_col), id_col)
    out = _near_dedup(keyed, key, text_col)
    if key != id_col:
        names = keyed.select(F.col(key).alias("row"), F.col(id_col).alias("name"))
        named = out.join(names, F.col("doc_id") == F.col("row"))
        best = named.groupBy(F.col("class_id").alias("c")).agg(F.min(F.struct(F.col("name").isNull(), "name", "row")).alias("m"))
        out = named.join(best, F.col("class_id") == F.col("c")).select(
            F.col("name").alias("doc_id"), F.col("m.name").alias("class_id"), "class_size", "n_links",
            (F.col("row") == F.col("m.row")).alias("kept"))
    return out


def _near_dedup(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    idf = inverse_frequency(document_frequency(docs, text_col))
    sig = stored(signatures(docs, idf, id_col, text_col), "near-signatures")
    reps = stored(
        sig.where("c1 is not null").groupBy("c1", "c2").agg(
            F.min("doc_id").alias("rep"), F.first("weight").alias("w"), F.first("bands").alias("bands")),
        "near-texts-distinct")
    keys = reps.select("rep", "w", F.posexplode("bands").alias("band", "key"))
    centres = keys.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.struct(F.xxhash64("rep", "band", F.lit(k)).alias("h"), "rep", "w")).alias(f"c{k}") for k in (0, 1)],
    ).where("n > 1").select("band", "key", "c0", "c1")
    grouped = stored(keys.join(centres, ["band", "key"]), "near-buckets")
    names = grouped.select("rep").distinct()
    # both sides grow with the input, so they are joined alike at every size
    texts = stored(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(names.hint("merge"), "rep"), "near-texts")
    star = grouped.select(F.col("rep").alias("a"), F.col("w").alias("wa"), F.explode(F.array("c0", "c1")).alias("c")).select(
        "a", "wa", F.col("c.rep").alias("b"), F.col("c.w").alias("wb"))
    # every pair is compared once: what was compared stays in a table
    tested = stored(verified(_bounded(star), texts, idf, least=0.0), "near-tested")
    links = tested.where(F.col("similarity") >= SIMILARITY)

    placed = stored(_placed(grouped.select("band", "key", "rep", "w"), links), "near-placed")
    rest = stored(placed.join(_mixed(placed), ["band", "key"]), "near-mixed")
    if not rest.isEmpty():
        links = stored(_across(rest, reps, texts, idf, tested), "near-links")
    roots = stored(components(links), "near-roots")

    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    classes = reps.select("c1", "c2", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").select(
        "c1", "c2", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = sig.where("c1 is not null").select("doc_id", "c1", "c2").join(classes, ["c1", "c2"]).select("doc_id", "class_id", "n_links")
    alone = sig.where("c1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    rows = rows.unionByName(alone)
    size = rows.groupBy(F.col("class_id").alias("c")).agg(F.count(F.lit(1)).alias("class_size"))
    return rows.join(size, F.col("class_id").eqNullSafe(F.col("c"))).select(
        "doc_id", "class_id", "class_size", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class (the smallest identifier), with all columns."""
    columns = docs.columns
    docs, key = row_keyed(docs, id_col)
    own = fresh(docs, "kept_id")
    if key == id_col:
        kept = near_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(own))
    else:  # rows stand for themselves; the smallest identifier of a class is found by name
        out = _near_dedup(docs.select(key, text_col), key, text_col)
        names = docs.select(F.col(key).alias("row"), F.col(id_col).alias("name"))
        named = out.join(names, F.col("doc_id") == F.col("row"))
        kept = named.groupBy("class_id").agg(F.min(F.struct(F.col("name").isNull(), "name", "row"))["row"].alias(own)).select(own)
    return docs.join(kept, F.col(key) == F.col(own), "left_semi").select(*columns)
