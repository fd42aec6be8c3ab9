"""Language identification by cross-parsing (operator 5).

For each language a suffix automaton is built over labelled text.  A text is
parsed against each automaton into the longest phrases that occur in that
language's text (Ziv and Merhav, 1993); the language that needs the fewest
phrases for its characters wins.  Texts are folded before: lower case, every
run of characters that are not letters is one space, letters that no language
was seen with are one common mark.

The automata are fitted on a bounded sample: per language the labelled texts
of ``SAMPLE_ROWS`` different ones (those with the smallest hash), of which
at most ``SAMPLE_CHARS`` characters are kept.  Predictions read every text
whole.  So that the characters of a batch are parsed side by side, a text is
parsed in blocks of ``BLOCK`` characters, and a phrase ends with its block; the
same holds for all languages.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if there is no labelled text at all; ties go to the language that sorts first;
the score is the winner's share of the inverse phrase counts, 1 for a single
language; equal texts get equal predictions.  Languages are few: a row with a
null label teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS, SAMPLE_CHARS, BLOCK = 64, 40_000, 512
UNDETERMINED = "und"
_CODES = 0x110000


def _fold_table() -> np.ndarray:
    """Code point -> folded code point; 32 for everything but letters."""
    table = np.full(_CODES, 32, dtype=np.int32)
    for c in range(_CODES):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0])
    return table


_fold: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    """Code points of the folded text, without leading or trailing spaces."""
    if not _fold:
        _fold.append(_fold_table())
    codes = _fold[0][np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    return codes[int(len(codes) > 0 and codes[0] == 32): len(codes) - int(len(codes) > 1 and codes[-1] == 32)]


class Transitions:
    """(state, symbol) -> state in an open hash table a quarter full, so its size
    follows the transitions there are, whatever the alphabet."""

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray):
        bits = max(4, (4 * len(to)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.to = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        key = (state.astype(np.int64) << 21) | symbol
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.keys[at[left]] < 0
            _, one = np.unique(at[left][free], return_index=True)
            put = left[free][one]  # of several for a slot, one
            self.keys[at[put]], self.to[at[put]] = key[put], to[put]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is no transition."""
        key = (state.astype(np.int64) << 21) | symbol
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.to[at], np.int32(-1))
        left = np.flatnonzero((got != key) & (got >= 0))
        key, at, flat = key.ravel(), at.ravel(), out.ravel()
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got = self.keys[at[left]]
            hit = got == key[left]
            flat[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (got >= 0)]
        return flat.reshape(out.shape)


def suffix_automaton(symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Transitions of the suffix automaton of a symbol sequence (state, symbol,
    next state) and the number of states; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    n = sum(map(len, nxt))
    state = np.repeat(np.arange(len(nxt)), list(map(len, nxt)))
    symbol = np.fromiter((c for moves in nxt for c in moves), dtype=np.int64, count=n)
    to = np.fromiter((t for moves in nxt for t in moves.values()), dtype=np.int64, count=n)
    return state, symbol, to, len(nxt)


class CrossParser:
    """The automata of all languages, one after another in one table."""

    def __init__(self, samples: list[tuple[str, list[str]]]):
        self.langs = [lang for lang, _ in samples]
        texts = [np.concatenate([np.append(folded(t), 32) for t in own]) if own else np.zeros(0, np.int32) for _, own in samples]
        letters = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.int32)
        self.symbol = np.zeros(_CODES, dtype=np.int32)  # 0: any other letter
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        parts = [suffix_automaton(self.symbol[t].tolist()) for t in texts]
        self.start = np.append(0, np.cumsum([n for *_, n in parts]))[:-1].astype(np.int32) if parts else np.zeros(0, np.int32)
        self.dead = sum(n for *_, n in parts)  # a state without any transition
        none = np.zeros(0, dtype=np.int64)
        self.next = Transitions(
            np.concatenate([none, *[s + b for (s, _, _, _), b in zip(parts, self.start)]]),
            np.concatenate([none, *[c for _, c, _, _ in parts]]),
            np.concatenate([none, *[t + b for (_, _, t, _), b in zip(parts, self.start)]]))
        # where each symbol leads from each start
        every = np.arange(len(letters) + 1)
        first = self.next.find(np.repeat(self.start[:, None], len(every), axis=1), np.repeat(every[None, :], len(parts), axis=0))
        self.first = np.where(first < 0, self.dead, first).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language (texts by languages)."""
        n_lang = len(self.langs)
        out = np.zeros((len(texts), n_lang), dtype=np.int64)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        if not size.sum() or not n_lang:
            return out
        n_blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        flat = self.symbol[np.concatenate(texts)]
        begin = np.repeat(np.cumsum(size) - size, n_blocks)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        begin = begin + k * BLOCK
        length = np.minimum(BLOCK, np.repeat(size, n_blocks) - k * BLOCK)
        # longest blocks first, so that those still running are a prefix
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        running = np.searchsorted(-length, -np.arange(BLOCK), side="left")
        state = np.repeat(self.start[:, None], len(owner), axis=1)
        count = np.ones((n_lang, len(owner)), dtype=np.int32)
        for step in range(int(length[0])):
            live = int(running[step])
            c = flat[begin[:live] + step]
            to = self.next.find(state[:, :live], c)
            ended = to < 0
            if step:
                count[:, :live] += ended
            # a new phrase starts with this character; one that the language
            # does not have is a phrase by itself
            state[:, :live] = np.where(ended, self.first[:, c], to)
        for lang in range(n_lang):
            out[:, lang] = np.bincount(owner, weights=count[lang], minlength=len(texts)).astype(np.int64)
        return out


def training_sample(labelled: DataFrame, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS,
                    chars: int = SAMPLE_CHARS) -> list[tuple[str, list[str]]]:
    """Per language at most ``rows`` texts and ``chars`` characters (one row per
    language comes to the driver; languages are few)."""
    texts = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # texts by hash, under a threshold that leaves about eight times as many as
    # wanted: ranking never sees a language whole.  Copies have one hash, so the
    # threshold is set by the distinct ones (combined in each task first)
    distinct = texts.select("lang", "h").distinct()
    share = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # languages are few
    if not share:
        return []
    limit = F.create_map(*[F.lit(x) for lang, n in share.items() for x in (lang, 8.0 * rows / n)])
    near = texts.where((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= limit[F.col("lang")])
    near = near.groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies teach once
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= rows)
    before = F.sum(F.char_length("text")).over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    part = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < chars).select(
        "lang", "k", F.substring("text", F.lit(1), (F.lit(chars) - F.col("before")).cast("int")).alias("text"))
    got: dict[str, list[str]] = {}
    for row in part.orderBy("lang", "k").collect():
        got.setdefault(row.lang, []).append(row.text)
    return sorted(got.items())


_parser: dict[int, CrossParser] = {}


def identify(docs: DataFrame, samples: list[tuple[str, list[str]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, phrases (of the winner) and n_symbols per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)  # at most SAMPLE_CHARS per language
    token = hash(str(samples))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser.get(token)
        if parser is None:
            _parser.clear()
            parser = _parser[token] = CrossParser(sent.value)
        for batch in batches:
            col, row = batch.column(1), 0
            while row < len(col):
                texts, held = [], 0
                while row + len(texts) < len(col) and held < (4 << 20):
                    texts.append(folded(col[row + len(texts)].as_py() or ""))
                    held += len(texts[-1])
                count = parser.phrases(texts)
                size = np.array([len(t) for t in texts])
                none = (size == 0) | (len(parser.langs) == 0)
                if len(parser.langs):
                    best = count.argmin(axis=1)
                    inverse = 1.0 / np.maximum(count, 1)
                    score = np.where(none, 0.0, inverse[np.arange(len(best)), best] / inverse.sum(axis=1))
                    pred = [UNDETERMINED if n else parser.langs[b] for n, b in zip(none, best)]
                    phrases = np.where(none, 0, count[np.arange(len(best)), best])
                else:
                    score, pred, phrases = np.zeros(len(texts)), [UNDETERMINED] * len(texts), np.zeros(len(texts), np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(texts)), pa.array(pred), pa.array(score), pa.array(phrases), pa.array(size)],
                    ["doc_id", "lang_pred", "score", "phrases", "n_symbols"])
                row += len(texts)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, phrases long, n_symbols long")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that teaches nothing: crc32 of the identifier as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
