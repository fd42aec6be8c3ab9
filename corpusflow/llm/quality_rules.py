"""Quality rules with suffix-array repetition (operator 10).

Base figures count words, symbols, duplicate lines and repeated 5-word
windows.  The verdict of the method comes from a suffix array over the words
of each text, built by prefix doubling: neighbours in suffix order give the
longest common prefixes, every LCP interval of at least ``MIN_REPEAT`` words
is a maximal repeat, and the union of all its occurrences is the covered part.
A text is rejected when more than ``MAX_COVERED_PCT`` per cent of its words
are covered or when one repeat is longer than ``MAX_REPEAT`` words.

Defined results: a null or empty text has no words (all counts 0) and fails
the base rule; equal rows get equal verdicts; an empty table gives an empty
table; other columns never matter.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusflow.llm.words import Block, U, blocks, inside, mix, repeated, window_hashes

#: Base rule: at least so many words, and at most so many per cent of them in
#: 5-word windows that the text holds twice.
MIN_WORDS, WINDOW, MAX_REPEAT_WORDS_PCT = 10, 5, 20
#: Method: repeats of at least MIN_REPEAT words count as covered.
MIN_REPEAT, MAX_COVERED_PCT, MAX_REPEAT = 8, 20, 60

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)


def suffix_ranks(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of the texts in a block, and the ranks of each doubling step.

    ``levels[k][i]`` is the class of the 2^k words from i; suffixes of
    different texts never share a class, and a suffix that ends early sorts
    before those it prefixes.  Only classes with several members are sorted
    again in the next step.
    """
    n = len(symbols)
    order = np.lexsort((symbols, doc))
    change = np.ones(n, dtype=bool)
    change[1:] = (symbols[order][1:] != symbols[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(change)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    levels, step = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        nxt = open_ + step
        fits = nxt < n
        fits[fits] = doc[nxt[fits]] == doc[open_[fits]]
        second = np.full(len(open_), -1, dtype=np.int64)
        second[fits] = rank[nxt[fits]]
        by = np.lexsort((second, rank[open_]))
        pos, r, s = open_[by], rank[open_[by]], second[by]
        head = np.ones(len(pos), dtype=bool)
        head[1:] = r[1:] != r[:-1]
        fresh = head.copy()
        fresh[1:] |= s[1:] != s[:-1]
        # rank = start of the class + members of it that sort before
        idx = np.arange(len(pos))
        begin = np.maximum.accumulate(np.where(head, idx, 0))
        group = np.maximum.accumulate(np.where(fresh, idx, 0))
        rank = rank.copy()
        rank[pos] = r + (group - begin)
        levels.append(rank)
        step *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def neighbour_lcp(suffixes: np.ndarray, levels: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Longest common prefix, in words, of each suffix with the one before it."""
    n = len(suffixes)
    lcp = np.zeros(n, dtype=np.int64)
    if n < 2:
        return lcp
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    live = doc[a] == doc[b]
    got = np.zeros(n - 1, dtype=np.int64)
    home = doc[a]
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        can = live & (np.maximum(a, b) + (step - 1) < n)
        idx = np.flatnonzero(can)
        idx = idx[(levels[k][a[idx]] == levels[k][b[idx]])]
        # equal classes can mean equal short tails: the whole step must fit
        idx = idx[(doc[a[idx] + step - 1] == home[idx]) & (doc[b[idx] + step - 1] == home[idx])]
        a[idx] += step
        b[idx] += step
        got[idx] += step
        over = np.maximum(a, b) >= n
        live &= ~over
        chk = np.flatnonzero(live)
        live[chk] = (doc[a[chk]] == home[chk]) & (doc[b[chk]] == home[chk])
    lcp[1:] = got
    return lcp


def repeat_cover(words: np.ndarray, doc: np.ndarray, n_docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words covered by repeats of at least ``least`` words, and the longest repeat."""
    n = len(words)
    if not n:
        zero = np.zeros(n_docs, dtype=np.int64)
        return zero, zero.copy()
    suffixes, levels = suffix_ranks(words, doc)
    lcp = neighbour_lcp(suffixes, levels, doc)
    longest_here = np.empty(n, dtype=np.int64)  # longest repeat that starts at a word
    longest_here[suffixes] = np.maximum(lcp, np.append(lcp[1:], 0))
    longest = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(longest, doc, longest_here)
    start = np.flatnonzero(longest_here >= least)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + longest_here[start], -1)
    covered = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)
    return covered, longest


def _lines(block: Block, run: np.ndarray) -> np.ndarray:
    """Per text: \\n-split lines with a word that equal an earlier line."""
    cut = np.union1d(np.flatnonzero(block.data == 0x0A) + 1, block.off[:-1])
    cut = cut[cut < len(block.data)]
    if not len(cut):
        return np.zeros(block.n_docs, dtype=np.int64)
    end = np.append(cut[1:], len(block.data))
    end = end - (block.data[end - 1] == 0x0A)
    solid = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(~block.space, out=solid[1:])
    has_word = solid[end] > solid[cut]
    cut, end = cut[has_word], end[has_word]
    doc = np.searchsorted(block.off, cut, side="right") - 1
    _, later = repeated(mix(block.span_hash(run, cut, end) + doc.astype(U) * U(0x9E3779B97F4A7C15)))
    return np.bincount(doc[later], minlength=block.n_docs)


def figures(block: Block) -> dict[str, np.ndarray]:
    """Every column of the operator for the texts of a block."""
    run = block.running(False)
    words = block.span_hash(run, *block.word_spans)
    doc, n = block.word_doc, block.n_docs
    n_words = np.diff(block.word_off)
    win = window_hashes(words, WINDOW)
    ok = np.flatnonzero(inside(doc, WINDOW))
    twice, _ = repeated(mix(win[ok] + doc[ok].astype(U) * U(0x9E3779B97F4A7C15)))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = ok[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    n_repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    covered, longest = repeat_cover(words, doc, n, MIN_REPEAT)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_WORDS_PCT * n_words)
    bad = (100 * covered > MAX_COVERED_PCT * n_words) | (longest > MAX_REPEAT)
    return {
        "n_words": n_words,
        "word_chars": block.per_doc(~block.space & ((block.data & 0xC0) != 0x80)),
        "n_symbols": block.per_doc(_SYMBOL[block.data]),
        "n_dup_lines": _lines(block, run),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & ~bad,
        "covered_words": covered,
        "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its figures and whether it is kept."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, block in blocks(batch.column(1)):
                got = figures(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), *map(pa.array, got.values())], ["doc_id", *got])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, block in blocks(batch.column(at)):
                yield batch.slice(row, end - row).filter(pa.array(figures(block)["kept"]))

    return docs.mapInArrow(run, docs.schema)
