"""BPE encoding and decoding (operator 2), and the library's encoders.

``WordBpe`` reads a public vocabulary file and does the whole job itself:
special tokens, NFC, white space and case, the split pattern, and merges by a
heap of (rank, position) over a doubly linked list of symbols, skipping
entries that an earlier merge has made stale.  Decoding puts the vocabulary
strings of the ids together, with the single space that the library's
``decode`` puts between tokens where the file names no decoder.

Pieces between white space encode alike wherever they stand, so each worker
keeps a bounded table of them (``piece_table``); a miss is encoded anew.

Defined results: null counts as empty and has no tokens; of pairs of equal
rank the leftmost merges first; empty tables give empty tables; repeated rows
are encoded alike and all returned; other columns never matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusflow.llm.piece_table import PieceTable, batch_ids, word_pieces

#: Split words whose merges a worker keeps; the table starts afresh beyond it.
MAX_WORDS = 300_000

#: FIXED VALUE: the split pattern of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space of the file's normaliser (the library's \\s, without U+001C to U+001F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_split = regex.compile(SPLIT)
_space = re.compile(f"[{SPACE}]+")


def normal(text: str) -> str:
    """NFC, one space for white space, lower case by character (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
    return _space.sub(" ", text).lower()


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies give each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBpe:
    """BPE with word ends from a tokenizers file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.merge = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b])
            for rank, (a, b) in enumerate(model["merges"])
        }
        letters = byte_letters()
        self.first = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.end) for c in letters]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words: dict[str, list[int]] = {}

    def merged(self, word: str) -> list[int]:
        """Ids of one split word."""
        raw = word.encode("utf-8")
        sym = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        sym = [s for s in sym if s is not None]
        n = len(sym)
        if n < 2:
            return sym
        merge = self.merge
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*m, i) for i in range(n - 1) if (m := merge.get((sym[i], sym[i + 1])))]
        queue = [(rank, i, new) for rank, new, i in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new = heapq.heappop(queue)
            j = after[i]
            if sym[i] < 0 or j < 0:
                continue  # stale: merged away, or nothing to its right any more
            m = merge.get((sym[i], sym[j]))
            if m is None or m[1] != new:
                continue  # stale: one of the two has changed
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merge.get((new, sym[k])):
                    heapq.heappush(queue, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merge.get((sym[h], new))):
                heapq.heappush(queue, (m[0], h, m[1]))
        return [s for s in sym if s >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of any text."""
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            for word in _split.findall(normal(part)):
                got = self.words.get(word)
                if got is None:
                    if len(self.words) >= MAX_WORDS:
                        self.words.clear()
                    got = self.words[word] = self.merged(word)
                out += got
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return list(map(self.encode, pieces))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids; the file has no decoder, so the
        library leaves one space between tokens."""
        return " ".join([self.strings[i] for i in ids])


_worker: dict = {}


def word_bpe(path: str) -> tuple[WordBpe, PieceTable]:
    """The encoder and table of this worker."""
    if ("own", path) not in _worker:
        bpe = WordBpe(path)
        _worker["own", path] = bpe, PieceTable(bpe.encode_pieces)
    return _worker["own", path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  full: bool = False) -> DataFrame:
    """Per document: n_tokens, ids_sha256 and decoded_sha256; with ``full`` also
    the ids and the decoded text themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = word_bpe(path)
        for batch in batches:
            for row, end, ids, off in batch_ids(table, batch.column(1), word_pieces):
                wide, off = ids.astype("<u4"), off.tolist()
                rows = []
                for s, e in zip(off, off[1:]):
                    own = ids[s:e].tolist()
                    decoded = bpe.decode(own)
                    rows.append((
                        e - s, hashlib.sha256(wide[s:e]).hexdigest(),
                        hashlib.sha256(decoded.encode("utf-8")).hexdigest(), own, decoded))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["doc_id", *names])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + (", ids array<int>, decoded string" if full else ""))


#: Letters that NFC leaves alone and whose lower case is one of them, and the
#: ASCII marks that begin no contraction and no special token.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_plain = re.compile(f"[{_LATIN}!-&(-;=-~]+")
_plain_words = re.compile(f"[{_LATIN}]+|[0-9]|[!-&(-/:;=-@\\[-`{{-~]+")


def library_words(path: str) -> PieceTable:
    """The tokenizers library over a word-end vocabulary.  Pieces of Latin letters,
    digits and ASCII marks are split as the file's pattern splits them, and the
    library's model encodes each word; other pieces go through the whole library,
    many per call, told apart by a special token that no piece holds."""
    if ("words", path) not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        mark = "<|endoftext|>"
        mark_id = tok.token_to_id(mark)
        model, letters = tok.model, byte_letters()
        spelled = {c: "".join(letters[b] for b in chr(c).encode("utf-8")) for c in range(0x80, 0x100)}

        def encode(pieces: list[str]) -> list[list[int]]:
            out: list[list[int] | None] = [None] * len(pieces)
            plain = []
            for i, p in enumerate(pieces):
                if _plain.fullmatch(p):
                    low = p.lower()
                    out[i] = [t.id for word in _plain_words.findall(low) for t in model.tokenize(word if word.isascii() else word.translate(spelled))]
                elif "<|" in p:
                    out[i] = tok.encode(p, add_special_tokens=False).ids
                else:
                    plain.append(i)
            for lo in range(0, len(plain), 64):
                some = plain[lo: lo + 64]
                ids = tok.encode_batch_fast([mark.join([pieces[i] for i in some])], add_special_tokens=False)[0].ids
                at = 0
                for i in some:
                    try:
                        stop = ids.index(mark_id, at)
                    except ValueError:
                        stop = len(ids)
                    out[i] = ids[at:stop]
                    at = stop + 1
            return out

        _worker["words", path] = PieceTable(encode)
    return _worker["words", path]


#: Characters of a piece from which the tokenizers library encodes it.
LONG_PIECE = 10_000


def library_bytes(path: str, ranks: str, pattern: str) -> PieceTable:
    """The byte-level vocabulary.  Misses are encoded from the same vocabulary's
    rank file (equal ids, tested), by far the faster of the two libraries; a
    piece that holds a special token's string, or a long one, whose white space
    the faster library cannot take in, goes to the tokenizers library."""
    if ("bytes", path) not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

        def encode(pieces: list[str]) -> list[list[int]]:
            return [
                tok.encode(p, add_special_tokens=False).ids if "<|" in p or len(p) > LONG_PIECE else fast.encode_ordinary(p) for p in pieces]

        _worker["bytes", path] = PieceTable(encode)
    return _worker["bytes", path]
