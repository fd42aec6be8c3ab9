"""Packed character trigrams, computed per Arrow batch inside Spark tasks.

A trigram is three code points of 21 bits in one 64-bit integer, so equal
integers are equal trigrams.  Numbering the repeats of a trigram turns the
multiset of a text into a set of tokens; a token's 64-bit name is a hash of
(trigram, repeat) and serves the candidate search only, the exact counts are
compared as packed trigrams.
"""

from __future__ import annotations

import numpy as np

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def packed_grams(text: str | None) -> np.ndarray:
    """Sorted packed trigrams of a (lower-cased) text, repeats included."""
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if len(code) < 3:
        return np.zeros(0, dtype=np.int64)
    grams = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
    grams.sort()
    return grams


def token_names(grams: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit name per (trigram, number of the repeat)."""
    first = np.ones(len(grams), dtype=bool)
    first[1:] = grams[1:] != grams[:-1]
    at = np.arange(len(grams))
    repeat = at - np.maximum.accumulate(np.where(first, at, 0)) if len(grams) else at
    h = grams.astype(np.uint64) * MIX_A + repeat.astype(np.uint64) * MIX_B
    h ^= h >> np.uint64(30)
    h *= MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    return h ^ (h >> np.uint64(31))


def gram_counts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct trigrams of a text, how often each occurs, and all of them."""
    return *np.unique(grams, return_counts=True), len(grams)


def common_counts(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> int:
    """Size of the multiset intersection of two texts' trigrams."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = np.flatnonzero(b[0][at] == a[0]) if len(b[0]) else at[:0]
    return int(np.minimum(a[1][both], b[1][at[both]]).sum())


#: Buckets of a gram histogram: a fixed size, whatever the text.
HISTOGRAM = 256


def gram_histogram(grams: np.ndarray) -> bytes:
    """Counts of the trigrams per hashed bucket: 16-bit numbers, 32-bit ones for a
    text with more in a bucket."""
    at = (grams.astype(np.uint64) * MIX_A) >> np.uint64(56)
    counts = np.bincount(at.astype(np.int64), minlength=HISTOGRAM)
    return counts.astype("<u2" if counts.max(initial=0) < 1 << 16 else "<u4").tobytes()


def histograms(packed: list[bytes]) -> np.ndarray:
    """The histograms of some texts, one row each."""
    if all(len(x) == 2 * HISTOGRAM for x in packed):
        return np.frombuffer(b"".join(packed), dtype="<u2").reshape(-1, HISTOGRAM)
    return np.stack([np.frombuffer(x, dtype="<u2" if len(x) == 2 * HISTOGRAM else "<u4").astype(np.uint32) for x in packed])


def part_names(tokens: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Names of the subsets of a token set that fall into each of ``parts`` hashed
    parts; equal subsets have equal names."""
    z = tokens + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * MIX_A
    z = (z ^ (z >> np.uint64(27))) * MIX_B
    z ^= z >> np.uint64(31)
    out = np.zeros(parts, dtype=np.uint64)
    np.add.at(out, ((z >> np.uint64(11)) % np.uint64(parts)).astype(np.int64), z * MIX_A)
    return out


def parity_sketch(names: np.ndarray, bits: int) -> bytes:
    """One bit per hashed bucket (``bits``: a power of two, 64 at least): whether an
    odd number of tokens falls into it.

    A token that only one of two texts has turns one bit, so the sketches of two
    texts differ in no more bits than their token sets in tokens.
    """
    odd = np.bincount((names >> np.uint64(7) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_words(packed: list[bytes], words: int) -> np.ndarray:
    """Sketches of one width as 64-bit words, a row per word; wider ones than
    ``words`` are folded, which is the sketch of that width."""
    out = np.frombuffer(b"".join(packed), dtype="<u8").reshape(len(packed), -1)
    while out.shape[1] > words:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return np.ascontiguousarray(out.T)


#: Numbers that a comparison of sketches holds at a time.
_PAIRS = 1 << 17


def close_sketches(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray],
                   num: int, den: int, most: int | None = None,
                   after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) whose Jaccard similarity may be above ``num / den``, as far as
    their sketches tell: no similar pair is lost.

    Both sides are (key, tokens, words of the sketch) in ascending order of keys;
    a pair's first key is the smaller.  Returns the keys of the pairs and the keys
    of ``b`` that have more than ``most`` partners, of which the first stay.  With
    ``after``, a key per text of ``b``, only partners beyond that key count.
    """
    key_a, size_a, word_a = a
    key_b, size_b, word_b = b
    words = len(word_a)
    some = max(1, words // 2)  # enough of them to tell unlike texts
    open_ = np.arange(len(key_b))  # of b, while its list is not full
    had, more = np.zeros(len(key_b), dtype=np.int64), np.zeros(len(key_b), dtype=bool)
    out_a, out_b = [key_a[:0]], [key_b[:0]]
    lo = 0 if after is None or not len(after) else int(np.searchsorted(key_a, after.min(), side="right"))
    while lo < len(key_a):
        later = open_[np.searchsorted(key_b[open_], key_a[lo], side="right"):]
        if not len(later):
            break
        hi = lo + max(1, _PAIRS // len(later))
        x, y = word_a[:, lo:hi], word_b if len(later) == len(key_b) else word_b[:, later]
        differ = np.zeros((x.shape[1], len(later)), dtype=np.int32 if words > 512 else np.uint16)
        turned, count = np.empty(differ.shape, dtype=np.uint64), np.empty(differ.shape, dtype=np.uint8)
        for w in range(some):
            np.bitwise_xor(x[w][:, None], y[w][None, :], out=turned)
            np.add(differ, np.bitwise_count(turned, out=count), out=differ)
        # similar: (num + den) * common > num * total, so (num + den) * differing < (den - num) * total
        total = size_a[lo:hi][:, None] + size_b[later][None, :]
        i, j = np.nonzero((num + den) * differ.astype(total.dtype) < (den - num) * total)
        n = differ[i, j].astype(np.int64)
        for w in range(some, words):
            n += np.bitwise_count(x[w][i] ^ y[w][j])
        i += lo
        j = later[j]
        sa, sb = size_a[i], size_b[j]
        ok = (((num + den) * n < (den - num) * (sa + sb)) & (key_a[i] < key_b[j])
              & (den * np.minimum(sa, sb) > num * np.maximum(sa, sb)))
        if after is not None:
            ok &= key_a[i] > after[j]
        i, j = i[ok], j[ok]
        if most is not None and len(j):
            by = np.argsort(j, kind="stable")  # a partner after the other, in the order of their keys
            i, j = i[by], j[by]
            head = np.append(True, j[1:] != j[:-1])
            at = np.arange(len(j))
            place = had[j] + at - np.maximum.accumulate(np.where(head, at, 0))
            np.add.at(had, j, 1)
            more |= had > most
            i, j = i[place < most], j[place < most]
            if more[open_].mean() > 0.1:
                open_ = open_[~more[open_]]
        out_a.append(key_a[i])
        out_b.append(key_b[j])
        lo = hi
    return np.concatenate(out_a), np.concatenate(out_b), key_b[more]
