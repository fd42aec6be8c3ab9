"""Small documents with every odd case the operators must take."""

import random

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau "
         "upsilon phi chi psi omega one two three four five six seven eight nine ten").split()

#: documents plus columns whose names the operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, cuts string, "
          "kept_id long, own_sha string, kept_sha string, digest string, sym long, h long, a long, b long, root long, n long")


def alternating(bits):
    """Two words of 2^bits letters, each the other's complement, of so much inner
    symmetry that polynomial sums modulo 2^64 cannot tell them apart."""
    parity = [bin(i).count("1") & 1 for i in range(1 << bits)]
    return "".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity)


def prose(rng, n, words=WORDS):
    """Sentences of n words, hardly ever alike."""
    out = []
    for i in range(n):
        w = "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7))) if rng.random() < 0.6 else rng.choice(words)
        out.append(w + ("." if rng.random() < 0.1 else ""))
    return " ".join(out)


def changed(rng, text, n):
    """The text with n of its words replaced."""
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = "changed" + str(rng.randint(0, 10**6))
    return " ".join(words)


def documents(seed=7, repeated_ids=False):
    """(doc_id, text): nulls, empty and very long texts, copies, near copies,
    shared passages; optionally rows without or with a repeated identifier."""
    rng = random.Random(seed)
    base = [prose(rng, 150) for _ in range(6)]
    passage = prose(rng, 80)
    texts = [None, "", " \n\t ", "one two", "é", base[0], base[0], base[0].upper(), base[1], changed(rng, base[1], 2), changed(rng, base[1], 3),
             prose(rng, 60) + " " + passage + " " + prose(rng, 40), passage + " " + prose(rng, 90), prose(rng, 70) + "\n" + passage,
             base[2], base[3], base[4] + "\n" + base[4], " ".join(["same line again"] * 60), prose(rng, 9), prose(rng, 20000),
             "x" * 3000, "x" * 2999, "Ärger über Straßen​ \U0001F600 漢字 <|endoftext|> " * 5, None, ""]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    if repeated_ids:
        rows += [(16, base[0]), (16, base[0]), (None, base[5]), (None, base[5]), (25, base[2] + " end"), (40, prose(rng, 100))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, partitions=3):
    extra = ("en", "src", None, True, 5, "c", 9, "o", "k", "d", 1, 2, 3, 4, 5, 6)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
