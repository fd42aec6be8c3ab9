"""Golden micro-cases for the cleaning functions (C1..C8)."""

import random

from pyspark.sql import functions as F

from corpusflow.functions import text as T
from tests.conftest import one_col


def apply(spark, fn, values):
    df = one_col(spark, values).withColumn("_i", F.monotonically_increasing_id())
    out = df.select("_i", fn(F.col("x")).alias("y")).orderBy("_i").collect()
    return [r.y for r in out]


def test_strip_urls_eats_up_to_whitespace(spark):
    got = apply(spark, T.strip_urls, ["see https://ex.org/a/b) now", "http://x y", "no url"])
    assert got == ["see  now", " y", "no url"]


def test_strip_mentions_quirks(spark):
    got = apply(spark, T.strip_mentions, ["by u/some_user and r/sub_1 ok", "your/their", "and/or/maybe", "/u/x"])
    # unanchored: "your/their" loses "r/their"; "and/or/maybe" loses "r/maybe"
    assert got == ["by  and  ok", "you", "and/o", ""]


def test_strip_tombstones_case_sensitive(spark):
    got = apply(spark, T.strip_tombstones, ["a [deleted] b [removed]", "[Removed]"])
    assert got == ["a  b ", "[Removed]"]


def test_cut_edit_any_case_multiline(spark):
    got = apply(spark, T.cut_edit, ["keep EDIT: gone\nstill gone", "credit: desk", "no marker", "x edİt: y"])
    # "credit:" ends in "edit:"; dotted capital I folds like Python's re
    assert got == ["keep ", "cr", "no marker", "x "]


def test_collapse_ws_python_class(spark):
    s = "a \u001f b　　c\n\t d "
    assert apply(spark, T.collapse_ws, [s]) == ["a b c d"]


def test_ustrip_unicode(spark):
    assert apply(spark, T.ustrip, ["   x y 　", "   ", ""]) == ["x y", "", ""]


def test_clean_text_order(spark):
    # tombstone removal after URL removal can join the halves of a word
    got = apply(spark, T.clean_text, ["http://a.b c[removed]d  Edit: bye", "e[deleted]dit: tail"])
    assert got == ["cd", ""]


def test_char_ngrams(spark):
    got = apply(spark, T.char_ngrams, ["AbCd", "ab", ""])
    assert got == [["abc", "bcd"], [], []]


def _py_ws(c):
    return c.isspace()


def test_ws_class_matches_python_isspace(spark):
    # every code point up to U+3000 that Python treats as whitespace is
    # collapsed, and nothing else is
    chars = [chr(i) for i in range(1, 0x3001) if not (0xD800 <= i <= 0xDFFF)]
    sample = "".join(chars)
    (got,) = apply(spark, lambda c: F.regexp_replace(c, T.WS, ""), [sample])
    assert got == "".join(c for c in chars if not _py_ws(c))


def test_lower_contains_any(spark):
    df = one_col(spark, ["Beep Boop here", "I AM A BOT", "fine"])
    got = [r[0] for r in df.select(T.lower_contains_any(F.col("x"), ["beep boop", "i am a bot"])).collect()]
    assert got == [True, True, False]


def test_random_cleaning_idempotent_whitespace(spark):
    rnd = random.Random(7)
    alphabet = "ab \n 　xyz/ru:"
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    got = apply(spark, T.collapse_ws, vals)
    exp = [" ".join(v.split()) for v in vals]
    assert got == exp
