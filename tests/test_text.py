from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kartei.functions import text

col = F.col


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


MARKED = [
    ("Here is a *word*", "word", "ok"),
    ("Here is a *bad input", None, "no closing"),
    ("Here is a *good* input", "good", "ok"),
    ("Here is more bad input", None, "no opening"),
    ("Here are **too many** delimiters.", None, "too many"),
    ("Here is ** nothing.", "", "ok"),
    ("Two *lines\nhere* are", None, "unmatched"),
    ("A *line separator* stays", "line separator", "ok"),
    ("Der Gemeinde *warnt vor* Hochwasser.", "warnt vor", "ok"),
]


def test_marked_word_and_status(spark):
    prompts = [(p,) for p, _, _ in MARKED]
    assert values(spark, prompts, "p string", text.marked_word(col("p"))) == [w for _, w, _ in MARKED]
    assert values(spark, prompts, "p string", text.marker_status(col("p"))) == [s for _, _, s in MARKED]


def test_redacted_prompt(spark):
    cases = [
        ("Here is a *word*.", "Here is a _____."),
        ("Here is *bad input", None),
        ("Here is *good* input.", "Here is _____ input."),
        ("More bad input.", None),
        ("Here is ** nothing.", "Here is _____ nothing."),
        ("", None),
        ("Here is *bad** input!", None),
        ("**Bad input*!", None),
        ("Der Gemeinde *warnt vor* Hochwasser.", "Der Gemeinde _____ Hochwasser."),
        ("*Anfang* und", "_____ und"),
    ]
    got = values(spark, [(p,) for p, _ in cases], "p string", text.redacted_prompt(col("p")))
    assert got == [w for _, w in cases]


BLANKED = [
    ("This is a word.", "word", "This is a ______."),
    ("This is a word.", "bird", "This is a word."),
    ("This is a word.", "is", "This ______ a word."),
    ("This is a word (promise).", "promise", "This is a word (______)."),
    ("This is a word. Another word.", "word", "This is a ______. Another ______."),
    ("WORD and Word", "word", "______ and ______"),
    ("Die Übung ist.", "Übung", "Die Übung ist."),  # edges know ASCII letters only
    ("xÜbung", "Übung", "x______"),  # so x and Ü have an edge between them
    ("aÜbungb", "Übung", "aÜbungb"),
    ("a.c abc", "a.c", "______ abc"),  # the word is taken literally
    (r"cost \E here", r"\E here", r"cost \E here"),
]


def test_blank_out_word(spark):
    got = values(
        spark, [(s, w) for s, w, _ in BLANKED], "s string, w string", text.blank_out_word(col("s"), col("w"))
    )
    assert got == [want for _, _, want in BLANKED]
    unicode = text.blank_out_word(col("s"), col("w"), unicode=True)
    assert values(spark, [("Die Übung ist.", "Übung")], "s string, w string", unicode) == ["Die ______ ist."]


def test_mark_word(spark):
    cases = [
        ("This is a word.", "word", "This is a *word*."),
        ("This is a word.", "bird", "This is a word."),
        ("This is a word.", "is", "This *is* a word."),
        ("This is a word (promise).", "promise", "This is a word (*promise*)."),
        ("HAUS und haus", "Haus", "*Haus* und *Haus*"),
        ("pay a$1b now", "a$1b", "pay *a$1b* now"),
    ]
    got = values(spark, [(s, w) for s, w, _ in cases], "s string, w string", text.mark_word(col("s"), col("w")))
    assert got == [want for _, _, want in cases]


def test_unmark_translation(spark):
    cases = [
        ("I *buy* a book.", "buy", "I buy a book."),
        ("none", "", "none"),
        ("odd ** one", "", "odd  one"),
        ("a *b* c *d*", "", "a *b* c *d*"),
        ("a ** b *c", "", "a  b *c"),
    ]
    rows = [(t,) for t, _, _ in cases]
    assert values(spark, rows, "t string", text.translated_word(col("t"))) == [w for _, w, _ in cases]
    assert values(spark, rows, "t string", text.unmark_translation(col("t"))) == [w for _, _, w in cases]


def test_fold_umlauts(spark):
    got = values(spark, [("Übung",), ("ÄÖÜäöüß",), ("ü",)], "t string", text.fold_umlauts(col("t")))
    assert got == ["Ubung", "AOUaouß", "ü"]


@pytest.mark.parametrize(
    ("case", "umlaut", "want"),
    [
        (True, True, [True, True, True, True, True, False]),
        (False, True, [False, True, False, False, True, False]),
        (True, False, [True, False, False, False, False, False]),
    ],
)
def test_match_modes(spark, case, umlaut, want):
    pairs = [("a", "A"), ("Ä", "A"), ("ä", "A"), ("a", "Ä"), ("a", "ä"), ("a", "e")]
    same = text.match_key(col("x"), case, umlaut) == text.match_key(col("y"), case, umlaut)
    assert values(spark, pairs, "x string, y string", same) == want


def test_case_is_folded_per_code_point(spark):
    rows = [("ΟΔΟΣ",), ("İ",), ("ẞ",), ("straße",)]
    assert values(spark, rows, "t string", text.fold_case(col("t"))) == ["οδοσ", "i", "ß", "straße"]


def test_lex_before(spark):
    rows = [(["a"], ["b"]), (["a"], ["a", "b"]), (["a"], ["a"]), ([], []), (["b"], []), ([], ["a"]), (["b"], ["a", "z"])]
    got = values(spark, rows, "x array<string>, y array<string>", text.lex_before(col("x"), col("y")))
    assert got == [True, True, False, False, False, True, False]


def test_exact_keys_of_all_code_points(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    cased = [(c, other) for c in chars for other in {c.lower(), c.upper()} if len(other) == 1 and other != c]
    rows = spark.createDataFrame(cased, "a string, b string")
    apart = rows.filter(text.equal_fold_key(F.col("a")) != text.equal_fold_key(F.col("b"))).collect()
    assert [(r.a, r.b) for r in apart] == [("ı", "I")]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("5 µm", "5 μm", True), ("ϑ", "θ", True), ("Σς", "σσ", True), ("ſ", "S", True), ("K", "k", True), ("ẞ", "ß", True), ("ᲀ", "В", True),
     ("ι", "ι", True), ("𐐀", "𐐨", True), ("ß", "ss", False), ("İ", "i̇", False), ("İ", "i", False), ("ı", "i", False)],
)
def test_exact_keys(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    assert row.filter(text.equal_fold_key(F.col("a")) == text.equal_fold_key(F.col("b"))).count() == int(same)
