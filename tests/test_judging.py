from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from kartei.functions import judging
from tests.model import lcs

col = F.col


def judged(spark, pairs, column):
    rows = spark.createDataFrame([(i, a, g) for i, (a, g) in enumerate(pairs)], "i int, answer string, guess string")
    return [r[1] for r in sorted(rows.select("i", column.alias("v")).collect())]


def random_pairs(seed, count, longest, letters="abäß😀"):
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))

    return [(word(), word()) for _ in range(count)]


def test_lcs_equals_the_table_method(spark):
    pairs = random_pairs(1, 300, 14) + random_pairs(2, 60, 70) + random_pairs(3, 12, 200) + random_pairs(4, 40, 61)
    pairs += [("a" * 60, "a" * 61), ("a" * 60 + "b", "b" + "a" * 60), ("ab" * 60, "ba" * 60), ("", "a"), ("a", "")]
    assert judged(spark, pairs, judging.lcs_length(col("answer"), col("guess"))) == [lcs(a, g) for a, g in pairs]


def test_ratio_and_quality(spark):
    pairs = random_pairs(5, 200, 10) + [("", ""), ("abc", "abc"), ("Übung", "UBUNG"), ("haus", "maus")]
    rows = spark.createDataFrame([(i, a, g) for i, (a, g) in enumerate(pairs)], "i int, answer string, guess string")
    got = [r.ratio for r in sorted(judging.with_ratio(rows, "ratio", False, False).collect())]
    want = [2 * lcs(a, g) / (len(a) + len(g)) if a + g else 0.0 for a, g in pairs]
    assert got == want
    grades = judged(spark, pairs, judging.quality(judging.answer_ratio(col("answer"), col("guess"), False, False)))
    assert grades == [math.floor(5 * r) for r in want]


def test_is_correct_is_ratio_one(spark):
    pairs = random_pairs(6, 300, 3, "aAäÄ") + [("", ""), ("Straße", "STRASSE"), ("Σας", "σας")]
    for case in (False, True):
        for umlaut in (False, True):
            short = judged(spark, pairs, judging.is_correct(col("answer"), col("guess"), case, umlaut))
            full = judged(spark, pairs, judging.answer_ratio(col("answer"), col("guess"), case, umlaut) == 1.0)
            assert short == full


def test_exact_judge_folds_case_only(spark):
    pairs = [("Haus", "hAUS"), ("Übung", "ubung"), ("ß", "ss"), ("ſ", "S"), ("ὈΔΟΣ", "ὀδος"), ("", "")]
    assert judged(spark, pairs, judging.exact_ratio(col("answer"), col("guess"))) == [1.0, 0.0, 0.0, 1.0, 1.0, 1.0]


def test_judges_are_registered_by_name(spark):
    judging.register_judge("length", lambda a, g: (F.length(a) == F.length(g)).cast("double"))
    try:
        assert judged(spark, [("ab", "xy"), ("ab", "x")], judging.JUDGES["length"](col("answer"), col("guess"))) == [1.0, 0.0]
        assert judged(spark, [("Äb", "ab")], judging.JUDGES["levenshtein_both"](col("answer"), col("guess"))) == [1.0]
    finally:
        del judging.JUDGES["length"]
