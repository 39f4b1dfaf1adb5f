"""Judging a guess against the answer: exact, and a tolerant edit-distance ratio.

Inserting and deleting cost 1 and substituting costs 2, so the distance of two
strings of m and n characters is m + n - 2*LCS and the ratio is 2*LCS/(m + n).
Spark's ``levenshtein`` substitutes at cost 1 and cannot be used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.functions.text import characters, equal_fold_key, match_key

# Bits of a bigint used per word: two such words and a carry still fit.
_BITS = 60
_FULL = (1 << _BITS) - 1


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _masks(chars: Column, words: Column) -> Column:
    """character -> its positions, as an array of 60-bit words."""

    def word_mask(char: Column, word: Column) -> Column:
        part = F.slice(chars, word * _BITS + 1, F.lit(_BITS))
        bits = F.transform(
            part,
            lambda c, i: F.when(c == char, F.call_function("shiftleft", _long(1), i)).otherwise(_long(0)),
        )
        return F.aggregate(bits, _long(0), lambda acc, bit: acc.bitwiseOR(bit))

    return F.map_from_entries(
        F.transform(
            F.array_distinct(chars),
            lambda char: F.struct(char, F.transform(words, lambda word: word_mask(char, word))),
        )
    )


def _word_step(v: Column, mask: Column, carry: Column) -> Column:
    """One word of the row update: sum with carry, then the untouched bits."""
    total = v + v.bitwiseAND(mask) + carry
    kept = v.bitwiseAND(mask.bitwiseXOR(_long(_FULL)))
    return F.struct(
        total.bitwiseAND(_long(_FULL)).bitwiseOR(kept).alias("v"),
        F.call_function("shiftright", total, F.lit(_BITS)).alias("carry"),
    )


def _lcs_one_word(left: Column, right: Column) -> Column:
    """Bit-parallel LCS for at most 60 characters on the left."""
    chars = characters(left)
    masks = _masks(chars, F.array(F.lit(0)))

    def run(table: Column) -> Column:
        return F.aggregate(
            characters(right),
            _long(_FULL),
            lambda v, c: bind(
                F.coalesce(F.element_at(F.try_element_at(table, c), 1), _long(0)),
                lambda mask: (v + v.bitwiseAND(mask)).bitwiseAND(_long(_FULL)).bitwiseOR(
                    v.bitwiseAND(mask.bitwiseXOR(_long(_FULL)))
                ),
            ),
            lambda v: (F.lit(_BITS) - F.bit_count(v)).cast("int"),
        )

    return bind(masks, run)


def _lcs_many_words(left: Column, right: Column) -> Column:
    """The same with one carry chain over as many words as the left side needs."""
    count = F.ceil(F.length(left) / F.lit(_BITS)).cast("int")
    words = F.sequence(F.lit(0), count - 1)
    none = F.array_repeat(_long(0), count)

    def char_step(row: Column, mask: Column) -> Column:
        pairs = F.arrays_zip(row.alias("v"), mask.alias("mask"))
        start = F.struct(F.array().cast("array<bigint>").alias("row"), _long(0).alias("carry"))

        def one(acc: Column, pair: Column) -> Column:
            return bind(
                _word_step(pair["v"], pair["mask"], acc["carry"]),
                lambda step: F.struct(
                    F.concat(acc["row"], F.array(step["v"])).alias("row"),
                    step["carry"].alias("carry"),
                ),
            )

        return F.aggregate(pairs, start, one, lambda acc: acc["row"])

    def run(table: Column) -> Column:
        return F.aggregate(
            characters(right),
            F.array_repeat(_long(_FULL), count),
            lambda row, c: char_step(row, F.coalesce(F.try_element_at(table, c), none)),
            lambda row: F.aggregate(row, F.lit(0), lambda acc, v: acc + F.lit(_BITS) - F.bit_count(v)),
        )

    return bind(_masks(characters(left), words), run)


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence, in code points.

    If one string contains the other no fold runs: the shorter one is the
    subsequence. Bits beyond the last character never clear, so a fixed word
    width needs no masking by length.
    """
    fits = F.length(left) <= _BITS
    narrow, other = F.when(fits, left).otherwise(right), F.when(fits, right).otherwise(left)
    return (
        F.when(F.contains(left, right), F.length(right))
        .when(F.contains(right, left), F.length(left))
        .when(F.length(narrow) <= _BITS, _lcs_one_word(narrow, other))
        .otherwise(_lcs_many_words(left, right))
    )


def ratio_of_keys(answer_key: Column, guess_key: Column) -> Column:
    """2*LCS/(m+n) in [0, 1]; 0.0 for two empty strings."""
    total = F.length(answer_key) + F.length(guess_key)
    return (
        F.when(total == 0, F.lit(0.0))
        .when(answer_key == guess_key, F.lit(1.0))
        .otherwise((F.lit(2) * lcs_length(answer_key, guess_key)).cast("double") / total.cast("double"))
    )


@lru_cache(maxsize=32)
def _ratio_of_named_keys(answer_key: str, guess_key: str, application: str) -> Column:
    return ratio_of_keys(F.col(answer_key), F.col(guess_key))


def with_ratio(rows: DataFrame, name: str, case_insensitive: bool = True, umlaut_insensitive: bool = True) -> DataFrame:
    """Add the ratio of ``answer`` and ``guess``, with both keys computed once per row.

    The ratio is a large expression, so it is built once per application and
    refers to the keys by name.
    """
    keys = "_answer_key", "_guess_key"
    ratio = _ratio_of_named_keys(*keys, rows.sparkSession.sparkContext.applicationId)
    keyed = rows.withColumns(
        {
            keys[0]: match_key(F.col("answer"), case_insensitive, umlaut_insensitive),
            keys[1]: match_key(F.col("guess"), case_insensitive, umlaut_insensitive),
        }
    )
    return keyed.withColumn(name, ratio).drop(*keys)


#: The pairs of switches (case, umlaut).
MODES = [(case, umlaut) for case in (False, True) for umlaut in (False, True)]


@lru_cache(maxsize=8)
def _ratios_of_pairs(application: str) -> Column:
    return F.transform(F.col("_pairs"), lambda pair: ratio_of_keys(pair["answer"], pair["guess"]))


def with_ratios(rows: DataFrame, modes: dict[str, tuple[bool, bool]]) -> DataFrame:
    """Add a ratio of ``answer`` and ``guess`` for each named pair of switches.

    Most texts hold few capitals and umlauts, so the modes often compare the same
    two keys: each different pair of keys is judged once, and in one expression for all.
    """
    pairs = [
        F.struct(
            match_key(F.col("answer"), *switches).alias("answer"), match_key(F.col("guess"), *switches).alias("guess")
        )
        for switches in modes.values()
    ]
    every = F.array(*pairs)
    rated = (
        rows.withColumn("_keys", every)
        .withColumn("_pairs", F.array_distinct("_keys"))
        .withColumn("_ratios", _ratios_of_pairs(rows.sparkSession.sparkContext.applicationId))
    )
    found = {
        name: F.get("_ratios", (F.array_position("_pairs", F.get("_keys", F.lit(at))) - 1).cast("int"))
        for at, name in enumerate(modes)
    }
    return rated.withColumns(found).drop("_keys", "_pairs", "_ratios")


def answer_ratio(
    answer: Column, guess: Column, case_insensitive: bool = True, umlaut_insensitive: bool = True
) -> Column:
    return ratio_of_keys(
        match_key(answer, case_insensitive, umlaut_insensitive),
        match_key(guess, case_insensitive, umlaut_insensitive),
    )


def exact_ratio(answer: Column, guess: Column) -> Column:
    """1.0 if the strings are equal under case folding, else 0.0."""
    return F.when(equal_fold_key(answer) == equal_fold_key(guess), F.lit(1.0)).otherwise(F.lit(0.0))


def quality(ratio: Column) -> Column:
    """Grade 0..5 of a ratio."""
    return F.floor(F.lit(5.0) * ratio).cast("int")


def is_correct(
    answer: Column, guess: Column, case_insensitive: bool = True, umlaut_insensitive: bool = True
) -> Column:
    """Ratio 1.0 without computing it: equal, non-empty keys."""
    answer_key = match_key(answer, case_insensitive, umlaut_insensitive)
    return (answer_key == match_key(guess, case_insensitive, umlaut_insensitive)) & (answer != "")


JUDGES: dict[str, Callable[[Column, Column], Column]] = {
    "exact": exact_ratio,
    "levenshtein": lambda a, g: answer_ratio(a, g, False, False),
    "levenshtein_case": lambda a, g: answer_ratio(a, g, True, False),
    "levenshtein_umlaut": lambda a, g: answer_ratio(a, g, False, True),
    "levenshtein_both": lambda a, g: answer_ratio(a, g, True, True),
}


def judge_by_name(name: str, answer: Column, guess: Column) -> Column:
    """The ratio by the judge of that name."""
    if name not in JUDGES:
        raise ValueError(f"no judge {name!r}; there are {', '.join(sorted(JUDGES))}")
    return JUDGES[name](answer, guess)


def register_judge(name: str, judge: Callable[[Column, Column], Column]) -> None:
    """Add a judge: (answer, guess) -> ratio in [0, 1]."""
    JUDGES[name] = judge
