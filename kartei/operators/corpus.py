"""A word index over sentences, and card candidates drawn from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.functions.text import blank_out_word, mark_word, translated_word, unmark_translation
from kartei.plans.chunks import number_rows
from kartei.plans.storage import compact
from kartei.sources.lines import TARGET_LANG

# Letters and digits make words; everything else separates them.
SEPARATORS = "[^0-9A-Za-zÀ-ÖØ-öø-ÿ]+"

# Fixed value: what both translation fields hold without translation.
NO_TRANSLATIONS = "Translations are off"


@dataclass(frozen=True)
class WordIndex:
    """words(word_id, word), sentences(sentence_id, sentence), positions(word_id, sentence_id, position)."""

    words: DataFrame
    sentences: DataFrame
    positions: DataFrame


def tokens(sentences: DataFrame) -> DataFrame:
    """(sentence_id, position, word): the words of each sentence, counted from 0."""
    found = F.filter(F.split("sentence", SEPARATORS), lambda w: w != "")
    return sentences.select("sentence_id", F.posexplode(found).alias("position", "word"))


def distinct_words(found: DataFrame) -> DataFrame:
    return found.select("word").distinct()


def number_words(words: DataFrame) -> DataFrame:
    """Dense ids from 1 in word order. Numbering reads ``words`` more than once: give a stored table."""
    return number_rows(words, ["word"], "_n").select((F.col("_n") + 1).alias("word_id"), "word")


def word_positions(found: DataFrame, words: DataFrame) -> DataFrame:
    """Every occurrence of every word. Words are skewed by nature: adaptive execution splits the hot ones."""
    return found.join(words, "word").select("word_id", "sentence_id", "position")


def sentences_with_word(index: WordIndex) -> DataFrame:
    """For every word the ids of the sentences it occurs in, once per occurrence."""
    return index.positions.join(index.words, "word_id").select("word", "sentence_id")


def word_by_id(ids: DataFrame, words: DataFrame) -> DataFrame:
    return ids.join(words, "word_id")


def sentence_by_id(ids: DataFrame, sentences: DataFrame) -> DataFrame:
    return ids.join(sentences, "sentence_id")


def seeded_order(seed: int = 0) -> Column:
    """A pseudo-random but repeatable order of a word's occurrences."""
    return F.xxhash64("word_id", "sentence_id", "position", F.lit(seed))


def word_sentence_sample(index: WordIndex, order: Column | None = None, bare: bool = False) -> DataFrame:
    """One pseudo-random occurrence of each word, with word and sentence; bare, with the id of the sentence only.

    A minimum per word combines before the shuffle, however common the word. What is drawn is stored,
    so that its shuffles are gone when the sentences are shuffled.
    """
    ranked = F.struct(
        (seeded_order() if order is None else order).alias("rank"), "sentence_id", "position"
    )
    chosen = index.positions.groupBy("word_id").agg(F.min(ranked).alias("_c"))
    rows = chosen.select("word_id", "_c.sentence_id", "_c.position").join(index.words, "word_id")
    rows = compact(rows, "drawn")
    return rows if bare else rows.join(index.sentences, "sentence_id")


def candidate_cards(
    index: WordIndex,
    translations: DataFrame | None = None,
    target_lang: str = TARGET_LANG,
    order: Column | None = None,
) -> DataFrame:
    """A card candidate for every word: blanked prompt, answer, and its translation.

    Without a translations table both translation fields say so. With one, a
    sentence that is not in it leaves them NULL.
    """
    drawn = word_sentence_sample(index, order, bare=True)
    sentence, word = F.col("sentence"), F.col("word")

    def made(rows: DataFrame) -> DataFrame:
        return rows.join(index.sentences, "sentence_id").select(
            "word_id",
            "sentence_id",
            word.alias("answer"),
            blank_out_word(sentence, word).alias("prompt"),
            mark_word(sentence, word).alias("marked_sentence"),
        )

    cards = made(drawn)
    if translations is None:
        off = F.lit(NO_TRANSLATIONS)
        return cards.withColumns({"word_translation": off, "full_translation": off})
    table = translations.where(F.col("target_lang") == target_lang).select(
        F.col("sentence").alias("marked_sentence"), "translation"
    )
    # few cards are in the table: by hashes, which let none through that is missing, most are known not to be,
    # and only the texts of the others meet its own
    key = F.xxhash64("marked_sentence").alias("_key")
    keys = table.select(key).distinct()
    likely = compact(cards.select("word_id", key).join(keys, "_key", "left_semi").select("word_id").distinct(), "likely-ids")
    # parted while rows are ids and words: texts are not shuffled for it
    met = compact(made(drawn.join(likely, "word_id", "left_semi")), "likely-cards").join(table, "marked_sentence", "left")
    met = compact(met, "met-cards")
    missed = made(drawn.join(likely, "word_id", "left_anti")).withColumn("translation", F.lit(None).cast("string"))
    found = F.col("translation")
    translated = met.unionByName(missed)
    return translated.withColumns(
        {"word_translation": translated_word(found), "full_translation": unmark_translation(found)}
    ).drop("translation")
