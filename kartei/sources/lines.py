"""From sentence files to cards: lines, translations, records, rejects, statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.functions.text import STATUS_OK, marked_word, marker_status

# The languages cards are made for unless told otherwise.
LANG_LEARN = "DE"
LANG_USER = "EN-GB"
TARGET_LANG = "EN"

CARD_COLUMNS = ["card_id", "grammar", "hint", "lang_learn", "lang_user", "prompt", "word_translation"]


def read_sentence_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per line; only a line feed ends a line."""
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


def lines_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """The lines of whole texts, with ``line_no`` counted from 0."""
    kept = [c for c in texts.columns if c != text]
    return texts.select(*kept, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def is_sentence(line: Column) -> Column:
    """More than one byte and not a ``-`` comment."""
    return (F.octet_length(line) > 1) & ~F.startswith(line, F.lit("-"))


def sentence_lines(lines: DataFrame) -> DataFrame:
    return lines.where(is_sentence(F.col("line")))


def translate(
    sentences: DataFrame,
    translations: DataFrame,
    target_lang: str = TARGET_LANG,
    sentence: str = "line",
) -> DataFrame:
    """Look each sentence up in (sentence, target_lang, translation); NULL for a miss.

    Sentences repeat, so a single one may be hot; adaptive execution splits it.
    """
    table = translations.where(F.col("target_lang") == target_lang).select(
        F.col("sentence").alias(sentence), "translation"
    )
    return sentences.join(table, sentence, "left")


def card_status(sentence: Column, translation: Column) -> Column:
    """Why a line gives no card; translation is tried before the marker."""
    return F.when(translation.isNull(), F.lit("no translation")).otherwise(marker_status(sentence))


def card_identity(*parts: Column) -> Column:
    """An id that is the same on every run, in place of a random one."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def card_records(
    translated: DataFrame,
    card_id: Column | None = None,
    lang_learn: Column | None = None,
    lang_user: Column | None = None,
) -> DataFrame:
    """Card rows of the translated lines that parse: the marked word is hint and answer."""
    learn = F.lit(LANG_LEARN) if lang_learn is None else lang_learn
    user = F.lit(LANG_USER) if lang_user is None else lang_user
    line = F.col("line")
    good = translated.where(card_status(line, F.col("translation")) == STATUS_OK)
    return good.select(
        (card_identity(line, learn, user) if card_id is None else card_id).alias("card_id"),
        F.lit("").alias("grammar"),
        marked_word(line).alias("hint"),
        learn.alias("lang_learn"),
        user.alias("lang_user"),
        line.alias("prompt"),
        F.col("translation").alias("word_translation"),
        marked_word(line).alias("answer"),
    )


def card_rejects(translated: DataFrame) -> DataFrame:
    """The lines left out, each with its reason."""
    reason = card_status(F.col("line"), F.col("translation"))
    return translated.withColumn("reason", reason).where(F.col("reason") != STATUS_OK)


def insert_statement() -> Column:
    """One INSERT per card. Quotes are doubled, so any sentence is a valid literal; what is NULL stays so."""
    quoted = [F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) for c in CARD_COLUMNS]
    template = f"INSERT INTO cards ({', '.join(CARD_COLUMNS)}) VALUES ({', '.join(['%s'] * 7)});"
    return F.format_string(template, *(F.coalesce(value, F.lit("NULL")) for value in quoted))


def write_insert_statements(cards: DataFrame, path: str) -> None:
    cards.select(insert_statement().alias("value")).write.text(path)
