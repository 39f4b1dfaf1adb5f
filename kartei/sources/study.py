"""The study tables, derived from the given tables and stored once per session.

The given tables hold documents and events but no cards, so the lines of the
documents become cards and the events become guesses:

* a card is a line of a document; its hint is the first word of four letters or
  more, marked with ``*``. A line that does not end in a full stop gets only the
  opening marker, a line without such a word gets none, and lines that hold
  ``*`` of their own have too many: such prompts do not parse.
* an event is a guess of its user in deck ``user_id % 3``. The event type says
  how good the guess is: the answer itself, in upper case, without umlauts,
  without its last letter, or ``xx``.
* translations exist for the prompts of all documents but the French ones.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.functions.text import STATUS_OK, fold_umlauts, marker_status
from kartei.operators.cards import answers
from kartei.operators.corpus import WordIndex, distinct_words, number_words, tokens, word_positions
from kartei.operators.history import ORDER, derive_drop, judged_actions
from kartei.operators.replay import card_status, graded_actions, split_graded
from kartei.plans.chunks import number_rows, split_groups
from kartei.plans.storage import new_folder, prepare, write_compact
from kartei.sources.lines import LANG_USER, TARGET_LANG, lines_of, sentence_lines
from kartei.sources.schemas import GUESSES
from kartei.sources.sinks import read_history, record_actions, to_second

HINT = "[A-Za-zÀ-ÖØ-öø-ÿ]{4,}"

# Fixed values of the projection: decks per user, and how events pick cards.
DECKS = 3
CARD_STRIDE = 7919
FIRST_CARD = 5
UNSEEN_OFFSET = 100
UNSEEN_READY = "2024-01-01 00:00:00"


def _number_of(user_id: Column, offset: Column) -> Column:
    return user_id * F.lit(CARD_STRIDE) + F.lit(FIRST_CARD) + offset


def sentence_key(doc_id: Column, line_no: Column) -> Column:
    """One number for a line of a document."""
    return doc_id * F.lit(1 << 32) + line_no


def event_columns(events: DataFrame) -> DataFrame:
    """Events as bare actions: who, which deck, when."""
    return events.select(
        "event_id",
        "user_id",
        (F.col("user_id") % DECKS).alias("deck_id"),
        "event_type",
        F.col("value").alias("duration"),
        to_second(F.col("ts")).alias("created_at"),
    )


def guess_of(event_type: Column, answer: Column) -> Column:
    return (
        F.when(event_type == "view", answer)
        .when(event_type == "click", F.upper(F.replace(answer, F.lit("ß"), F.lit("ss"))))
        .when(event_type == "purchase", fold_umlauts(answer))
        .when(event_type == "signup", F.left(answer, F.length(answer) - 1))
        .otherwise(F.lit("xx"))
    )

#: Folders of stored guesses, so that a stream can take them in several micro-batches.
GUESS_PARTS = 4
#: All occurrences of words are several times the text, so those of a third of the words are shuffled at a time.
WORD_PARTS = 3


class Study:
    """The study tables of one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")
        self.source = self.folder.rsplit("/", 1)[-1]

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table to the shared folder and read it back: short lineage, safe from lost executors.

        The rebalance hint makes files of even size, whatever came out of the last step.
        """
        path = new_folder(self.spark, f"{self.source}-{name}")
        write_compact(rows.hint("rebalance"), path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @property
    def lines(self) -> DataFrame:
        """(doc_id, lang, source, line_no, line) of whole documents."""
        return lines_of(self.given("documents").select("doc_id", "lang", "source", "text"))

    @cached_property
    def sentences(self) -> DataFrame:
        kept = sentence_lines(self.lines)
        return self.stored(
            "sentences",
            kept.select(
                sentence_key(F.col("doc_id"), F.col("line_no")).alias("sentence_id"),
                F.col("line").alias("sentence"),
                "doc_id",
                "lang",
            ),
        )

    @property
    def card_rows(self) -> DataFrame:
        """The cards as made from the sentences."""
        line = F.col("sentence")
        hint = F.regexp_extract(line, HINT, 0)
        at = F.position(F.col("hint"), line)
        after = F.substr(line, at + F.length("hint"))
        head = F.concat(F.substr(line, F.lit(1), at - 1), F.lit("*"), F.col("hint"))
        prompt = (
            F.when(F.col("hint") == "", line)
            .when(~F.endswith(line, F.lit(".")), F.concat(head, after))
            .otherwise(F.concat(head, F.lit("*"), after))
        )
        return self.sentences.withColumn("hint", hint).select(
            F.col("sentence_id").alias("card_id"),
            F.lit("").alias("grammar"),
            "hint",
            F.upper("lang").alias("lang_learn"),
            F.lit(LANG_USER).alias("lang_user"),
            prompt.alias("prompt"),
            F.concat(F.lit("[tr] "), line).alias("word_translation"),
        )

    @cached_property
    def cards(self) -> DataFrame:
        return self.stored("cards", self.card_rows)

    @cached_property
    def numbered_answers(self) -> DataFrame:
        """(rn, card_id, answer) of the cards that parse, numbered by id."""
        good = self.cards.where(marker_status(F.col("prompt")) == STATUS_OK)
        numbered = number_rows(answers(good), ["card_id"], "rn")
        return self.stored("numbered-answers", numbered)

    @cached_property
    def card_count(self) -> int:
        return self.numbered_answers.count()

    @property
    def actions(self) -> DataFrame:
        """The events as actions, without card and guess."""
        return event_columns(self.given("events"))

    @property
    def guesses(self) -> DataFrame:
        """The guesses as they arrive, without drop flags."""
        event_id = F.col("event_id")
        offset = F.when(event_id % 4 == 0, event_id % 5).otherwise(F.lit(0))
        numbered = self.actions.withColumn("rn", _number_of(F.col("user_id"), offset) % F.lit(self.card_count))
        joined = numbered.join(self.numbered_answers, "rn")
        guess = guess_of(F.col("event_type"), F.col("answer"))
        return joined.withColumn("guess", guess).select(*GUESSES.names)

    @cached_property
    def guess_path(self) -> str:
        """The guesses stored as files of mixed times, for streams to read: some for each part."""
        path = new_folder(self.spark, f"{self.source}-guesses")
        parts = self.guesses.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(GUESS_PARTS)))
        parts.hint("rebalance", "part").write.partitionBy("part").parquet(path)
        return path

    @cached_property
    def history_path(self) -> str:
        """The stored history, with drop flags, one folder per day."""
        judged = judged_actions(self.guesses, self.cards)
        chunked = split_groups(judged, ["user_id", "deck_id"], ORDER, source=self.actions)
        path = new_folder(self.spark, f"{self.source}-history")
        record_actions(derive_drop(chunked), path)
        return path

    @cached_property
    def history(self) -> DataFrame:
        return read_history(self.spark, self.history_path)

    @property
    def unseen(self) -> DataFrame:
        """One deck row per (user, deck) that no guess has touched."""
        pairs = self.actions.select("user_id", "deck_id").distinct()
        number = _number_of(F.col("user_id"), F.lit(UNSEEN_OFFSET)) % F.lit(self.card_count)
        ids = self.numbered_answers.select("rn", "card_id")
        return (
            pairs.withColumn("rn", number)
            .join(ids, "rn")
            .select(
                "user_id",
                "deck_id",
                "card_id",
                F.lit(UNSEEN_READY).cast("timestamp_ntz").alias("date_ready"),
                F.lit(False).alias("card_learned"),
                F.lit(0).alias("card_progress"),
                F.lit(0).alias("times_seen"),
            )
        )

    def decks_before(self, moment: Column | None = None) -> DataFrame:
        """The deck table as of a moment: replayed statuses and the unseen cards."""
        history = self.history if moment is None else self.history.where(F.col("created_at") < moment)
        graded = graded_actions(history, self.cards)
        return card_status(split_graded(graded, source=self.history)).unionByName(self.unseen)

    @cached_property
    def decks(self) -> DataFrame:
        return self.stored("decks", self.decks_before())

    @property
    def users(self) -> DataFrame:
        pairs = self.actions.select("user_id", "deck_id").distinct()
        return pairs.withColumn("daily_goal", (F.col("user_id") % 5 + 1).cast("int"))

    @cached_property
    def translations(self) -> DataFrame:
        """(sentence, target_lang, translation), each sentence once. Cards are several times the sentences, and not stored for it."""
        prompts = self.card_rows.where(F.col("lang_learn") != "FR").select(F.col("prompt").alias("sentence")).distinct()
        return self.stored("translations", prompts).select(
            "sentence",
            F.lit(TARGET_LANG).alias("target_lang"),
            F.concat(F.lit("[tr] "), F.col("sentence")).alias("translation"),
        )

    @cached_property
    def word_index(self) -> WordIndex:
        """The words of a sentence are split off again whenever they are asked for: stored, they are larger than the text.

        Positions are stored as the join deals them, those of each part of the words in turn; in order, which packs best.
        """
        sentences = self.sentences.select("sentence_id", "sentence")
        found = tokens(sentences)
        words = self.stored("words", number_words(self.stored("distinct-words", distinct_words(found))))
        part = F.pmod(F.xxhash64("word"), F.lit(WORD_PARTS))
        paths = [new_folder(self.spark, f"{self.source}-positions") for _ in range(WORD_PARTS)]
        for number, path in enumerate(paths):
            placed = word_positions(found.where(part == number), words.where(part == number))
            write_compact(placed.sortWithinPartitions("word_id", "sentence_id", "position"), path)
        schema = word_positions(found, words).schema
        return WordIndex(words, sentences, self.spark.read.schema(schema).parquet(*paths))


_STUDIES: dict[tuple[str, str], Study] = {}


def study_of(spark: SparkSession, folder: str) -> Study:
    """The study tables of a folder, built at most once per Spark application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STUDIES:
        _STUDIES[key] = Study(spark, folder)
    return _STUDIES[key]


