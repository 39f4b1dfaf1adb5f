"""Operators over the history of guesses: filters, judging, drop flags, showings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartei.functions.judging import is_correct
from kartei.operators.cards import answers
from kartei.plans.chunks import DEFAULT_SIZE, Chunked, ChunkSize, split_groups

DECK = ["user_id", "deck_id"]
CARD = ["user_id", "deck_id", "card_id"]
ORDER = ["created_at", "event_id"]


def _day(value: str | Column) -> Column:
    return F.to_date(F.lit(value)) if isinstance(value, str) else F.to_date(value)


def _when(history: DataFrame) -> Column:
    """The day column: the folder of a stored history, else derived."""
    return F.col("created_on") if "created_on" in history.columns else F.to_date("created_at")


def card_actions(history: DataFrame) -> DataFrame:
    """Non-dropped actions of every card, by time."""
    return history.where(F.col("drop_action") == 0).orderBy(*CARD, *ORDER)


def actions_between(history: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """All actions, dropped ones too, from day ``start`` up to but without day ``end``."""
    day = _when(history)
    return history.where((day >= _day(start)) & (day < _day(end)))


def actions_today(history: DataFrame, as_of: str | Column) -> DataFrame:
    return history.where(_when(history) == _day(as_of))


def deck_actions(history: DataFrame, decks: DataFrame) -> DataFrame:
    """All actions of the given (user, deck) pairs."""
    return history.join(decks.select(*DECK), DECK, "left_semi")


def times_answered(history: DataFrame) -> DataFrame:
    """How often each card was answered, dropped answers included."""
    return history.groupBy(*CARD).agg(F.count("*").alias("times_answered"))


def judged_actions(
    history: DataFrame,
    cards: DataFrame,
    judge: Callable[[Column, Column], Column] = is_correct,
) -> DataFrame:
    """Each action with its answer and verdict; actions on missing cards are skipped."""
    joined = history.join(answers(cards), "card_id")
    return joined.withColumn("correct", judge(F.col("answer"), F.col("guess")))


def judged_actions_strict(
    history: DataFrame,
    cards: DataFrame,
    judge: Callable[[Column, Column], Column] = is_correct,
) -> DataFrame:
    """The same, but an action on a missing card fails the job."""
    joined = history.join(answers(cards), "card_id", "left")
    missing = F.raise_error(F.concat(F.lit("no card "), F.col("card_id").cast("string")))
    answer = F.when(F.col("answer").isNull(), missing).otherwise(F.col("answer"))
    return joined.withColumn("answer", answer).withColumn("correct", judge(F.col("answer"), F.col("guess")))


def orphan_actions(history: DataFrame, cards: DataFrame) -> DataFrame:
    """Actions on cards that do not exist."""
    return history.join(cards, "card_id", "left_anti")


def split_history(
    history: DataFrame,
    keys: list[str] | None = None,
    size: ChunkSize = DEFAULT_SIZE,
    source: DataFrame | None = None,
) -> Chunked:
    """The history in chunks per (user, deck), or per the given keys."""
    return split_groups(history, keys or DECK, ORDER, size, source)


def derive_drop(judged: Chunked, stored: str | None = None) -> DataFrame:
    """Drop a correct guess that follows a wrong one: the answer had been shown.

    The previous guess of a chunk's first row is the last one of the chunk before;
    ``stored`` names a column with the verdict on the guess before all of these rows.
    """
    carry = judged.carry(
        {"_last": F.max_by("correct", F.struct(*judged.order))},
        {"_last_before": F.last("_last")},
    )
    previous = F.lag("correct").over(judged.window())
    rows = judged.join_carry(judged.rows.withColumn("_previous", previous), carry)
    known = ["_previous", "_last_before"] if stored is None else ["_previous", "_last_before", stored]
    before = F.coalesce(*known, F.lit(True))
    dropped = (F.col("correct") & ~before).cast("int")
    return rows.withColumn("drop_action", dropped).drop("_previous", "_last_before")


def presentation_attempts(judged: Chunked) -> DataFrame:
    """Guesses per showing of a card: a showing lasts until a correct guess."""
    solved = F.col("correct").cast("bigint")
    carry = judged.carry({"_solved": F.sum(solved)}, {"_solved_before": F.sum("_solved")})
    earlier = judged.window().rowsBetween(Window.unboundedPreceding, -1)
    rows = judged.rows.withColumn("_local", F.coalesce(F.sum(solved).over(earlier), F.lit(0)))
    none = F.lit(0).cast("bigint")
    showing = F.col("_local") + F.coalesce("_solved_before", none)
    return (
        judged.join_carry(rows, carry)
        .withColumn("showing", showing)
        .groupBy(*judged.keys, "showing")
        .agg(
            F.count("*").alias("attempts"),
            F.bool_or("correct").alias("solved"),
            F.min("created_at").alias("first_at"),
            F.max("created_at").alias("last_at"),
        )
    )


def shown_to_guess(
    shows: DataFrame, guesses: DataFrame, size: ChunkSize = DEFAULT_SIZE, source: DataFrame | None = None
) -> DataFrame:
    """For each guess of a user the time since a card was last shown to them.

    Both inputs hold (user_id, moment, event_id). A guess with nothing shown
    before has no duration.
    """
    order = ["moment", "event_id"]
    kept = ["user_id", *order]
    rows = (
        shows.select(*kept)
        .withColumn("_shown", F.col("moment"))
        .unionByName(guesses.select(*kept).withColumn("_shown", F.lit(None).cast("timestamp_ntz")))
    )
    cut = split_groups(rows, ["user_id"], order, size, source)
    carry = cut.carry({"_last": F.max("_shown")}, {"_shown_before": F.max("_last")})
    up_to = cut.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.rows.withColumn("_latest", F.last("_shown", ignorenulls=True).over(up_to))
    shown_at = F.coalesce("_latest", "_shown_before")
    return (
        cut.join_carry(local, carry)
        .where(F.col("_shown").isNull())
        .select(
            "event_id",
            "user_id",
            shown_at.alias("shown_at"),
            F.col("moment").alias("guessed_at"),
            (F.timestamp_diff("MICROSECOND", shown_at, F.col("moment")) / F.lit(1e6)).alias("duration"),
        )
    )
