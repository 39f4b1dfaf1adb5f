"""Statistics per (user, deck) and per day, all decks in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.operators.history import DECK, actions_between, actions_today
from kartei.operators.queue import is_due

NANOS = 1_000_000_000


def percentage(part: Column, total: Column) -> Column:
    """Per cent with two decimals, half away from zero; NULL of nothing."""
    share = F.try_divide(part.cast("double"), total.cast("double"))
    return F.round(F.lit(10000.0) * share) / F.lit(100.0)


def count_actions_between(history: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    return actions_between(history, start, end).groupBy(*DECK).agg(F.count("*").alias("actions"))


def count_actions_today(history: DataFrame, as_of: str | Column) -> DataFrame:
    return actions_today(history, as_of).groupBy(*DECK).agg(F.count("*").alias("actions"))


def count_ready(decks: DataFrame, as_of: str | Column) -> DataFrame:
    return decks.groupBy(*DECK).agg(F.count_if(is_due(as_of)).alias("cards_ready"))


def _deck_count_columns() -> list[Column]:
    seen = F.col("times_seen")
    return [
        F.count_if(seen == 0).alias("not_seen"),
        F.count_if((seen > 0) & ~F.col("card_learned")).alias("in_progress"),
        F.count_if(F.col("card_learned")).alias("learned"),
    ]


def _total() -> Column:
    return F.col("not_seen") + F.col("in_progress") + F.col("learned")


def deck_counts(decks: DataFrame) -> DataFrame:
    return decks.groupBy(*DECK).agg(*_deck_count_columns()).withColumn("total", _total())


def _share_columns() -> list[Column]:
    return [
        percentage(F.col(c), F.col("total")).alias(f"{c}_percent") for c in ("not_seen", "in_progress", "learned")
    ]


def deck_shares(decks: DataFrame) -> DataFrame:
    return deck_counts(decks).select(*DECK, *_share_columns())


def _correct_count() -> Column:
    return F.count_if((F.col("drop_action") == 0) & F.col("correct"))


def _dropped_count() -> Column:
    return F.count_if(F.col("drop_action") == 1)


def answered_today(judged_today: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Correct guesses plus dropped ones; wrong guesses do not count."""
    return judged_today.groupBy(*(by or DECK)).agg((_correct_count() + _dropped_count()).alias("answered_today"))


def goal_reached(answered: DataFrame, users: DataFrame) -> DataFrame:
    """Every user's goal against the day's answers; no answers count as 0."""
    done = F.coalesce("answered_today", F.lit(0).cast("bigint"))
    return users.join(answered, DECK, "left").select(
        *DECK,
        done.alias("answered_today"),
        "daily_goal",
        (done >= F.col("daily_goal")).alias("goal_reached"),
    )


def _seconds_spent() -> Column:
    """Whole seconds of all durations, each cut to nanoseconds first."""
    nanos = (F.col("duration") * F.lit(float(NANOS))).cast("bigint")
    return F.call_function("div", F.sum(nanos), F.lit(NANOS).cast("bigint"))


def time_spent(actions: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = by or DECK
    spent = actions.groupBy(*keys).agg(_seconds_spent().alias("_spent"))
    return spent.select(*keys, *_minutes_and_seconds())


def _minutes_and_seconds() -> list[Column]:
    sixty = F.lit(60).cast("bigint")
    return [
        F.call_function("div", F.col("_spent"), sixty).alias("minutes"),
        (F.col("_spent") % sixty).alias("seconds"),
    ]


def correct_rate(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of correct guesses among correct and dropped ones."""
    keys = by or DECK
    counts = judged.groupBy(*keys).agg(_correct_count().alias("_correct"), _dropped_count().alias("_dropped"))
    return counts.select(
        *keys, percentage(F.col("_correct"), F.col("_correct") + F.col("_dropped")).alias("correct_rate")
    )


def home_dashboard(judged_today: DataFrame, decks: DataFrame, users: DataFrame, as_of: str | Column) -> DataFrame:
    """One row per (user, deck): queue, deck counts and shares, the day's answers and goal."""
    deck_part = decks.groupBy(*DECK).agg(*_deck_count_columns(), F.count_if(is_due(as_of)).alias("cards_ready"))
    joined = deck_part.join(answered_today(judged_today), DECK, "full_outer").join(users, DECK, "left")
    counts = ["not_seen", "in_progress", "learned", "cards_ready", "answered_today"]
    zero = F.lit(0).cast("bigint")
    return (
        joined.select(*DECK, "daily_goal", *[F.coalesce(c, zero).alias(c) for c in counts])
        .withColumn("total", _total())
        .select(
            *DECK,
            "daily_goal",
            *counts,
            "total",
            (F.col("answered_today") >= F.col("daily_goal")).alias("goal_reached"),
            *_share_columns(),
            percentage(F.col("answered_today"), F.col("daily_goal")).alias("goal_percent"),
        )
    )


def session_summary(judged: DataFrame, by: list[str]) -> DataFrame:
    """Answers, time and rate per group, in one aggregation."""
    sums = judged.groupBy(*by).agg(
        _correct_count().alias("_correct"), _dropped_count().alias("_dropped"), _seconds_spent().alias("_spent")
    )
    answered = F.col("_correct") + F.col("_dropped")
    return sums.select(
        *by,
        answered.alias("answered_today"),
        *_minutes_and_seconds(),
        percentage(F.col("_correct"), answered).alias("correct_rate"),
    )
