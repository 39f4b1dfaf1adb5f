"""Scheduling arithmetic: ease factor, SuperMemo-2 steps and waiting times.

The state is ``struct<ease_factor:double, interval:bigint, is_learned:boolean,
progress:int, times_seen:bigint>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kartei.functions.judging import bind

# Fixed values of the recurrence.
FIRST_EASE = 2.5
LEAST_EASE = 1.3
FIRST_INTERVAL = 6
LEARNED_AT = 10

# Fixed values of the waiting times, in seconds.
WAIT_INTERVAL_1 = 30
WAIT_INTERVAL_6 = 300
WAIT_PER_INTERVAL = 1800
# Beyond this interval the wait would not fit 64-bit nanoseconds.
LONGEST_INTERVAL = 5_124_095

# A run of quality-4 grades reaches a fixed point (or the largest bigint) in
# fewer steps than this from any reachable state; see tests/test_scheduling.py.
RUN_LIMIT = 6000
# The ease alone settles within this many 4s.
EASE_LIMIT = 4


def state(ease: Column, interval: Column, learned: Column, progress: Column, seen: Column) -> Column:
    return F.struct(
        ease.cast("double").alias("ease_factor"),
        interval.cast("bigint").alias("interval"),
        learned.alias("is_learned"),
        progress.cast("int").alias("progress"),
        seen.cast("bigint").alias("times_seen"),
    )


def new_state() -> Column:
    return state(F.lit(FIRST_EASE), F.lit(0), F.lit(False), F.lit(0), F.lit(0))


def ease_factor(ease: Column, grade: Column) -> Column:
    """New ease from the old one and a grade.

    Doubles in this order, cut (not rounded) to two decimals: the cut of the
    binary value is part of the result.
    """
    q = grade.cast("double")
    raw = ease - F.lit(0.8) + F.lit(0.28) * q - F.lit(0.02) * q * q
    cut = (raw * F.lit(100.0)).cast("bigint").cast("double") / F.lit(100.0)
    return F.greatest(cut, F.lit(LEAST_EASE))


def _grown(interval: Column, factor: Column) -> Column:
    # ceil of a double saturates at the largest bigint
    return F.ceil(interval.cast("double") * factor).cast("bigint")


def _next_progress(progress: Column) -> Column:
    return F.when(progress < LEARNED_AT, progress + 1).otherwise(F.lit(0))


def sm2_step(old: Column, grade: Column) -> Column:
    """The state after one graded answer."""

    def with_ease(ease: Column) -> Column:
        seen = old["times_seen"] + 1
        progress = F.when(grade == 5, _next_progress(old["progress"])).otherwise(old["progress"])
        interval = (
            F.when(seen == 1, F.lit(FIRST_INTERVAL).cast("bigint"))
            .when(grade == 5, _grown(old["interval"], ease - F.lit(0.8)))
            .when(grade == 4, _grown(old["interval"], ease - F.lit(1.3)))
            .otherwise(F.lit(1).cast("bigint"))
        )
        kept = F.when((seen == 1) | (grade >= 4), ease).otherwise(old["ease_factor"])
        learned = (grade == 5) & (progress >= LEARNED_AT)
        return state(kept, interval, learned, progress, seen)

    return F.when(old["is_learned"], old).otherwise(bind(ease_factor(old["ease_factor"], grade), with_ease))


def _after_fours(ease: Column, interval: Column, count: Column) -> Column:
    """Ease and interval after ``count`` grades of 4 in a row."""
    four = F.lit(4)
    steps = F.array_repeat(F.lit(0), F.least(count, F.lit(RUN_LIMIT)).cast("int"))
    return F.aggregate(
        steps,
        F.struct(ease.alias("ease"), interval.alias("interval")),
        lambda acc, _: bind(
            ease_factor(acc["ease"], four),
            lambda ease_now: F.struct(
                ease_now.alias("ease"),
                _grown(acc["interval"], ease_now - F.lit(1.3)).alias("interval"),
            ),
        ),
    )


def _first_or_later(old: Column, stretch: Column) -> Column:
    last = stretch["last_grade"]

    def from_rest(rest: Column) -> Column:
        seen = old["times_seen"] + stretch["answers"]

        def with_five(ease: Column) -> Column:
            progress = _next_progress(old["progress"])
            return state(
                ease, _grown(rest["interval"], ease - F.lit(0.8)), progress >= LEARNED_AT, progress, seen
            )

        unchanged = state(rest["ease"], rest["interval"], F.lit(False), old["progress"], seen)
        return F.when(last == 5, bind(ease_factor(rest["ease"], last), with_five)).otherwise(unchanged)

    # A low grade restores the ease and restarts the interval, so only the 4s
    # after the last low grade count for the interval, while every 4 counts for
    # the ease.
    without_low = _after_fours(old["ease_factor"], old["interval"], stretch["fours"])
    fours_before = F.least(stretch["fours"] - stretch["fours_after_low"], F.lit(EASE_LIMIT))
    with_low = bind(
        _after_fours(old["ease_factor"], F.lit(0).cast("bigint"), fours_before),
        lambda before: _after_fours(before["ease"], F.lit(1).cast("bigint"), stretch["fours_after_low"]),
    )
    rest = F.when(stretch["has_low"], with_low).otherwise(without_low)
    return F.when(old["times_seen"] == 0, sm2_step(old, last)).otherwise(bind(rest, from_rest))


def sm2_stretch(old: Column, stretch: Column) -> Column:
    """The state after a whole stretch of answers, of which only the last may be a 5.

    ``stretch`` is ``struct<answers, fours, fours_after_low, has_low, last_grade>``.
    Equal to ``sm2_step`` over the answers one by one. The very first answer of a
    card must come as a stretch of its own.
    """
    return F.when(old["is_learned"], old).otherwise(_first_or_later(old, stretch))


def due_delay(interval: Column) -> Column:
    """Seconds until a card is due again."""
    capped = F.least(interval.cast("bigint"), F.lit(LONGEST_INTERVAL).cast("bigint"))
    return (
        F.when(interval == 1, F.lit(WAIT_INTERVAL_1).cast("bigint"))
        .when(interval == 6, F.lit(WAIT_INTERVAL_6).cast("bigint"))
        .otherwise(capped * F.lit(WAIT_PER_INTERVAL).cast("bigint"))
    )


def add_seconds(moment: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, moment)


# Fixed values of the last-answer scheduler: least ratio and seconds to wait.
NAIVE_WAITS = ((1.0, 86_400), (0.8, 3_600), (0.5, 300), (0.2, 60), (0.0, 1))
NAIVE_LEARNED_AT = 5


def naive_wait(ratio: Column) -> Column:
    """Seconds to wait after an answer, by its ratio alone."""
    wait = F.lit(NAIVE_WAITS[-1][1])
    for least, seconds in reversed(NAIVE_WAITS[:-1]):
        wait = F.when(ratio >= least, F.lit(seconds)).otherwise(wait)
    return wait.cast("bigint")
