from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kartei.operators import history
from kartei.plans.chunks import DEFAULT_SIZE
from tests.conftest import TINY
from tests.model import ACTION_SCHEMA, START, actions, by_deck


def judged(spark, rows):
    return spark.createDataFrame(rows, ACTION_SCHEMA).withColumn("correct", F.col("grade") == 5).repartition(4)


@pytest.mark.parametrize("size", [TINY, DEFAULT_SIZE])
def test_derive_drop(spark, size):
    rows = actions(3, grades=(1, 5))
    want = {}
    for group in by_deck(rows).values():
        before = True
        for row in group:
            correct = row["grade"] == 5
            want[row["event_id"]] = int(correct and not before)
            before = correct
    flagged = history.derive_drop(history.split_history(judged(spark, rows), size=size))
    assert {r.event_id: r.drop_action for r in flagged.collect()} == want


@pytest.mark.parametrize("size", [TINY, DEFAULT_SIZE])
def test_presentation_attempts(spark, size):
    rows = actions(4, grades=(0, 1, 5))
    want = set()
    for key, group in by_deck(rows).items():
        showings = {}
        solved = 0
        for row in group:
            showings.setdefault(solved, []).append(row)
            solved += row["grade"] == 5
        for number, shown in showings.items():
            times = [r["created_at"] for r in shown]
            want.add((*key, number, len(shown), any(r["grade"] == 5 for r in shown), min(times), max(times)))
    got = history.presentation_attempts(history.split_history(judged(spark, rows), size=size))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("size", [TINY, DEFAULT_SIZE])
def test_shown_to_guess(spark, size):
    rows = judged(spark, actions(5, grades=(0, 0, 0, 0, 1))).select(
        "user_id", "event_id", F.col("created_at").alias("moment"), "grade"
    )
    local = sorted(rows.collect(), key=lambda r: (r.moment, r.event_id))
    want, shown = {}, {}
    for row in local:
        if row.grade == 1:
            shown[row.user_id] = row.moment
        else:
            at = shown.get(row.user_id)
            want[row.event_id] = (at, (row.moment - at).total_seconds() if at else None)
    got = history.shown_to_guess(rows.where("grade = 1"), rows.where("grade <> 1"), size)
    assert {r.event_id: (r.shown_at, r.duration) for r in got.collect()} == want


def stored(spark):
    rows = [
        (1, 1, 0, 7, "Haus", 1.5, START, 0),
        (2, 1, 0, 7, "haus", 2.0, START.replace(day=2), 1),
        (3, 1, 0, 8, "x", 2.0, START.replace(day=3), 0),
    ]
    return spark.createDataFrame(
        rows,
        "event_id bigint, user_id bigint, deck_id bigint, card_id bigint, guess string, duration double,"
        " created_at timestamp_ntz, drop_action int",
    )


def cards(spark):
    return spark.createDataFrame([(7, "Das *Haus* ist da.")], "card_id bigint, prompt string")


def test_missing_cards(spark):
    assert {r.event_id for r in history.judged_actions(stored(spark), cards(spark)).collect()} == {1, 2}
    assert [r.event_id for r in history.orphan_actions(stored(spark), cards(spark)).collect()] == [3]
    with pytest.raises(PySparkException, match="no card 8"):
        history.judged_actions_strict(stored(spark), cards(spark)).collect()
    known = history.judged_actions_strict(stored(spark).where("card_id = 7"), cards(spark))
    assert [r.correct for r in known.collect()] == [True, True]


def test_day_filters(spark):
    def ids(rows):
        return sorted(r.event_id for r in rows.collect())

    assert ids(history.actions_between(stored(spark), "2024-01-01", "2024-01-03")) == [1, 2]
    assert ids(history.actions_between(stored(spark), "2024-01-01 23:00:00", "2024-01-03 05:00:00")) == [1, 2]
    assert ids(history.actions_today(stored(spark), "2024-01-03 12:00:00")) == [3]
    assert [r.event_id for r in history.card_actions(stored(spark)).collect()] == [1, 3]
    assert {r.card_id: r.times_answered for r in history.times_answered(stored(spark)).collect()} == {7: 2, 8: 1}
