from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from kartei.operators import queue, stats
from tests.model import START

DECKS = "user_id bigint, deck_id bigint, card_id bigint, date_ready timestamp_ntz, card_learned boolean, card_progress int, times_seen int"
AS_OF = "2024-01-01 00:00:10"


def decks(spark):
    early = START + timedelta(seconds=3)
    return spark.createDataFrame(
        [
            (1, 0, 1, early, False, 0, 0),
            (1, 0, 2, START, False, 4, 3),
            (1, 0, 3, START, False, 5, 6),  # taken for learned by the filter
            (1, 0, 4, START, False, -1, 0),  # inactive
            (1, 0, 5, START + timedelta(seconds=10), False, 1, 1),  # ready exactly then: not yet
            (1, 0, 6, early, True, 10, 12),  # learned cards pass the filter
            (2, 0, 1, START + timedelta(days=1), True, 10, 12),
        ],
        DECKS,
    )


def test_due_queue(spark):
    assert sorted(r.card_id for r in queue.due_cards(decks(spark), AS_OF).collect()) == [1, 2, 6]
    assert [r.card_id for r in queue.next_due_card(decks(spark), AS_OF).collect()] == [2]
    top = queue.next_due_card(decks(spark), AS_OF, 2)
    assert sorted((r.place, r.card_id) for r in top.collect()) == [(1, 2), (2, 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert {r.user_id: r.cards_ready for r in stats.count_ready(decks(spark), AS_OF).collect()} == {1: 3, 2: 0}


def test_deck_counts(spark):
    rows = {r.user_id: r for r in stats.deck_counts(decks(spark)).collect()}
    assert (rows[1].not_seen, rows[1].in_progress, rows[1].learned, rows[1].total) == (2, 3, 1, 6)
    shares = {r.user_id: tuple(r)[2:] for r in stats.deck_shares(decks(spark)).collect()}
    assert shares == {1: (33.33, 50.0, 16.67), 2: (0.0, 0.0, 100.0)}


def test_percentage(spark):
    rows = spark.createDataFrame([(1, 3), (2, 3), (1, 8), (0, 0), (5, 0), (1, 16)], "p bigint, t bigint").coalesce(1)
    got = [r[0] for r in rows.select(stats.percentage(F.col("p"), F.col("t"))).collect()]
    assert got == [33.33, 66.67, 12.5, None, None, 6.25]


def judged(spark):
    return spark.createDataFrame(
        [(1, 0, True, 0, 30.9), (1, 0, False, 0, 31.2), (1, 0, True, 1, 0.0000000019), (2, 0, False, 0, 1.0)],
        "user_id bigint, deck_id bigint, correct boolean, drop_action int, duration double",
    )


def test_daily_numbers(spark):
    assert {r.user_id: r.answered_today for r in stats.answered_today(judged(spark)).collect()} == {1: 2, 2: 0}
    assert {r.user_id: (r.minutes, r.seconds) for r in stats.time_spent(judged(spark)).collect()} == {1: (1, 2), 2: (0, 1)}
    assert {r.user_id: r.correct_rate for r in stats.correct_rate(judged(spark)).collect()} == {1: 50.0, 2: None}
    summary = {r.user_id: tuple(r)[2:] for r in stats.session_summary(judged(spark), ["user_id", "deck_id"]).collect()}
    assert summary == {1: (2, 1, 2, 50.0), 2: (0, 0, 1, None)}


def test_goal(spark):
    users = spark.createDataFrame([(1, 0, 2), (2, 0, 1), (3, 0, 0)], "user_id bigint, deck_id bigint, daily_goal int")
    goals = stats.goal_reached(stats.answered_today(judged(spark)), users)
    assert {r.user_id: r.goal_reached for r in goals.collect()} == {1: True, 2: False, 3: True}


def test_dashboard_keeps_decks_without_answers(spark):
    users = spark.createDataFrame([(1, 0, 4), (2, 0, 1), (3, 0, 1)], "user_id bigint, deck_id bigint, daily_goal int")
    today = judged(spark).where("user_id = 1").unionByName(judged(spark).where("user_id = 2").withColumn("user_id", F.lit(3).cast("bigint")))
    rows = {r.user_id: r for r in stats.home_dashboard(today, decks(spark), users, AS_OF).collect()}
    assert (rows[1].answered_today, rows[1].goal_percent, rows[1].goal_reached) == (2, 50.0, False)
    assert (rows[2].answered_today, rows[2].learned) == (0, 1)
    assert (rows[3].total, rows[3].cards_ready, rows[3].learned_percent) == (0, 0, None)
