from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from kartei.functions import judging
from kartei.operators import replay
from kartei.operators.history import CARD
from kartei.plans.chunks import DEFAULT_SIZE
from tests.conftest import TINY
from tests.model import ACTION_SCHEMA, FRESH, START, actions, by_card, delay, fold, step

SIZES = [TINY, DEFAULT_SIZE]
MIXES = [(0, 1, 2, 3, 4, 4, 4, 5), (4, 4, 4, 4, 1), (5, 5, 5, 4, 0), (4, 5)]


def graded(spark, rows):
    return spark.createDataFrame(rows, ACTION_SCHEMA).repartition(4)


def kept(group):
    return [r["grade"] for r in group if r["drop_action"] == 0]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("mix", MIXES)
def test_replay_and_status(spark, size, mix):
    rows = actions(11, hot=90, grades=mix)
    groups = by_card(rows)
    cut = replay.split_graded(graded(spark, rows), size)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in replay.sm2_replay(cut).collect()}
    assert got == {k: fold(kept(g)) for k, g in groups.items() if kept(g)}
    statuses = {tuple(r)[:3]: tuple(r)[3:] for r in replay.card_status(cut).collect()}
    want = {}
    for key, group in groups.items():
        ease, interval, learned, progress, seen = fold(kept(group))
        want[key] = (group[-1]["created_at"] + timedelta(seconds=delay(interval)), learned, progress, seen)
    assert statuses == want


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("mix", MIXES)
def test_trajectory(spark, size, mix):
    rows = actions(12, hot=90, grades=mix)
    want = {}
    for group in by_card(rows).values():
        state = FRESH
        for row in group:
            if row["drop_action"] == 0:
                state = step(state, row["grade"])
                want[row["event_id"]] = state
    got = replay.sm2_trajectory(graded(spark, rows), size)
    assert {r.event_id: tuple(r[c] for c in replay.STATE_FIELDS) for r in got.collect()} == want


LATE = {
    "in order": lambda r: r["created_at"] >= START + timedelta(seconds=17),
    "mixed": lambda r: r["created_at"] >= START + timedelta(seconds=17) or r["event_id"] % 5 == 0,
    "one user late": lambda r: r["user_id"] == 1 and r["event_id"] % 2 == 0,
}


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("is_new", LATE.values(), ids=LATE)
def test_incremental_equals_replay(spark, size, is_new):
    rows = actions(13, hot=90)
    old, new = [r for r in rows if not is_new(r)], [r for r in rows if is_new(r)]
    stored = replay.snapshot(replay.split_graded(graded(spark, old), size))
    # an action that is stored already is late, and counts once
    moved = replay.sm2_incremental(stored, graded(spark, new + old[3:4]), graded(spark, old), size)
    whole = replay.snapshot(replay.split_graded(graded(spark, rows), size))
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, whole.select(*moved.columns).collect()))


def test_only_late_keys_are_replayed(spark):
    rows = actions(13, hot=90)
    old, new = [r for r in rows if r["event_id"] % 3], [r for r in rows if r["event_id"] % 3 == 0]
    stored = replay.snapshot(replay.split_graded(graded(spark, old)))
    got = {tuple(r) for r in replay.late_keys(graded(spark, new), stored).collect()}
    order = lambda r: (r["created_at"], r["event_id"])
    last = {k: max(map(order, group)) for k, group in by_card(old).items()}
    assert got == {k for k, group in by_card(new).items() if k in last and min(map(order, group)) <= last[k]} and got


def test_naive_schedule(spark):
    base = dict(user_id=1, deck_id=0, card_id=1, created_at=START, grade=0, drop_action=0, event_id=1)
    rows = [
        dict(base),
        dict(base, event_id=2, created_at=START + timedelta(seconds=5)),
        dict(base, event_id=3, created_at=START + timedelta(seconds=9), drop_action=1),
        dict(base, card_id=2, event_id=4),
        dict(base, card_id=3, event_id=5, drop_action=1),
    ]
    ratio = F.element_at(F.create_map(*[F.lit(x) for x in (1, 0.1, 2, 1.0, 3, 0.9, 4, 0.85, 5, 1.0)]), F.col("event_id").cast("int"))
    actions_rows = graded(spark, rows).withColumn("ratio", ratio)
    ready = START.replace(year=2023)
    decks = spark.createDataFrame(
        [(1, 0, c, ready, False, 4, 8) for c in (1, 2, 3, 4)],
        "user_id bigint, deck_id bigint, card_id bigint, date_ready timestamp_ntz, card_learned boolean,"
        " card_progress int, times_seen int",
    )
    got = {r.card_id: tuple(r)[3:] for r in replay.naive_schedule(actions_rows, decks).collect()}
    assert got == {
        1: (START + timedelta(days=1, seconds=9), True, 5, 0),
        2: (START + timedelta(hours=1), False, 0, 0),
        3: (ready, False, 4, 8),
        4: (ready, False, 4, 8),
    }


def test_modes_and_schedulers(spark):
    history = spark.createDataFrame(
        [(1, 1, 0, 7, "ubung", START, 0), (2, 1, 0, 7, "Übung", START + timedelta(seconds=1), 0)],
        "event_id bigint, user_id bigint, deck_id bigint, card_id bigint, guess string, created_at timestamp_ntz, drop_action int",
    )
    cards = spark.createDataFrame([(7, "Die *Übung*.")], "card_id bigint, prompt string")
    modes = replay.graded_in_all_modes(history, cards)
    got = {(r.event_id, r.case_insensitive, r.umlaut_insensitive): r.grade for r in modes.collect()}
    assert got == {
        (1, False, False): 4, (1, True, False): 4, (1, False, True): 4, (1, True, True): 5,
        (2, False, False): 5, (2, True, False): 5, (2, False, True): 5, (2, True, True): 5,
    }
    plain = replay.graded_actions(history, cards)
    assert replay.SCHEDULERS["sm2"](plain, None).select(*CARD, "times_seen").collect()[0].times_seen == 2
    replay.register_scheduler("again", lambda rows, decks: rows)
    assert replay.schedule_by_name("again", plain, None) is plain
    del replay.SCHEDULERS["again"]
    with pytest.raises(ValueError, match="no scheduler 'again'; there are naive, sm2"):
        replay.schedule_by_name("again", plain, None)


def test_a_named_judge_grades(spark, monkeypatch):
    cards = spark.createDataFrame([(1, "Das *Haus* steht")], "card_id long, prompt string")
    history = spark.createDataFrame([(1, 1, "haus"), (2, 1, "Hauz"), (3, 1, None)], "event_id long, card_id long, guess string")
    monkeypatch.setitem(judging.JUDGES, "always", lambda answer, guess: F.lit(0.4).cast("double"))
    got = {j: {r.event_id: r.grade for r in replay.graded_actions(history, cards, judge=j).collect()} for j in ("exact", "levenshtein", "always")}
    assert got["exact"] == {1: 5, 2: 0, 3: 0} and got["always"] == {1: 2, 2: 2, 3: 2}
    assert got["levenshtein"][1] == 3 and got["levenshtein"][2] == 3
