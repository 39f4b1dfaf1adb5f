"""Plain Python models, written from the rules, to compare the Spark operators with."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta


def lcs(a: str, b: str) -> int:
    row = [0] * (len(a) + 1)
    for c in b:
        diagonal = 0
        for j, d in enumerate(a, 1):
            diagonal, row[j] = row[j], diagonal + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def step(state, q):
    ease, interval, learned, progress, seen = state
    if learned:
        return state
    new_progress, new_learned = progress, False
    if q == 5:
        new_progress = progress + 1 if progress < 10 else 0
        new_learned = new_progress >= 10
    new_ease = max(math.trunc((ease - 0.8 + 0.28 * q - 0.02 * q * q) * 100) / 100, 1.3)
    if seen == 0:
        return new_ease, 6, new_learned, new_progress, 1
    if q == 5:
        return new_ease, math.ceil(interval * (new_ease - 0.8)), new_learned, new_progress, seen + 1
    if q == 4:
        return new_ease, math.ceil(interval * (new_ease - 1.3)), new_learned, new_progress, seen + 1
    return ease, 1, new_learned, new_progress, seen + 1


FRESH = (2.5, 0, False, 0, 0)


def fold(grades, state=FRESH):
    for q in grades:
        state = step(state, q)
    return state


def delay(interval: int) -> int:
    return {1: 30, 6: 300}.get(interval, min(interval, 5_124_095) * 1800)


START = datetime(2024, 1, 1)


def actions(seed: int, hot: int = 60, users: int = 4, cards: int = 3, grades=(0, 1, 2, 3, 4, 4, 4, 5)):
    """Graded actions of a few users; user 0 owns a large share. Seconds collide on purpose."""
    rng = random.Random(seed)
    rows = []
    for user in range(users):
        for _ in range(hot if user == 0 else rng.randint(0, 12)):
            moment = START + timedelta(seconds=rng.randint(0, 40))
            rows.append(
                dict(
                    user_id=user,
                    deck_id=user % 2,
                    card_id=0 if user == 0 and rng.random() < 0.7 else rng.randrange(cards),
                    created_at=moment,
                    grade=rng.choice(grades),
                    drop_action=int(rng.random() < 0.2),
                )
            )
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    for row, event_id in zip(rows, ids, strict=True):
        row["event_id"] = event_id
    return rows


ACTION_SCHEMA = (
    "user_id bigint, deck_id bigint, card_id bigint, created_at timestamp_ntz, grade int, drop_action int, event_id bigint"
)


def in_order(rows):
    return sorted(rows, key=lambda r: (r["created_at"], r["event_id"]))


def by_card(rows):
    groups = {}
    for row in in_order(rows):
        groups.setdefault((row["user_id"], row["deck_id"], row["card_id"]), []).append(row)
    return groups


def by_deck(rows):
    groups = {}
    for row in in_order(rows):
        groups.setdefault((row["user_id"], row["deck_id"]), []).append(row)
    return groups


def next_state(state: tuple, grade: int) -> tuple:
    """One graded answer: (ease, interval, learned, progress, seen)."""
    ease, interval, learned, progress, seen = state
    if learned:
        return state
    moved = ease - 0.8 + 0.28 * grade - 0.02 * grade * grade
    moved = max(int(moved * 100) / 100, 1.3)
    if grade == 5:
        progress = progress + 1 if progress < 10 else 0
    seen += 1
    if seen == 1:
        ease, interval = moved, 6
    elif grade >= 4:
        factor = moved - (0.8 if grade == 5 else 1.3)
        ease, interval = moved, min(math.ceil(float(interval) * factor), (1 << 63) - 1)
    else:
        interval = 1
    return ease, interval, grade == 5 and progress >= 10, progress, seen
