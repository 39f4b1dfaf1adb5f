"""Replaying guess histories to scheduling states.

A replay is a fold in time order, and one card of one user may own a large share
of all rows. So no key's actions are collected: each chunk is cut at its perfect
answers into at most eleven stretches (after ten perfect answers a card is
learned and nothing changes), the stretches are summed up by plain aggregates,
and only those summaries are folded per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartei.functions.judging import JUDGES, MODES, quality, with_ratio, with_ratios
from kartei.functions.scheduling import (
    LEARNED_AT,
    NAIVE_LEARNED_AT,
    add_seconds,
    due_delay,
    naive_wait,
    new_state,
    sm2_stretch,
)
from kartei.operators.cards import answers
from kartei.operators.history import CARD, DECK, ORDER
from kartei.plans.chunks import CHUNK, DEFAULT_SIZE, Chunked, ChunkSize, split_groups

STATE_FIELDS = ["ease_factor", "interval", "is_learned", "progress", "times_seen"]
_STRETCHES = "_stretches"


def graded_actions(
    history: DataFrame,
    cards: DataFrame,
    case_insensitive: bool = True,
    umlaut_insensitive: bool = True,
    judge: str | None = None,
) -> DataFrame:
    """The history with ``ratio`` and ``grade`` of every guess; a named judge takes the place of the two switches."""
    joined = history.join(answers(cards), "card_id")
    if judge is None:
        rated = with_ratio(joined, "ratio", case_insensitive, umlaut_insensitive)
    else:
        rated = joined.withColumn("ratio", JUDGES[judge](F.col("answer"), F.col("guess")))
    return rated.withColumn("grade", quality(F.col("ratio")))


def graded_in_all_modes(history: DataFrame, cards: DataFrame) -> DataFrame:
    """Four rows per action, one for each pair of judge switches."""
    rated = history.join(answers(cards), "card_id")
    modes = {f"_ratio_{int(case)}{int(umlaut)}": (case, umlaut) for case, umlaut in MODES}
    rated = with_ratios(rated, modes)
    entries = [
        F.struct(
            F.lit(case).alias("case_insensitive"),
            F.lit(umlaut).alias("umlaut_insensitive"),
            quality(F.col(name)).alias("grade"),
        )
        for name, (case, umlaut) in modes.items()
    ]
    return rated.withColumn("_mode", F.explode(F.array(*entries))).select("*", "_mode.*").drop("_mode", *modes)


def _stretch_rows(graded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per stretch: (keys, chunk, stretch, last_at, is_dropped, summary columns).

    The first answer of a chunk is a stretch of its own, so that the fold can
    treat a card's very first answer on its own. Dropped actions only carry time.
    """
    in_order = Window.partitionBy(*keys, CHUNK, "drop_action").orderBy(*ORDER)
    up_to = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("grade") <= 3
    ranked = (
        graded.withColumn("_rank", F.row_number().over(in_order))
        .withColumn("_fours", F.count_if(F.col("grade") == 4).over(up_to))
        .withColumn("_fives", F.coalesce(F.count_if(F.col("grade") == 5).over(before), F.lit(0)))
    )
    dropped = F.col("drop_action") == 1
    # -2: dropped, -1: first of the chunk, otherwise the number of fives before;
    # past the tenth five only the time of an action still matters
    stretch = (
        F.when(dropped | (F.col("_fives") >= LEARNED_AT), -2)
        .when(F.col("_rank") == 1, -1)
        .otherwise(F.col("_fives"))
    )
    last_low = F.max(F.when(low, F.col("_fours")))
    fours = F.count_if(F.col("grade") == 4)
    return (
        ranked.withColumn("_stretch", stretch.cast("int"))
        .groupBy(*keys, CHUNK, "drop_action", "_stretch")
        .agg(
            F.max("created_at").alias("last_at"),
            F.count("*").alias("answers"),
            fours.alias("fours"),
            F.coalesce(F.max("_fours") - last_low, fours).alias("fours_after_low"),
            F.bool_or(low).alias("has_low"),
            F.max_by("grade", "_rank").alias("last_grade"),
        )
    )


_SUMMARY = ["answers", "fours", "fours_after_low", "has_low", "last_grade"]


def _collected(stretches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, last_at, _stretches): at most a dozen summaries per chunk of a key."""
    entry = F.struct(CHUNK, "_stretch", *_SUMMARY)
    counted = F.when(F.col("_stretch") > -2, entry)
    return stretches.groupBy(*keys).agg(
        F.max("last_at").alias("last_at"),
        F.sort_array(F.collect_list(counted)).alias(_STRETCHES),
    )


@lru_cache(maxsize=8)
def _folded(start: str | None, application: str) -> Column:
    """The fold of a key's stretches from a fresh state, or from a column; built once per application."""
    fresh = new_state()
    first = fresh if start is None else F.coalesce(F.col(start), fresh)
    return F.aggregate(F.col(_STRETCHES), first, sm2_stretch)


def _fold(rows: DataFrame, start: str | None = None) -> Column:
    return _folded(start, rows.sparkSession.sparkContext.applicationId)


def replay(graded: DataFrame, keys: Sequence[str] = CARD) -> DataFrame:
    """(keys, last_at, state) from graded actions in chunks.

    ``last_at`` is the time of the last action, dropped or not; the state comes
    from the actions that were not dropped.
    """
    folded = _collected(_stretch_rows(graded, keys), keys)
    return folded.select(*keys, "last_at", _fold(folded).alias("state"))


def split_graded(
    graded: DataFrame, size: ChunkSize = DEFAULT_SIZE, source: DataFrame | None = None, keys: Sequence[str] = DECK
) -> Chunked:
    """Graded actions in chunks per (user, deck), which also keep each card in order."""
    return split_groups(graded, keys, ORDER, size, source)


def sm2_replay(chunked: Chunked, keys: Sequence[str] = CARD) -> DataFrame:
    """The state of every card with an action that was not dropped."""
    rows = chunked.rows.where(F.col("drop_action") == 0)
    return replay(rows, keys).select(*keys, "state.*")


def card_status(chunked: Chunked, keys: Sequence[str] = CARD) -> DataFrame:
    """When each card is due again, counted from its last action of any kind."""
    return status_of(replay(chunked.rows, keys), keys)


def status_of(states: DataFrame, keys: Sequence[str] = CARD) -> DataFrame:
    """Deck rows of replayed states."""
    return states.select(
        *keys,
        add_seconds(F.col("last_at"), due_delay(F.col("state.interval"))).alias("date_ready"),
        F.col("state.is_learned").alias("card_learned"),
        F.col("state.progress").alias("card_progress"),
        F.col("state.times_seen").cast("int").alias("times_seen"),
    )


def snapshot(chunked: Chunked) -> DataFrame:
    """(keys, last_order, state): what later actions are folded onto; last_order is the (created_at, event_id) reached."""
    last = chunked.rows.groupBy(*CARD).agg(F.max(F.struct(*ORDER)).alias("last_order"))
    return replay(chunked.rows).select(*CARD, "state").join(last, CARD).select(*CARD, "last_order", "state")


def late_keys(new: DataFrame, stored: DataFrame, keys: Sequence[str] = CARD) -> DataFrame:
    """The keys with a new action at or before the last one stored: what came of them can not be moved on."""
    first = new.groupBy(*keys).agg(F.min(F.struct(*ORDER)).alias("_first"))
    return first.join(stored.select(*keys, "last_order"), list(keys)).where(F.col("_first") <= F.col("last_order")).select(*keys)


def sm2_incremental(stored: DataFrame, new: DataFrame, history: DataFrame, size: ChunkSize = DEFAULT_SIZE) -> DataFrame:
    """Stored states moved on by new graded actions, some of which may be older than what is stored.

    ``stored`` is a ``snapshot``, and so is the result. Cards whose new actions all come after
    the stored ones are moved on from their states. The others are replayed from
    ``history``, the graded actions behind ``stored``, of which only their rows
    are used; an action that both hold counts once.
    """
    late = late_keys(new, stored)
    fresh = split_graded(new.join(late, CARD, "left_anti"), size, keys=CARD)
    moved = _collected(_stretch_rows(fresh.rows, CARD), CARD)
    last = fresh.rows.groupBy(*CARD).agg(F.max(F.struct(*ORDER)).alias("_new_order"))
    moved = moved.select(*CARD, _STRETCHES).join(last, CARD)
    kept = stored.join(late, CARD, "left_anti").withColumnsRenamed({"last_order": "_stored_order", "state": "_stored"})
    joined = kept.join(moved, CARD, "full_outer")
    on_time = joined.select(
        *CARD,
        F.coalesce("_new_order", "_stored_order").alias("last_order"),
        F.when(F.col(_STRETCHES).isNull(), F.col("_stored")).otherwise(_fold(joined, "_stored")).alias("state"),
    )
    needed = [*CARD, *ORDER, "grade", "drop_action"]
    again = history.join(late, CARD, "left_semi").select(*needed).unionByName(new.join(late, CARD, "left_semi").select(*needed))
    again = again.groupBy(*CARD, "event_id").agg(*(F.first(c).alias(c) for c in ("created_at", "grade", "drop_action")))
    return on_time.unionByName(snapshot(split_graded(again, size, keys=CARD)))


def sm2_trajectory(
    graded: DataFrame, size: ChunkSize = DEFAULT_SIZE, source: DataFrame | None = None
) -> DataFrame:
    """The state after each action that was not dropped.

    Within a chunk a row's state follows from the chunk's entry state, the closed
    stretches before it (at most eleven) and the open one it stands in, all of
    which window functions provide; no array grows with the history.
    """
    cut = split_groups(graded.where(F.col("drop_action") == 0), CARD, ORDER, size, source)
    entry = _entry_states(cut)
    window = cut.window()
    up_to = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    grade = F.col("grade")
    closes = (grade == 5) | (F.col("_rank") == 1)
    counted = (
        cut.rows.withColumn("_rank", F.row_number().over(window).cast("bigint"))
        .withColumn("_fours", F.count_if(grade == 4).over(up_to))
        .withColumn("_fives", F.coalesce(F.count_if(grade == 5).over(before), F.lit(0)))
    )
    # where the open stretch began, and the fours counted by its last low grade
    began = (
        counted.withColumn("_began", F.coalesce(F.max(F.when(closes, F.col("_rank"))).over(before), F.lit(0)))
        .withColumn("_fours_began", F.coalesce(F.max(F.when(closes, F.col("_fours"))).over(before), F.lit(0)))
        .withColumn("_low_rank", F.max(F.when(grade <= 3, F.col("_rank"))).over(up_to))
        .withColumn("_low_fours", F.max(F.when(grade <= 3, F.col("_fours"))).over(up_to))
    )
    has_low = F.coalesce(F.col("_low_rank") > F.col("_began"), F.lit(False))
    fours = F.col("_fours") - F.col("_fours_began")
    open_stretch = F.struct(
        (F.col("_rank") - F.col("_began")).alias("answers"),
        fours.alias("fours"),
        F.when(has_low, F.col("_fours") - F.col("_low_fours")).otherwise(fours).alias("fours_after_low"),
        has_low.alias("has_low"),
        grade.alias("last_grade"),
    )
    closed = F.collect_list(F.when(closes & (F.col("_fives") < LEARNED_AT), F.col("_open"))).over(before)
    rows = began.withColumn("_open", open_stretch).withColumn("_closed", closed)
    path = F.concat(F.col("_closed"), F.array("_open"))
    after = F.aggregate(path, F.coalesce("_entry", new_state()), sm2_stretch)
    return (
        cut.join_carry(rows, entry)
        .withColumn("state", after)
        .select("event_id", *CARD, "created_at", "grade", "state.*")
    )


def _entry_states(cut: Chunked) -> DataFrame:
    """(card keys, chunk, _entry): the state each later chunk of a split card starts from."""
    hot = cut.rows.join(F.broadcast(cut.splits.select(*CARD)), CARD, "left_semi")
    per_card = _collected(_stretch_rows(hot, CARD), CARD)
    start = F.struct(
        new_state().alias("state"),
        F.lit(-1).alias("chunk"),
        F.expr("cast(array() as array<struct<chunk:int, state:struct<ease_factor:double, interval:bigint,"
               " is_learned:boolean, progress:int, times_seen:bigint>>>)").alias("entries"),
    )

    def step(acc: Column, stretch: Column) -> Column:
        seen = F.struct(stretch[CHUNK].alias("chunk"), acc["state"].alias("state"))
        entries = F.when(
            stretch[CHUNK] == acc["chunk"], acc["entries"]
        ).otherwise(F.concat(acc["entries"], F.array(seen)))
        return F.struct(
            sm2_stretch(acc["state"], stretch).alias("state"),
            stretch[CHUNK].alias("chunk"),
            entries.alias("entries"),
        )

    entries = F.aggregate(F.col(_STRETCHES), start, step, lambda acc: acc["entries"])
    return per_card.select(*CARD, F.explode(entries).alias("_e")).select(
        *CARD, F.col("_e.chunk").alias(CHUNK), F.col("_e.state").alias("_entry")
    )


def naive_schedule(graded: DataFrame, decks: DataFrame) -> DataFrame:
    """Next status from the last action alone; cards without one keep their status.

    The wait counts from the last action of any kind; the ratio is that of the
    last action that was not dropped. Any answer but a perfect one sets progress
    to 0, and times_seen always is.
    """
    kept = F.col("drop_action") == 0
    last = graded.groupBy(*CARD).agg(
        F.max("created_at").alias("last_at"),
        F.max(F.when(kept, F.struct(*ORDER, "ratio"))).getField("ratio").alias("ratio"),
    )
    ratio = F.col("ratio")
    perfect = ratio == 1.0
    progress = F.when(perfect, F.col("card_progress") + 1).otherwise(F.lit(0))
    unchanged = ratio.isNull()
    return decks.join(last, CARD, "left").select(
        *CARD,
        F.when(unchanged, F.col("date_ready"))
        .otherwise(add_seconds(F.col("last_at"), naive_wait(ratio)))
        .alias("date_ready"),
        F.when(unchanged, F.col("card_learned"))
        .otherwise(perfect & (progress == NAIVE_LEARNED_AT))
        .alias("card_learned"),
        F.when(unchanged, F.col("card_progress")).otherwise(progress).cast("int").alias("card_progress"),
        F.when(unchanged, F.col("times_seen")).otherwise(F.lit(0)).cast("int").alias("times_seen"),
    )


def _schedule_sm2(graded: DataFrame, decks: DataFrame) -> DataFrame:
    return card_status(split_graded(graded))


SCHEDULERS = {"sm2": _schedule_sm2, "naive": naive_schedule}


def schedule_by_name(name: str, graded: DataFrame, decks: DataFrame) -> DataFrame:
    """Deck rows by the scheduler of that name: the status of cards with actions (sm2), or of all deck rows (naive)."""
    if name not in SCHEDULERS:
        raise ValueError(f"no scheduler {name!r}; there are {', '.join(sorted(SCHEDULERS))}")
    return SCHEDULERS[name](graded, decks)


def register_scheduler(name: str, scheduler) -> None:
    """Add a scheduler: (graded actions, decks) -> deck rows."""
    SCHEDULERS[name] = scheduler
