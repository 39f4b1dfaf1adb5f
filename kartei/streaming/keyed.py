"""Drop flags, card states, daily progress and the whole guess loop, moved on by micro-batches in any order.

What depends on order keeps, for each key, the last (created_at, event_id) it has seen.
Keys of which a micro-batch holds later guesses only are moved on from what is stored. The
keys of late guesses, and only they, are worked out again from the stored rows of their
buckets. So what a micro-batch reads follows the keys it touches, and however a stream is cut, the last result of
each key is that of the batch operator over all that has arrived. A guess that is
delivered again is late and counts once. Hot keys are split as in the batch operators. Guesses without a
user, deck or card belong to no history and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartei.operators.history import CARD, DECK, ORDER, derive_drop, judged_actions
from kartei.operators.replay import graded_actions, late_keys, sm2_incremental, snapshot, split_graded, status_of
from kartei.plans.chunks import DEFAULT_SIZE, ChunkSize, split_groups
from kartei.plans.storage import written
from kartei.sources.schemas import HISTORY
from kartei.sources.sinks import deck_upsert, to_second
from kartei.streaming.segments import VERSION, Commits, Segment, Segments, each_once, newest


def _fields(**types: str | T.DataType) -> T.StructType:
    schema = T.StructType()
    for name, kind in types.items():
        schema.add(name, kind)
    return schema


_DECK = {"user_id": "long", "deck_id": "long"}
_CARD = {**_DECK, "card_id": "long"}
_WHEN = {"created_at": "timestamp_ntz", "event_id": "long"}
_STATE = _fields(ease_factor="double", interval="long", is_learned="boolean", progress="integer", times_seen="long")
STATES = _fields(**_CARD, last_order=_fields(**_WHEN), state=_STATE)
GRADED = _fields(**_CARD, **_WHEN, grade="integer", drop_action="integer")
JUDGED = _fields(**_CARD, event_id="long", guess="string", duration="double", created_at="timestamp_ntz", grade="integer", correct="boolean")
VERDICTS = _fields(**_DECK, last_order=_fields(**_WHEN), correct="boolean")
FLAGGED = T.StructType([*JUDGED.fields, T.StructField("drop_action", T.IntegerType())])
COUNTS = _fields(**_DECK, day="date", answered_today="long")
SEEN = _fields(**_DECK, day="date", event_id="long")


@dataclass
class Keyed:
    """What the four tables have in common: staged micro-batches, commits, and the run."""

    spark: SparkSession
    cards: DataFrame
    folder: str
    size: ChunkSize = DEFAULT_SIZE
    buckets: int = 64
    most_segments: int = 8

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, f"{self.folder}/commits")

    def table(self, name: str, schema: T.StructType, keys: list[str], merge, bucket_by: list[str] | None = None) -> Segments:
        return Segments(self.spark, f"{self.folder}/{name}", schema, keys, merge, self.buckets, self.most_segments, bucket_by)

    def staged(self, rows: DataFrame, schema: T.StructType, name: str, version: int) -> DataFrame:
        """Rows of a micro-batch, judged once and each once, as a table that a repeat replaces."""
        path = f"{self.folder}/staged/{name}/{VERSION}={version}"
        rows.select(*schema.names).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _graded(self, batch: DataFrame, schema: T.StructType, version: int) -> DataFrame:
        rows = batch.where(" AND ".join(f"{k} IS NOT NULL" for k in CARD)).dropDuplicates([*CARD, "event_id"])
        graded = graded_actions(rows, self.cards).withColumn("correct", F.col("ratio") == 1.0)
        return self.staged(graded, schema, "batch", version)

    def process(self, batch: DataFrame, version: int) -> None:
        raise NotImplementedError

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Process all that is there."""
        run = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()


class CardStates(Keyed):
    """Card states over a history that has its drop flags."""

    def _tables(self) -> tuple[Segments, Segments]:
        states = self.table("states", STATES, CARD, lambda rows: newest(rows, CARD))
        return states, self.table("actions", GRADED, CARD, lambda rows: each_once(rows, [*CARD, "event_id"]))

    def process(self, batch: DataFrame, version: int) -> None:
        (states, actions), before = self._tables(), self.commits.before(version)
        held, log = before.get("states", []), before.get("actions", [])
        new = self._graded(batch, GRADED, version)
        touched = states.buckets_of(new)
        stored = states.read(held, touched).join(new.select(*CARD).distinct(), CARD, "left_semi")
        # only the buckets of late guesses are read again
        history = actions.read(log, actions.buckets_of(late_keys(new, stored)))
        moved = sm2_incremental(stored, new, history, self.size)
        self.commits.write(version, {"states": states.add(moved, version, held, touched), "actions": actions.add(new, version, log, touched)})

    def results(self) -> DataFrame:
        """Deck rows of all cards with actions."""
        states, _ = self._tables()
        rows = states.read(self.commits.before().get("states", []))
        return status_of(rows.withColumn("last_at", F.col("last_order.created_at")))


class DropFlags(Keyed):
    """The drop flag of each guess, from the verdict on the guess before it in its deck."""

    def _tables(self) -> tuple[Segments, Segments, Segments]:
        event = [*DECK, "event_id"]
        return (
            self.table("verdicts", VERDICTS, DECK, lambda rows: newest(rows, DECK)),
            self.table("guesses", JUDGED, DECK, lambda rows: each_once(rows, event)),
            self.table("flags", FLAGGED, DECK, lambda rows: newest(rows, event)),
        )

    def _flagged(self, batch: DataFrame, version: int, before: dict[str, list[Segment]]) -> tuple[DataFrame, DataFrame, dict[str, list[Segment]]]:
        """(guesses of decks that moved on, all guesses of decks with late ones, the tables' segments)."""
        verdicts, guesses, flags = self._tables()
        held, log = before.get("verdicts", []), before.get("guesses", [])
        new = self._graded(batch, JUDGED, version)
        touched = verdicts.buckets_of(new)
        stored = verdicts.read(held, touched).join(new.select(*DECK).distinct(), DECK, "left_semi")
        late = self.staged(late_keys(new, stored, DECK), _fields(**_DECK), "late", version)
        before_new = stored.select(*DECK, F.col("correct").alias("_stored"))
        on_time = new.join(late, DECK, "left_anti").join(before_new, DECK, "left")
        moved = derive_drop(split_groups(on_time, DECK, ORDER, self.size, source=new), "_stored")
        moved = self.staged(moved, FLAGGED, "moved", version)
        again = moved.limit(0)
        read_again = guesses.buckets_of(late)
        if read_again:
            rows = guesses.read(log, read_again).join(late, DECK, "left_semi").withColumn(VERSION, F.lit(0))
            rows = each_once(rows.unionByName(new.join(late, DECK, "left_semi").withColumn(VERSION, F.lit(1))), [*DECK, "event_id"])
            again = self.staged(derive_drop(split_groups(rows, DECK, ORDER, self.size)), FLAGGED, "again", version)
        both = moved.unionByName(again)
        last = both.groupBy(*DECK).agg(F.max(F.struct(*ORDER)).alias("last_order"), F.max_by("correct", F.struct(*ORDER)).alias("correct"))
        segments = {
            "verdicts": verdicts.add(last, version, held, touched),
            "guesses": guesses.add(new, version, log, touched),
            "flags": flags.add(both, version, before.get("flags", []), touched),
        }
        return moved, again, segments

    def process(self, batch: DataFrame, version: int) -> None:
        _, _, segments = self._flagged(batch, version, self.commits.before(version))
        self.commits.write(version, segments)

    def flagged(self) -> DataFrame:
        return self._tables()[2].read(self.commits.before().get("flags", []))

    def results(self) -> DataFrame:
        return self.flagged().select(*DECK, "event_id", "drop_action")


class DailyProgress(Keyed):
    """Answers that count towards the goal, per user, deck and UTC day of the actions.

    Counts add up, so a micro-batch adds its own and reads none. What is read is the ids of the days
    that its guesses fall on, so that a guess delivered again is not counted again; other days' buckets stay unread.
    """

    def _tables(self) -> tuple[Segments, Segments]:
        keys = [*DECK, "day"]
        counts = self.table("counts", COUNTS, keys, lambda rows: rows.groupBy(*keys).agg(F.sum("answered_today").alias("answered_today")), ["day"])
        return counts, self.table("seen", SEEN, [*keys, "event_id"], lambda rows: rows, ["day"])

    def process(self, batch: DataFrame, version: int) -> None:
        (counts, seen), before = self._tables(), self.commits.before(version)
        counted = ((F.col("drop_action") == 1) | F.col("correct")).cast("long").alias("answered_today")
        rows = batch.where(" AND ".join(f"{k} IS NOT NULL" for k in CARD)).dropDuplicates([*DECK, "event_id"])
        judged = judged_actions(rows, self.cards).withColumn("day", F.to_date("created_at"))
        schema = T.StructType([*SEEN.fields, COUNTS["answered_today"]])
        new = self.staged(judged.select(*SEEN.names, counted), schema, "batch", version)
        touched = seen.buckets_of(new)
        known = seen.read(before.get("seen", []), touched)
        fresh = self.staged(new.join(known, [*DECK, "day", "event_id"], "left_anti"), schema, "fresh", version)
        sums = fresh.groupBy(*DECK, "day").agg(F.sum("answered_today").alias("answered_today"))
        self.commits.write(version, {"counts": counts.add(sums, version, before.get("counts", []), touched), "seen": seen.add(fresh, version, before.get("seen", []), touched)})

    def results(self) -> DataFrame:
        counts, _ = self._tables()
        return counts.read(self.commits.before().get("counts", []))


@dataclass
class GuessLoop(DropFlags):
    """The whole loop from guess to deck table: flags of each deck, then states of each card."""

    decks: DataFrame | None = None

    def _states(self) -> Segments:
        return self.table("states", STATES, CARD, lambda rows: newest(rows, CARD))

    def process(self, batch: DataFrame, version: int) -> None:
        states, before = self._states(), self.commits.before(version)
        held = before.get("states", [])
        moved, again, segments = self._flagged(batch.withColumn("created_at", to_second(F.col("created_at"))), version, before)
        both = moved.unionByName(again)
        touched = states.buckets_of(both)
        stored = states.read(held, touched).join(moved.select(*CARD).distinct(), CARD, "left_semi")
        # guesses that come after all of their deck come after all of their card
        on_time = sm2_incremental(stored, moved.select(*GRADED.names), moved.select(*GRADED.names).limit(0), self.size)
        refolded = snapshot(split_graded(again, self.size, keys=CARD))
        segments["states"] = states.add(on_time.unionByName(refolded), version, held, touched)
        self.commits.write(version, segments)

    def history(self) -> DataFrame:
        return self.flagged().select(*HISTORY.names)

    def deck_table(self) -> DataFrame:
        """The deck table with the last status of every card that was guessed.

        The decks are stored as they are now, so the plan of what is returned does not hold theirs.
        """
        rows = self._states().read(self.commits.before().get("states", []))
        return deck_upsert(written(self.decks, "decks"), status_of(rows.withColumn("last_at", F.col("last_order.created_at"))))
