from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from kartei.operators import history, replay
from kartei.operators.history import CARD, DECK
from kartei.streaming import guesses as streams
from kartei.streaming import keyed, segments
from tests.conftest import TINY
from tests.model import START, actions

PARTS = [(0, 14), (14, 27), (27, 100)]
CARDS = [(0, "das *Haus*"), (1, "die *Übung*"), (2, "der *Baum*")]
WORDS = ["Haus", "Übung", "Baum"]


def guess_rows():
    rows = []
    for r in actions(21, hot=50, grades=(5, 5, 4, 0)):
        word = WORDS[r["card_id"]]
        guess = {5: word.upper(), 4: word[:-1], 0: "xx"}[r["grade"]]
        rows.append((r["event_id"], r["user_id"], r["deck_id"], r["card_id"], guess, 1.0, r["created_at"]))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(guess_rows(), streams.GUESSES)


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame(CARDS, "card_id bigint, prompt string")


def part(rows, bounds):
    low, high = (F.lit(START + timedelta(seconds=s)).cast("timestamp_ntz") for s in bounds)
    return rows.where((F.col("created_at") >= low) & (F.col("created_at") < high))


def flagged(table, cards):
    return history.derive_drop(history.split_history(history.judged_actions(table, cards)))


def in_parts(rows, path, run):
    """Three micro-batches in time order, each run picking up where the last one stopped."""
    for bounds in PARTS:
        part(rows, bounds).coalesce(1).write.mode("append").parquet(path)
        run()


def shuffled(rows, path, run):
    """Three micro-batches of mixed times."""
    for n in (2, 0, 1):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n).coalesce(1).write.mode("append").parquet(path)
        run()


WAYS = pytest.mark.parametrize("cut", [in_parts, shuffled])


SETTINGS = pytest.mark.parametrize("settings", [{"size": TINY, "buckets": 2, "most_segments": 1}])


@WAYS
@SETTINGS
def test_drop_flags(spark, table, cards, tmp_path, cut, settings):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    flags = streams.drop_flags(out, cards, **settings)
    cut(table, source, lambda: flags.run(streams.read_guesses(spark, source), checkpoint))
    got = flags.results().collect()
    want = {r.event_id: r.drop_action for r in flagged(table, cards).collect()}
    assert {r.event_id: r.drop_action for r in got} == want and len(got) == len(want)


@WAYS
@SETTINGS
def test_replay(spark, table, cards, tmp_path, cut, settings):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = flagged(table, cards).drop("answer", "correct", "chunk")
    states = streams.card_states(out, cards, **settings)
    cut(rows, source, lambda: states.run(streams.read_guesses(spark, source, rows.schema), checkpoint))
    batch = replay.card_status(replay.split_graded(replay.graded_actions(rows, cards)))
    assert sorted(map(tuple, states.results().collect())) == sorted(map(tuple, batch.collect()))


@WAYS
def test_daily_progress(spark, table, cards, tmp_path, cut):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = flagged(table, cards).drop("answer", "correct", "chunk")
    progress = streams.daily_progress(out, cards)
    cut(rows, source, lambda: progress.run(streams.read_guesses(spark, source, rows.schema), checkpoint))
    got = {tuple(r)[:2]: r.answered_today for r in progress.results().collect()}
    counted = F.sum(((F.col("drop_action") == 1) | F.col("correct")).cast("int")).alias("n")
    assert got == {tuple(r)[:2]: r.n for r in flagged(table, cards).groupBy(*DECK).agg(counted).collect()}


def by_hash(rows, n, parts=3):
    return rows.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == n)


@WAYS
@SETTINGS
def test_guess_loop(spark, table, cards, tmp_path, settings, cut):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    whole = flagged(table, cards)
    status = replay.card_status(replay.split_graded(replay.graded_actions(whole.drop("answer", "correct", "chunk"), cards)))
    ready = F.lit(START).cast("timestamp_ntz")
    decks = status.select(*CARD, ready.alias("date_ready"), F.lit(False).alias("card_learned"), F.lit(0).alias("card_progress"), F.lit(0).alias("times_seen"))
    loop = keyed.GuessLoop(spark, cards, str(tmp_path / "loop"), decks=decks, **settings)
    cut(table, source, lambda: loop.run(streams.read_guesses(spark, source), checkpoint))

    def as_the_batch():
        assert sorted((r.event_id, r.drop_action) for r in loop.history().collect()) == sorted((r.event_id, r.drop_action) for r in whole.collect())
        got = loop.deck_table()
        assert sorted(map(tuple, got.select(*status.columns).collect())) == sorted(map(tuple, status.collect()))

    as_the_batch()
    loop.process(by_hash(table, 1) if cut is shuffled else part(table, PARTS[2]), 2)  # a repeated micro-batch changes nothing
    as_the_batch()
    loop.process(by_hash(table, 0), 3)  # guesses that are delivered again change nothing
    as_the_batch()


def read_of(rows):
    """(version, bucket) of the files that a table is read from."""
    names = [name.split("/") for name in rows.inputFiles()]
    return {tuple(int(x.split("=")[1]) for x in name if x.startswith(("version=", "bucket="))) for name in names}


@pytest.mark.parametrize("most", [2, 8])
def test_only_touched_buckets_are_read_and_written(spark, tmp_path, most):
    schema = keyed._fields(k="long", n="long")
    table = segments.Segments(spark, str(tmp_path / "t"), schema, ["k"], lambda rows: segments.newest(rows, ["k"]), 16, most)
    commits = segments.Commits(spark, str(tmp_path / "c"))
    assert commits.before() == {}
    held = table.add(spark.range(1000).selectExpr("id AS k", "0L AS n"), 0, [], set(range(16)))
    commits.write(0, {"t": held})
    one = spark.createDataFrame([(7, 1)], schema)
    [bucket] = table.buckets_of(one)
    for version in (1, 2, 3):
        before = commits.before(version)["t"]
        assert {b for _, b in read_of(table._raw(before, {bucket}))} == {bucket}
        after = table.add(one.withColumn("n", F.lit(version).cast("long")), version, before, {bucket})
        written = {b for v, b in read_of(table._raw([s for s in after if s[0] == version], None)) if v == version}
        assert written == {bucket} and [s for s in after if s[1] != bucket] == [s for s in before if s[1] != bucket]
        assert sum(s[1] == bucket for s in after) <= most
        commits.write(version, {"t": after})
    got = {r.k: r.n for r in table.read(commits.before()["t"]).collect()}
    assert got == {k: 0 for k in range(1000)} | {7: 3}
    # what no commit names does not exist, and a repeat starts from the commit before
    table.add(one, 4, commits.before(4)["t"], {bucket})
    assert commits.before() == commits.before(4) and {r.k: r.n for r in table.read(commits.before()["t"]).collect()}[7] == 3
    assert {r.k: r.n for r in table.read(commits.before(3)["t"]).collect()}[7] == 2


def test_late_guesses_alone_are_read_again(spark, table, cards, tmp_path, monkeypatch):
    rows = flagged(table, cards).drop("answer", "correct", "chunk")
    states = streams.card_states(str(tmp_path / "out"), cards, buckets=16)
    reads = []
    real = segments.Segments.read

    def noted(self, held, buckets=None):
        if self.folder.endswith("actions"):
            reads.append(buckets)
        return real(self, held, buckets)

    monkeypatch.setattr(segments.Segments, "read", noted)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    early, late = part(rows, (0, 20)), part(rows, (20, 100))
    kept_back = early.where("user_id = 1 AND event_id % 2 = 0")
    states.process(early.join(kept_back, "event_id", "left_anti"), 0)
    states.process(late.where("user_id <> 1"), 1)
    states.process(late.where("user_id = 1"), 2)
    assert reads == [set(), set(), set()]
    states.process(kept_back, 3)
    assert reads[3] == states._tables()[1].buckets_of(kept_back)
    batch = replay.card_status(replay.split_graded(replay.graded_actions(rows, cards)))
    assert sorted(map(tuple, states.results().collect())) == sorted(map(tuple, batch.collect()))
