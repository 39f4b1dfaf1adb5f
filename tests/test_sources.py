from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kartei.functions.text import marked_word
from kartei.operators.cards import card_lookup, prompt_lookup, sample_rows
from kartei.plans import storage
from kartei.sources import lines, sinks
from tests.model import START


def test_sentence_file(spark, tmp_path):
    path = tmp_path / "sentences.txt"
    path.write_text("-- Everyday German\nIch *kaufe* ein Buch.\n\nx\nЯ\n- skip\r\nTwo\rlines\r\n", encoding="utf-8")
    got = [r.line for r in lines.sentence_lines(lines.read_sentence_file(spark, str(path))).collect()]
    assert got == ["Ich *kaufe* ein Buch.", "Я", "Two\rlines\r"]


def test_lines_of_whole_texts(spark):
    texts = spark.createDataFrame([(1, "a\n\nb"), (2, "")], "doc_id int, text string")
    got = sorted(tuple(r) for r in lines.lines_of(texts).collect())
    assert got == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, "")]


SENTENCES = ["El *gato* es blanco.", "sin marca", "Yo *como* a *dos*.", "I *didn't* go.", "no translation *here*"]


def translated(spark):
    sentences = spark.createDataFrame(list(enumerate(SENTENCES)), "card_id bigint, line string")
    table = spark.createDataFrame(
        [(s, "UK", f"tr {s}") for s in SENTENCES[:4]] + [(SENTENCES[4], "EN", "other language")],
        "sentence string, target_lang string, translation string",
    )
    return lines.translate(sentences, table, "UK")


def test_records_and_rejects(spark):
    cards = lines.card_records(translated(spark), lang_learn=F.lit("ES"), lang_user=F.lit("UK"))
    rows = {r.prompt: r for r in cards.collect()}
    assert set(rows) == {SENTENCES[0], SENTENCES[3]}
    card = rows[SENTENCES[0]]
    assert (card.hint, card.answer, card.grammar, card.lang_learn, card.lang_user) == ("gato", "gato", "", "ES", "UK")
    assert card.word_translation == "tr El *gato* es blanco."
    again = {r.prompt: r.card_id for r in lines.card_records(translated(spark), lang_learn=F.lit("ES"), lang_user=F.lit("UK")).collect()}
    assert again == {p: r.card_id for p, r in rows.items()}
    rejects = {r.line: r.reason for r in lines.card_rejects(translated(spark)).collect()}
    assert rejects == {SENTENCES[1]: "no opening", SENTENCES[2]: "too many", SENTENCES[4]: "no translation"}


def test_insert_statements_quote_quotes(spark, tmp_path):
    path = str(tmp_path / "sql")
    cards = lines.card_records(translated(spark), F.lit("id1"), F.lit("ES"), F.lit("UK"))
    lines.write_insert_statements(cards.where(F.contains("prompt", F.lit("didn"))), path)
    assert [r.value for r in spark.read.text(path).collect()] == [
        "INSERT INTO cards (card_id, grammar, hint, lang_learn, lang_user, prompt, word_translation) VALUES "
        "('id1', '', 'didn''t', 'ES', 'UK', 'I *didn''t* go.', 'tr I *didn''t* go.');"
    ]


def test_history_sink(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame(
        [(1, 1, 0, 7, "a", 1.5, START.replace(hour=23, second=59, microsecond=999_999), 0), (2, 1, 0, 7, "b", 0.5, START.replace(day=2), 1)],
        "event_id bigint, user_id bigint, deck_id bigint, card_id bigint, guess string, duration double,"
        " created_at timestamp_ntz, drop_action int",
    )
    sinks.record_actions(rows.where("event_id = 1"), path)
    sinks.record_actions(rows.where("event_id = 2"), path)
    got = sorted((r.event_id, r.created_at, str(r.created_on)) for r in sinks.read_history(spark, path).collect())
    assert got == [(1, START.replace(hour=23, second=59), "2024-01-01"), (2, START.replace(day=2), "2024-01-02")]
    scan = sinks.read_history(spark, path).where(F.col("created_on") == F.lit("2024-01-02").cast("date"))
    assert "PartitionFilters: [isnotnull(created_on" in scan._jdf.queryExecution().toString()


def test_upsert_updates_only(spark):
    schema = "user_id bigint, deck_id bigint, card_id bigint, date_ready timestamp_ntz, card_learned boolean, card_progress int, times_seen int"
    decks = spark.createDataFrame([(1, 0, 7, START, False, 1, 2), (1, 0, 8, START, False, 0, 0)], schema)
    updates = spark.createDataFrame([(1, 0, 7, START.replace(day=3), True, 10, 9), (9, 9, 9, START, True, 1, 1)], schema)
    got = sorted(tuple(r) for r in sinks.deck_upsert(decks, updates).collect())
    assert got == [(1, 0, 7, START.replace(day=3), True, 10, 9), (1, 0, 8, START, False, 0, 0)]


def test_card_lookup(spark):
    cards = spark.createDataFrame(
        [
            (1, "verb, third person, sing.", "warns of; phrasal verb", "DE", "EN-GB", "Der Gemeinde *warnt vor* Hochwasser.", "The community warns of floods."),
            (2, "", "", "DE", "EN-GB", "kaputt *", "broken"),
        ],
        "card_id bigint, grammar string, hint string, lang_learn string, lang_user string, prompt string, word_translation string",
    )
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,)], "card_id bigint")
    rows = {r.card_id: r for r in card_lookup(cards, ids).collect()}
    assert (rows[1].prompt, rows[1].answer) == ("Der Gemeinde _____ Hochwasser.", "warnt vor")
    assert (rows[2].prompt, rows[2].answer, rows[2].status) == ("", "", "no closing")
    assert [tuple(r) for r in prompt_lookup(cards, ids).collect()] == [(1, "Der Gemeinde _____ Hochwasser.")]
    first = [r.card_id for r in sample_rows(cards, "card_id", 1, seed=3).collect()]
    assert first == [r.card_id for r in sample_rows(cards, "card_id", 1, seed=3).collect()]
    assert cards.select(marked_word(F.col("prompt"))).columns


class Session:
    """A stand-in for a session: its master and its checkpoint folder."""

    def __init__(self, master, folder=None):
        self.folder = folder
        self.conf = self.sparkContext = self
        self.master = master

    def get(self, name, default):
        return self.folder if name == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):  # noqa: N802
        return None


def test_shared_folder_comes_from_the_session(spark):
    named = storage.new_folder(Session("yarn", "hdfs://shared/kartei/"), "x")
    assert named.startswith("hdfs://shared/kartei/x-")
    assert storage.shared_folder(spark) == storage.shared_folder(spark)


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session("yarn"))
