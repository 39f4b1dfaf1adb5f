from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from kartei.operators import corpus
from kartei.plans import storage
from kartei.sources import study as study_tables
from kartei.sources.study import Study

SENTENCES = {
    1: "Das Haus, das HAUS und das Dorf.",
    2: "und und und -- Übung3!",
    3: "...",
    4: "Die Übung ist im Haus",
}


def index(spark):
    sentences = spark.createDataFrame(list(SENTENCES.items()), "sentence_id bigint, sentence string").repartition(3)
    found = corpus.tokens(sentences).cache()
    words = corpus.number_words(corpus.distinct_words(found).cache()).cache()
    return corpus.WordIndex(words, sentences, corpus.word_positions(found, words).cache())


def expected():
    return {
        (word, sentence_id, position)
        for sentence_id, sentence in SENTENCES.items()
        for position, word in enumerate(w for w in re.split(corpus.SEPARATORS, sentence) if w)
    }


def test_index(no_broadcast):
    built = index(no_broadcast)
    words = {r.word: r.word_id for r in built.words.collect()}
    distinct = sorted({w for w, _, _ in expected()}, key=lambda w: w.encode())
    assert words == {w: i for i, w in enumerate(distinct, 1)}
    names = {i: w for w, i in words.items()}
    assert {(names[r.word_id], r.sentence_id, r.position) for r in built.positions.collect()} == expected()
    pairs = sorted((r.word, r.sentence_id) for r in corpus.sentences_with_word(built).collect())
    assert pairs == sorted((w, s) for w, s, _ in expected())


def test_sample_and_candidates(spark):
    built = index(spark)
    drawn = {r.word: (r.sentence_id, r.position) for r in corpus.word_sentence_sample(built).collect()}
    assert set(drawn) == {w for w, _, _ in expected()}
    assert all((w, s, p) in expected() for w, (s, p) in drawn.items())
    plain = {r.answer: r for r in corpus.candidate_cards(built).collect()}
    assert plain["Dorf"].prompt == "Das Haus, das HAUS und das ______."
    assert plain["Dorf"].full_translation == corpus.NO_TRANSLATIONS
    translations = spark.createDataFrame(
        [("Das Haus, das HAUS und das *Dorf*.", "EN", "The house and the *village*."), ("Die Übung *ist* im Haus", "EN", "no mark")],
        "sentence string, target_lang string, translation string",
    )
    cards = {r.answer: r for r in corpus.candidate_cards(built, translations).collect()}
    assert (cards["Dorf"].word_translation, cards["Dorf"].full_translation) == ("village", "The house and the village.")
    assert (cards["ist"].word_translation, cards["ist"].full_translation) == ("", "no mark")
    assert cards["im"].full_translation is None


def study(spark, tmp_path):
    rows = [(i, "de", "s", f"Das Haus {i} steht im Dorf.\nDie Übung{i % 3} ist im Haus, im HAUS.\n-- nichts\n...") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    docs.write.parquet(f"{tmp_path}/given/documents.parquet")
    return Study(spark, f"{tmp_path}/given")


def test_word_index_stores_no_occurrence_twice(spark, tmp_path, monkeypatch):
    """Tokens are not stored beside positions, and no shuffle holds the occurrences of all words."""
    written = []
    real = study_tables.write_compact
    monkeypatch.setattr(study_tables, "write_compact", lambda frame, path: written.append(path.rsplit("/", 1)[1]) or real(frame, path))
    index = study(spark, tmp_path).word_index
    names = [n.split("-", 1)[1].rsplit("-", 1)[0] for n in written]
    assert names == ["sentences", "distinct-words", "words"] + ["positions"] * study_tables.WORD_PARTS
    got = sorted(tuple(r) for r in index.positions.join(index.words, "word_id").select("word", "sentence_id", "position").collect())
    want = [(w, r.sentence_id, p) for r in index.sentences.collect() for p, w in enumerate(x for x in re.split(corpus.SEPARATORS, r.sentence) if x)]
    assert got == sorted(want)


def test_compact_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get(storage.RELEASE, None)
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: set(blocks.getAllFiles().mkString("\n").split("\n"))
    known = held()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    stored = storage.compact(rows, "rows")
    for _ in range(100):  # files go in the background
        left = [f for f in held() - known if "shuffle_" in f]
        if not left:
            break
        time.sleep(0.1)
    assert left == []
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get(storage.RELEASE, None) == before


def test_candidates_meet_a_table_with_repeats_and_nulls(spark):
    """Cards that a hash rules out keep NULL; others meet each row of the table, as a left join has it."""
    built = index(spark)
    rows = [("Das *Haus*, das HAUS und das Dorf.", "EN", "a *a*"), (None, "EN", "none"), ("Die Übung *ist* im Haus", "EN", "b"), ("Die Übung *ist* im Haus", "EN", None), ("Die Übung ist *im* Haus", "FR", "c")]
    translations = spark.createDataFrame(rows, "sentence string, target_lang string, translation string")
    got = corpus.candidate_cards(built, translations)
    plain = corpus.candidate_cards(built).drop("word_translation", "full_translation")
    table = translations.where("target_lang = 'EN'").select(F.col("sentence").alias("marked_sentence"), F.col("translation").alias("full"))
    want = plain.join(table, "marked_sentence", "left").withColumn("full", F.replace("full", F.lit("*"), F.lit("")))
    assert got.columns == ["marked_sentence", "word_id", "sentence_id", "answer", "prompt", "word_translation", "full_translation"]
    assert sorted(map(str, got.drop("word_translation").collect())) == sorted(map(str, want.withColumnRenamed("full", "full_translation").collect()))


def test_translations_store_sentences_once_and_no_cards(spark, tmp_path, monkeypatch):
    stored = []
    real = Study.stored
    monkeypatch.setattr(Study, "stored", lambda self, name, rows: stored.append((name, rows.columns)) or real(self, name, rows))
    tables = study(spark, tmp_path)
    assert tables.translations.columns == ["sentence", "target_lang", "translation"]
    assert tables.translations.count() > 0
    assert [x for x in stored if x[0] != "sentences"] == [("translations", ["sentence"])]
