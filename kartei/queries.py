"""Every operator as a named query over a folder of given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartei.functions import judging, scheduling, text
from kartei.operators import cards as card_ops
from kartei.operators import corpus, history, queue, replay, stats
from kartei.plans.storage import new_folder
from kartei.sources import lines, sinks
from kartei.sources.schemas import GUESSES, HISTORY
from kartei.sources.study import Study, study_of
from kartei.streaming import guesses as streams
from kartei.streaming import tables
from kartei.streaming.keyed import GuessLoop, Keyed

# Moments the queries are asked for; the events cover 2024-01-01 to 2024-01-30.
AS_OF = "2024-01-30 23:59:59"
START, END = "2024-01-10", "2024-01-20"
CUT = "2024-01-16 00:00:00"

_QUERIES: dict[str, Callable[[Study], DataFrame]] = {}


def query(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    _QUERIES[build.__name__] = build
    return build


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Callable[[Study], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(study_of(spark, folder))

    return {name: bound(build) for name, build in _QUERIES.items()}


col = F.col

# --- sources and sinks ---------------------------------------------------------


@query
def sentence_lines(s: Study) -> DataFrame:
    return lines.sentence_lines(s.lines).select("doc_id", "line_no", "line")


def _translated(s: Study) -> DataFrame:
    return lines.translate(s.cards.select("card_id", "lang_learn", col("prompt").alias("line")), s.translations)


@query
def card_records(s: Study) -> DataFrame:
    identity = lines.card_identity(col("card_id").cast("string"), col("line"))
    return lines.card_records(_translated(s), identity, lang_learn=col("lang_learn"))


@query
def card_rejects(s: Study) -> DataFrame:
    return lines.card_rejects(_translated(s)).select("card_id", "line", "reason")


@query
def card_insert_sql(s: Study) -> DataFrame:
    return s.cards.select("card_id", lines.insert_statement().alias("statement"))


@query
def sentence_file(s: Study) -> DataFrame:
    """All lines written as a text file, and the sentences read from it."""
    path = new_folder(s.spark, f"{s.source}-sentence-file")
    s.lines.select(col("line").alias("value")).write.text(path)
    return lines.sentence_lines(lines.read_sentence_file(s.spark, path)).select("line")


@query
def insert_file(s: Study) -> DataFrame:
    """The statements of all cards, as they stand in the file that is written."""
    path = new_folder(s.spark, f"{s.source}-insert-file")
    lines.write_insert_statements(s.cards, path)
    return lines.read_sentence_file(s.spark, path).select(col("line").alias("statement"))


@query
def translate_join(s: Study) -> DataFrame:
    return _translated(s).select("card_id", "line", "translation")


@query
def record_actions(s: Study) -> DataFrame:
    path = new_folder(s.spark, "recorded")
    sinks.record_actions(s.history, path)
    return sinks.read_history(s.spark, path)


def _graded(s: Study, rows: DataFrame | None = None) -> DataFrame:
    return replay.graded_actions(s.history if rows is None else rows, s.cards)


def _split_graded(s: Study, rows: DataFrame | None = None):
    return replay.split_graded(_graded(s, rows), source=s.history)


def _before(s: Study) -> DataFrame:
    return s.history.where(col("created_at") < queue.moment(CUT))


def _after(s: Study) -> DataFrame:
    return s.history.where(col("created_at") >= queue.moment(CUT))


@query
def deck_upsert(s: Study) -> DataFrame:
    """The deck table as of the cut, updated with the statuses after the later actions."""
    snapshot = s.decks_before(queue.moment(CUT))
    touched = _after(s).select(*history.CARD).distinct()
    updates = replay.card_status(_split_graded(s)).join(touched, history.CARD, "left_semi")
    return sinks.deck_upsert(snapshot, updates)


@query
def status_json(s: Study) -> DataFrame:
    state = F.struct(*[col(c) for c in replay.STATE_FIELDS])
    text_form = F.to_json(state, {"ignoreNullFields": "false"})
    return replay.sm2_replay(_split_graded(s)).select(*history.CARD, text_form.alias("status"))


# --- text and answers ----------------------------------------------------------


@query
def marker_status(s: Study) -> DataFrame:
    return s.cards.select("card_id", text.marker_status(col("prompt")).alias("status"))


@query
def marked_word(s: Study) -> DataFrame:
    return s.cards.select("card_id", text.marked_word(col("prompt")).alias("answer"))


@query
def redacted_prompt(s: Study) -> DataFrame:
    return s.cards.select("card_id", text.redacted_prompt(col("prompt")).alias("prompt"))


def _documents_with_hint(s: Study) -> DataFrame:
    """Whole documents, each with the first word of four letters or more."""
    documents = s.given("documents").select("doc_id", "text")
    hint = F.regexp_extract("text", "[A-Za-zÀ-ÖØ-öø-ÿ]{4,}", 0)
    return documents.withColumn("word", hint).where(col("word") != "")


@query
def blank_out_word(s: Study) -> DataFrame:
    blanked = text.blank_out_word(col("text"), col("word"))
    return _documents_with_hint(s).select("doc_id", "word", blanked.alias("text"))


@query
def mark_word(s: Study) -> DataFrame:
    marked = text.mark_word(col("text"), col("word"))
    return _documents_with_hint(s).select("doc_id", "word", marked.alias("text"))


@query
def unmark_translation(s: Study) -> DataFrame:
    translation = col("translation")
    return s.translations.select(
        "sentence",
        text.translated_word(translation).alias("word_translation"),
        text.unmark_translation(translation).alias("full_translation"),
    )


@query
def fold_umlauts(s: Study) -> DataFrame:
    return s.sentences.select("sentence_id", text.fold_umlauts(col("sentence")).alias("folded"))


@query
def match_key(s: Study) -> DataFrame:
    sentence = col("sentence")
    return s.sentences.select(
        "sentence_id",
        text.match_key(sentence, False, False).alias("exact_key"),
        text.match_key(sentence, True, False).alias("case_key"),
        text.match_key(sentence, False, True).alias("umlaut_key"),
        text.match_key(sentence, True, True).alias("both_key"),
    )


def _answered(s: Study) -> DataFrame:
    return history.judged_actions(s.history, s.cards)


@query
def exact_judge(s: Study) -> DataFrame:
    return _answered(s).select("event_id", judging.exact_ratio(col("answer"), col("guess")).alias("ratio"))


_MODES = {
    "exact_ratio": (False, False),
    "case_ratio": (True, False),
    "umlaut_ratio": (False, True),
    "both_ratio": (True, True),
}


@query
def answer_ratio(s: Study) -> DataFrame:
    return judging.with_ratios(_answered(s), _MODES).select("event_id", *_MODES)


@query
def answer_quality(s: Study) -> DataFrame:
    return _graded(s).select("event_id", "grade")


@query
def is_correct(s: Study) -> DataFrame:
    return _answered(s).select("event_id", "correct")


@query
def lex_order(s: Study) -> DataFrame:
    before = text.lex_before(text.characters(col("guess")), text.characters(col("answer")))
    return _answered(s).select("event_id", before.alias("guess_before_answer"))


# --- scheduling ----------------------------------------------------------------


@query
def ease_factor(s: Study) -> DataFrame:
    """New ease for every ease between 1.30 and 3.50, by the grade of the action."""
    old = F.lit(1.3) + (col("event_id") % 221).cast("double") / F.lit(100.0)
    return _graded(s).select(
        "event_id", "grade", old.alias("old_ease"), scheduling.ease_factor(old, col("grade")).alias("new_ease")
    )


def _varied_state() -> Column:
    """A state that depends on the event, to try single steps from many states."""
    event_id = col("event_id")
    return scheduling.state(
        F.lit(1.3) + (event_id % 221).cast("double") / F.lit(100.0),
        event_id % 97,
        event_id % 13 == 0,
        event_id % 10,
        event_id % 7,
    )


@query
def sm2_step(s: Study) -> DataFrame:
    after = scheduling.sm2_step(col("state"), col("grade"))
    return _graded(s).withColumn("state", _varied_state()).select("event_id", after.alias("after")).select(
        "event_id", "after.*"
    )


@query
def sm2_replay(s: Study) -> DataFrame:
    return replay.sm2_replay(_split_graded(s))


@query
def sm2_trajectory(s: Study) -> DataFrame:
    return replay.sm2_trajectory(_graded(s), source=s.history)


@query
def due_delay(s: Study) -> DataFrame:
    interval = col("event_id") % 50
    return s.history.select("event_id", scheduling.due_delay(interval).alias("seconds"))


@query
def card_status(s: Study) -> DataFrame:
    return replay.card_status(_split_graded(s))


@query
def naive_schedule(s: Study) -> DataFrame:
    return replay.naive_schedule(_graded(s), s.decks)


@query
def sm2_incremental(s: Study) -> DataFrame:
    """States as of the cut, moved on by the later actions and by one in seven earlier ones that arrive late."""
    is_late = col("event_id") % 7 == 3
    stored = _before(s).where(~is_late)
    new = _after(s).unionByName(_before(s).where(is_late))
    moved = replay.sm2_incremental(replay.snapshot(_split_graded(s, stored)), _graded(s, new), _graded(s, stored))
    return moved.select(*history.CARD, col("last_order.created_at").alias("last_at"), "state.*")


@query
def schedule_by_name(s: Study) -> DataFrame:
    """Every registered scheduler over the same actions."""
    graded = _graded(s)
    return reduce(
        DataFrame.unionByName,
        (replay.schedule_by_name(name, graded, s.decks).withColumn("scheduler", F.lit(name)) for name in sorted(replay.SCHEDULERS)),
    )


@query
def judge_by_name(s: Study) -> DataFrame:
    """How every registered judge grades each guess."""
    ratios = {f"{name}_ratio": judging.judge_by_name(name, col("answer"), col("guess")) for name in sorted(judging.JUDGES)}
    return _answered(s).select("event_id", *(judge.alias(name) for name, judge in ratios.items()))


@query
def judge_mode_compare(s: Study) -> DataFrame:
    graded = replay.graded_in_all_modes(s.history, s.cards)
    keys = [*history.CARD, "case_insensitive", "umlaut_insensitive"]
    return replay.sm2_replay(replay.split_graded(graded, source=s.history), keys)


# --- lookups -------------------------------------------------------------------


@query
def card_lookup(s: Study) -> DataFrame:
    return card_ops.card_lookup(s.cards, s.history)


@query
def prompt_lookup(s: Study) -> DataFrame:
    return card_ops.prompt_lookup(s.cards)


@query
def status_lookup(s: Study) -> DataFrame:
    return queue.status_lookup(s.decks, history.actions_today(s.history, AS_OF))


@query
def card_actions(s: Study) -> DataFrame:
    actions = history.card_actions(s.history)
    return actions.select("user_id", "deck_id", "card_id", "event_id", "guess", "duration", "created_at")


_ACTION = ["event_id", "user_id", "deck_id", "card_id", "guess", "duration", "drop_action"]


@query
def actions_between(s: Study) -> DataFrame:
    return history.actions_between(s.history, START, END).select(*_ACTION)


@query
def actions_today(s: Study) -> DataFrame:
    return history.actions_today(s.history, AS_OF).select(*_ACTION)


@query
def deck_actions(s: Study) -> DataFrame:
    return history.deck_actions(s.history, s.users).select(*_ACTION, "created_at")


@query
def due_cards(s: Study) -> DataFrame:
    return queue.due_cards(s.decks, AS_OF)


def _judged_today(s: Study) -> DataFrame:
    return history.judged_actions(history.actions_today(s.history, AS_OF), s.cards)


@query
def goal_reached(s: Study) -> DataFrame:
    return stats.goal_reached(stats.answered_today(_judged_today(s)), s.users)


# --- joins ---------------------------------------------------------------------


def _labelled_cards(s: Study) -> DataFrame:
    """The cards of labelled documents: a deck from which cards have gone missing."""
    labels = s.given("labels").select("doc_id").distinct()
    doc_id = F.shiftright("card_id", 32)
    return s.cards.withColumn("doc_id", doc_id).join(labels, "doc_id", "left_semi").drop("doc_id")


_VERDICT = ["event_id", "user_id", "deck_id", "card_id", "drop_action", "answer", "correct"]


@query
def judged_actions(s: Study) -> DataFrame:
    return history.judged_actions(s.history, _labelled_cards(s)).select(*_VERDICT)


@query
def judged_actions_strict(s: Study) -> DataFrame:
    return history.judged_actions_strict(s.history, s.cards).select(*_VERDICT)


@query
def orphan_actions(s: Study) -> DataFrame:
    return history.orphan_actions(s.history, _labelled_cards(s)).select(*_ACTION)


@query
def due_card_content(s: Study) -> DataFrame:
    content = queue.due_card_content(s.decks, s.cards, AS_OF)
    return content.select("user_id", "deck_id", "card_id", "date_ready", "hint", "prompt", "answer")


@query
def sentences_with_word(s: Study) -> DataFrame:
    return corpus.sentences_with_word(s.word_index)


@query
def word_by_id(s: Study) -> DataFrame:
    return corpus.word_by_id(s.word_index.positions, s.word_index.words)


@query
def sentence_by_id(s: Study) -> DataFrame:
    ids = s.cards.select(col("card_id").alias("sentence_id"))
    return corpus.sentence_by_id(ids, s.word_index.sentences)


def _draw_order() -> Column:
    """A draw order both engines can compute."""
    mixed = col("word_id") * 31 + col("sentence_id") % 2147483647 + col("position")
    return (mixed * 48271) % 2147483647


@query
def word_sentence_sample(s: Study) -> DataFrame:
    return corpus.word_sentence_sample(s.word_index, _draw_order())


@query
def candidate_cards(s: Study) -> DataFrame:
    return corpus.candidate_cards(s.word_index, s.translations, order=_draw_order())


@query
def candidate_cards_untranslated(s: Study) -> DataFrame:
    return corpus.candidate_cards(s.word_index, order=_draw_order())


@query
def shown_to_guess(s: Study) -> DataFrame:
    """Events of type view show a card, all others are guesses."""
    events = s.given("events").select("event_id", "user_id", "event_type", col("ts").alias("moment"))
    shows = events.where(col("event_type") == "view")
    answers = events.where(col("event_type") != "view")
    return history.shown_to_guess(shows, answers, source=events)


# --- aggregations --------------------------------------------------------------


@query
def count_actions_between(s: Study) -> DataFrame:
    return stats.count_actions_between(s.history, START, END)


@query
def count_actions_today(s: Study) -> DataFrame:
    return stats.count_actions_today(s.history, AS_OF)


@query
def count_ready(s: Study) -> DataFrame:
    return stats.count_ready(s.decks, AS_OF)


@query
def deck_counts(s: Study) -> DataFrame:
    return stats.deck_counts(s.decks)


@query
def times_answered(s: Study) -> DataFrame:
    return history.times_answered(s.history)


_BY_DAY = [*history.DECK, "created_on"]


@query
def answered_today(s: Study) -> DataFrame:
    return stats.answered_today(_answered(s), _BY_DAY)


@query
def time_spent(s: Study) -> DataFrame:
    return stats.time_spent(s.history, _BY_DAY)


@query
def correct_rate(s: Study) -> DataFrame:
    return stats.correct_rate(_answered(s), _BY_DAY)


@query
def percentage(s: Study) -> DataFrame:
    """The share of each deck's actions that were dropped, per day."""
    counts = s.history.groupBy(*_BY_DAY).agg(F.count_if(col("drop_action") == 1).alias("dropped"), F.count("*").alias("n"))
    return counts.select(*_BY_DAY, stats.percentage(col("dropped"), col("n")).alias("dropped_percent"))


@query
def deck_shares(s: Study) -> DataFrame:
    return stats.deck_shares(s.decks)


@query
def home_dashboard(s: Study) -> DataFrame:
    return stats.home_dashboard(_judged_today(s), s.decks, s.users, AS_OF)


@query
def session_summary(s: Study) -> DataFrame:
    return stats.session_summary(history.judged_actions_strict(s.history, s.cards), _BY_DAY)


# --- windows, samples ----------------------------------------------------------


@query
def next_due_card(s: Study) -> DataFrame:
    return queue.next_due_card(s.decks, AS_OF).select(*history.CARD, "date_ready")


def _judged_guesses(s: Study) -> history.Chunked:
    return history.split_history(history.judged_actions(s.guesses, s.cards), source=s.actions)


@query
def derive_drop(s: Study) -> DataFrame:
    return history.derive_drop(_judged_guesses(s)).select("event_id", "drop_action")


@query
def presentation_attempts(s: Study) -> DataFrame:
    return history.presentation_attempts(_judged_guesses(s))


@query
def sample_cards(s: Study) -> DataFrame:
    order = ((col("card_id") % 2147483647) * 48271) % 2147483647
    return card_ops.sample_rows(s.cards, "card_id", 25, order=order).select("card_id", "prompt")


# --- streams -------------------------------------------------------------------


def _stream_folders(s: Study, name: str) -> tuple[str, str]:
    folder = new_folder(s.spark, f"{s.source}-{name}")
    return f"{folder}/out", f"{folder}/checkpoint"


def _guess_stream(s: Study) -> DataFrame:
    """All guesses in several micro-batches of mixed times."""
    return _in_parts(s, s.guess_path, GUESSES)


def _history_stream(s: Study) -> DataFrame:
    return _in_parts(s, s.history_path, HISTORY)


def _in_parts(s: Study, path: str, schema: T.StructType, parts: int = 4) -> DataFrame:
    files = len(s.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).inputFiles())
    return streams.read_guesses(s.spark, path, schema, recursive=True, max_files=-(-files // parts) or 1)


@query
def stream_judge(s: Study) -> DataFrame:
    def judged(batch: DataFrame) -> DataFrame:
        return streams.judged_batch(batch, s.cards).select("event_id", "ratio", "grade", "correct")

    out, checkpoint = _stream_folders(s, "stream-judge")
    tables.write_batches(_guess_stream(s), out, checkpoint, "append", judged)
    return tables.read_batches(s.spark, out, judged(s.guesses)).drop(tables.BATCH)


def _kept_up(s: Study, name: str, make: Callable[[str, DataFrame], Keyed], stream: DataFrame) -> DataFrame:
    out, checkpoint = _stream_folders(s, name)
    kept = make(out, s.cards)
    kept.run(stream, checkpoint)
    return kept.results()


@query
def stream_drop(s: Study) -> DataFrame:
    return _kept_up(s, "stream-drop", streams.drop_flags, _guess_stream(s))


@query
def stream_sm2(s: Study) -> DataFrame:
    return _kept_up(s, "stream-sm2", streams.card_states, _history_stream(s))


@query
def stream_daily_progress(s: Study) -> DataFrame:
    return _kept_up(s, "stream-progress", streams.daily_progress, _history_stream(s))


def _guess_loop(s: Study) -> GuessLoop:
    """The whole loop over all guesses; every card in play has a deck row."""
    known = s.history.select(*history.CARD).distinct()
    fresh = known.select(
        *history.CARD,
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("date_ready"),
        F.lit(False).alias("card_learned"),
        F.lit(0).alias("card_progress"),
        F.lit(0).alias("times_seen"),
    )
    out, checkpoint = _stream_folders(s, "stream-history")
    loop = GuessLoop(s.spark, s.cards, out, decks=fresh.unionByName(s.unseen))
    loop.run(_guess_stream(s), checkpoint)
    return loop


@query
def stream_history_sink(s: Study) -> DataFrame:
    return _guess_loop(s).history()


@query
def stream_deck_table(s: Study) -> DataFrame:
    return _guess_loop(s).deck_table()


# --- word index ----------------------------------------------------------------


@query
def build_word_index(s: Study) -> DataFrame:
    found = s.stored("found", corpus.tokens(s.sentences))
    words = s.stored("found-words", corpus.number_words(s.stored("found-distinct", corpus.distinct_words(found))))
    return corpus.word_by_id(corpus.word_positions(found, words), words)
