"""One SQL statement per named query, over the tables of ``oracle.tables``."""

from __future__ import annotations

from oracle.tables import STATE, delay, ease, key, pct, plus_seconds, query, step_columns

AS_OF = "timestamp '2024-01-30 23:59:59'"
TODAY = "date '2024-01-30'"
START, END = "date '2024-01-10'", "date '2024-01-20'"
CUT = "timestamp '2024-01-16 00:00:00'"

K = "user_id, deck_id, card_id"
ACTION = "event_id, user_id, deck_id, card_id, guess, duration, drop_action"
DUE = f"date_ready < {AS_OF} AND card_progress <> 5 AND card_progress <> -1"
ANSWERED = "(count(*) FILTER (WHERE drop_action = 1 OR correct))"
SOLVED = "(count(*) FILTER (WHERE drop_action = 0 AND correct))"
SPENT = "sum(trunc(duration * 1e9::double)::bigint)::bigint // 1000000000"
SEEN_COUNTS = (
    "count(*) FILTER (WHERE times_seen = 0) AS not_seen, "
    "count(*) FILTER (WHERE times_seen > 0 AND NOT card_learned) AS in_progress, "
    "count(*) FILTER (WHERE card_learned) AS learned"
)
COUNTS = f"SELECT *, not_seen + in_progress + learned AS total FROM (SELECT user_id, deck_id, {SEEN_COUNTS} FROM decks GROUP BY ALL)"
SHARES = ", ".join(f"{pct(c, 'total')} AS {c}_percent" for c in ("not_seen", "in_progress", "learned"))
TODAY_ANSWERS = f"SELECT user_id, deck_id, {ANSWERED} AS answered_today FROM judged WHERE created_on = {TODAY} GROUP BY ALL"
EDGE_PATTERN = "'\\b(?i)' || {word} || '\\b'"
BLANKED = "regexp_replace({text}, " + EDGE_PATTERN + ", '______', 'g')"
MARKED = "regexp_replace({text}, " + EDGE_PATTERN + ", '*' || {word} || '*', 'g')"
HINTED_DOCS = """(SELECT doc_id, text, regexp_extract(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{4,}') AS word FROM documents)
  WHERE word <> ''"""
STORED = "INSERT INTO cards (card_id, grammar, hint, lang_learn, lang_user, prompt, word_translation) VALUES ("
QUOTED = " || ', ' || ".join(
    f"'''' || replace({c}::varchar, '''', '''''') || ''''"
    for c in ("card_id", "grammar", "hint", "lang_learn", "lang_user", "prompt", "word_translation")
)
OLD_EASE = "1.3::double + (event_id % 221)::double / 100::double"
DRAWN_CARDS = f"""SELECT word_id, sentence_id, word AS answer, {BLANKED.format(text='sentence', word='word')} AS prompt,
  {MARKED.format(text='sentence', word='word')} AS marked_sentence FROM drawn"""
TRANSLATED_WORD = """CASE WHEN length({t}) - length(replace({t}, '*', '')) = 2 THEN regexp_extract({t}, '\\*(.*)\\*', 1) ELSE '' END"""


def translated(t: str) -> str:
    word = TRANSLATED_WORD.format(t=t)
    return (
        f"CASE WHEN {t} IS NOT NULL THEN {word} END AS word_translation, "
        f"replace({t}, '*' || {word} || '*', {word}) AS full_translation"
    )


LABELLED = "(SELECT n.* FROM numbered n WHERE n.card_id // 4294967296 IN (SELECT doc_id FROM labels))"
SUMMARY = f"user_id, deck_id, created_on, {ANSWERED} AS answered_today"

STATEMENTS: dict[str, str] = {
    "sentence_lines": "SELECT doc_id, line_no, line FROM lines WHERE strlen(line) > 1 AND NOT starts_with(line, '-')",
    "card_records": """SELECT sha256(card_id::varchar || chr(31) || prompt) AS card_id, '' AS grammar, answer AS hint, lang_learn,
  'EN-GB' AS lang_user, prompt, translation AS word_translation, answer FROM translated WHERE reason = 'ok'""",
    "card_rejects": "SELECT card_id, prompt AS line, reason FROM translated WHERE reason <> 'ok'",
    "card_insert_sql": f"SELECT card_id, '{STORED}' || {QUOTED} || ');' AS statement FROM cards",
    "translate_join": "SELECT card_id, prompt AS line, translation FROM translated",
    "record_actions": "SELECT * FROM history",
    # the deck table as of the cut, updated by the statuses of cards with later actions
    "deck_upsert": f"""SELECT {K}, date_ready, card_learned, card_progress, times_seen FROM decks
WHERE ({K}) IN (SELECT ({K}) FROM history WHERE created_at < {CUT}) OR ({K}) IN (SELECT ({K}) FROM unseen)""",
    "status_json": f"""SELECT {K}, '{{"ease_factor":' || ease_factor || ',"interval":' || interval || ',"is_learned":' || is_learned
  || ',"progress":' || progress || ',"times_seen":' || times_seen || '}}' AS status FROM sm2_final""",
    "marker_status": "SELECT card_id, status FROM checked",
    "marked_word": "SELECT card_id, answer FROM checked",
    "redacted_prompt": "SELECT card_id, redacted AS prompt FROM checked",
    "blank_out_word": f"SELECT doc_id, word, {BLANKED.format(text='text', word='word')} AS text FROM {HINTED_DOCS}",
    "mark_word": f"SELECT doc_id, word, {MARKED.format(text='text', word='word')} AS text FROM {HINTED_DOCS}",
    "unmark_translation": f"SELECT sentence, {translated('translation')} FROM translations",
    "fold_umlauts": "SELECT sentence_id, translate(sentence, 'ÄÖÜäöü', 'AOUaou') AS folded FROM sentences",
    "match_key": f"""SELECT sentence_id, sentence AS exact_key, {key('sentence', True, False)} AS case_key,
  {key('sentence', False, True)} AS umlaut_key, {key('sentence')} AS both_key FROM sentences""",
    "exact_judge": "SELECT event_id, CASE WHEN lower(answer) = lower(guess) THEN 1::double ELSE 0::double END AS ratio FROM answered",
    "answer_ratio": """SELECT event_id, n.ratio AS exact_ratio, c.ratio AS case_ratio, u.ratio AS umlaut_ratio, b.ratio AS both_ratio
FROM none_ratios n JOIN case_ratios c USING (event_id) JOIN umlaut_ratios u USING (event_id) JOIN both_ratios b USING (event_id)""",
    "answer_quality": "SELECT event_id, grade FROM graded",
    "is_correct": "SELECT event_id, correct FROM judged",
    "lex_order": "SELECT event_id, string_split(guess, '') < string_split(answer, '') AS guess_before_answer FROM answered",
    "ease_factor": f"""SELECT event_id, grade, old_ease, {ease('old_ease', 'grade')} AS new_ease
FROM (SELECT event_id, grade, {OLD_EASE} AS old_ease FROM graded)""",
    "sm2_step": f"""SELECT event_id, {step_columns('s.grade')} FROM (SELECT event_id, grade, {OLD_EASE} AS ease_factor,
  event_id % 97 AS interval, event_id % 13 = 0 AS is_learned, (event_id % 10)::integer AS progress, event_id % 7 AS times_seen
  FROM graded) s""",
    "sm2_replay": f"SELECT {K}, {STATE} FROM sm2_final",
    "sm2_trajectory": f"SELECT event_id, {K}, created_at, grade, {STATE} FROM sm2_states WHERE n > 0",
    "due_delay": f"SELECT event_id, {delay('(event_id % 50)')}::bigint AS seconds FROM history",
    "card_status": "SELECT * FROM statuses",
    "naive_schedule": f"""SELECT {K},
  CASE WHEN ratio IS NULL THEN date_ready ELSE {plus_seconds('last_at', 'CASE WHEN ratio = 1 THEN 86400 WHEN ratio >= 0.8::double THEN 3600 '
    'WHEN ratio >= 0.5::double THEN 300 WHEN ratio >= 0.2::double THEN 60 ELSE 1 END')} END AS date_ready,
  CASE WHEN ratio IS NULL THEN card_learned ELSE ratio = 1 AND card_progress = 4 END AS card_learned,
  (CASE WHEN ratio IS NULL THEN card_progress WHEN ratio = 1 THEN card_progress + 1 ELSE 0 END)::integer AS card_progress,
  CASE WHEN ratio IS NULL THEN times_seen ELSE 0::integer END AS times_seen
FROM decks LEFT JOIN last_actions USING ({K}) LEFT JOIN
  (SELECT {K}, arg_max(ratio, (created_at, event_id)) AS ratio FROM graded WHERE drop_action = 0 GROUP BY ALL) USING ({K})""",
    "sm2_incremental": f"""SELECT {K}, last_at, coalesce(ease_factor, 2.5::double) AS ease_factor, coalesce(interval, 0) AS interval,
  coalesce(is_learned, false) AS is_learned, coalesce(progress, 0)::integer AS progress, coalesce(times_seen, 0) AS times_seen
FROM last_actions LEFT JOIN sm2_final USING ({K})""",
    "judge_mode_compare": f"SELECT {K}, case_insensitive, umlaut_insensitive, {STATE} FROM modes_final",
    "card_lookup": """SELECT card_id, grammar, hint, lang_learn, lang_user, word_translation, coalesce(redacted, '') AS prompt,
  coalesce(answer, '') AS answer, status FROM checked WHERE card_id IN (SELECT card_id FROM history)""",
    "prompt_lookup": "SELECT card_id, redacted AS prompt FROM checked WHERE status = 'ok'",
    "status_lookup": f"SELECT * FROM decks WHERE ({K}) IN (SELECT ({K}) FROM history WHERE created_on = {TODAY})",
    "card_actions": f"SELECT {K}, event_id, guess, duration, created_at FROM history WHERE drop_action = 0",
    "actions_between": f"SELECT {ACTION} FROM history WHERE created_on >= {START} AND created_on < {END}",
    "actions_today": f"SELECT {ACTION} FROM history WHERE created_on = {TODAY}",
    "deck_actions": f"SELECT {ACTION}, created_at FROM history",
    "due_cards": f"SELECT * FROM decks WHERE {DUE}",
    "goal_reached": f"""SELECT user_id, deck_id, coalesce(answered_today, 0) AS answered_today, daily_goal,
  coalesce(answered_today, 0) >= daily_goal AS goal_reached FROM users LEFT JOIN ({TODAY_ANSWERS}) USING (user_id, deck_id)""",
    "judged_actions": f"""SELECT event_id, user_id, deck_id, card_id, drop_action, j.answer, correct FROM judged j
WHERE card_id IN (SELECT card_id FROM {LABELLED})""",
    "judged_actions_strict": "SELECT event_id, user_id, deck_id, card_id, drop_action, answer, correct FROM judged",
    "orphan_actions": f"SELECT {ACTION} FROM history WHERE card_id NOT IN (SELECT card_id FROM {LABELLED})",
    "due_card_content": f"""SELECT user_id, deck_id, card_id, date_ready, hint, redacted AS prompt, answer FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, deck_id ORDER BY date_ready, card_id) AS place FROM decks WHERE {DUE})
  JOIN checked USING (card_id) WHERE place = 1""",
    "sentences_with_word": "SELECT word, sentence_id FROM positions JOIN words USING (word_id)",
    "word_by_id": "SELECT word_id, sentence_id, position, word FROM positions JOIN words USING (word_id)",
    "sentence_by_id": "SELECT sentence_id, sentence FROM sentences",
    "word_sentence_sample": "SELECT sentence_id, word_id, position, word, sentence FROM drawn",
    "candidate_cards": f"""SELECT c.*, {translated('t.translation')} FROM ({DRAWN_CARDS}) c
LEFT JOIN translations t ON c.marked_sentence = t.sentence""",
    "candidate_cards_untranslated": f"""SELECT *, 'Translations are off' AS word_translation,
  'Translations are off' AS full_translation FROM ({DRAWN_CARDS})""",
    "shown_to_guess": """SELECT event_id, user_id, shown_at, ts AS guessed_at, (epoch_us(ts) - epoch_us(shown_at))::double / 1e6::double AS duration
FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown_at FROM events) WHERE event_type <> 'view'""",
    "count_actions_between": f"""SELECT user_id, deck_id, count(*) AS actions FROM history
WHERE created_on >= {START} AND created_on < {END} GROUP BY ALL""",
    "count_actions_today": f"SELECT user_id, deck_id, count(*) AS actions FROM history WHERE created_on = {TODAY} GROUP BY ALL",
    "count_ready": f"SELECT user_id, deck_id, count(*) FILTER (WHERE {DUE}) AS cards_ready FROM decks GROUP BY ALL",
    "deck_counts": COUNTS,
    "times_answered": f"SELECT {K}, count(*) AS times_answered FROM history GROUP BY ALL",
    "answered_today": f"SELECT {SUMMARY} FROM judged GROUP BY ALL",
    "time_spent": f"""SELECT user_id, deck_id, created_on, spent // 60 AS minutes, spent % 60 AS seconds
FROM (SELECT user_id, deck_id, created_on, {SPENT} AS spent FROM history GROUP BY ALL)""",
    "correct_rate": f"SELECT user_id, deck_id, created_on, {pct(SOLVED, ANSWERED)} AS correct_rate FROM judged GROUP BY ALL",
    "percentage": f"""SELECT user_id, deck_id, created_on, {pct('count(*) FILTER (WHERE drop_action = 1)', 'count(*)')} AS dropped_percent
FROM history GROUP BY ALL""",
    "deck_shares": f"SELECT user_id, deck_id, {SHARES} FROM ({COUNTS})",
    "home_dashboard": f"""SELECT *, answered_today >= daily_goal AS goal_reached, {SHARES}, {pct('answered_today', 'daily_goal')} AS goal_percent
FROM (SELECT user_id, deck_id, daily_goal, coalesce(not_seen, 0) AS not_seen, coalesce(in_progress, 0) AS in_progress,
    coalesce(learned, 0) AS learned, coalesce(cards_ready, 0) AS cards_ready, coalesce(answered_today, 0) AS answered_today,
    coalesce(total, 0) AS total
  FROM ({COUNTS}) FULL JOIN (SELECT user_id, deck_id, count(*) FILTER (WHERE {DUE}) AS cards_ready FROM decks GROUP BY ALL)
    USING (user_id, deck_id) FULL JOIN ({TODAY_ANSWERS}) USING (user_id, deck_id) LEFT JOIN users USING (user_id, deck_id))""",
    "session_summary": f"""SELECT user_id, deck_id, created_on, answered_today, spent // 60 AS minutes, spent % 60 AS seconds, correct_rate
FROM (SELECT {SUMMARY}, {SPENT} AS spent, {pct(SOLVED, ANSWERED)} AS correct_rate FROM judged GROUP BY ALL)""",
    "next_due_card": f"""SELECT {K}, date_ready FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, deck_id ORDER BY date_ready, card_id) AS place FROM decks WHERE {DUE})
WHERE place = 1""",
    "derive_drop": "SELECT event_id, drop_action FROM judged",
    "presentation_attempts": """SELECT user_id, deck_id, showing, count(*) AS attempts, bool_or(correct) AS solved,
  min(created_at) AS first_at, max(created_at) AS last_at
FROM (SELECT *, coalesce(sum(correct::bigint) OVER (PARTITION BY user_id, deck_id ORDER BY created_at, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS showing FROM verdicts) GROUP BY user_id, deck_id, showing""",
    "sample_cards": """SELECT card_id, prompt FROM cards ORDER BY ((card_id % 2147483647) * 48271) % 2147483647, card_id LIMIT 25""",
    "stream_judge": "SELECT event_id, ratio, grade, correct FROM graded",
    "stream_drop": "SELECT user_id, deck_id, event_id, drop_action FROM judged",
    "stream_sm2": "SELECT * FROM statuses",
    "stream_daily_progress": """SELECT user_id, deck_id, created_on AS day,
  sum((drop_action = 1 OR correct)::bigint)::bigint AS answered_today FROM judged GROUP BY ALL""",
    "stream_history_sink": f"SELECT {ACTION}, created_at FROM history",
    "stream_deck_table": "SELECT * FROM decks",
    "build_word_index": "SELECT word_id, sentence_id, position, word FROM positions JOIN words USING (word_id)",
}


STATEMENTS["sentence_file"] = f"SELECT line FROM ({STATEMENTS['sentence_lines']})"
STATEMENTS["insert_file"] = f"SELECT statement FROM ({STATEMENTS['card_insert_sql']})"
STATEMENTS["schedule_by_name"] = f"""SELECT {K}, date_ready, card_learned, card_progress, times_seen, 'sm2' AS scheduler FROM statuses
UNION ALL SELECT {K}, date_ready, card_learned, card_progress, times_seen, 'naive' AS scheduler FROM ({STATEMENTS['naive_schedule']})"""
STATEMENTS["judge_by_name"] = f"""SELECT event_id, e.ratio AS exact_ratio, r.exact_ratio AS levenshtein_ratio, case_ratio AS levenshtein_case_ratio,
  umlaut_ratio AS levenshtein_umlaut_ratio, both_ratio AS levenshtein_both_ratio
FROM ({STATEMENTS['exact_judge']}) e JOIN ({STATEMENTS['answer_ratio']}) r USING (event_id)"""


def all_statements() -> dict[str, str]:
    return {name: query(statement) for name, statement in STATEMENTS.items()}
