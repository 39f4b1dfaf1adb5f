"""The study tables and replayed states as plain SQL, to check the Spark results against.

Each entry of TABLES is one common table expression over the given tables;
``query`` puts the ones a statement needs in front of it.
"""

from __future__ import annotations

import re


def ease(old: str, grade: str) -> str:
    """Ease factor in doubles, cut to two decimals."""
    raw = f"({old} - 0.8::double + 0.28::double * {grade}::double - 0.02::double * {grade}::double * {grade}::double)"
    return f"greatest(trunc({raw} * 100::double) / 100::double, 1.3::double)"


def delay(interval: str) -> str:
    return f"(CASE {interval} WHEN 1 THEN 30 WHEN 6 THEN 300 ELSE least({interval}, 5124095) * 1800 END)"


def plus_seconds(moment: str, seconds: str) -> str:
    return f"({moment} + to_seconds({seconds}))"


def pct(part: str, total: str) -> str:
    return f"round(10000::double * (({part})::double / nullif({total}, 0)::double)) / 100::double"


def fold_umlauts(text: str) -> str:
    return f"translate({text}, 'ÄÖÜäöü', 'AOUaou')"


def key(text: str, case: bool = True, umlaut: bool = True) -> str:
    text = fold_umlauts(text) if umlaut else text
    return f"lower({text})" if case else text


def step(ease_now: str, q: str) -> dict[str, str]:
    """The next state of row ``s`` for grade ``q``, given its new ease."""
    return {
        "ease_factor": f"CASE WHEN s.is_learned THEN s.ease_factor WHEN s.times_seen = 0 OR {q} >= 4 THEN {ease_now} "
        "ELSE s.ease_factor END",
        "interval": f"CASE WHEN s.is_learned THEN s.interval WHEN s.times_seen = 0 THEN 6 "
        f"WHEN {q} = 5 THEN ceil(s.interval::double * ({ease_now} - 0.8::double))::bigint "
        f"WHEN {q} = 4 THEN ceil(s.interval::double * ({ease_now} - 1.3::double))::bigint ELSE 1 END",
        "is_learned": f"s.is_learned OR ({q} = 5 AND s.progress = 9)",
        "progress": f"CASE WHEN s.is_learned OR {q} <> 5 THEN s.progress WHEN s.progress < 10 THEN s.progress + 1 "
        "ELSE 0 END",
        "times_seen": "CASE WHEN s.is_learned THEN s.times_seen ELSE s.times_seen + 1 END",
    }


def step_columns(q: str) -> str:
    types = {"ease_factor": "double", "interval": "bigint", "is_learned": "boolean", "progress": "integer", "times_seen": "bigint"}
    cols = step(ease("s.ease_factor", q), q)
    return ", ".join(f"({expr})::{types[name]} AS {name}" for name, expr in cols.items())


FIRST_STATE = "2.5::double AS ease_factor, 0::bigint AS interval, false AS is_learned, 0::integer AS progress, 0::bigint AS times_seen"
STATE = "ease_factor, interval, is_learned, progress, times_seen"

_LCS_ROW = """list_transform(range(1, length(a) + 2), lambda j: list_max(list_transform(range(1, j + 1),
  lambda t: greatest(r[t], CASE WHEN t > 1 AND substr(a, t - 1, 1) = substr(g, i + 1, 1) THEN r[t - 1] + 1 ELSE 0 END))))"""


def _replay(name: str, source: str, extra: str = "") -> dict[str, str]:
    """States after each non-dropped action of ``source``, per card and ``extra`` key columns."""
    keys = ", ".join(["user_id", "deck_id", "card_id", *([extra] if extra else [])])
    match = " AND ".join(f"a.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    selected = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return {
        f"{name}_steps": f"""SELECT {keys}, event_id, created_at, grade,
  row_number() OVER (PARTITION BY {keys} ORDER BY created_at, event_id) AS n FROM {source} WHERE drop_action = 0""",
        f"{name}_states": f"""SELECT DISTINCT {keys}, 0::bigint AS n, NULL::bigint AS event_id, NULL::timestamp AS created_at,
  NULL::integer AS grade, {FIRST_STATE} FROM {name}_steps
UNION ALL
SELECT {selected}, a.n, a.event_id, a.created_at, a.grade, {step_columns("a.grade")}
FROM {name}_states s JOIN {name}_steps a ON {match} AND a.n = s.n + 1""",
        f"{name}_final": f"""SELECT {keys}, arg_max(ease_factor, n) AS ease_factor, arg_max(interval, n) AS interval,
  arg_max(is_learned, n) AS is_learned, arg_max(progress, n) AS progress, arg_max(times_seen, n) AS times_seen
FROM {name}_states GROUP BY ALL""",
    }


def _graded(name: str, case: bool, umlaut: bool) -> dict[str, str]:
    return {
        f"{name}_keyed": f"SELECT event_id, {key('answer', case, umlaut)} AS a, {key('guess', case, umlaut)} AS g FROM answered",
        f"{name}_lcs": f"""SELECT DISTINCT a, g, 0 AS i, list_transform(range(length(a) + 1), lambda x: 0) AS r FROM {name}_keyed
UNION ALL
SELECT a, g, i + 1, {_LCS_ROW} FROM {name}_lcs WHERE i < length(g)""",
        f"{name}_ratios": f"""SELECT k.event_id, k.a = k.g AS same,
  CASE WHEN length(k.a) + length(k.g) = 0 THEN 0::double
       ELSE (2 * l.r[length(k.a) + 1])::double / (length(k.a) + length(k.g))::double END AS ratio
FROM {name}_keyed k JOIN (SELECT a, g, r FROM {name}_lcs WHERE i = length(g)) l ON k.a = l.a AND k.g = l.g""",
    }


TABLES: dict[str, str] = {
    "lines": """SELECT doc_id, lang, source, (generate_subscripts(parts, 1) - 1)::integer AS line_no, unnest(parts) AS line
FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)""",
    "sentences": """SELECT doc_id * 4294967296 + line_no AS sentence_id, line AS sentence, doc_id, lang FROM lines
WHERE strlen(line) > 1 AND NOT starts_with(line, '-')""",
    "hinted": """SELECT *, strpos(sentence, hint) AS hint_at FROM
  (SELECT *, regexp_extract(sentence, '[A-Za-zÀ-ÖØ-öø-ÿ]{4,}') AS hint FROM sentences)""",
    "cards": """SELECT sentence_id AS card_id, '' AS grammar, hint, upper(lang) AS lang_learn, 'EN-GB' AS lang_user,
  CASE WHEN hint = '' THEN sentence
       WHEN NOT ends_with(sentence, '.') THEN substr(sentence, 1, hint_at - 1) || '*' || hint || substr(sentence, hint_at + length(hint))
       ELSE substr(sentence, 1, hint_at - 1) || '*' || hint || '*' || substr(sentence, hint_at + length(hint)) END AS prompt,
  '[tr] ' || sentence AS word_translation FROM hinted""",
    "checked": """SELECT *, CASE markers WHEN 0 THEN 'no opening' WHEN 1 THEN 'no closing' WHEN 2 THEN 'ok' ELSE 'too many' END AS status,
  CASE WHEN markers = 2 THEN regexp_extract(prompt, '\\*(.*)\\*', 1) END AS answer,
  CASE WHEN markers = 2 THEN regexp_replace(prompt, '\\*.*\\*', '_____') END AS redacted
FROM (SELECT *, length(prompt) - length(replace(prompt, '*', '')) AS markers FROM cards)""",
    "numbered": "SELECT card_id, answer, row_number() OVER (ORDER BY card_id) - 1 AS rn FROM checked WHERE status = 'ok'",
    "card_total": "SELECT count(*) AS n FROM numbered",
    "actions": """SELECT event_id, user_id, user_id % 3 AS deck_id, event_type, value AS duration,
  date_trunc('second', ts) AS created_at FROM events""",
    "guesses": """SELECT event_id, user_id, deck_id, card_id,
  CASE event_type WHEN 'view' THEN answer WHEN 'click' THEN upper(replace(answer, 'ß', 'ss'))
    WHEN 'purchase' THEN translate(answer, 'ÄÖÜäöü', 'AOUaou') WHEN 'signup' THEN left(answer, length(answer) - 1)
    ELSE 'xx' END AS guess, duration, created_at
FROM (SELECT *, (user_id * 7919 + 5 + CASE WHEN event_id % 4 = 0 THEN event_id % 5 ELSE 0 END) % n AS rn FROM actions, card_total)
JOIN numbered USING (rn)""",
    "verdicts": f"""SELECT g.*, c.answer, {key('c.answer')} = {key('g.guess')} AND c.answer <> '' AS correct
FROM guesses g JOIN numbered c USING (card_id)""",
    "judged": """SELECT *, (correct AND NOT coalesce(lag(correct) OVER (PARTITION BY user_id, deck_id ORDER BY created_at, event_id), true))::integer
  AS drop_action, created_at::date AS created_on FROM verdicts""",
    "history": "SELECT event_id, user_id, deck_id, card_id, guess, duration, created_at, drop_action, created_on FROM judged",
    "answered": "SELECT h.*, c.answer FROM history h JOIN numbered c USING (card_id)",
    **_graded("both", True, True),
    **_graded("case", True, False),
    **_graded("umlaut", False, True),
    **_graded("none", False, False),
    "graded": """SELECT j.*, r.ratio, floor(5::double * r.ratio)::integer AS grade
FROM judged j JOIN both_ratios r USING (event_id)""",
    **_replay("sm2", "graded"),
    "all_modes": " UNION ALL ".join(
        f"SELECT j.*, {case} AS case_insensitive, {umlaut} AS umlaut_insensitive, floor(5::double * r.ratio)::integer AS grade "
        f"FROM judged j JOIN {name}_ratios r USING (event_id)"
        for name, case, umlaut in (
            ("none", "false", "false"),
            ("umlaut", "false", "true"),
            ("case", "true", "false"),
            ("both", "true", "true"),
        )
    ),
    **_replay("modes", "all_modes", "case_insensitive, umlaut_insensitive"),
    "last_actions": "SELECT user_id, deck_id, card_id, max(created_at) AS last_at FROM history GROUP BY ALL",
    "statuses": f"""SELECT user_id, deck_id, card_id,
  {plus_seconds('last_at', delay('coalesce(interval, 0)'))} AS date_ready, coalesce(is_learned, false) AS card_learned,
  coalesce(progress, 0)::integer AS card_progress, coalesce(times_seen, 0)::integer AS times_seen
FROM last_actions LEFT JOIN sm2_final USING (user_id, deck_id, card_id)""",
    "pairs": "SELECT DISTINCT user_id, deck_id FROM actions",
    "unseen": """SELECT user_id, deck_id, card_id, timestamp '2024-01-01 00:00:00' AS date_ready, false AS card_learned,
  0::integer AS card_progress, 0::integer AS times_seen
FROM (SELECT *, (user_id * 7919 + 5 + 100) % n AS rn FROM pairs, card_total) JOIN numbered USING (rn)""",
    "decks": "SELECT * FROM statuses UNION ALL SELECT * FROM unseen",
    "users": "SELECT user_id, deck_id, (user_id % 5 + 1)::integer AS daily_goal FROM pairs",
    "translations": """SELECT DISTINCT prompt AS sentence, 'EN' AS target_lang, '[tr] ' || prompt AS translation
FROM cards WHERE lang_learn <> 'FR'""",
    "translated": """SELECT c.*, t.translation,
  CASE WHEN t.translation IS NULL THEN 'no translation' ELSE c.status END AS reason
FROM checked c LEFT JOIN translations t ON c.prompt = t.sentence""",
    "split_words": """SELECT sentence_id, list_filter(regexp_split_to_array(sentence, '[^0-9A-Za-zÀ-ÖØ-öø-ÿ]+'), lambda w: w <> '') AS found
FROM sentences""",
    "tokens": "SELECT sentence_id, (generate_subscripts(found, 1) - 1)::integer AS position, unnest(found) AS word FROM split_words",
    "words": "SELECT row_number() OVER (ORDER BY word) AS word_id, word FROM (SELECT DISTINCT word FROM tokens)",
    "positions": "SELECT word_id, sentence_id, position FROM tokens JOIN words USING (word)",
    "ranked_positions": """SELECT *, ((word_id * 31 + sentence_id % 2147483647 + position) * 48271) % 2147483647 AS rank
FROM positions""",
    "drawn": """SELECT word_id, sentence_id, position, word, sentence FROM
  (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY rank, sentence_id, position) AS place FROM ranked_positions)
  JOIN words USING (word_id) JOIN sentences USING (sentence_id) WHERE place = 1""",
}


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"(?:FROM|JOIN|,) {name}\b", text) is not None


def _needed(text: str, found: list[str]) -> None:
    for name, table in TABLES.items():
        if name not in found and _mentions(text, name):
            _needed(re.sub(rf"\b{name}\b", "", table), found)
            found.append(name)


def query(statement: str) -> str:
    """The statement with every table it needs, in order."""
    names: list[str] = []
    _needed(statement, names)
    tables = [f"{n} AS {'' if _mentions(TABLES[n], n) else 'MATERIALIZED '}({TABLES[n]})" for n in names]
    return f"WITH RECURSIVE {', '.join(tables)} {statement}" if tables else statement
