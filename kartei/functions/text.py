"""Text columns of a flashcard: markers, redaction, blanks and comparison keys.

A prompt marks the word to learn with one pair of ``*``. All functions take and
return Columns and stay inside the JVM.
"""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker and the two fillers (five and six underscores).
MARKER = "*"
REDACTED = "_____"
BLANK = "______"

# What a marker check can report.
STATUS_OK = "ok"
STATUS_NO_OPENING = "no opening"
STATUS_NO_CLOSING = "no closing"
STATUS_TOO_MANY = "too many"
STATUS_UNMATCHED = "unmatched"

# Vowels with an umlaut and the vowels they are compared as.
UMLAUTS = "ÄÖÜäöü"
VOWELS = "AOUaou"


def marker_count(prompt: Column) -> Column:
    return F.octet_length(prompt) - F.octet_length(F.replace(prompt, F.lit(MARKER), F.lit("")))


def _between(prompt: Column) -> Column:
    """What lies between the two markers of a prompt that has exactly two."""
    return F.substring_index(F.substring_index(prompt, MARKER, 2), MARKER, -1)


def _on_one_line(word: Column) -> Column:
    # a line feed, and nothing else, parts the markers of a pair
    return ~F.contains(word, F.lit("\n"))


def marker_status(prompt: Column) -> Column:
    """``ok`` for exactly two markers on one line, otherwise what is wrong."""
    count = marker_count(prompt)
    return (
        F.when(count == 0, STATUS_NO_OPENING)
        .when(count == 1, STATUS_NO_CLOSING)
        .when(count > 2, STATUS_TOO_MANY)
        .when(~_on_one_line(_between(prompt)), STATUS_UNMATCHED)
        .when(count == 2, STATUS_OK)
    )


def _is_ok(prompt: Column) -> Column:
    """Whether the status is ``ok``, at the cost of one count."""
    return (marker_count(prompt) == 2) & _on_one_line(_between(prompt))


def marked_word(prompt: Column) -> Column:
    """The text between the two markers; NULL unless the prompt is ``ok``."""
    return F.when(_is_ok(prompt), _between(prompt))


def redacted_prompt(prompt: Column) -> Column:
    """The prompt with its marked word replaced by five underscores; NULL unless ``ok``."""
    head, tail = F.substring_index(prompt, MARKER, 1), F.substring_index(prompt, MARKER, -1)
    return F.when(_is_ok(prompt), F.concat(head, F.lit(REDACTED), tail))


def _whole_word(word: Column, unicode: bool) -> Column:
    # Edges know ASCII word characters only, so a word that starts with an umlaut
    # has an edge only next to an ASCII letter, digit or '_'. Java's own \b is
    # Unicode-aware, hence the explicit lookarounds.
    letters = r"[\p{L}\p{N}_]" if unicode else "[0-9A-Za-z_]"
    edge = f"(?:(?<={letters})(?!{letters})|(?<!{letters})(?={letters}))"
    quoted = F.concat(F.lit(r"(?iu:\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    # looking ahead for the word first is cheaper than testing every position for an edge
    return F.concat(F.lit("(?="), quoted, F.lit(")" + edge), quoted, F.lit(edge))


def _literal(replacement: Column) -> Column:
    """Escape ``\\`` and ``$`` so that a replacement is taken as it stands."""
    escaped = F.replace(replacement, F.lit("\\"), F.lit("\\\\"))
    return F.replace(escaped, F.lit("$"), F.lit("\\$"))


def blank_out_word(sentence: Column, word: Column, unicode: bool = False) -> Column:
    """Replace every whole-word, case-insensitive occurrence by six underscores."""
    return F.regexp_replace(sentence, _whole_word(word, unicode), F.lit(BLANK))


def mark_word(sentence: Column, word: Column, unicode: bool = False) -> Column:
    """Replace every such occurrence by ``*word*`` in the given spelling."""
    marked = F.concat(F.lit(MARKER), _literal(word), F.lit(MARKER))
    return F.regexp_replace(sentence, _whole_word(word, unicode), marked)


def translated_word(translation: Column) -> Column:
    """The marked word of a translated sentence, '' if it cannot be read."""
    return F.when(translation.isNotNull(), F.coalesce(marked_word(translation), F.lit("")))


def unmark_translation(translation: Column) -> Column:
    """Drop the markers around the translated word (and a stray ``**`` if there is none)."""
    word = translated_word(translation)
    return F.replace(translation, F.concat(F.lit(MARKER), word, F.lit(MARKER)), word)


def fold_umlauts(text: Column) -> Column:
    return F.translate(text, UMLAUTS, VOWELS)


def fold_case(text: Column) -> Column:
    """Lower case code point by code point.

    ``lower`` works on whole strings: it turns a final Σ into ς and İ into two
    code points. Both are mapped first, so equal keys mean equal runes.
    """
    return F.lower(F.translate(text, "İΣ", "iσ"))


def match_key(text: Column, case_insensitive: bool = True, umlaut_insensitive: bool = True) -> Column:
    """The form two strings are compared in: umlauts first, then case."""
    key = fold_umlauts(text) if umlaut_insensitive else text
    return fold_case(key) if case_insensitive else key


def _simple_fold(char: str) -> str:
    """Simple case folding: one code point for one, so ẞ is ß and İ stays as it is."""
    folded = char.casefold() if len(char.casefold()) == 1 else char.lower()
    return folded if len(folded) == 1 else char


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """All code points that fold to another one, and those."""
    pairs = [(c, _simple_fold(c)) for c in map(chr, range(sys.maxunicode + 1))]
    pairs = [(c, to) for c, to in pairs if c != to]
    return "".join(c for c, _ in pairs), "".join(to for _, to in pairs)


def equal_fold_key(text: Column) -> Column:
    """Equal keys mean equality under simple Unicode case folding (ß stays apart from ss, İ and ı from i)."""
    return F.translate(text, *_folding())


def characters(text: Column) -> Column:
    """The code points of a string; empty for ''."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def lex_before(left: Column, right: Column) -> Column:
    """Whether sequence ``left`` sorts strictly before ``right``; a proper prefix does."""
    return left < right
