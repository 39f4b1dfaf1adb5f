"""Looking cards up, with answer and redacted prompt derived from the stored prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.functions.text import STATUS_OK, marked_word, marker_status, redacted_prompt


def with_derived(cards: DataFrame) -> DataFrame:
    """Cards as shown: a prompt that does not parse gives an empty answer and prompt."""
    raw = F.col("prompt")
    return cards.select(
        *[c for c in cards.columns if c != "prompt"],
        F.coalesce(redacted_prompt(raw), F.lit("")).alias("prompt"),
        F.coalesce(marked_word(raw), F.lit("")).alias("answer"),
        marker_status(raw).alias("status"),
    )


def answers(cards: DataFrame) -> DataFrame:
    """(card_id, answer): all that judging needs of a card."""
    return cards.select("card_id", F.coalesce(marked_word(F.col("prompt")), F.lit("")).alias("answer"))


def card_lookup(cards: DataFrame, ids: DataFrame) -> DataFrame:
    """The cards whose id occurs in ``ids``."""
    return with_derived(cards.join(ids.select("card_id").distinct(), "card_id", "left_semi"))


def prompt_lookup(cards: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Redacted prompts by card id; a prompt that does not parse is left out."""
    wanted = cards if ids is None else cards.join(ids.select("card_id").distinct(), "card_id", "left_semi")
    raw = F.col("prompt")
    good = wanted.where(marker_status(raw) == STATUS_OK)
    return good.select("card_id", redacted_prompt(raw).alias("prompt"))


def sample_rows(rows: DataFrame, key: str, count: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """``count`` rows in a pseudo-random order that the seed fixes."""
    shuffled = F.xxhash64(F.col(key), F.lit(seed)) if order is None else order
    return rows.orderBy(shuffled, key).limit(count)


def attach_cards(facts: DataFrame, cards: DataFrame) -> DataFrame:
    return facts.join(with_derived(cards), "card_id")
