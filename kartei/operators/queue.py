"""The due queue: which cards are ready, and which comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartei.operators.cards import attach_cards
from kartei.operators.history import CARD, DECK

# Progress at which the due filter takes a card for learned, and
# the progress of an inactive card.
LEARNED_PROGRESS = 5
INACTIVE_PROGRESS = -1


def moment(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def is_due(as_of: str | Column, learned_progress: int = LEARNED_PROGRESS) -> Column:
    """Ready before ``as_of``, not learned by the filter's own measure, not inactive."""
    progress = F.col("card_progress")
    return (F.col("date_ready") < moment(as_of)) & (progress != learned_progress) & (progress != INACTIVE_PROGRESS)


def due_cards(decks: DataFrame, as_of: str | Column) -> DataFrame:
    return decks.where(is_due(as_of))


def next_due_card(decks: DataFrame, as_of: str | Column, count: int = 1) -> DataFrame:
    """The ``count`` cards of each (user, deck) that have been due longest.

    Spark limits the groups before the shuffle, so a large deck sends only
    ``count`` rows per task.
    """
    queue = Window.partitionBy(*DECK).orderBy("date_ready", "card_id")
    return due_cards(decks, as_of).withColumn("place", F.row_number().over(queue)).where(F.col("place") <= count)


def due_card_content(decks: DataFrame, cards: DataFrame, as_of: str | Column, count: int = 1) -> DataFrame:
    """The next cards with their redacted prompts and answers; missing cards are skipped."""
    return attach_cards(next_due_card(decks, as_of, count), cards)


def status_lookup(decks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The statuses of the wanted (user, deck, card) triples."""
    return decks.join(wanted.select(*CARD).distinct(), CARD, "left_semi")
