"""Schemas of the study tables."""

from __future__ import annotations

from pyspark.sql import types as T

CARDS = T.StructType(
    [
        T.StructField("card_id", T.LongType()),
        T.StructField("grammar", T.StringType()),
        T.StructField("hint", T.StringType()),
        T.StructField("lang_learn", T.StringType()),
        T.StructField("lang_user", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("word_translation", T.StringType()),
    ]
)

GUESSES = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("deck_id", T.LongType()),
        T.StructField("card_id", T.LongType()),
        T.StructField("guess", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

HISTORY = T.StructType([*GUESSES.fields, T.StructField("drop_action", T.IntegerType())])

# As stored: one folder per day.
HISTORY_BY_DAY = T.StructType([*HISTORY.fields, T.StructField("created_on", T.DateType())])

DECKS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("deck_id", T.LongType()),
        T.StructField("card_id", T.LongType()),
        T.StructField("date_ready", T.TimestampNTZType()),
        T.StructField("card_learned", T.BooleanType()),
        T.StructField("card_progress", T.IntegerType()),
        T.StructField("times_seen", T.IntegerType()),
    ]
)
