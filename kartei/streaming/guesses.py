"""Guess streams: source and judging, which is stateless. What depends on order is in `keyed`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartei.functions.judging import quality, with_ratio
from kartei.operators.cards import answers
from kartei.sources.schemas import GUESSES
from kartei.streaming.keyed import CardStates, DailyProgress, DropFlags


def read_guesses(
    spark: SparkSession, path: str, schema: T.StructType = GUESSES, max_bytes: int = 4 << 30, recursive: bool = False, max_files: int | None = None
) -> DataFrame:
    """A stream over the files of a folder, oldest first; micro-batches are bounded by bytes, or by files."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", str(recursive).lower())
    if max_files is not None:
        return reader.option("maxFilesPerTrigger", str(max_files)).parquet(path)
    return reader.option("maxBytesPerTrigger", str(max_bytes)).parquet(path)


def judged_batch(guesses: DataFrame, cards: DataFrame) -> DataFrame:
    """Guesses with ratio, grade and verdict. Stateless.

    Give it the rows of a micro-batch inside a sink: joins there are adaptive, which a
    stream's own joins are not, so a hot card is split and a small batch is what is broadcast.
    """
    return (
        with_ratio(guesses.join(answers(cards), "card_id"), "ratio")
        .withColumn("grade", quality(F.col("ratio")))
        .withColumn("correct", F.col("ratio") == 1.0)
    )


def drop_flags(folder: str, cards: DataFrame, **settings) -> DropFlags:
    return DropFlags(cards.sparkSession, cards, folder, **settings)


def card_states(folder: str, cards: DataFrame, **settings) -> CardStates:
    return CardStates(cards.sparkSession, cards, folder, **settings)


def daily_progress(folder: str, cards: DataFrame, **settings) -> DailyProgress:
    return DailyProgress(cards.sparkSession, cards, folder, **settings)
