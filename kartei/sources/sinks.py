"""Appending to the history and writing new versions of the deck table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.sources.schemas import HISTORY, HISTORY_BY_DAY

DECK_KEYS = ["user_id", "deck_id", "card_id"]
STATUS_COLUMNS = ["date_ready", "card_learned", "card_progress", "times_seen"]


def to_second(moment):
    """Cut to whole seconds, without a time zone."""
    return F.date_trunc("SECOND", moment).cast("timestamp_ntz")


def record_actions(actions: DataFrame, path: str, mode: str = "append") -> None:
    """Append actions to the history, one folder per day.

    The rebalance hint brings a day together, splits a busy day over several
    tasks and merges quiet ones, by size.
    """
    rows = actions.select(
        *[to_second(F.col(c)).alias(c) if c == "created_at" else F.col(c) for c in HISTORY.names],
        F.to_date("created_at").alias("created_on"),
    )
    rows.hint("rebalance", "created_on").write.mode(mode).partitionBy("created_on").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_BY_DAY).parquet(path)


def deck_upsert(decks: DataFrame, updates: DataFrame) -> DataFrame:
    """The deck table with the updated statuses; updates of absent rows change nothing."""
    new = updates.select(*DECK_KEYS, *[F.col(c).alias(f"new_{c}") for c in STATUS_COLUMNS])
    joined = decks.join(new, DECK_KEYS, "left")
    return joined.select(*DECK_KEYS, *[F.coalesce(f"new_{c}", c).alias(c) for c in STATUS_COLUMNS])
