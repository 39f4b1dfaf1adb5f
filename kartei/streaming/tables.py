"""Stream sinks: result tables by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH = "batch"


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "update", each: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Run the stream over all data that is there; each micro-batch, as ``each`` makes it, is one folder.

    A repeated micro-batch replaces its own folder, so a restart writes nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch if each is None else each(batch)).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).start().awaitTermination()


def read_batches(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = T.StructType([*like.schema.fields, T.StructField(BATCH, T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
