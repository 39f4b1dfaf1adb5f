"""What sessions need before Python runs in their tasks."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kartei.plans.storage import ship_package

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole documents at a time in a Python worker.
MOST_ROWS = 1_000


def ready(spark: SparkSession) -> None:
    """Executors can import this package, and get documents in batches of bounded size.

    The session's batch size is lowered if it is larger: its default, 10,000 rows, is
    meant for rows of numbers.
    """
    ship_package(spark)
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= MOST_ROWS:
        spark.conf.set(BATCH_ROWS, str(MOST_ROWS))
