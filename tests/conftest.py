from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from kartei.plans.chunks import ChunkSize  # noqa: E402
from tools.check import session  # noqa: E402

# Every row is sampled and a chunk holds three: all groups of the fixtures are split.
TINY = ChunkSize(sample_every=1, samples=3, max_splits=10_000)


@pytest.fixture(scope="session")
def spark():
    spark = session()
    yield spark
    spark.stop()


@pytest.fixture
def no_broadcast(spark):
    """As if no table were small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
