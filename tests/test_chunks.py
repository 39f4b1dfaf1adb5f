from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kartei.plans.chunks import ChunkSize, number_rows, split_groups
from tests.conftest import TINY


def skewed(spark, count=200, seed=1):
    rng = random.Random(seed)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 40), rng.randrange(50), i) for i in range(count)]
    return spark.createDataFrame(rows, "k int, t int, event_id bigint").repartition(4)


def test_chunks_are_consecutive_and_small(spark):
    cut = split_groups(skewed(spark), ["k"], ["t", "event_id"], TINY)
    groups = {}
    for row in cut.rows.collect():
        groups.setdefault(row.k, []).append(((row.t, row.event_id), row.chunk))
    assert sum(map(len, groups.values())) == 200
    for rows in groups.values():
        chunks = [chunk for _, chunk in sorted(rows)]
        assert chunks == sorted(chunks)
        assert max(chunks.count(c) for c in chunks) <= TINY.samples
    assert len({chunk for _, chunk in groups[0]}) > 20


def test_split_points_are_bounded(spark):
    cut = split_groups(skewed(spark), ["k"], ["t", "event_id"], ChunkSize(sample_every=1, samples=3, max_splits=5))
    assert cut.splits.agg(F.sum(F.size("_splits"))).first()[0] <= 5
    assert cut.rows.count() == 200


def test_small_groups_are_not_split(spark):
    assert split_groups(skewed(spark), ["k"], ["t", "event_id"]).rows.where("chunk <> 0").isEmpty()


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_number_rows(spark, coalesced):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, coalesced)
    try:
        numbered = number_rows(skewed(spark).select("t", "event_id"), ["t", "event_id"], "n")
        assert number_rows(numbered.drop("n").limit(0), ["t", "event_id"], "n").isEmpty()
    finally:
        spark.conf.set(name, before)
    rows = sorted((r.t, r.event_id, r.n) for r in numbered.collect())
    assert [n for _, _, n in rows] == list(range(200))


def test_numbering_deals_rows_to_several_ranges(spark):
    numbered = number_rows(spark.range(1000).repartition(7).selectExpr("id * 3 AS id", "id % 5 AS _rows"), ["id"], "n")
    assert numbered.columns == ["id", "_rows", "n"]
    assert numbered.where("id <> 3 * n OR n IS NULL").isEmpty() and numbered.count() == 1000
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "row_number() windowspecdefinition(_range" in plan


def test_rows_of_a_hot_join_key_are_dealt_anew(no_broadcast):
    """A join below hands its partitioning to no window: adaptive execution may split what is hot there."""
    spark = no_broadcast
    lookup = spark.range(40).selectExpr("cast(id AS int) AS k", "id AS v")
    cut = split_groups(skewed(spark).join(lookup, "k"), ["k", "v"], ["t", "event_id"])
    last = cut.rows.selectExpr("*", "1 AS one").withColumn("n", F.row_number().over(cut.window()))
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "REPARTITION_BY_COL" in plan
    assert last.count() == 200
