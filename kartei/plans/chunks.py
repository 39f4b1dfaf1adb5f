"""Splitting large ordered groups, and numbering rows.

Windows and folds need the rows of a key in order, and one key may own a large
share of all rows. ``split_groups`` cuts such keys into consecutive chunks at
split points taken from a hash sample, so that a window over (key, chunk) stays
small; operators then carry a small summary from chunk to chunk. The sample only
places the cuts: every row stays in exactly one chunk, whatever the sample says.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kartei.plans.storage import written

CHUNK = "chunk"
_SPLITS = "_splits"
_RANGE = "_range"
# Thinning goes up to two to this power.
_LEVELS = 24


@dataclass(frozen=True)
class ChunkSize:
    """One row in ``sample_every`` is sampled; a chunk spans ``samples`` sampled rows.

    With the defaults a chunk holds about a million rows. ``max_splits`` bounds
    the split table, and with it the sample: past ``max_splits * samples`` sampled
    rows the sample is thinned, so chunks become longer instead.
    """

    sample_every: int = 10_000
    samples: int = 100
    max_splits: int = 50_000


DEFAULT_SIZE = ChunkSize()


def _sampled(rows: DataFrame, identity: Sequence[str], every: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(*identity), F.lit(every)) == 0)


def split_points(source: DataFrame, keys: Sequence[str], order: Sequence[str], size: ChunkSize) -> DataFrame:
    """(keys, _splits): sorted split points of the keys that need any.

    The sample is thinned by the least power of two that leaves at most
    ``max_splits * samples`` rows, which one aggregate over the sample finds. So
    the rows sorted here and the split points have fixed bounds.
    """
    bound = size.max_splits * size.samples
    mixed = F.xxhash64(*order, F.lit(1))
    sample = _sampled(source.select(*keys, *order), order, size.sample_every).withColumn("_mixed", mixed)
    left = " ".join(f"WHEN count_if(pmod(_mixed, {1 << k}) = 0) <= {bound} THEN {k}" for k in range(_LEVELS))
    level = sample.agg(F.expr(f"CASE {left} ELSE {_LEVELS} END")).scalar()
    thinning = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        sample.where(F.pmod("_mixed", thinning) == 0)
        .withColumn("_position", position)
        .where(F.col("_position") % size.samples == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*order))).alias(_SPLITS))
    )


def _points_up_to(splits: Column, moment: Column) -> Column:
    """How many split points lie at or before ``moment`` (binary search)."""
    steps = F.array(*[F.lit(1 << bit) for bit in range(20, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda pos, step: F.when(F.get(splits, pos + step - 1) <= moment, pos + step).otherwise(pos),
    )


@dataclass(frozen=True)
class Chunked:
    """Rows with a ``chunk`` column: order within a key never decreases across chunks."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    splits: DataFrame = field(repr=False)

    def with_rows(self, rows: DataFrame) -> Chunked:
        """The same chunks over transformed rows (keys, order and chunk must be kept)."""
        return replace(self, rows=rows)

    def window(self) -> WindowSpec:
        """The window over one chunk, in order."""
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self.order)

    def carry(self, per_chunk: dict[str, Column], across: dict[str, Column]) -> DataFrame:
        """(keys, chunk, ...): what earlier chunks of a key contribute to each chunk.

        ``per_chunk`` aggregates a chunk; ``across`` are window-ready aggregates
        over those columns, taken over all earlier chunks. Only keys with split
        points appear, so there are at most twice ``max_splits`` rows.
        """
        hot = self.rows.join(F.broadcast(self.splits.select(*self.keys)), list(self.keys), "left_semi")
        chunks = hot.groupBy(*self.keys, CHUNK).agg(*[c.alias(n) for n, c in per_chunk.items()])
        earlier = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        return chunks.select(*self.keys, CHUNK, *[c.over(earlier).alias(n) for n, c in across.items()])

    def join_carry(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(carry), [*self.keys, CHUNK], "left")


def split_groups(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: ChunkSize = DEFAULT_SIZE,
    source: DataFrame | None = None,
) -> Chunked:
    """Add the chunk column. ``order`` must be a total order within a key.

    ``source`` is any table whose keys and order columns cover those of ``rows``;
    give the stored table where ``rows`` is expensive to compute twice.

    The rows are dealt by (keys, chunk), which serves every window over a chunk. It
    also keeps a join below from passing its own partitioning on to them: a
    hot key of that join may then be split at run time.
    """
    splits = split_points(rows if source is None else source, keys, order, size)
    found = _points_up_to(F.col(_SPLITS), F.struct(*order))
    chunked = (
        rows.join(F.broadcast(splits), list(keys), "left")
        .withColumn(CHUNK, F.when(F.col(_SPLITS).isNull(), F.lit(0)).otherwise(found))
        .drop(_SPLITS)
        .repartition(*keys, CHUNK)
    )
    return Chunked(chunked, tuple(keys), tuple(order), splits)


def number_rows(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number all rows from 0 in order: dealt to tasks by ranges of ``order``, then numbered range by range.

    Range partitioning takes its bounds from a sample, so the dealt rows are stored with
    the number of their range before they are counted and numbered; both then see the same ranges.
    What is broadcast is one count for each range, of which there are at most as many as
    shuffle partitions. ``order`` must be a total order; rows that tie stay in one range.
    """
    dealt = rows.repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id())
    stored = written(dealt, "ranges")
    counts = stored.groupBy(_RANGE).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    first = counts.select(_RANGE, F.coalesce(F.sum("_rows").over(earlier), none).alias("_first"))
    within = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*order)).cast("bigint") - 1
    return (
        stored.withColumn(name, within)
        .join(F.broadcast(first), _RANGE)
        .withColumn(name, F.col(name) + F.col("_first"))
        .drop(_RANGE, "_first")
    )
