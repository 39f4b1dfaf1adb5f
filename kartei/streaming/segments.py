"""Keyed tables that micro-batches add to: key-hash buckets, segments, a marker for each commit, compaction.

A table is a set of segments, one folder for each (version, bucket); a version is the
number of the micro-batch that wrote it. A commit is a small table that lists the segments
there are, and how many rows each holds; what no commit lists does not exist. So a micro-batch reads the buckets of
its own keys only, a failed one leaves nothing behind, and a repeated one starts from the
commit before it and replaces its own folders. A bucket of more than `most_segments` segments is
written anew as one with what a micro-batch adds to it. All files are read and written by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION, BUCKET = "version", "bucket"
Segment = tuple[int, int]
COMMIT = T.StructType().add("name", "string").add("segment", "long").add("bucket", "integer")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key from the last version that holds any."""
    last = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max(VERSION).alias("_last"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(last, [*same, F.col(VERSION) == F.col("_last")], "left_semi")


def each_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the one of the first version: rows delivered again change nothing."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), VERSION).alias("_row")).select(*keys, "_row.*")


@dataclass
class Segments:
    """One table. ``merge`` says what rows of several versions amount to, and is applied on reading and compaction."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    keys: list[str]
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = 64
    most_segments: int = 8
    #: What the bucket is a hash of, if not of all keys.
    bucket_by: list[str] | None = None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.bucket_by or self.keys)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> set[int]:
        """At most ``buckets`` numbers."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def _path(self, segment: Segment) -> str:
        return f"{self.folder}/rows/{VERSION}={segment[0]}/{BUCKET}={segment[1]}"

    def read(self, segments: Iterable[Segment], buckets: set[int] | None = None) -> DataFrame:
        """What these segments amount to, of some buckets or all."""
        return self.merge(self._raw(segments, buckets)).select(*self.schema.names)

    def _raw(self, segments: Iterable[Segment], buckets: set[int] | None) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        paths = [self._path(s) for s in segments if buckets is None or s[1] in buckets]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.folder}/rows").parquet(*paths)

    def add(self, rows: DataFrame, version: int, segments: list[Segment], touched: set[int]) -> list[Segment]:
        """Write rows as segments of this version; the segments that the table then has.

        ``touched`` are the buckets that rows may be in: of these, full ones are compacted.
        """
        rows = rows.select(*self.schema.names, F.lit(version).cast("long").alias(VERSION), self.bucket().alias(BUCKET))
        path = f"{self.folder}/rows/{VERSION}={version}"
        held = Counter(bucket for _, bucket in segments)
        full = {b for b in touched if held[b] >= self.most_segments}
        if full:
            both = self._raw(segments, full).unionByName(rows)
            merged = self.merge(both.where(F.col(BUCKET).isin(*full))).select(*self.schema.names, F.lit(version).cast("long").alias(VERSION), self.bucket().alias(BUCKET))
            rows = rows.where(~F.col(BUCKET).isin(*full)).unionByName(merged)
        rows.drop(VERSION).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        files = self.spark.read.schema(schema).parquet(path).inputFiles()
        added = {int(part.removeprefix(f"{BUCKET}=")) for name in files for part in name.split("/") if part.startswith(f"{BUCKET}=")}
        return [s for s in segments if s[1] not in full] + [(version, b) for b in sorted(added)]


@dataclass
class Commits:
    """Which segments of which table there are, as of each version."""

    spark: SparkSession
    folder: str

    def before(self, version: int | None = None) -> dict[str, list[Segment]]:
        """The last commit, or the last one before a version: at most buckets x segments rows for each table."""
        schema = T.StructType([*COMMIT.fields, T.StructField("commit", T.LongType())])
        try:
            rows = self.spark.read.schema(schema).parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if version is not None:
            rows = rows.where(F.col("commit") < version)
        last = rows.agg(F.max("commit")).first()[0]
        found: dict[str, list[Segment]] = {}
        if last is not None:
            for r in rows.where(F.col("commit") == last).collect():
                found.setdefault(r.name, []).append((r.segment, r.bucket))
        return {name: sorted(s) for name, s in found.items()}

    def write(self, version: int, tables: dict[str, list[Segment]]) -> None:
        rows = [(name, v, b) for name, segments in tables.items() for v, b in segments]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commit={version}")
