"""Exact k-means over a vector-approximation file.

The file. Each component of a vector is compressed to the number of one of at most
2^`BITS` cells; the borders of a component's cells are quantiles of at most `SAMPLE`
vectors, and every vector is filed. Borders steer the work, never the result. A stored
row is a vector's cells, one byte each, beside its components as packed integers.

A round. For each centroid, component and cell a lookup table holds the least and the
largest squared distance of the centroid from anything in the cell; summed over the
components they give an interval of its distance from the vector, read off the cells alone.
Centroids whose interval begins above the least end of all are out. A vector of which
one centroid is left is assigned without being looked at; for others the components are fetched
and the distances of the centroids left are computed. All numbers are whole, so
intervals, distances, ties and sums are exact. A round is one pass that shuffles no vector:
tasks put out sums for each centroid. Those read a vector's components once more, in the same pass.

Integers are 64-bit where the largest component proves that nothing overflows, and of any
size otherwise.

Defined cases: vectors that are NULL, of another length, or hold a NULL or a non-finite
component take no part, and neither do components that are infinite once multiplied by
the scale. Rows without an id are clustered but never begin a centroid. Repeated rows are vectors of
their own; equal ids begin in the order of their components. With fewer vectors than
centroids there are as many centroids as vectors with an id; without any of them there are no rows, as for
an empty table. A distance or an inertia that no long holds is NULL. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.tasks import ready
from kartei.plans.storage import written

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Cells of a component: two to this power.
BITS = 6
#: Vectors that cell borders are taken from.
SAMPLE = 4_096
_LONG = (1 << 63) - 1
LIMB = 10**18
#: Rows of a batch are worked on in pieces of this many.
PIECE = 512


def kept_vectors(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and v, doubles without a fraction, of the rows that take part."""
    v = F.transform("embedding", lambda x: _floor(x.cast("double") * SCALE))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    usable = rows.filter((F.size("embedding") == dims) & F.coalesce(fine, F.lit(False)))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _floor(x):
    """The floor as a double; Spark's own is a long and ends at 2^63."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _packed(v: np.ndarray) -> bytes:
    """Whole doubles as bytes; doubles hold them exactly, whatever their size."""
    return v.astype("<f8").tobytes()


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f8").reshape(-1, dims)


def _narrow(largest: float, dims: int) -> bool:
    """Whether 64-bit integers hold all sums of squared differences of such components."""
    return 4 * dims * max(largest, 1.0) ** 2 < float(1 << 62)


def exact_integers(x: np.ndarray, narrow: bool) -> np.ndarray:
    """Whole doubles as 64-bit integers, or as Python's."""
    if narrow:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


@dataclass
class Cells:
    """For each component the sorted lower borders of its cells, and the last value of the last cell."""

    borders: list[np.ndarray]
    ends: list[float]

    def numbers(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for d, b in enumerate(self.borders):
            out[:, d] = np.searchsorted(b[1:], x[:, d], side="right")
        return out


def cells_of(sample: np.ndarray, lows: list[float], highs: list[float], bits: int) -> Cells:
    borders = []
    for d in range(len(lows)):
        inner = np.quantile(sample[:, d], np.arange(1, 1 << bits) / (1 << bits), method="lower")
        borders.append(np.unique(np.concatenate(([lows[d]], np.clip(inner, lows[d], highs[d])))))
    return Cells(borders, list(highs))


def lookup_tables(cells: Cells, centroids: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): squared distances of each centroid from each cell, by component and cell."""
    n = max(len(b) for b in cells.borders)
    least = np.zeros((len(cells.borders), n, len(centroids)), centroids.dtype)
    most = np.zeros_like(least)
    for d, b in enumerate(cells.borders):
        low = exact_integers(b[:, None], narrow)
        high = exact_integers(np.concatenate((b[1:], [cells.ends[d]]))[:, None], narrow)
        if len(b) > 1:
            high[:-1] = high[:-1] - 1
        c = centroids[None, :, d]
        outside = np.maximum(np.maximum(low - c, c - high), 0)
        far = np.maximum(abs(c - low), abs(high - c))
        least[d, : len(b)], most[d, : len(b)] = outside * outside, far * far
    return least, most


def assign(codes: np.ndarray, fetch, tables, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), and how many were fetched.

    fetch gives the components of the vectors at some places, as integers.
    """
    least, most = tables
    low = np.zeros((len(codes), len(centroids)), centroids.dtype)
    high = np.zeros_like(low)
    for d in range(codes.shape[1]):
        low += least[d, codes[:, d]]
        high += most[d, codes[:, d]]
    left = low <= high.min(axis=1)[:, None]
    cluster = left.argmax(axis=1)
    open_ = np.flatnonzero(left.sum(axis=1) > 1)
    if len(open_):
        x = fetch(open_)
        best = np.full(len(open_), -1, centroids.dtype)
        for c in range(len(centroids)):
            here = np.flatnonzero(left[open_, c])
            if not len(here):
                continue
            gap = x[here] - centroids[c]
            square = (gap * gap).sum(axis=1)
            nearer = (best[here] < 0) | (square < best[here])
            best[here[nearer]] = square[nearer]
            cluster[open_[here[nearer]]] = c
    return cluster, len(open_)


@dataclass
class _Round:
    """What a pass over the file needs; at most a few megabytes, whatever the number of vectors."""

    cells: Cells
    centroids: np.ndarray
    narrow: bool
    dims: int

    def results(self, parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(rows, components, cluster) of each piece of vec_id, codes, v."""
        tables = lookup_tables(self.cells, self.centroids, self.narrow)
        for batch in parts:
            for first in range(0, batch.num_rows, PIECE):
                some = batch.slice(first, PIECE)
                codes = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, self.dims)
                x = _unpacked(some.column(2), self.dims)
                cluster, _ = assign(codes, lambda at: exact_integers(x[at], self.narrow), tables, self.centroids)
                yield some, x, cluster


def _limbs(total: int) -> list[int]:
    """The number in parts of 18 digits, lowest first, each with its sign."""
    sign, rest, out = (-1, -total, []) if total < 0 else (1, total, [])
    while rest or not out:
        rest, limb = divmod(rest, LIMB)
        out.append(sign * limb)
    return out


def _sums(task: _Round):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each centroid of this task the number of its vectors and the sums of their components."""
        totals: dict[int, tuple[int, list[int]]] = {}
        for _, x, cluster in task.results(parts):
            whole = exact_integers(x, task.narrow)
            for c in np.unique(cluster).tolist():
                own = whole[cluster == c]
                n, before = totals.get(c, (0, [0] * task.dims))
                totals[c] = (n + len(own), [a + int(b) for a, b in zip(before, own.sum(axis=0))])
        rows = [(c, d, i, n, limb) for c, (n, sums) in totals.items() for d, s in enumerate(sums) for i, limb in enumerate(_limbs(s))]
        columns = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["cluster", "dim", "limb", "n", "total"])

    return batches


def _last(task: _Round):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x, cluster in task.results(parts):
            gap = exact_integers(x, task.narrow) - task.centroids[cluster]
            square = [int(s) if s <= _LONG else None for s in (gap * gap).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(cluster.astype(np.int32)), pa.array(square, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    return batches


def _filer(cells: Cells):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = [row.tobytes() for row in cells.numbers(values)]
            packed = [_packed(row) for row in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(packed, pa.binary())], ["vec_id", "codes", "v"])

    return batches


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The vectors of the smallest hashes of their ids, in that order; at most `clusters` rows reach the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    named = vectors.filter("vec_id IS NOT NULL").select(order.alias("h"), "v")
    return [[int(x) for x in r.v] for r in named.orderBy("h", "v").limit(clusters).collect()]


def _moved(sums: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid becomes the floor of its vectors' mean, exactly."""
    summed = sums.groupBy("cluster", "dim", "limb").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(19,0)")).alias("total"))
    totals: dict[tuple[int, int], int] = {}
    counts: dict[tuple[int, int], int] = {}
    for r in summed.collect():  # clusters x components x limbs rows
        key = r.cluster, r.dim
        totals[key] = totals.get(key, 0) + int(r.total) * LIMB**r.limb
        if r.limb == 0:
            counts[key] = r.n
    return [[totals[c, d] // counts[c, d] if (c, d) in totals else x for d, x in enumerate(old)] for c, old in enumerate(centroids)]


def va_kmeans(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2", bits: int = BITS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of each vector in (vec_id, v); the final centroids)."""
    spark = vectors.sparkSession
    ready(spark)
    vectors = written(vectors, "vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    dims = len(centroids[0])
    edges = vectors.agg(*(f(F.get("v", F.lit(d))).alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max))).first()
    lows, highs = ([edges[f"{name}{d}"] for d in range(dims)] for name in ("min", "max"))
    largest = max(abs(x) for x in (*lows, *highs))
    drawn = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").collect()
    cells = cells_of(np.array([r.v for r in drawn]), lows, highs, bits)
    filed = written(vectors.mapInArrow(_filer(cells), "vec_id long, codes binary, v binary"), "vector-file")

    narrow = _narrow(largest, dims)

    def task(current: list[list[int]]) -> _Round:
        return _Round(cells, np.array(current, np.int64 if narrow else object), narrow, dims)

    for _ in range(rounds):
        centroids = _moved(filed.mapInArrow(_sums(task(centroids)), "cluster int, dim int, limb int, n long, total long"), centroids)
    return filed.mapInArrow(_last(task(centroids)), "vec_id long, cluster int, distance long"), centroids


def cluster_digests(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    found, centroids = va_kmeans(kept_vectors(embeddings))
    found = written(found, "clusters")
    wide = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost"))
    sums = {r.cluster: None if r.lost else int(r.s) for r in wide.collect()}  # at most a row for each centroid
    total = None if None in sums.values() else sum(sums.values())
    long = lambda x: x if x is not None and x <= _LONG else None
    rows = [(c, long(sums.get(c)), long(total), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
