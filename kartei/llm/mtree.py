"""Exact top-k by inner product with a distributed M-tree.

With M the largest length, a vector x gets one more component sqrt(M^2 - |x|^2) and
a query gets 0 there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors have
the largest products, and distances obey the triangle inequality.

Index. Equal vectors are one entry with their smallest ids. Pivots are drawn from at
most `SAMPLE` vectors; each vector goes to the cell of its nearest pivot. Cells
are cut into blocks of about `BLOCK` entries, by a hash, so a crowded cell is many tasks. A block
is an M-tree of two levels of pages: a node holds routing vectors with covering
radii and parent distances, a leaf at most `PAGE` entries with theirs. All pages are rows of a stored table.

Search. Each query first searches its own block, which bounds its k-th distance. It
then visits only blocks whose cell can hold something as near, best page first:
pages and entries are left out by |d(q, parent) - d(x, parent)| and covering radii,
which are stored, before any product is computed. Queries of a block are cut into
groups of `QUERIES`, so no group grows with the input.

Numbers. Whole components are kept as doubles, which hold floor(256 * x) exactly. Products are
summed as doubles while no sum can pass 2^52, as 64-bit integers up to 2^62, and as Python integers
beyond that; distances only choose what is multiplied, with a slack above their rounding. Results are
ordered by exact products of any size, as bytes of a width that holds the largest.

Defined cases: vectors that are NULL, empty, or hold NULL or a non-finite component (256 * x must be a
finite double too) take no part, as entry or query, nor do rows without an id. A product beyond a long is
ranked by its exact value and shown as the nearest long. Long vectors are whole. An empty table gives no
rows. Ties go to smaller ids. Vectors of different lengths are filled up with zeros. Rows that repeat an id are different entries if their vectors
differ; a query never finds its own id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kartei.llm.tasks import ready
from kartei.plans.storage import written

SAMPLE = 8_192
CELLS = 256
BLOCK = 4_096
PAGE = 64
QUERIES = 4_096
#: Components are multiplied by this and rounded down.
SCALE = 256
LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v, the whole-numbered components, of the rows that take part."""
    # doubles of 2^53 and more are whole already, and may be too large for a long
    whole = lambda y: F.when(F.abs(y) < 1 << 53, F.floor(y).cast("double")).otherwise(y)
    wide = F.transform("embedding", lambda x: whole(x.cast("double") * SCALE))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter((F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("v"))


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Space:
    """Distances of entries from each other and from queries, for a common largest length.

    `square` bounds the sums of squares and `largest` the size of components. Matrices are in units of
    `unit`, a power of two that is 1 unless squares pass what a double holds.
    """

    def __init__(self, dims: int, square: float, largest: float):
        self.dims, self.unit = dims, 1.0
        #: Bytes of the largest product and its sign.
        self.width = (2 * max(int(largest), 1).bit_length() + dims.bit_length()) // 8 + 1
        #: Whether sums of products are whole numbers that a double, or else an int64, holds.
        self.exact, self.wide = square < 1 << 52, square < 1 << 62
        if not square < 1e300:
            self.unit = 2.0 ** min(int(largest).bit_length(), 1023)
            square = 4.0 * dims
        self.square = square
        #: More than any rounding can add to a distance.
        self.slack = 1e-6 * max(square, 1.0) ** 0.5 + 1e-6

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        product = x @ y.T + self.extra(x)[:, None] * self.extra(y)[None, :]
        return np.sqrt(np.maximum(2 * self.square - 2 * product, 0))

    def matrix(self, vectors) -> np.ndarray:
        return _matrix(vectors, self.dims) / self.unit

    def given(self, x: np.ndarray) -> np.ndarray:
        """The components as they were before they were put in units."""
        return x * self.unit

    def products(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """The exact product of each row of x with y, both in units."""
        if self.wide:
            return (x.astype(np.int64) @ y.astype(np.int64)).tolist()
        y = [int(b) for b in self.given(y).tolist()]
        return [sum(int(a) * b for a, b in zip(row, y) if a) for row in self.given(x).tolist()]

    def key(self, score: int) -> bytes:
        """Bytes that are ordered as the scores are."""
        return (score + (1 << 8 * self.width - 1)).to_bytes(self.width, "big")

    def score(self, key: bytes) -> int:
        return int.from_bytes(key, "big") - (1 << 8 * self.width - 1)

    def in_units(self, score: int) -> float:
        exponent = int(self.unit).bit_length() - 1
        return float(score) if not exponent else score / (1 << 2 * exponent)

    def distance(self, length_square, product):
        """Of a query from entries with these products."""
        return np.sqrt(np.maximum(length_square + self.square - 2 * product, 0))


def choose_pivots(sample: np.ndarray, n: int, space: Space) -> np.ndarray:
    """Farthest first: each pivot is the sample vector farthest from those before."""
    chosen = [0]
    far = space.between(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        following = int(far.argmax())
        if far[following] <= space.slack:
            break
        chosen.append(following)
        far = np.minimum(far, space.between(sample, sample[following : following + 1])[:, 0])
    return sample[chosen]


def _assigner(pivots: np.ndarray, space: Space):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            far = space.between(space.matrix(batch.column(0).to_pylist()), pivots)
            cell = far.argmin(axis=1) if len(far) else np.empty(0, np.int64)
            near = far[np.arange(len(far)), cell]
            columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "parent_distance"])

    return batches


PAGE_SCHEMA = (
    "cell int, slice int, page int, router array<double>, router_distance double, radius double, "
    "vectors array<array<double>>, ids array<array<long>>, parent_distances array<double>"
)


def _page_builder(pivots: np.ndarray, space: Space):
    def build(block: pd.DataFrame) -> pd.DataFrame:
        """Pages of one block: routers farthest first, entries with their nearest, full pages cut by distance."""
        block = block.sort_values("ids", key=lambda s: s.map(lambda x: x[0]), ignore_index=True)
        x = space.matrix(block["v"].tolist())
        cell, slice_ = int(block["cell"].iloc[0]), int(block["slice"].iloc[0])
        routers = choose_pivots(x, max(1, -(-len(x) // PAGE)), space)
        far = space.between(x, routers)
        own = far.argmin(axis=1)
        rows = []
        for r in range(len(routers)):
            of = np.flatnonzero(own == r)
            of = of[np.argsort(far[of, r], kind="stable")]
            for first in range(0, len(of), PAGE):
                some = of[first : first + PAGE]
                rows.append(
                    (cell, slice_, len(rows), space.given(routers[r]).tolist(), float(space.between(routers[r : r + 1], pivots[cell : cell + 1])[0, 0]),
                     float(far[some, r].max()), space.given(x[some]).tolist(), [list(block["ids"].iloc[i]) for i in some], far[some, r].tolist())
                )
        names = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]
        return pd.DataFrame(rows, columns=names)

    return build


class Best:
    """The k best (score, id) of each query, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def add(self, q: int, scores: list[float] | list[int], ids: list[list[int]]) -> None:
        rows = self.scores[q]
        rows.extend((-int(s), i) for s, group in zip(scores, ids) for i in group)
        rows.sort()
        del rows[self.k :]


def search_block(pages: pd.DataFrame, queries: np.ndarray, bounds: np.ndarray, pivot: np.ndarray, space: Space, k: int) -> list[list[tuple[int, int]]]:
    """For each query the k best entries of a block that may be nearer than its bound: (-score, id) pairs."""
    square = (queries * queries).sum(axis=1)
    to_pivot = space.distance(square, queries @ pivot)
    routers = space.matrix(pages["router"].tolist())
    from_pivot, radius = pages["router_distance"].to_numpy(), pages["radius"].to_numpy()
    leaves = [(space.matrix(v), np.array(d, float), [list(i) for i in ids]) for v, d, ids in zip(pages["vectors"], pages["parent_distances"], pages["ids"])]
    # parent distances first: routers that they rule out are never multiplied
    low = np.abs(to_pivot[:, None] - from_pivot[None, :]) - radius[None, :]
    open_ = low <= bounds[:, None] + space.slack
    to_router = np.full(low.shape, np.inf)
    for p in np.flatnonzero(open_.any(axis=0)):
        of = np.flatnonzero(open_[:, p])
        to_router[of, p] = space.distance(square[of], queries[of] @ routers[p])
    low = np.where(open_, np.maximum(to_router - radius[None, :], 0), np.inf)
    best, kth = Best(len(queries), k), bounds.copy()
    active = np.arange(len(queries))
    while len(active):
        # each query opens its most promising page; queries of one page are multiplied together
        page = low[active].argmin(axis=1)
        nearest = low[active, page]
        going = np.isfinite(nearest) & (nearest <= kth[active] + space.slack)
        active, page = active[going], page[going]
        order = np.argsort(page, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(page[order])) + 1) if len(order) else []:
            p, of = page[some[0]], active[some]
            vectors, parents, ids = leaves[p]
            near = np.abs(to_router[of, p][:, None] - parents[None, :]) <= kth[of][:, None] + space.slack
            cols = np.flatnonzero(near.any(axis=0))
            if len(cols):
                products = queries[of] @ vectors[cols].T
                for row, q in enumerate(of.tolist()):
                    use = near[row, cols] & (space.distance(square[q], products[row]) <= kth[q] + space.slack)
                    if use.any():
                        scores = products[row, use].tolist() if space.exact else space.products(vectors[cols[use]], queries[q])
                        best.add(q, scores, [ids[c] for c in cols[use]])
                        if len(best.scores[q]) == k:
                            kth[q] = min(kth[q], float(space.distance(square[q], space.in_units(-best.scores[q][-1][0]))))
            low[of, p] = np.inf
    return best.scores


def _searcher(pivots: np.ndarray, space: Space, k: int):
    def search(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pages) or not len(asked):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "score": pd.Series(dtype="object"), "vec_id": pd.Series(dtype="int64")})
        queries = space.matrix(asked["v"].tolist())
        found = search_block(pages, queries, asked["bound"].to_numpy(float), pivots[int(pages["cell"].iloc[0])], space, k)
        rows = [(q, space.key(-s), i) for q, best in zip(asked["q"].tolist(), found) for s, i in best]
        return pd.DataFrame(rows, columns=["q", "score", "vec_id"])

    return search


def _cells_of(pivots: np.ndarray, radii: np.ndarray, space: Space):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that may hold something within a query's bound."""
        for batch in parts:
            x = space.matrix(batch.column(1).to_pylist())
            bound = batch.column(2).to_numpy(zero_copy_only=False)
            far = space.distance((x * x).sum(axis=1)[:, None], x @ pivots.T)
            row, cell = np.nonzero((far - radii[None, :] <= bound[:, None] + space.slack) & (radii[None, :] >= 0))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return batches


def _reaches(space: Space):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distance of each query's worst result so far, without a limit where there are too few."""
        for batch in parts:
            x = space.matrix(batch.column(1).to_pylist())
            worst = [space.in_units(space.score(w)) if w is not None else -np.inf for w in batch.column(4).to_pylist()]
            bound = space.distance((x * x).sum(axis=1), np.array(worst, float))
            q, v, cell, slice_ = batch.columns[:4]
            yield pa.RecordBatch.from_arrays([q, v, pa.array(bound), cell, slice_], ["q", "v", "bound", "own_cell", "own_slice"])

    return batches


def _shown(space: Space):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores as longs."""
        for batch in parts:
            scores = [max(-LONG - 1, min(LONG, space.score(key))) for key in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.int64())], ["query_id", "rank", "vec_id", "score"])

    return batches


def _k_smallest_ids(vectors: DataFrame, k: int) -> DataFrame:
    """v and ids: the k smallest ids of each different vector; no group is collected before it is cut."""
    first = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each query (vec_id, v) among other ids of vectors (vec_id, v)."""
    spark = vectors.sparkSession
    ready(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = written(vectors, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    about = vectors.select(F.size("v").alias("n"), square.alias("s"), F.array_max(F.transform("v", F.abs)).alias("x"))
    about = about.agg(F.max("n").alias("n"), F.max("s").alias("s"), F.max("x").alias("x"), F.count("*").alias("rows")).first()
    if not about["rows"]:
        return empty
    space = Space(about["n"], about["s"], about["x"])
    entries = _k_smallest_ids(vectors, k + 1)
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    n_cells = min(CELLS, max(1, int(about["rows"] / BLOCK) * 2))
    pivots = choose_pivots(space.matrix([r.v for r in drawn]), n_cells, space)
    placed = written(entries.mapInArrow(_assigner(pivots, space), "v array<double>, ids array<long>, cell int, parent_distance double"), "cells")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("parent_distance").alias("radius"))
    sizes = cells.withColumn("slices", F.ceil(F.col("n") / BLOCK).cast("int")).select("cell", "slices", "radius").collect()  # at most CELLS rows
    radii = np.full(len(pivots), -1.0)
    for row in sizes:
        radii[row.cell] = row.radius
    slices = F.broadcast(spark.createDataFrame([(r.cell, r.slices) for r in sizes], "cell int, slices int"))

    def in_slice(rows: DataFrame) -> DataFrame:
        return rows.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("v"), F.col("slices")).cast("int"))

    blocks = in_slice(placed).select("cell", "slice", "v", "ids")
    pages = written(blocks.groupBy("cell", "slice").applyInPandas(_page_builder(pivots, space), PAGE_SCHEMA), "pages")

    # equal query vectors are searched once; k + 1 results leave k when the query's own id goes
    asked = written(queries.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    own = in_slice(asked.select("v", "q").mapInArrow(_assigner(pivots, space), "v array<double>, q long, cell int, parent_distance double"))
    own = own.select("q", "v", F.lit(float("inf")).alias("bound"), "cell", "slice")
    own = written(own, "own-blocks")
    first = written(_search(pages, own, pivots, space, k + 1), "first-search")
    kth = first.groupBy("q").agg(F.min("score").alias("worst"), F.count("*").alias("n")).filter(F.col("n") > k)
    bounded = own.select("q", "v", F.col("cell").alias("own_cell"), F.col("slice").alias("own_slice")).join(kth, "q", "left")
    bounded = bounded.select("q", "v", "own_cell", "own_slice", "worst")
    bounded = bounded.mapInArrow(_reaches(space), "q long, v array<double>, bound double, own_cell int, own_slice int")
    visits = bounded.mapInArrow(_cells_of(pivots, radii, space), "q long, v array<double>, bound double, own_cell int, own_slice int, cell int")
    visits = visits.join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    visits = visits.filter((F.col("cell") != F.col("own_cell")) | (F.col("slice") != F.col("own_slice"))).select("q", "v", "bound", "cell", "slice")
    rest = _search(pages, visits, pivots, space, k + 1)
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    best = first.union(rest).withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k + 1).drop("n")
    ids = queries.select(F.col("vec_id").alias("query_id"), "v").join(asked, "v").select("query_id", "q")
    by_rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = ids.join(best, "q").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    out = out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return out.mapInArrow(_shown(space), "query_id long, rank int, vec_id long, score long")


def _search(pages: DataFrame, asked: DataFrame, pivots: np.ndarray, space: Space, k: int) -> DataFrame:
    """Results of each query in each block that it asks; blocks are repeated for each group of queries."""
    groups = asked.groupBy("cell", "slice").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    per_page = pages.join(groups, ["cell", "slice"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    per_query = asked.join(groups, ["cell", "slice"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("groups")).cast("int")).drop("groups")
    keys = ["cell", "slice", "part"]
    return per_page.groupBy(*keys).cogroup(per_query.groupBy(*keys)).applyInPandas(_searcher(pivots, space, k), "q long, score binary, vec_id long")


def embedding_top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    vectors = whole_vectors(embeddings)
    return top_k(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
