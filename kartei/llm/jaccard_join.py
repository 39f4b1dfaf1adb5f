"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-grams.

The matrix has a row for each different set of n-grams (documents with one set are one
row) and a column for each n-gram, named by a 64-bit hash. Overlaps are the entries of its product
with itself, and only those that can reach the threshold are accumulated.

Columns. They are ordered from rare to common, by counts of all documents' n-grams over a
fixed number of buckets; those that rows were found to share by that order go last in a second one, as
buckets can not tell rare from unique. Of sets of a and b n-grams a link needs t/(1+t)(a+b) in common,
so a linked pair meets in the first n - ceil(t n) + 1 columns of each row, its head.
Copies are left out, by a bitmap of the rows that stand for a set, so each entry of a column is one more row.
Heads travel as 42 bits of each column, sorted and packed by the first bits; what is counted once is held by one row
alone. A bitmap lets through what may be shared. Columns or copies that fall together in bits or bitmaps only
let more through: candidates are compared in full.

Few rows in a column. Columns of at most `FEW` rows are joined with themselves: pairs of sizes within the
bound, whose places in both rows leave enough columns for a link, add up their overlap. A
pair goes on if that and what lies behind the heads may reach the bound, and its rows
are then compared in full. Pairs that also share a column of many rows are found there.

Many rows in a column. Pairs would grow with the square of a family of near copies. Such rows are
dealt to blocks: rows of a like size with the same smallest common column, cut by hash
into blocks of about `BLOCK` n-grams. Two blocks that share a column are one task,
which multiplies them in memory, columns in groups, and puts out a spanning forest of the links it finds:
fewer links than rows, whatever the number of pairs. Components are what the links are
for, and the forest has the same ones.

Defined cases: a NULL text, or one of blanks only, has no n-grams, is linked with nothing, and is
a component of its own. Fewer words than n make one n-gram of all. Repeated rows and copies are one row of
the matrix and each give a row. Rows without a doc_id are linked like others, but give a
component its id only if no member has one: it is NULL then. A very long text is a long
row; a block may hold a single row. Ties of columns are broken by their hashes. An empty table gives no rows.
Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.graph import components
from kartei.llm.spans import mixed, slices, words_of
from kartei.llm.tasks import ready
from kartei.plans.storage import written

WORDS = 5
#: Links have a similarity of at least PER_CENT hundredths.
PER_CENT = 80
#: Counters of n-grams; 2 MB on each worker.
BUCKETS = 1 << 18
#: Slices that the counters travel in.
SLICES = 1 << 6
#: Binary digits of places in a map of columns or rows, by the n-grams there are: 4 to 32 MB on each worker.
LEAST_DIGITS, MOST_DIGITS = 25, 28
#: Columns are counted by their first PART + 32 bits; those with the same first PART are counted together.
PART = 10
#: Columns that a task packs at a time.
PACKED = 1 << 20
#: Rows of a column that are paired one by one.
FEW = 8
#: N-grams of a block, on average at most.
BLOCK = 1 << 19
#: Rows of a block, on average at most.
BLOCK_ROWS = 1 << 11
#: Pairs of a task that compares rows one by one, on average.
STARS = 256
#: Rows of a task that multiplies pairs of blocks, on average; a pair of blocks is not cut.
TILE_ROWS = 512
#: Rows of at most 40 bytes: 40 MB.
MOST_BROADCAST = 1_000_000
#: Columns, and pairs of entries, that are multiplied at a time.
GROUP, PAIRS = 1 << 11, 1 << 22


def ngram_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """The sorted different hashes of each text's runs of n words, A-Z lowered."""
    found = words_of([t.lower() for t in texts])
    h = found.hashes()
    owners = found.owners
    ends = np.searchsorted(owners, np.arange(len(texts) + 1))
    grams = mixed(h, np.uint64(n))
    if len(h) >= n:
        grams = grams.copy()
        run = grams[: len(h) - n + 1].copy()
        for k in range(1, n):
            run = mixed(run * np.uint64(3), h[k : len(h) - n + 1 + k])
        grams[: len(run)] = run
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.array([np.uint64(b - a)])
            for k in range(a, b):
                whole = mixed(whole * np.uint64(5), h[k : k + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least_overlap(total: int, per_cent: int = PER_CENT) -> int:
    """The smallest overlap that links sets of so many n-grams together."""
    return -(-per_cent * total // (100 + per_cent))


def head_length(n: int, per_cent: int = PER_CENT) -> int:
    """How many of its rarest columns a row of n must show to meet every row it links to."""
    return n - -(-per_cent * n // 100) + 1 if n else 0


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.sha256(grams.tobytes()).digest()[:16]


def _sets_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch of bounded bytes with the sets of their texts."""
    texts = [x or b"" for x in batch.column(column).to_pylist()]
    for first, last in slices([len(x) for x in texts]):
        yield batch.slice(first, last - first), ngram_sets(texts[first:last])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


ROWS = "doc_id long, text_hash long, digest binary, n int, slice int, found binary"


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; at the end a row for each slice of the buckets with the n-grams found in them."""
    counts = np.zeros(BUCKETS, np.int64)
    names = [c.split()[0] for c in ROWS.split(", ")]
    for batch in batches:
        for some, sets in _sets_of(batch, 2):
            if sets:
                counts += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array([_digest(g) for g in sets], pa.binary()), pa.array([len(g) for g in sets], pa.int32()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                names,
            )
    if counts.any():
        found = [x.tobytes() for x in np.split(counts.astype("<i8"), SLICES)]
        none = [pa.nulls(SLICES, kind) for kind in (pa.int64(), pa.int64(), pa.binary(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(found, pa.binary())], names)


def _added(table: pa.Table) -> pa.Table:
    """The sum of a slice's counters over all tasks."""
    total = np.sum([np.frombuffer(x, "<i8") for x in table.column("found").to_pylist()], axis=0, dtype="<i8")
    return pa.table({"slice": table.column("slice")[:1].cast(pa.int32()), "found": pa.array([total.tobytes()], pa.binary())})


def _marked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a map; their first digits are its places."""
    spot = hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1 > 0


def _heads_of(parts: Iterator[pa.RecordBatch], counts, rows, late) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Sets with n-grams of the rows (row, text) in the bitmap `rows`, and their heads.

    Columns in the bitmap `late` come after all others.
    """
    common = counts.value
    for batch in parts:
        stands = _marked(batch.column(0).to_numpy().view(np.uint64), rows.value)
        for _, sets in _sets_of(batch.filter(pa.array(stands)), 1):
            sets = [g for g in sets if len(g)]
            heads = []
            for grams in sets:
                keys = [grams, common[(grams % np.uint64(BUCKETS)).astype(np.int64)]]
                order = np.lexsort(keys if late is None else [*keys, _marked(grams, late.value)])
                heads.append(grams[order[: head_length(len(grams))]])
            if sets:
                yield sets, heads


def packed(columns: np.ndarray, few: int) -> pa.RecordBatch:
    """part, columns: the 32 bits after the first ones, sorted; a column that is there more than few + 1 times is kept so often."""
    keys = np.sort(columns >> np.uint64(32 - PART))
    most = max(few, 1) + 1
    keys = keys[np.concatenate((np.ones(min(most, len(keys)), bool), keys[most:] != keys[:-most]))]
    ends = np.searchsorted(keys >> np.uint64(32), np.arange((1 << PART) + 1, dtype=np.uint64))
    low = keys.astype("<u4")
    there = np.flatnonzero(ends[1:] > ends[:-1])
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([low[ends[i] : ends[i + 1]].tobytes() for i in there], pa.binary())], ["part", "columns"])


def _columns(counts, rows, late, few: int):
    """The columns of all heads, packed."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, heads in _heads_of(parts, counts, rows, late):
            held += heads
            size += sum(map(len, heads))
            if size >= PACKED:
                yield packed(np.concatenate(held), few)
                held, size = [], 0
        if held:
            yield packed(np.concatenate(held), few)

    return batches


def counted(few: int, digits: int):
    """part, bits, crowded: a part's stretch of the map of columns found again, and its columns of more than few rows."""
    width = digits - PART

    def of_part(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        columns = np.sort(np.frombuffer(b"".join(table.column("columns").to_pylist()), "<u4"))
        first = np.flatnonzero(np.concatenate(([True], columns[1:] != columns[:-1])))
        times = np.diff(np.append(first, len(columns)))
        marks = np.zeros(1 << width, np.uint8)
        marks[columns[first[times > 1]] >> np.uint32(32 - width)] = 1
        crowded = columns[first[times > few]].astype(np.int64) | part << 32
        return pa.table(
            {"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary()), "crowded": pa.array([crowded], pa.list_(pa.int64()))}
        )

    return of_part


def _heads(counts, rows, late, shared):
    """Entries of heads, of columns that the bitmap `shared` lets through."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, heads in _heads_of(parts, counts, rows, late):
            may = [_marked(head, shared.value) for head in heads]
            sizes = [int(m.sum()) for m in may]
            digests = pa.array([_digest(g) for g in sets], pa.binary()).take(pa.array(np.repeat(np.arange(len(sets)), sizes)))
            n = np.repeat(np.array([len(g) for g in sets], np.int32), sizes)
            gram = _signed(np.concatenate([head[m] for head, m in zip(heads, may)]))
            place = np.concatenate([np.flatnonzero(m) for m in may]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([gram, digests, pa.array(n), pa.array(place)], ["gram", "digest", "n", "place"])

    return batches


def _entries(block: list[np.ndarray], flat: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, sizes): the rows in each of these columns, where each column begins, how many it has."""
    row = np.repeat(np.arange(len(block)), [len(g) for g in block])
    at = np.searchsorted(columns, flat)
    hit = columns[np.minimum(at, len(columns) - 1)] == flat
    order = np.argsort(at[hit], kind="stable")
    sizes = np.bincount(at[hit], minlength=len(columns))
    return row[hit][order], np.cumsum(sizes) - sizes, sizes


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of these ranges, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The product of two blocks of rows: how many columns each pair has in common.

    Columns of many rows are multiplied as matrices, columns of few as their entries.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(x, y)
    if not len(columns):
        return out
    (xr, xs, xn), (yr, ys, yn) = _entries(left, x, columns), _entries(right, y, columns)
    heavy = xn * yn > max(1, out.size // 256)
    light = np.flatnonzero(~heavy)
    total = np.cumsum((xn * yn)[light])
    for some in np.split(light, np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) if len(light) else []):
        # each entry on the left meets all those of its column on the right
        one = _ranges(xs[some], xn[some])
        of = np.repeat(some, xn[some])
        cell = np.repeat(xr[one], yn[of]) * len(right) + yr[_ranges(ys[of], yn[of])]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    heavy = np.flatnonzero(heavy)
    for first in range(0, len(heavy), GROUP):
        some = heavy[first : first + GROUP]
        a, b = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
        a[xr[_ranges(xs[some], xn[some])], np.repeat(np.arange(len(some)), xn[some])] = 1
        b[yr[_ranges(ys[some], yn[some])], np.repeat(np.arange(len(some)), yn[some])] = 1
        out += a @ b.T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with this symmetric matrix."""
    todo = np.ones(len(linked), bool)
    edges = []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root], stack = False, [root]
        while stack:
            node = stack.pop()
            fresh = np.flatnonzero(linked[node] & todo)
            todo[fresh] = False
            edges.extend((node, int(f)) for f in fresh)
            stack.extend(fresh.tolist())
    return edges


def _near(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Which of these rows are linked."""
    sizes = [np.array([len(g) for g in some], np.int64) for some in (rows, columns)]
    return (100 + PER_CENT) * overlaps(rows, columns) >= PER_CENT * (sizes[0][:, None] + sizes[1][None, :])


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    texts = [x or b"" for x in column.to_pylist()]
    return [g for first, last in slices([len(x) for x in texts]) for g in ngram_sets(texts[first:last])]


LINKS = "a binary, b binary"


def _link_table(edges: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})


def _groups(keys: list) -> list[list[int]]:
    """The places of each key."""
    found: dict = {}
    for i, key in enumerate(keys):
        found.setdefault(key, []).append(i)
    return list(found.values())


def _products(table: pa.Table) -> pa.Table:
    """Forest links of some pairs of blocks: tile, digest, text, side (0, 1, or 2 for a block with itself)."""
    digests, sets = table.column("digest").to_pylist(), _sets(table.column("text"))
    side, edges = table.column("side").to_numpy(), []
    for own in _groups(table.column("tile").to_pylist()):
        own = np.array(own)
        rows, columns = np.flatnonzero(side[own] != 1), np.flatnonzero(side[own] != 0)
        if not len(rows) or not len(columns):
            continue
        linked = np.zeros((len(own), len(own)), bool)
        linked[np.ix_(rows, columns)] = _near([sets[i] for i in own[rows]], [sets[i] for i in own[columns]])
        linked |= linked.T
        np.fill_diagonal(linked, False)
        edges += [(digests[own[i]], digests[own[j]]) for i, j in forest(linked)]
    return _link_table(edges)


def _stars(table: pa.Table) -> pa.Table:
    """Links of some rows (star) with each of their candidates: star, digest, text."""
    stars, digests, sets = table.column("star").to_pylist(), table.column("digest").to_pylist(), _sets(table.column("text"))
    edges = []
    for own in _groups(stars):
        star = stars[own[0]]
        centre = [i for i in own if digests[i] == star]
        others = [i for i in own if digests[i] != star]
        if centre and others:
            near = _near([sets[centre[0]]], [sets[i] for i in others])[0]
            edges += [(star, digests[i]) for i, linked in zip(others, near.tolist()) if linked]
    return _link_table(edges)


def _rows(slim: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(documents with digest and n, counts of n-grams by bucket)."""
    found = written(slim.mapInArrow(_row_batches, ROWS), "ngram-rows")
    summed = found.filter("slice IS NOT NULL").select("slice", "found").groupBy("slice").applyInArrow(_added, "slice int, found binary")
    counts = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    table = summed.toArrow()  # at most SLICES rows
    for at, found_there in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
        counts[at] = np.frombuffer(found_there, "<i8")
    return found.filter("slice IS NULL").select("doc_id", "text_hash", "digest", "n"), counts.ravel()


def _map_of(hashes: DataFrame) -> np.ndarray:
    """One bit for each place of these hashes (h)."""
    place = F.shiftrightunsigned("h", 64 - LEAST_DIGITS)
    word = hashes.select(F.shiftright(place, 5).cast("int").alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - LEAST_DIGITS}) & 31))").alias("bit"))
    table = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most as many rows as the map has words
    out = np.zeros((1 << LEAST_DIGITS) // 32, "<u4")
    out[table.column(0).to_numpy()] = table.column(1).to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _shared(known: DataFrame, counts, rows, late, few: int, digits: int) -> tuple[np.ndarray, DataFrame]:
    """(the map of columns that heads of two rows hold, the columns of more than few rows)."""
    columns = known.mapInArrow(_columns(counts, rows, late, few), "part int, columns binary")
    found = written(columns.groupBy("part").applyInArrow(counted(few, digits), "part int, bits binary, crowded array<bigint>"), "shared-columns")
    bits = np.zeros((1 << PART, (1 << digits - PART) // 8), np.uint8)
    table = found.select("part", "bits").toArrow()  # the map, in stretches
    for part, stretch in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
        bits[part] = np.frombuffer(stretch, np.uint8)
    return bits.ravel(), found.select(F.explode("crowded").alias("many"))


def links(slim: DataFrame, documents: DataFrame, classes: DataFrame, counts: np.ndarray, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """a, b: digests of linked sets; every linked pair is connected by them.

    slim: doc_id, text_hash, text (bytes); documents: the same rows with their digest; classes: digest and row, a
    (doc_id, text_hash) that has it.
    """
    spark = slim.sparkSession
    cast = spark.sparkContext.broadcast
    digits = min(MOST_DIGITS, max(LEAST_DIGITS, int(counts.sum() // 4).bit_length()))
    known = slim.select(F.xxhash64("doc_id", "text_hash").alias("row"), "text")
    common, stands = cast(counts), cast(_map_of(classes.select(F.xxhash64("row.doc_id", "row.text_hash").alias("h"))))
    # columns that heads were found to share go last, and others take their places in the heads
    late = cast(_shared(known, common, stands, None, few, digits)[0])
    shared, many = _shared(known, common, stands, late, few, digits)
    heads = known.mapInArrow(_heads(common, stands, late, cast(shared)), "gram long, digest binary, n int, place int")
    heads = written(heads, "heads").withColumn("column", F.shiftrightunsigned("gram", 32 - PART))
    many = _small(many)

    # blocks of the rows that are in crowded columns: like sizes, the same smallest crowded column, and a part
    crowded = written(heads.join(many, F.col("column") == F.col("many"), "left_semi").select("gram", "digest", "n"), "crowded-heads")
    home = crowded.groupBy("digest", "n").agg(F.min(F.struct(F.xxhash64("gram").alias("h"), "gram")).alias("least"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PER_CENT))).cast("int")
    home = written(home.select("digest", "n", F.col("least.gram").alias("home"), band.alias("band")), "homes")
    parts = F.greatest(F.ceil(F.sum("n") / F.lit(block)), F.ceil(F.count("*") / F.lit(BLOCK_ROWS))).cast("int")
    parts = home.groupBy("home", "band").agg(parts.alias("parts"))
    part = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    blocks = home.join(parts, ["home", "band"]).select("digest", "n", "band", F.struct("home", "band", part.alias("part")).alias("block"))
    blocks = written(blocks, "blocks")

    # pairs of rows that meet in columns of few rows; those that share a crowded column too meet in their blocks
    sparse = heads.join(many, F.col("column") == F.col("many"), "left_anti").select("gram", "digest", "n", "place")
    left, right = (sparse.select("gram", *(F.col(c).alias(f"{c}_{side}") for c in sparse.columns[1:])) for side in "ab")
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * PER_CENT / F.lit(100 + PER_CENT))
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * PER_CENT) & (F.col("n_b") * 100 >= F.col("n_a") * PER_CENT)
    met = left.join(right, "gram").filter((F.col("digest_a") < F.col("digest_b")) & sizes)
    # from the first column that they share on, each row has so many left
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    summed = met.groupBy("digest_a", "digest_b", "n_a", "n_b").agg(F.count("*").alias("overlap"), F.max(room).alias("room"))
    behind = F.greatest(F.ceil(F.col("n_a") * PER_CENT / 100), F.ceil(F.col("n_b") * PER_CENT / 100)) - 1
    candidates = summed.filter((F.col("room") >= needed) & (F.col("overlap") + behind >= needed))
    candidates = written(candidates.select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b")), "candidates")

    # pairs of blocks that share a crowded column
    placed = crowded.select("gram", "digest").join(blocks.select("digest", "block"), "digest").select("gram", "block").distinct()
    placed = written(placed, "placed-blocks")
    one, other = placed.withColumnRenamed("block", "one"), placed.withColumnRenamed("block", "other")
    near = F.abs(F.col("one.band") - F.col("other.band")) <= 1
    tiles = one.join(other, "gram").filter((F.col("one") <= F.col("other")) & near).select("one", "other").distinct()
    tiles = written(tiles, "tiles")

    # stars: each row with the larger ones it may be linked to, some hundred pairs at a time
    bundles = max(1, candidates.count() // STARS)
    bundle = F.pmod(F.xxhash64("a"), F.lit(bundles)).alias("bundle")
    stars = candidates.select(bundle, F.col("a").alias("star"), F.col("b").alias("digest"))
    stars = written(stars.union(candidates.select(bundle, F.col("a"), F.col("a")).distinct()), "stars")

    # the texts of all rows that are compared, once each
    wanted = stars.select("digest").union(blocks.select("digest")).distinct()
    holders = classes.join(wanted, "digest").select("digest", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash"))
    holders = _small(written(holders, "holders"))
    held = slim.join(holders, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("digest", "text")
    # rows that are there several times are told by their ids, so that the others' texts stay where they are
    again = documents.drop("digest", "n").join(holders, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    again = _small(written(again.groupBy("digest").count().filter("count > 1").select("digest"), "repeated-rows"))
    single = held.join(again, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    texts = written(held.join(again, "digest", "left_anti").union(single), "texts")

    found = texts.join(_small(stars), "digest").select("bundle", "star", "digest", "text").groupBy("bundle").applyInArrow(_stars, LINKS)
    sides = tiles.filter("one <> other")
    asked = sides.select("one", "other", F.lit(0).alias("side"), F.col("one").alias("block"))
    asked = asked.union(sides.select("one", "other", F.lit(1), "other")).union(tiles.filter("one = other").select("one", "other", F.lit(2), "one"))
    rows = blocks.select("digest", "block").join(asked.withColumn("tile", F.xxhash64("one", "other")), "block").select("tile", "side", "digest")
    rows = written(rows, "tile-rows")
    bundles = max(1, rows.count() // TILE_ROWS)
    tasks = texts.join(_small(rows), "digest").select("tile", "side", "digest", "text").withColumn("bundle", F.pmod("tile", F.lit(bundles)))
    products = tasks.groupBy("bundle").applyInArrow(_products, LINKS)
    return written(found.union(products), "ngram-links")


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast if counted and at most `MOST_BROADCAST`, else joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rows


def near_duplicates(docs: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs."""
    ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))
    documents, counts = _rows(slim)
    # a set of very many copies is one row from here on
    classes = documents.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("row"))
    classes = written(classes, "classes")
    linked = links(slim, documents, classes, counts, few, block)
    # sets get numbers: the links' ends are few beside all documents
    ends = linked.select(F.col("a").alias("digest")).union(linked.select("b")).distinct()
    numbered = written(ends.withColumn("node", F.monotonically_increasing_id()), "nodes")
    first = linked.join(numbered.select(F.col("digest").alias("a"), F.col("node").alias("x")), "a")
    edges = first.join(numbered.select(F.col("digest").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = numbered.join(components(edges), "node").select("digest", "label")
    least = written(classes.select("digest", "least").join(labels, "digest", "left"), "labelled-classes")
    of_label = least.filter("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component_id"))
    least = least.join(of_label, "label", "left").select("digest", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = documents.filter("n > 0").join(least, "digest").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.union(documents.filter("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id"))
