"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most `RADIUS` = 4 bits apart have a point halfway, at most 2
bits from each. Emitting all variants within 2 bits of a 64-bit fingerprint is
2,081 rows for each, so the ball is taken where it is small: of two fingerprints
4 bits apart, one 32-bit half is at most 2 bits apart, and then both halves have a
variant within 1 bit in common. So each half emits its 33 variants: 66 rows for
each different fingerprint, and no link is lost. Rows are shuffled on the variant,
fingerprints that meet are verified on all 64 bits and paired once, in the one variant
that speaks for all they share.

Copies cost nothing: only different fingerprints are hashed. A variant that more
than `CROWDED` fingerprints share would give too many pairs. Those fingerprints
emit their whole 2-bit ball instead, and are linked to the smallest fingerprint in
each point of it: all that share such a point are at most 4 bits apart, and all that
are at most 4 bits apart share one, so the components are exact without any pair.

Defined cases: a NULL text, or one of blanks only, has no words and fingerprint 0.
Fewer words than a shingle make one shingle of all. Repeated rows are copies. Rows
without a doc_id are linked like others, but never give a component its id unless
no member has one, which makes it NULL. Other columns are carried along by
`near_duplicates` and `one_of_each` and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kartei.llm.graph import components
from kartei.llm.tasks import ready
from kartei.llm.words import quoted, unused
from kartei.plans.storage import written

SHINGLE = 4
SEED = 42
RADIUS = 4
HALF = 32
CROWDED = 1_000
#: Variants that a task makes.
EMITTED = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority of the bits of all shingles' hashes, as an unsigned integer."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = len(parts) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
    counts = np.zeros(64, np.int64)
    for first in range(0, n, 1 << 16):  # a long text is counted in pieces
        block = np.frombuffer(hashes, np.uint8, min(n - first, 1 << 16) * 8, first * 8)
        counts += np.unpackbits(block.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "bits"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and bits (the fingerprint as a signed long) for each row of docs."""
    ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, bits long")


def _ball(bits: int, radius: int) -> list[int]:
    """Masks of up to radius of the given number of low bits, as signed 64-bit integers."""
    masks = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _variants(bits: Column) -> Column:
    """half (0 or 1) and the values within 1 bit of that half, packed into one long: 33 low bits."""
    low = bits.bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned(bits, HALF)
    flips = F.array(*(F.lit(m).cast("long") for m in _ball(HALF, RADIUS // 4)))
    tag = F.lit(1 << HALF).cast("long")
    return F.concat(F.transform(flips, lambda m: low.bitwiseXOR(m)), F.transform(flips, lambda m: high.bitwiseXOR(m).bitwiseOR(tag)))


def _meets_here() -> Column:
    """Whether a and b are linked and this variant is the one of all they share that speaks for them.

    Of the halves it is the low one if that is at most 2 bits apart. Equal halves share
    33 variants, and the half itself speaks; others share two, and the smaller speaks:
    the other one is the variant with the bits in which the halves differ turned over.
    """
    apart, variant = F.col("a").bitwiseXOR(F.col("b")), F.col("variant")
    low, high = apart.bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned(apart, HALF)
    is_high = F.shiftright(variant, HALF) == 1
    by_high = F.bit_count(low) > RADIUS // 2
    differ = F.when(by_high, high).otherwise(low)
    own = F.when(by_high, F.shiftrightunsigned(F.col("a"), HALF)).otherwise(F.col("a").bitwiseAND(F.lit((1 << HALF) - 1)))
    here = variant.bitwiseAND(F.lit((1 << HALF) - 1))
    speaks = F.when(differ == 0, here == own).otherwise(here < here.bitwiseXOR(differ))
    return (F.bit_count(apart) <= RADIUS) & (is_high == by_high) & speaks


def _tasks(different: DataFrame) -> int:
    """So many tasks that each makes about `EMITTED` variants."""
    return max(1, -(-different.count() * 2 * (HALF + 1) // EMITTED))


def links(different: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """a, b: verified links between different fingerprints; every linked pair is connected by them."""
    # a few megabytes of fingerprints become 66 times as many rows: dealt to tasks by the rows to come
    spread = different.repartition(_tasks(different), "bits")
    emitted = spread.select("bits", F.explode_outer(_variants(F.col("bits"))).alias("variant"))
    met = emitted.groupBy("variant").agg(F.count("*").alias("n")).filter("n > 1")
    # an exploded table is sized as the one before it, and stored variants as their files, which repeats make
    # small: either may pass for small enough to broadcast, so these joins are told to shuffle and sort
    met = written(emitted.hint("merge").join(met, "variant"), "variants")
    sparse = met.filter(F.col("n") <= crowded).select("variant", "bits").hint("merge")
    left, right = sparse.withColumnRenamed("bits", "a"), sparse.withColumnRenamed("bits", "b")
    pairs = left.join(right, "variant").filter((F.col("a") < F.col("b")) & _meets_here()).select("a", "b")
    dense = met.filter(F.col("n") > crowded).select("bits").distinct()
    masks = F.array(*(F.lit(m).cast("long") for m in _ball(64, RADIUS // 2)))
    points = dense.select("bits", F.explode_outer(F.transform(masks, lambda m: F.col("bits").bitwiseXOR(m))).alias("point"))
    centres = points.groupBy("point").agg(F.min("bits").alias("b"), F.max("bits").alias("last")).filter("b < last").drop("last")
    stars = points.hint("merge").join(centres, "point").filter("bits <> b").select(F.col("bits").alias("a"), "b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """doc_id, text_hash, bits, label (the class, a fingerprint) and component_id for each row of docs."""
    own = written(fingerprints(docs), "fingerprints")
    different = written(own.groupBy("bits").agg(F.min("doc_id").alias("least")), "different")
    labels = components(links(different.select("bits"), crowded))
    labelled = different.join(labels, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("label", "bits").alias("label"))
    labelled = written(labelled, "labels")
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.join(smallest, "label").select("bits", "label", "component_id")
    return own.join(classes, "bits").select("doc_id", "text_hash", "bits", "label", "component_id")


def simhash_digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component; one row if that repeats."""
    # no id comes after all ids; a minimum, so that no component is one task
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = near_duplicates(docs).groupBy("label").agg(F.min(order).alias("kept"))
    # the same key twice is the same text under the same id; no id sorts below all ids
    id_, hash_, n = unused(docs, "kept_id", "kept_hash", "kept_n")
    no_id = F.lit(-(1 << 63))
    kept = kept.select(F.coalesce("kept.doc_id", no_id).alias(id_), F.col("kept.text_hash").alias(hash_))
    rows = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), no_id), hash_: F.xxhash64("text")}).join(kept, [id_, hash_])
    copies = Window.partitionBy(id_, hash_).orderBy(id_, hash_)
    return rows.withColumn(n, F.row_number().over(copies)).filter(F.col(n) == 1).select(*map(quoted, docs.columns))
