"""Audit of filters that are applied one after the other, in every order.

Five filters look at whole texts: A too few words, B too few different words, C too many
capitals, D a sign of a given set, E the text of a smaller doc_id again. One pass of a
table-driven transducer over the UTF-8 bytes (`spans`) counts words, capitals, code
points and signs, and puts word spans into a hash table that compares bytes, so that
different words are counted exactly. What a document fails is five bits; a part (a
language) is then 32 counts for each pair of labels, and all orders follow from those.

Only keys and bits are shuffled, never a text. Copies are told by SHA-256: rows of one
doc_id and text become one row with a count, the smallest doc_id of each text is a
minimum, which combines before the shuffle, and it is joined on text and doc_id, so a text
that a third of all rows hold is no hot key.

Defined cases: a NULL text is empty; an empty text fails A only, and E like others. A NULL
lang is part ''. Rows without a doc_id have no labels, never fail E and make no other row
fail it. Rows that repeat a doc_id count each; equal ids are not smaller. Labels that
repeat a doc_id count as 1 if any of them is 1; NULL labels are not 1. Continuation bytes
are not code points, in ill-formed texts neither. A very long text is one entry of a
batch: its pass takes memory in proportion to it. An empty table has no parts and gives no
rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.llm.spans import CAPITAL, FIRST, SIGN, count_distinct, slices, words_of
from kartei.llm.tasks import ready
from kartei.plans.storage import written

FILTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    """A fails under least_words; B under distinct_percent; C over capital_percent."""

    least_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 3


def text_failures(texts: list[bytes], limits: Limits = Limits()) -> np.ndarray:
    """For each text the sum of 1 for A, 2 for B, 4 for C, 8 for D."""
    found = words_of(texts, (CAPITAL, FIRST, SIGN))
    n = np.bincount(found.owners, minlength=len(texts))
    points = found.counts[FIRST] - 1  # the blank after each text
    fails = (
        n < limits.least_words,
        100 * count_distinct(found) < limits.distinct_percent * n,
        100 * found.counts[CAPITAL] > limits.capital_percent * points,
        found.counts[SIGN] > 0,
    )
    return sum(bits.astype(np.int32) << i for i, bits in enumerate(fails))


def _marker(limits: Limits):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sizes = [0 if x is None else len(x) for x in batch.column(2).to_pylist()]
            for first, last in slices(sizes):
                some = batch.slice(first, last - first)
                texts = [x or b"" for x in some.column(2).to_pylist()]
                digests = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), digests, pa.array(text_failures(texts, limits), pa.int32())], ["doc_id", "part", "digest", "fails"]
                )

    return batches


def document_failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, part, fails (five bits) and n, the rows that are so: each different document row once."""
    ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text"))
    marked = slim.mapInArrow(_marker(limits), "doc_id long, part string, digest binary, fails int")
    rows = written(marked.groupBy("digest", "doc_id", "part", "fails").agg(F.count("*").alias("n")), "failures")
    # joined on text and id: a text of very many rows is spread by their ids
    keepers = rows.groupBy("digest").agg(F.min("doc_id").alias("keeper_id")).filter("keeper_id IS NOT NULL").withColumnRenamed("digest", "keeper")
    out = rows.join(keepers, (F.col("digest") == F.col("keeper")) & (F.col("doc_id") == F.col("keeper_id")), "left")
    again = (F.col("keeper").isNull() & F.col("doc_id").isNotNull()).cast("int")
    return out.select("doc_id", "part", (F.col("fails") + F.shiftleft(again, 4)).alias("fails"), "n")


def label_flags(labels: DataFrame) -> DataFrame:
    """labelled (a doc_id), good and toxic, each id once."""
    flags = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled"))
    return flags.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))


def _orders() -> Column:
    """All orders and their steps: filter_order, step, own (the bit of its filter), before and after (bits up to it)."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            rows.append(f"named_struct('filter_order', '{name}', 'step', {step}, 'own', {1 << i}, 'before', {before}, 'after', {after})")
            before = after
    return F.expr(f"array({', '.join(rows)})")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    fails = document_failures(docs, limits)
    # rows without an id would all meet in one task of the join
    flagged = fails.filter("doc_id IS NOT NULL").join(label_flags(labels), F.col("doc_id") == F.col("labelled"), "left")
    flagged = flagged.unionByName(fails.filter("doc_id IS NULL"), allowMissingColumns=True)
    good, toxic = F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))
    # at most 32 rows a part, whatever the number of documents
    cells = flagged.groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("n_toxic")
    )
    cells = written(cells, "filter-cells")
    steps = cells.withColumn("o", F.explode(_orders())).select("part", "fails", "n", "n_good", "n_toxic", "o.*")
    bits, none = F.col("fails"), F.lit(0).cast("long")
    own, earlier = bits.bitwiseAND(F.col("own")) != 0, bits.bitwiseAND(F.col("before")) != 0

    def summed(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(none)).cast("long")

    # of documents that fail so many filters, each of these removes its part: so many of 120 orders
    turns = F.get(F.array(*(F.lit(120 // k if k else 0) for k in range(len(FILTERS) + 1))), F.bit_count(bits))
    return steps.groupBy("part", "filter_order", "step").agg(
        summed(bits.bitwiseAND(F.col("after")) == 0).alias("kept"),
        summed(own & ~earlier).alias("removed"),
        summed(own & earlier).alias("redundant"),
        summed(bits == F.col("own")).alias("unique_fails"),
        summed(own & ~earlier, "n_good").alias("good_lost"),
        summed(own & ~earlier, "n_toxic").alias("toxic_lost"),
        F.sum(F.when(own, F.col("n") * turns).otherwise(none)).cast("long").alias("shapley"),
    )
