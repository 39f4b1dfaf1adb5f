"""Quality grades by ordinal cumulative-link regression over hashed text.

One weight vector over hashed features is shared by all grades; ordered thresholds
t_1 < t_2 < ... cut the score s of a text: P(grade >= k) = logistic(s - t_k). The
expected grade is the sum of these tails, and a text is selected by one of them.

Features are the share of each hashed four-byte piece of the text (digits as
one; pieces of blanks only aside), and one feature each, in steps, for the length and the shares of different tokens, of
tokens equal to the one before, of signs, of signs equal to the byte before, of digits, of
capitals among ASCII letters, and of blanks. So junk, shouting, and repetition show
in few weights, however many pieces they are spread over.

Ratings: 0 for low quality, 1 for good but toxic, 2 for good and clean. At most
`LABELLED` of them, drawn by a hash of the id, are used, each with all its features. These reach the driver
a partition at a time and wait in temporary files of 12 bytes a feature, read in blocks of `BLOCK`.

Defined cases: NULL and empty texts have no tokens and are scored by their length.
Ratings that are NULL or without a document teach nothing; a document rated more
than once has its lowest grade. With no ratings all tails are 0.5, with one grade
only all are near it. Repeated rows each get a row. Other columns are ignored.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.llm.language import BLANKS, blocks
from kartei.llm.tasks import ready
from kartei.plans.storage import written

LABELLED = 8_000
#: Features that one step of learning reads at once.
BLOCK = 1 << 20
SPACE = 1 << 16
#: Steps of each of the features of the whole text, after the hashed ones.
STEPS = 64
WHOLE = 8
GRADES = 3


def _bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("0") : ord("9") + 1] = ord("0")
    table[[9, 11, 12, 13]] = 0x20
    return table


_TABLE = _bytes()
_IS_SIGN = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])


def _places(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _step(share: float) -> int:
    """Finer for small shares."""
    return int(math.sqrt(share) * (STEPS - 1))


def _steps(text: str | None) -> list[int]:
    tokens = (text or "").split()
    n = len(tokens)
    different = len(set(tokens)) * 20 // n if n else 20
    again = sum(map(str.__eq__, tokens, tokens[1:])) * 20 // n if n else 0
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    signs, digits = int(counts[_IS_SIGN].sum()), int(counts[48:58].sum())
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    twice = int(np.count_nonzero(_IS_SIGN[raw[1:]] & (raw[1:] == raw[:-1])))
    size = max(len(raw), 1)
    shares = [signs / size, twice / size, digits / size, capitals / max(capitals + small, 1), int(counts[_TABLE == 32].sum()) / size]
    steps = [min(n.bit_length(), STEPS - 1), different, again, *map(_step, shares)]
    return [SPACE + STEPS * i + step for i, step in enumerate(steps)]


def _vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of all features of a text."""
    total, n = np.zeros(SPACE), 0
    for _, _, grams in blocks([text], _TABLE):
        grams = grams[grams != BLANKS]
        total += np.bincount(_places(grams), minlength=SPACE)
        n += len(grams)
    used, steps = np.flatnonzero(total), _steps(text)
    return np.concatenate((used, steps)), np.concatenate((total[used] / max(n, 1), np.ones(len(steps))))


def features(text: str | None) -> dict[int, float]:
    """Value of each feature of a text."""
    places, values = _vector(text)
    return dict(zip(places.tolist(), values.tolist()))


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for which, starts, grams in blocks(texts, _TABLE):
            told = grams != BLANKS
            np.add.at(total, which, np.add.reduceat(self.weights[_places(grams)] * told, starts))
            np.add.at(n, which, np.add.reduceat(told, starts, dtype=np.int64))
        return total / np.maximum(n, 1) + self.weights[[_steps(x) for x in texts]].sum(axis=1)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(grades: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_grades: int = GRADES, rounds: int = 300) -> Model:
    """Likelihood of cumulative links, climbed by steps scaled by past gradients; thresholds stay ordered by positive gaps."""
    size = SPACE + WHOLE * STEPS
    w, first, gaps = np.zeros(size), 0.0, np.zeros(n_grades - 2)
    past, past_t = np.full(size, 1e-10), np.full(n_grades - 1, 1e-10)
    n = max(len(grades), 1)
    parts = [slice(i, i + BLOCK) for i in range(0, len(cols), BLOCK)]
    used = np.flatnonzero(sum((np.bincount(cols[part], minlength=size) for part in parts), np.zeros(size)))
    for _ in range(rounds if len(grades) else 0):
        t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        s = sum((np.bincount(rows[part], w[cols[part]] * values[part], len(grades)) for part in parts), np.zeros(len(grades)))
        above = 1 / (1 + np.exp(-np.clip(s[:, None] - t[None, :], -40, 40)))  # P(y >= k), k = 1..
        tails = np.hstack([np.ones((len(grades), 1)), above, np.zeros((len(grades), 1))])
        at = np.arange(len(grades))
        p = np.maximum(tails[at, grades] - tails[at, grades + 1], 1e-9)
        slope = np.hstack([np.zeros((len(grades), 1)), above * (1 - above), np.zeros((len(grades), 1))])
        d_s = (slope[at, grades] - slope[at, grades + 1]) / p / n
        grad = sum((np.bincount(cols[part], d_s[rows[part]] * values[part], size) for part in parts), -1e-6 * w)
        past[used] += grad[used] ** 2
        w[used] += 0.2 * grad[used] / np.sqrt(past[used])
        d_t = np.zeros(n_grades + 1)
        np.add.at(d_t, grades, -slope[at, grades] / p / n)
        np.add.at(d_t, grades + 1, slope[at, grades + 1] / p / n)
        d_t = d_t[1:-1]
        step = np.concatenate(([d_t.sum()], np.exp(gaps) * np.cumsum(d_t[::-1])[::-1][1:]))
        past_t += step**2
        move = 0.1 * step / np.sqrt(past_t)
        first, gaps = first + move[0], gaps + move[1:]
    return Model(w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade (0, 1, 2) of each rated document."""
    good, clean = F.col("quality") > 0, F.coalesce(F.col("toxic"), F.lit(0)) <= 0
    grade = F.when(~good, 0).when(~clean, 1).otherwise(2)
    rated = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    return rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 32):
            some = batch.slice(first, 32)
            found = [_vector(x) for x in some.column(2).to_pylist()]
            places = pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary())
            values = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), places, values], ["doc_id", "grade", "places", "weights"])


def _filed(file, kind: str) -> np.ndarray:
    file.flush()
    return np.memmap(file, kind, "r") if file.tell() else np.empty(0, kind)


def learn(docs: DataFrame, rated: DataFrame, most: int = LABELLED) -> Model:
    """The model of at most so many ratings (doc_id, grade)."""
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = slim.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")  # at most `most` rows of 12 bytes
    sample = written(sample.mapInArrow(_featured, "doc_id long, grade int, places binary, weights binary"), "quality-features")
    grades = []
    with ExitStack() as files:
        rows, cols, values = (files.enter_context(tempfile.TemporaryFile()) for _ in range(3))
        for row in sample.orderBy("doc_id", "grade").select("grade", "places", "weights").toLocalIterator():
            rows.write(np.full(len(row.places) // 4, len(grades), "<i4").tobytes())
            cols.write(row.places)
            values.write(row.weights)
            grades.append(row.grade)
        return fit_ordinal(np.array(grades, np.int64), _filed(rows, "<i4"), _filed(cols, "<i4"), _filed(values, "<f4"))


def _grader(weights: np.ndarray, thresholds: np.ndarray, select_from: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, thresholds)
        for batch in parts:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                tails = model.tails(model.scores(some.column(1).to_pylist()))
                columns = [some.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, select_from - 1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail"])

    return batches


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents that never teaches."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def quality_grades(docs: DataFrame, labels: DataFrame, select_from: int = 1, most: int = LABELLED) -> DataFrame:
    """doc_id, held_out, expected_grade (0 to 2), tail (P(grade >= select_from)), selected (tail >= 0.5)."""
    ready(docs.sparkSession)
    model = learn(docs, ratings(labels).filter(~held_out(F.col("doc_id"))), most)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    graded = slim.mapInArrow(_grader(model.weights, model.thresholds, select_from), "doc_id long, expected_grade double, tail double")
    return graded.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("selected"))
