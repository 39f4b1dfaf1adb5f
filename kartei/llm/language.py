"""Language identification with one Bloom filter of language bitmasks.

Each slot of the filter holds a bit for every language, so one look-up (the AND
of `HASHES` slots) tells all languages that contain an n-gram. A text's n-grams
are looked up, each language's hits are counted, corrected by the false positives
that its filling of the slots makes likely, and the language with most is predicted.

N-grams are four bytes of the text with A-Z lowered and all ASCII but letters a
blank. A language contains an n-gram if it makes up at least `LEAST_SHARE` of the
language's n-grams, and at least `LEAST_RATIO` of the share it has in any other: so
a few foreign passages do not teach. At most 1 / `LEAST_SHARE` n-grams of a language
reach the filter, whose size is fixed; it is put together by Spark, and only its
slots are collected.

Defined cases: NULL texts, and texts without any letter, are `und` with score 0, as
are all if nothing is learned. Texts of unknown n-grams only get the language
with most n-grams learned, with score 0. Equal counts go to the language that sorts
first. Repeated rows each get a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.llm.tasks import ready
from kartei.plans.storage import written

GRAM = 4
SLOTS = 1 << 20
HASHES = 3
LEAST_SHARE = 2e-6
LEAST_RATIO = 0.1
#: Bits of one word of a mask; further languages take further words.
WORD = 62
UNKNOWN = "und"
_BLOCK = 1 << 21
BLANKS = np.uint32(0x20202020)


def _byte_table() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    letters = np.arange(ord("a"), ord("z") + 1)
    table[letters] = table[letters - 32] = letters
    table[0x80:] = np.arange(0x80, 256)
    return table


_TABLE = _byte_table()


def blocks(texts: list[str | None], table: np.ndarray = _TABLE) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(which text, first n-gram of each, all n-grams) for blocks of a few MB; long texts take part in several.

    table: what each byte is read as.
    """
    which: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        data = b" " + (text or "").encode("utf-8", "replace") + b" "
        for begin in range(0, len(data), _BLOCK):
            piece = data[begin : begin + _BLOCK + GRAM - 1]
            if parts and size + len(piece) > _BLOCK:
                yield which, *_grams(parts, table)
                which, parts, size = [], [], 0
            which.append(i)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield which, *_grams(parts, table)


def _grams(parts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pad = b" " * GRAM
    raw = table[np.frombuffer(pad.join(parts) + pad, np.uint8)]
    starts = np.cumsum([0] + [len(x) + GRAM for x in parts[:-1]])
    grams = np.ndarray((len(raw) - GRAM + 1,), np.dtype("<u4"), raw, 0, (1,)).copy()
    # n-grams that begin between two texts belong to neither
    between = (starts + [len(x) for x in parts])[:, None] + np.arange(GRAM)
    grams[between[between < len(grams)]] = BLANKS
    return starts, grams


def slot_numbers(grams: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram."""
    wide = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide ^= wide >> np.uint64(29)
    wide *= np.uint64(0xBF58476D1CE4E5B9)
    return [((wide >> np.uint64(s)) & np.uint64(SLOTS - 1)).astype(np.int64) for s in (3, 23, 43)][:HASHES]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for _, _, grams in blocks([t for t, own in zip(texts, langs) if own == lang]):
                found, n = np.unique(grams[grams != BLANKS], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = np.concatenate(slot_numbers(batch.column(0).to_numpy().astype(np.uint32)))
        again = np.tile(np.arange(batch.num_rows), HASHES)
        yield pa.RecordBatch.from_arrays([pa.array(slots), batch.column(1).take(pa.array(again))], ["slot", "place"])


class Filter:
    """Slots of language bitmasks."""

    def __init__(self, languages: list[str], slots: np.ndarray, common: int):
        self.languages, self.slots, self.common = languages, slots, common
        bits = [(slots[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1) for i in range(len(languages))]
        #: How likely a language seems to hold an n-gram that it does not.
        self.false = np.array([float(b.mean()) ** HASHES for b in bits])

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, hits of each text and language)."""
        n, found = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for which, starts, grams in blocks(texts):
            told = grams != BLANKS
            np.add.at(n, which, np.add.reduceat(told, starts, dtype=np.int64))
            slots = slot_numbers(grams)
            for word, table in enumerate(self.slots):
                masks = np.where(told, table[slots[0]], np.uint64(0))
                for slot in slots[1:]:
                    masks &= table[slot]
                for i in range(word * WORD, min((word + 1) * WORD, len(self.languages))):
                    bit = ((masks >> np.uint64(i % WORD)) & np.uint64(1)).astype(np.uint8)
                    np.add.at(found[:, i], which, np.add.reduceat(bit, starts, dtype=np.int64))
        return n, found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        n, found = self.hits(texts)
        true = np.maximum((found - n[:, None] * self.false) / np.maximum(1 - self.false, 1e-9), 0)
        total = true.sum(axis=1)
        best = np.where(total > 0, true.argmax(axis=1), self.common)
        share = np.where(total > 0, true.max(axis=1) / np.maximum(total, 1e-9), 0.0)
        known = [bool(t) and any(c.isalpha() for c in t) for t in texts]
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(share, known)]


def learn(docs: DataFrame, learns: Column) -> Filter:
    """The filter of all rows that may teach and have a text and a language."""
    ready(docs.sparkSession)
    taught = docs.filter(learns & F.col("text").isNotNull() & F.col("lang").isNotNull())
    taught = taught.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = taught.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filter([], np.zeros((1, SLOTS), np.uint64), 0)
    # a row for each language
    per_lang = F.broadcast(docs.sparkSession.createDataFrame([(lang, i, float(totals[lang])) for i, lang in enumerate(languages)], "lang string, place int, total double"))
    shares = counts.join(per_lang, "lang").select("gram", "place", (F.col("n") / F.col("total")).alias("share")).filter(F.col("share") >= LEAST_SHARE)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    held = shares.join(most, "gram").filter(F.col("share") >= LEAST_RATIO * F.col("most")).select("gram", "place")
    slots = held.mapInArrow(_slots_of, "slot long, place int")
    bit = F.expr(f"shiftleft(1L, place % {WORD})")
    masks = slots.groupBy("slot", F.floor(F.col("place") / WORD).alias("word")).agg(F.bit_or(bit).alias("mask"))
    table = np.zeros((1 + (len(languages) - 1) // WORD, SLOTS), np.uint64)
    for row in masks.toLocalIterator():  # at most the slots of the filter
        table[row.word, row.slot] = row.mask
    return Filter(languages, table, languages.index(max(languages, key=lambda x: totals[x])))


def _predictor(shared):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Filter = shared.value
        for batch in parts:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                langs, scores = model.predict(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return batches


def held_out(doc_id: Column) -> Column:
    """The third of all documents that never teaches."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame, learns: Column | None = None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, learned from the rows that may teach (all, if not said)."""
    model = learn(docs, F.lit(True) if learns is None else learns)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the filter's fixed size
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_predictor(shared), "doc_id long, lang_pred string, score double")


def language_digests(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = languages(docs, ~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
