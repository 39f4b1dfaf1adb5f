"""Toxicity by noisy-channel deobfuscation.

Words may be disguised: signs for letters (`1d10t`), letters spaced out (`i d i o t`,
`i.d.i.o.t`), letters repeated (`idiooot`). Each suspicious word is a lattice of
the letters its signs may stand for; a Viterbi search finds the likeliest reading
under a trigram model of characters and the costs of the channel. A second search may
put blanks anywhere, so phrases spaced out and words run together give their single words.
Tokens of any length are read, those joined by other signs also piece by piece. All
words of these readings are then scored.

The character model is counted over the texts of all documents. Scores come from a
logistic regression over words whose share of toxic documents is unusual, learned
from at most `LABELLED` labelled rows. What reaches the driver is bounded: 21,952
trigram counts, the words that tell toxic rows of the sample, and their places in it.

Each task remembers what it has made of at most `REMEMBERED` disguised tokens of up to `LONG` characters. Words count
by their first letters too, as endings vary, and more so if several words begin alike.

Defined cases: NULL and empty texts have no words and the score of a text without
any known word. Labels that are NULL, or without a document, teach nothing; with no
labels, or labels of one kind only, every score is the share of that kind. A
document labelled more than once is toxic if any label says so. Repeated rows each
get the same score. Other columns are carried along by `toxicity` and never looked at.
"""

from __future__ import annotations

import math
import os.path
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartei.llm.tasks import ready
from kartei.llm.words import quoted, unused
from kartei.plans.storage import written

LABELLED = 20_000
REMEMBERED = 200_000
LONG = 64
#: Steps of a search after which what all its readings share is set aside.
SETTLED = 32
#: Symbols of the character model: a blank, a-z, and one for all other letters.
SYMBOLS = 28

# Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs that may stand between the letters of one word.
BETWEEN = ".-_*~'`·"
# Costs of the channel, as negative logarithms.
COST_SIGN, COST_BETWEEN, COST_REPEAT = 2.0, 1.0, 1.0
#: Cost of the squares of weights.
SHRINK = 0.3

# A letter and a sign with nothing but gaps between, a letter three times, letters one by one.
_DISGUISED = re.compile(
    r"[^\W\d_]['`·~*.\-_]*[0-9@$!|+(€£¡]|[0-9@$!|+(€£¡]['`·~*.\-_]*[^\W\d_]"
    r"|([^\W\d_])\1\1|(?<![^\W_])(?:[^\W_][.\-_*~'`·]){2}[^\W_]"
)
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$|+(") + "“”„«»…"
# Signs that join words, and scripts written without blanks: disguised words begin and end there.
_JOINS = re.compile(
    r"[^\w\u0300-\u036f@$!|+(€£¡.\-~*'`·]+"
    r"|[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U00033fff]+"
)
#: Runs from five on are read alike.
_RUN = re.compile(r"(.)\1{5,}", re.DOTALL)
_LETTER, _DIGIT, _SIGN, _GAP, _BLANK, _OTHER_NUMBER, _MARK = 1, 2, 3, 4, 5, 6, 7


def _kind_of(char: str) -> int:
    if char in SIGNS or char in BETWEEN:
        return _GAP if char in BETWEEN else _DIGIT if char.isdigit() else _SIGN
    if char.isalnum():
        return _OTHER_NUMBER if char.isdecimal() else _LETTER
    return _BLANK if char.isspace() else _MARK if unicodedata.category(char)[0] == "M" else 0


def _kinds() -> np.ndarray:
    """Kind of each code point; there are no letters from 0x34000 on."""
    kind = np.zeros(0x110000, np.uint8)
    kind[:0x34000] = [_kind_of(chr(c)) for c in range(0x34000)]
    return kind


_KIND = _kinds()
#: Lowers A-Z and blanks all but letters of an ASCII text.
_LOWERED = bytes(c | 0x20 if chr(c).isalpha() and c < 0x80 else 0x20 for c in range(256))


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    table[0xC2:0xF5] = 27  # the first byte of a non-ASCII character; the others are left out
    return table


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            raw = np.frombuffer(f"  {text}  ".encode("utf-8", "replace"), np.uint8)
            seen = table[raw[(raw < 0x80) | (raw >= 0xC0)]].astype(np.int32)
            total += np.bincount((seen[:-2] * SYMBOLS + seen[1:-1]) * SYMBOLS + seen[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(third symbol | first two), counted over all texts; shape (28, 28, 28)."""
    ready(docs.sparkSession)
    counts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    counts = counts.mapInArrow(_count_trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    table = np.zeros(SYMBOLS**3)
    for row in counts.collect():  # bounded by the symbols
        table[row.trigram] = row.n
    table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = table.sum(axis=0) + 0.5  # backs off to the symbol before
    backed = pairs / pairs.sum(axis=1, keepdims=True)
    return np.log((table + 8 * backed) / (table.sum(axis=2, keepdims=True) + 8))


def _symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter == " " else 27


def _lattice(token: str, borders: bool = False) -> list[list[tuple[str, float]]]:
    """Readings (letters, cost) of each run of the same character. borders: a run may be cut by a blank."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        char, n = token[i], j - i
        letters = [(char, 0.0)] if char.isalpha() else [(x, COST_SIGN) for x in SIGNS.get(char, "")]
        times = {1: [1], 2: [2, 1]}.get(n, [1, 2])
        ways = [(x * t, cost + COST_REPEAT * (t != n)) for x, cost in letters for t in times]
        if borders:
            cuts = [(t, u) for t in (1, 2) for u in (1, 2) if t + u <= n]
            ways += [(x * t + " " + x * u, cost + COST_REPEAT * (t + u != n)) for x, cost in letters for t, u in cuts]
        if char in BETWEEN or not ways:
            ways.append(("", COST_BETWEEN * n))
        out.append(ways)
        i = j
    return out


def _with_borders(best: dict[tuple[int, int], tuple[float, str]], model) -> dict[tuple[int, int], tuple[float, str]]:
    """The same readings, and each with a blank after it."""
    out = dict(best)
    for (a, b), (score, word) in best.items():
        if b:
            s, known = score + model[a][b][0], out.get((b, 0))
            if known is None or (-s, word + " ") < (-known[0], known[1]):
                out[b, 0] = (s, word + " ")
    return out


def restore(token: str, model, borders: bool = False) -> str:
    """The likeliest word behind a disguised token, by Viterbi over its lattice; with borders, words with blanks between."""
    settled: list[str] = []
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for step, ways in enumerate(_lattice(token.lower(), borders), 1):
        if borders:
            best = _with_borders(best, model)
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, word) in best.items():
            for letters, cost in ways:
                x, y, s = a, b, score - cost
                for letter in letters:
                    z = _symbol(letter)
                    s += model[x][y][z]
                    x, y = y, z
                known = after.get((x, y))
                # ties go to the word that sorts first
                if known is None or (-s, word + letters) < (-known[0], known[1]):
                    after[x, y] = (s, word + letters)
        best = after
        if step % SETTLED == 0:
            shared = os.path.commonprefix([word for _, word in best.values()])
            settled.append(shared)
            best = {at: (score, word[len(shared) :]) for at, (score, word) in best.items()}
    ends = [(-(s + model[a][b][0]), word) for (a, b), (s, word) in best.items()]
    return "".join(settled) + min(ends)[1]


def readings(token: str, model) -> str:
    """All words behind a disguised token of any length, with blanks between."""
    short = _RUN.sub(r"\1\1\1\1\1", token)
    words = {restore(short, model)}
    pieces = [x.strip(_EDGES) for x in _JOINS.split(short)] if _JOINS.search(short) else []
    for piece in {x for x in pieces if _DISGUISED.search(x)} if pieces else {short}:
        words.add(restore(piece, model))
        words.update(restore(piece, model, True).split(" "))
    return " ".join(sorted(words - {""}))


def disguised(data: bytes) -> set[str]:
    """The tokens of a UTF-8 text that may be disguised words, and runs of letters with single blanks between."""
    text = data.decode("utf-8", "replace").lower()
    code = np.frombuffer(f" {text}     ".encode("utf-32-le"), "<u4")
    kind = _KIND[code]
    letter, blank = kind == _LETTER, kind == _BLANK
    plain = letter | (kind == _DIGIT) | (kind == _OTHER_NUMBER)
    # more than the pattern finds: a sign next to a letter but for gaps
    marked = np.zeros(len(kind), bool)
    solid = np.flatnonzero(kind != _GAP)
    sign = ((kind == _DIGIT) | (kind == _SIGN))[solid]
    marked[solid[:-1]] = sign[:-1] & letter[solid[1:]] | letter[solid[:-1]] & sign[1:]
    # a letter three times
    same = code[:-1] == code[1:]
    marked[:-2] |= same[:-1] & same[1:] & letter[:-2]
    # letters one by one: x.x.x
    gap = kind == _GAP
    marked[:-4] |= plain[:-4] & gap[1:-3] & plain[2:-2] & gap[3:-1] & plain[4:]
    # spaced out: blank x blank x blank x
    space = code == 0x20
    spaced = blank[:-5] & plain[1:-4] & space[2:-3] & plain[3:-2] & space[4:-1] & plain[5:]
    found = set()
    if marked.any():
        blanks = np.flatnonzero(blank)
        token = np.unique(np.searchsorted(blanks, np.flatnonzero(marked), "right"))
        tokens = {text[begin : end - 1].strip(_EDGES) for begin, end in zip(blanks[token - 1].tolist(), blanks[token].tolist())}
        found = {x for x in tokens if _DISGUISED.search(x)}
    if spaced.any():
        done = 0
        for begin in np.flatnonzero(spaced).tolist():
            if begin >= done:
                at = done = begin + 1
                while plain[at] and not plain[at + 1]:
                    done = at
                    if not space[at + 1]:
                        break
                    at += 2
                found.add(text[begin:done:2])
    return found - {""}


def plain_words(data: bytes) -> set[bytes]:
    """The different runs of letters of a UTF-8 text, lowered; marks on letters belong to them."""
    if data.isascii():
        return set(data.translate(_LOWERED).split())
    code = np.frombuffer(data.decode("utf-8", "replace").lower().encode("utf-32-le"), "<u4")
    kind = _KIND[code]
    code = np.where((kind == _LETTER) | (kind == _MARK), code, np.uint32(0x20))
    return set(code.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8").split())


def text_words(text: str | None, restored: Callable[[str], str]) -> set[bytes]:
    """The different words of a text, with those behind disguised ones, and their beginnings of 4 and 5 bytes.

    A beginning of so many different words, up to three, has so many dashes and those before.
    """
    if not text:
        return set()
    data = text.encode("utf-8", "replace")
    words = plain_words(data)
    for token in disguised(data):
        words.update(restored(token).encode("utf-8", "replace").split())
    marks: set[bytes] = set()
    for length in (4, 5):
        begin = Counter([w[:length] for w in words if len(w) > length])
        marks.update([b + b"-" * times for b, n in begin.items() for times in range(1, min(n, 3) + 1)])
    return words | marks


def _remembering(model: np.ndarray) -> Callable[[str], str]:
    table = model.tolist()  # faster to look up one by one
    short = lru_cache(maxsize=REMEMBERED)(lambda token: readings(token, table))
    return lambda token: short(token) if len(token) <= LONG else readings(token, table)


def labelled_rows(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id and toxic (0 or 1) of at most so many labelled documents, drawn by a hash of the id."""
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _words_of_rows(model: np.ndarray):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = _remembering(model)
        for batch in parts:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                words = [sorted(text_words(x, restored)) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(words, pa.list_(pa.binary()))], ["doc_id", "toxic", "words"])

    return batches


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, learns: Column | None = None, most: int = LABELLED) -> tuple[float, dict[bytes, float]]:
    """(bias, weight of each word). learns: which doc_id may teach."""
    chosen = labelled_rows(labels if learns is None else labels.filter(learns), most)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most `most` rows of 12 bytes
    sample = slim.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    sample = written(sample.mapInArrow(_words_of_rows(model), "doc_id long, toxic int, words array<binary>"), "toxic-words")
    kinds = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = kinds.get(1, 0), kinds.get(0, 0)
    if not bad or not good:
        return (math.log((bad + 0.5) / (good + 0.5)), {}) if bad or good else (-2.0, {})
    in_kind = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("in_bad"), F.sum(1 - F.col("toxic")).alias("in_good")
    )
    odds = F.log((F.col("in_bad") + 0.5) / (bad + 1)) - F.log((F.col("in_good") + 0.5) / (good + 1))
    # the sample is bounded, and with it the words of several toxic rows that are collected
    telling = in_kind.filter((F.col("in_bad") >= 2) & (odds > 1)).select("word")
    words = sorted(bytes(r.word) for r in telling.collect())
    place = F.broadcast(docs.sparkSession.createDataFrame([(i, bytearray(w)) for i, w in enumerate(words)], "place int, word binary"))
    found = sample.select("doc_id", "toxic", F.explode_outer("words").alias("word")).join(place, "word", "left")
    found = found.groupBy("doc_id", "toxic").agg(F.sort_array(F.collect_set("place")).alias("places")).orderBy("doc_id").collect()
    y = np.array([r.toxic for r in found], float)
    rows = np.repeat(np.arange(len(found)), [len(r.places) for r in found])
    cols = np.array([p for r in found for p in r.places], np.int64)
    bias, weights = _regression(y, rows, cols, len(words))
    return bias, {w: float(x) for w, x in zip(words, weights) if x > 0.01}


def _regression(y: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression over presence; weights are not negative and shrink by their squares.

    The bias is the log odds of all rows, so one word that stands in toxic texts only can decide. Learned freely,
    it sinks until texts need several such words. Shrinking gives words of few rows small weights. Steps are
    bounded by the curvature and sped up by the step before.
    """
    bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    per_row = np.bincount(rows, minlength=len(y)) + 1
    bound = np.bincount(cols, 0.25 * per_row[rows], n) + SHRINK
    w, last, pace = np.zeros(n), np.zeros(n), 1.0
    for _ in range(rounds):
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = np.maximum(w + (pace - 1) / faster * (w - last), 0)
        pace, last = faster, w
        miss = y - 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, ahead[cols], len(y)), -40, 40)))
        w = np.maximum(ahead + (np.bincount(cols, miss[rows], n) - SHRINK * ahead) / bound, 0)
    return bias, w


def _scorer(model: np.ndarray, bias: float, weights: dict[bytes, float]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, known = _remembering(model), frozenset(weights)
        for batch in parts:
            scores = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                total = bias + sum(sorted(weights[w] for w in known & text_words(text, restored)))
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, total)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "toxic_score"])

    return batches


def _scored(docs: DataFrame, labels: DataFrame, learns: Column | None, most: int) -> tuple[DataFrame, str]:
    """docs with one more column, a score, and the name of that column, which no other has."""
    model = character_model(docs)
    bias, weights = fit(docs, labels, model, learns, most)
    # numbered meanwhile, as Python functions over batches can not take names with dots
    [score] = unused(docs, "toxic_score")
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = numbered[f"c{docs.columns.index('text')}"].cast("string")
    fields = [T.StructField(n, f.dataType) for n, f in zip(numbered.columns, docs.schema.fields)]
    schema = T.StructType([*fields, T.StructField("toxic_score", T.DoubleType())])
    scored = numbered.withColumn("toxic_text", text).mapInArrow(_scorer(model, bias, weights), schema)
    return scored.toDF(*docs.columns, score), score


def toxicity(docs: DataFrame, labels: DataFrame, learns: Column | None = None, most: int = LABELLED) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if the score is 0.5 or more) in place of columns so named."""
    scored, name = _scored(docs, labels, learns, most)
    score = F.col(name)
    own = [F.col(quoted(c)) for c in docs.columns if c not in ("score", "predicted")]
    return scored.select(*own, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents that never teaches."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = toxicity(docs.select("doc_id", "text"), labels, ~held_out(F.col("doc_id")))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under 0.5, columns as they are."""
    scored, score = _scored(docs, labels, ~held_out(F.col("doc_id")), LABELLED)
    return scored.filter(F.col(score) < 0.5).select(*map(quoted, docs.columns))
