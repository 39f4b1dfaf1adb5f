"""Token counts of a unigram vocabulary without building tokens.

Aho-Corasick enumerates all vocabulary pieces in a text, by their ends; a Viterbi
pass carries the best score and the number of pieces of the best path. The tie
rules are those of the unigram tokenizer: paths are extended from left to right and
replaced by strictly better ones only, so of equal paths the longest last piece
stays; a character that no piece of its own covers costs the smallest score less
10 and is counted by its bytes if the vocabulary has them, or else
runs of such characters count once.

Where no piece of the vocabulary holds the two characters on both sides, texts may
be cut without any change in a sum, if all scores are whole numbers. `Counter` checks this for
the places before blanks, at line feeds, and between a letter and `SIGNS`, and then each worker
remembers the counts of the last `REMEMBERED` words.

Defined cases: NULL and empty texts have no tokens. Repeated rows each get a row.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.tasks import ready

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000
#: Signs that may be cut off the end of a word.
SIGNS = ".,;:!?|%&*#$()"
_WORDS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(vocabulary: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def normalized(text: str) -> str:
    """Blanks made visible, with one in front of the text."""
    return (BLANK + text.replace(" ", BLANK)) if text else ""


class Counter:
    """Counts the pieces of best paths under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.by_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # whatever would be cut
        self.separable = (
            all(s == int(s) for _, s in pieces)
            and all(len(_WORDS.findall(piece)) == 1 for piece in names - {""})
            and not any(a.isalpha() and b in SIGNS for piece in names for a, b in zip(piece, piece[1:]))
        )
        self.of_bare = lru_cache(maxsize=REMEMBERED // 2)(lambda word: self.best(word)[0])
        self.of_word = lru_cache(maxsize=REMEMBERED // 2)(self.word)

    def best(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path through a normalised text."""
        size = len(text)
        scores, counts, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        # of the paths that end after `now`: the best score, where its last piece begins, and if a piece covers the character alone
        now, best, begin, alone = 0, None, 0, False

        def close(end: int) -> None:
            candidate = self.unknown + scores[end]
            if not alone and (best is None or candidate > best):
                more = len(text[end].encode("utf-8", "replace")) if self.by_bytes else int(not unknown[end])
                scores[end + 1], counts[end + 1], unknown[end + 1] = candidate, counts[end] + more, True
            else:
                scores[end + 1], counts[end + 1] = best, counts[begin] + 1

        # by ends, and the longest piece of each end first
        for end, (length, score) in self.automaton.iter(text):
            while now != end:
                if alone:
                    scores[now + 1], counts[now + 1] = best, counts[begin] + 1
                else:
                    close(now)
                now, best, alone = now + 1, None, False
            first = end + 1 - length
            candidate = score + scores[first]
            if best is None or candidate > best:
                best, begin = candidate, first
            if length == 1:
                alone = True
        while now < size:
            close(now)
            now, best, alone = now + 1, None, False
        return counts[size], scores[size]

    def word(self, word: str) -> int:
        """The pieces of a word; signs at its end are counted by themselves."""
        bare = word.rstrip(SIGNS)
        if bare != word and bare and bare[-1].isalpha():
            return self.of_bare(bare) + self.of_bare(word[len(bare) :])
        return self.of_bare(word)

    def count(self, text: str | None) -> int:
        given = normalized(text or "")
        if not (self.separable and self.by_bytes):  # without bytes a run of unknown characters may reach over a cut
            return self.best(given)[0]
        return sum(map(self.of_word, _WORDS.findall(given)))


@lru_cache(maxsize=1)
def counter_of(vocabulary: str) -> Counter:
    """One for each Python worker, with what it remembers."""
    return Counter(pieces_of(vocabulary))


def _counting(vocabulary: str):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in parts:
            counts = [counter.count(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return batches


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens for each row of docs."""
    ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_counting(vocabulary or default_vocabulary()), "doc_id long, n_tokens long")
