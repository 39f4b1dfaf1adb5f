"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over eight bytes cuts texts where the content says so, so equal
passages are cut alike wherever they stand. The core of a chunk reaches from the
first to the last place in it where the tokenizer can not but begin a new word: a
space after an ASCII non-blank and before an ASCII letter. Cores depend on their own bytes only,
are encoded once in a task and reused by all documents there. What lies between two
cores is the join of two chunks, and is encoded again with its neighbours' edges,
from safe place to safe place, so the whole is exactly the encoding of the whole text.

Documents are dealt out by their smallest chunk hash, so copies meet in a task and
share their chunks. The bytes of each such group are counted first: a group of more than
`GROUP` bytes (of a `MOST_SPLIT`-th of all bytes, if that is more, so at most `MOST_SPLIT` groups
are and their table is small) is spread over as many tasks as its size asks for. The memory of
chunks is bounded and starts anew when it is full: that changes the work, not the result.

The vocabulary's path is a parameter; each Python worker loads it once. The merges
are made by a library that has the same vocabulary and merge ranks, which is
several times as fast as the one that defines the format (tests compare them).

Defined cases: a NULL text is empty and has no tokens. Repeated rows each give a
row, also those without doc_id. Special tokens that stand in a text are encoded as such. Other columns are
ignored. Long texts are whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.tasks import ready
from kartei.plans.storage import written

#: One cut in so many bytes, on average.
CHUNK = 1024
#: Groups of more bytes are spread over several tasks, the largest so many of them.
GROUP, MOST_SPLIT = 16 << 20, 10_000
#: A task remembers so many cores at most, and none of more bytes.
MOST_CORES, LONGEST_CORE = 16_384, 4_096
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Fixed value: how the tokenizer's format splits a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a byte-level BPE file; ids are the file's own."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        given = json.load(file)
    special = {x["content"]: x["id"] for x in given.get("added_tokens", [])}
    alphabet = _byte_alphabet()
    ids = {bytes(alphabet[c] for c in token): n for token, n in given["model"]["vocab"].items() if token not in special}
    # merges are tried in the order of the file, and a token's id grows with the rank of its merge
    return tiktoken.Encoding("kartei", pat_str=WORD_PATTERN, mergeable_ranks=ids, special_tokens=special)


def cuts(raw: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): chunk borders inside the text and the rolling hash at each."""
    if len(raw) <= 8:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    eights = np.ndarray((len(raw) - 7,), np.dtype("<u8"), np.ascontiguousarray(raw), 0, (1,)) * _MIX
    at = np.flatnonzero(eights < np.uint64((1 << 64) // chunk))
    return at + 8, eights[at]


def safe_places(raw: np.ndarray) -> np.ndarray:
    """Where a new word begins whatever stands before or after."""
    space = np.flatnonzero(raw[1:-1] == 0x20) + 1 if len(raw) > 2 else np.empty(0, np.int64)
    before, after = raw[space - 1], raw[space + 1] | 0x20
    return space[(before > 0x20) & (before < 0x7F) & (after >= 0x61) & (after <= 0x7A)]


def pieces(raw: np.ndarray, chunk: int = CHUNK) -> list[tuple[int, int, bool]]:
    """(from, to, is a core) in order; together they are the whole text."""
    places, safe = cuts(raw, chunk)[0], safe_places(raw)
    borders = np.concatenate(([0], places, [len(raw)]))
    # a place is safe by what the chunk itself holds, so its first and last byte do not count
    first = np.searchsorted(safe, borders[:-1] + 1)
    last = np.searchsorted(safe, borders[1:] - 1) - 1
    out, done = [], 0
    for i, j in zip(first.tolist(), last.tolist()):
        if i < j:
            begin, end = int(safe[i]), int(safe[j])
            if begin > done:
                out.append((done, begin, False))
            out.append((begin, end, True))
            done = end
    if done < len(raw):
        out.append((done, len(raw), False))
    return out


def encode(text: str, encode_part: Callable[[str], list[int]], memory: dict[bytes, bytes], chunk: int = CHUNK) -> bytes:
    """All token ids of a text, four bytes each; memory holds the cores met so far."""
    data = text.encode("utf-8", "replace")
    parts = []
    for begin, end, core in pieces(np.frombuffer(data, np.uint8), chunk):
        piece = data[begin:end]
        ids = memory.get(piece) if core else None
        if ids is None:
            ids = np.array(encode_part(piece.decode("utf-8")), "<u4").tobytes()
            if core and len(piece) <= LONGEST_CORE:
                if len(memory) >= MOST_CORES:
                    memory.clear()
                memory[piece] = ids
        parts.append(ids)
    return b"".join(parts)


def _encoder(vocabulary: str, chunk: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        memory: dict[bytes, bytes] = {}

        special = list(coder.special_tokens_set)

        def part(text: str) -> list[int]:
            if any(token in text for token in special):
                return coder.encode(text, allowed_special="all")
            return coder.encode_ordinary(text)

        for batch in parts:
            ids, decoded = [], []
            for text in batch.column(1).to_pylist():
                found = encode(text or "", part, memory, chunk)
                ids.append(found)
                decoded.append(coder.decode(np.frombuffer(found, "<u4").tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
            )

    return batches


def _digester(vocabulary: str, chunk: int):
    """As `_encoder`, but only counts and digests leave the worker."""
    encoded = _encoder(vocabulary, chunk)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encoded(x for whole in parts for x in _slices(whole)):
            ids, decoded = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return batches


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def _place(data: bytes, chunk: int) -> int:
    """Equal for copies, and for most texts that share passages: the smallest chunk hash, or that of a text without cuts."""
    hashes = cuts(np.frombuffer(data, np.uint8), chunk)[1]
    return int(hashes.min()) >> 1 if len(hashes) else xxhash.xxh64_intdigest(data) >> 1


def _places(chunk: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id and text with their place, and a number that tells rows apart which are alike in all else."""
        alike: Counter[int] = Counter()
        for batch in parts:
            for few in _slices(batch):
                places, numbers = [], []
                for doc_id, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                    data = (text or "").encode("utf-8", "replace")
                    places.append(_place(data, chunk))
                    # rows without an id are numbered among equal texts of the task, so a repeated task deals them alike
                    number = 0
                    if doc_id is None:
                        same = xxhash.xxh64_intdigest(data)
                        number = alike[same]
                        alike[same] += 1
                    numbers.append(number)
                columns = [few.column(0), few.column(1), pa.array(places, pa.int64()), pa.array(numbers, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "place", "number"])

    return batches


def _sizes(chunk: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for few in _slices(batch):
                data = [(text or "").encode("utf-8", "replace") for text in few.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_place(x, chunk) for x in data], pa.int64()), pa.array([len(x) + 1 for x in data], pa.int64())], ["place", "size"]
                )

    return batches


def _together(docs: DataFrame, chunk: int) -> DataFrame:
    """doc_id and text, with copies close to each other."""
    ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = slim.select("text").mapInArrow(_sizes(chunk), "place long, size long").groupBy("place").agg(F.sum("size").alias("size"))
    sizes = written(sizes, "bpe-groups")
    limit = max(GROUP, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // MOST_SPLIT))
    large = sizes.filter(F.col("size") > limit).select("place", F.ceil(F.col("size") / limit).alias("tasks"))
    marked = slim.mapInArrow(_places(chunk), "doc_id long, text string, place long, number long").join(F.broadcast(large), "place", "left")
    salt = F.pmod(F.xxhash64("doc_id", "number", "text"), F.coalesce("tasks", F.lit(1)))
    return marked.repartition("place", salt).select("doc_id", "text")


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text for each row of docs."""
    coder = _encoder(vocabulary or default_vocabulary(), chunk)
    return _together(docs, chunk).mapInArrow(coder, "doc_id long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coder = _digester(vocabulary or default_vocabulary(), chunk)
    return _together(docs, chunk).mapInArrow(coder, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
