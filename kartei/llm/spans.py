"""Words of UTF-8 bytes, found by one table-driven pass, and their 64-bit hashes: arrays, no loop over words.

The table gives each byte its kinds. The transducer has two states, inside and outside a
word; a byte alone decides the next one, so a whole block of bytes steps at once, and the
state that a block ends in is carried to the next. It puts out the place of each change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WORD, CAPITAL, FIRST, SIGN = 1, 2, 4, 8
#: Bytes that step at once.
BLOCK = 1 << 20
#: Words of more bytes are hashed and compared one by one.
LONG = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _kinds() -> np.ndarray:
    """The kinds of each byte: in a word, A-Z, first of a code point, one of #$%&*|."""
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        blank = byte == 0x20 or 0x09 <= byte <= 0x0D
        table[byte] = (
            WORD * (not blank)
            | CAPITAL * (0x41 <= byte <= 0x5A)
            | FIRST * (byte & 0xC0 != 0x80)
            | SIGN * (byte in b"#$%&*|")
        )
    return table


KINDS = _kinds()


@dataclass
class Words:
    """The words of several texts in one buffer; a blank follows each text."""

    raw: np.ndarray
    borders: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    #: For each text how many bytes of it and of the blank after it are of the kinds asked for.
    counts: dict[int, np.ndarray]

    @property
    def owners(self) -> np.ndarray:
        """The text that each word is in."""
        return np.searchsorted(self.borders, self.starts, side="right") - 1

    def hashes(self) -> np.ndarray:
        return _hashes(self.raw, self.starts, self.lengths)


def words_of(texts: list[bytes], counted: tuple[int, ...] = ()) -> Words:
    joined = b" ".join(texts) + b" " * 9
    raw = np.frombuffer(joined, np.uint8)
    borders = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))[: len(texts)]
    edges, totals = [], {kind: np.zeros(len(texts), np.int64) for kind in counted}
    inside = False
    for first in range(0, len(raw), BLOCK):
        kinds = KINDS[raw[first : first + BLOCK]]
        word = (kinds & WORD) != 0
        change = np.flatnonzero(word[1:] != word[:-1]) + (first + 1)
        edges.append(change if word[0] == inside else np.concatenate(([first], change)))
        inside = bool(word[-1])
        if counted and first < len(raw) - 8:
            low = int(np.searchsorted(borders, first, side="right")) - 1
            here = borders[low : int(np.searchsorted(borders, first + len(kinds), side="left"))]
            at = np.maximum(here - first, 0)
            for kind in counted:
                # the last eight blanks are there for reading eight bytes at a time
                totals[kind][low : low + len(here)] += np.add.reduceat((kinds[: len(raw) - 8 - first] & kind) != 0, at, dtype=np.int64)
    both = np.concatenate(edges) if edges else np.empty(0, np.int64)
    starts, ends = both[0::2], both[1::2]
    return Words(raw, borders, starts, ends - starts, totals)


def mixed(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One step of hashing; for a given h no two values give the same."""
    h = (h ^ value) * _MIX
    return h ^ (h >> np.uint64(29))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw, 0, (1,))


def _hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    import xxhash

    h = mixed(lengths.astype(np.uint64), np.uint64(1))
    if not len(h):
        return h
    eights = _eights(raw)
    live, done = np.flatnonzero(lengths <= LONG), 0
    while len(live):
        some = eights[starts[live] + done] & _MASKS[np.minimum(lengths[live] - done, 8)]
        h[live] = mixed(h[live], some)
        done += 8
        live = live[lengths[live] > done]
    for i in np.flatnonzero(lengths > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lengths[i]].tobytes())
    return mixed(h, np.uint64(0))


def _equal(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b, of equal lengths, have the same bytes."""
    same = np.ones(len(a), bool)
    starts, lengths = words.starts, words.lengths[a]
    eights = _eights(words.raw)
    live, done = np.flatnonzero(lengths <= LONG), 0
    while len(live):
        differ = (eights[starts[a[live]] + done] ^ eights[starts[b[live]] + done]) & _MASKS[np.minimum(lengths[live] - done, 8)]
        same[live[differ != 0]] = False
        done += 8
        live = live[(lengths[live] > done) & (differ == 0)]
    for i in np.flatnonzero(lengths > LONG).tolist():
        x, y, n = starts[a[i]], starts[b[i]], lengths[i]
        same[i] = words.raw[x : x + n].tobytes() == words.raw[y : y + n].tobytes()
    return same


def count_distinct(words: Words) -> np.ndarray:
    """How many different words each text has, by a hash table of word spans.

    All spans are put in at once: each claims its slot if that is free, is done if the
    span there has the same text and bytes, and goes on to the next slot if not. A span
    counts as the same only after its bytes were compared.
    """
    owners, h = words.owners, words.hashes()
    key = mixed(h, owners.astype(np.uint64))
    bits = max(4, int(2 * len(h)).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    slots = (key >> np.uint64(64 - bits)).astype(np.int64)
    counts = np.zeros(len(words.borders), np.int64)
    pending = np.arange(len(h))
    while len(pending):
        at = slots[pending]
        free = table[at] < 0
        table[at[free]] = pending[free]
        holder = table[at]
        fresh = holder == pending
        counts += np.bincount(owners[pending[fresh]], minlength=len(counts))
        alike = ~fresh & (key[holder] == key[pending]) & (owners[holder] == owners[pending]) & (words.lengths[holder] == words.lengths[pending])
        where = np.flatnonzero(alike)
        alike[where] = _equal(words, pending[where], holder[where])
        pending = pending[~(fresh | alike)]
        slots[pending] = (slots[pending] + 1) & ((1 << bits) - 1)
    return counts


def slices(sizes: list[int], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of about so many bytes; a longer text is a slice of its own."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
