"""Words, word hashes and document keys as columns: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc_id", "text_hash"]


def folded(text: Column) -> Column:
    """The text with A-Z lowered, as one character per UTF-8 byte.

    Bytes from 0x80 on are shifted by `lower` in a way that can be undone, so two
    folded texts are equal exactly if the texts are equal up to the case of A-Z.
    This is several times as fast as `translate`. NULL is empty.
    """
    return F.lower(F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1"))


def words(text: Column) -> Column:
    """The runs of 0-9, a-z and non-ASCII characters of a text with A-Z lowered, folded."""
    return F.array_remove(F.split(folded(text), SEPARATORS), "")


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_hash: repeated rows share a key, rows without an id have one too.

    Other columns are left behind, so none of them can clash.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def unused(rows: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of rows has, whatever the case of its letters."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """The name of a column as an expression, also if it holds dots or backquotes."""
    return "`" + name.replace("`", "``") + "`"


def same_key(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of the keys; an equi-join all the same."""
    return left.doc_id.eqNullSafe(right.doc_id) & (left.text_hash == right.text_hash)


def ngram_hashes(hashes: str, k: int) -> Column:
    """A 64-bit hash for each k consecutive entries of an array column of hashes."""
    def at(x: Column, i: Column) -> Column:
        return F.xxhash64(F.lit(k), x, *(F.get(F.col(hashes), i + j) for j in range(1, k)))

    grams = F.transform(hashes, at)
    return F.slice(grams, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0)))
