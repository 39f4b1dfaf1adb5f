"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble.

Native: built-in functions only. Lines are exploded with their places and hashed once; what
is stored and shuffled per line is two hashes, its place and the key of its document, never its text.
Counting combines before the shuffle, so a line that stands in a third of all documents
costs each task one row. The places of the lines that go are joined back to their document, which is put
together once from the places that stay.

Defined cases: a NULL or empty text is one empty line. Rows with the same doc_id
are one document. Rows without a doc_id count for nothing and keep their lines. A
line that repeats within one document only is kept. A NULL text becomes an empty one.
A very long text takes time and memory in proportion to its lines. The smallest doc_id keeps a line, so
there are no ties. An empty table gives no rows. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.llm.words import KEY, folded, quoted, unused, with_key
from kartei.plans.storage import written

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Lines with shorter keys are never dropped.
LEAST_LENGTH = 10
#: Documents that must hold a line before it is dropped.
LEAST_DOCUMENTS = 2


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(line: Column, least_length: int) -> Column:
    """128 bits of a line's key, NULL if it is too short to be dropped.

    Keys are stripped before they are folded, as folding turns a character into bytes.
    """
    bare = F.btrim(line, F.lit(BLANKS))
    key = folded(bare)
    return F.when(
        F.length(bare) >= least_length,
        F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")),
    )


def line_keys(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, text_hash, place (from 0), h1, h2: a row for each line that may be dropped."""
    keys = F.transform(lines(F.col("text")), lambda x: _hashes(x, least_length))
    # an outer explode, or a filter on the array's size is inferred, which computes the keys twice
    held = with_key(docs).select(*KEY, F.posexplode_outer(keys).alias("place", "k")).select(*KEY, "place", "k.h1", "k.h2")
    return held.filter("h1 IS NOT NULL AND doc_id IS NOT NULL")


def repeated_lines(held: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """h1, h2 and keeper (the smallest doc_id) of every line key that is found in enough documents."""
    if least_documents == 2:
        # two different documents hold it exactly if the smallest id is not the largest
        found = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        return found.filter("keeper < last").drop("last")
    found = held.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2")
    return found.agg(F.min("doc_id").alias("keeper"), F.count("one").alias("n")).filter(F.col("n") >= least_documents).drop("n")


def _deduplicated(docs: DataFrame, least_length: int, least_documents: int, kept: str, n_lines: str, n_dropped: str) -> DataFrame:
    """docs with three more columns: the text that stays, the number of lines, and how many of them go."""
    held = written(line_keys(docs, least_length), "line-keys")
    # stored, so that the join below shuffles both sides and a line of very many documents can be split
    twice = written(repeated_lines(held, least_documents), "repeated-lines")
    id_, hash_, gone, parts, left = unused(docs, "gone_id", "gone_hash", "gone", "parts", "left")
    places = held.join(twice, ["h1", "h2"]).filter("doc_id > keeper").groupBy(*KEY).agg(F.collect_set("place").alias(gone))
    places = places.withColumnsRenamed({"doc_id": id_, "text_hash": hash_})
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    joined = docs.join(places, same, "left").withColumn(parts, lines(F.col("text")))
    n = F.size(parts)
    # the places that stay, as a difference of sets, so that a text of very many lines takes time in proportion
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col(gone))
    joined = joined.withColumn(left, F.when(F.col(gone).isNull(), F.lit(None)).otherwise(stay))
    # asked for twice, or the lines are split anew for each of them
    rebuilt = F.array_join(F.transform(left, lambda i: F.when(i < n, F.get(parts, i))), "\n")
    text = F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(rebuilt)
    return joined.select(
        *map(quoted, docs.columns), text.alias(kept), n.cast("long").alias(n_lines), F.coalesce(n - F.size(left), F.lit(0)).cast("long").alias(n_dropped)
    )


def drop_repeated_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Every row of docs with its other columns: text without repeated lines, n_lines before, n_dropped (in place of columns so named)."""
    kept, n_lines, n_dropped = unused(docs, "kept", "n_lines", "n_dropped")
    found = _deduplicated(docs, least_length, least_documents, kept, n_lines, n_dropped)
    columns = [F.col(kept).alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return found.select(*columns, F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))



def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that stay as text; n_chars, if there, is counted anew.

    Documents that lose all their text go. Those that had none stay as they are.
    """
    kept, n_lines, n_dropped = unused(docs, "kept", "n_lines", "n_dropped")
    found = _deduplicated(docs, LEAST_LENGTH, LEAST_DOCUMENTS, kept, n_lines, n_dropped)
    found = found.filter((F.coalesce(F.length("text"), F.lit(0)) == 0) | (F.length(kept) > 0))
    own = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length(kept).cast(docs.schema["n_chars"].dataType)
    return found.select(*(own.get(c, F.col(quoted(c))).alias(c) for c in docs.columns))
