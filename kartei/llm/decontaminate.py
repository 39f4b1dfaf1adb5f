"""Benchmark decontamination by winnowing.

Native: built-in functions only. Every window of `WINDOW` words holds
`WINDOW - GRAM + 1` rolling hashes of `GRAM` words; the smallest is the window's
fingerprint, so a passage of `WINDOW` words that a document shares with an item
gives both the same fingerprint, always. The join finds the places of documents whose
fingerprint an item has; the documents with such places are read again, and the words of each
place are compared with the item's windows, so hits reach over the whole shared span.

What is exploded is a place and its hash, never an array, and each document's places are
then one row: the work on a document grows with its length, also if all of it is shared.

Items of fewer than `WINDOW` words are one window each. The guarantee does not
reach them, so for each length that occurs (nine at most) the hashes of all
document runs of that length are fingerprints.

The item fingerprints are broadcast only if they are counted and at most
`MOST_BROADCAST`. Otherwise each document's different fingerprints are shuffled to them first,
and places are looked for in the documents with any. The keys of documents with places are
broadcast under the same condition, else joined by a shuffle.

Defined cases: NULL or empty texts have no words and no hits. Repeated rows of documents each
get the same result; windows that repeat in an item, in items or in a document count once at each place.
Items without an id are searched for but not named. A very long document or item is
a row of arrays in proportion to its length, its windows about ten times its text if all
of it is hit. Items' ids that sort alike as strings keep that order. Without documents there are no rows,
without items no hits. Other columns are carried along by `without_contaminated`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kartei.llm.words import KEY, ngram_hashes, same_key, unused, with_key, words
from kartei.plans.storage import written

WINDOW = 10
GRAM = 5
#: Rows of 24 bytes: 24 MB.
MOST_BROADCAST = 1_000_000


def _at_length(length: int) -> str:
    return f"runs_{length}"


def _runs(length: int) -> Column:
    """Hashes of so many words; with other seeds than the grams', so that lengths never meet."""
    return F.transform("hashes", lambda x, i: F.xxhash64(F.lit(-length), x, *(F.get(F.col("hashes"), i + j) for j in range(1, length))))


def _with_windows(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds words, n_words and for each length the fingerprint of the window that starts at each word."""
    out = texts.withColumn("words", words(F.col("text"))).drop("text")
    out = out.withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.withColumn("grams", ngram_hashes("hashes", GRAM))
    width = WINDOW - GRAM + 1

    def smallest(x: Column, i: Column) -> Column:
        return F.least(x, *(F.get(F.col("grams"), i + j) for j in range(1, width)))

    minima = F.slice(F.transform("grams", smallest), F.lit(1), F.greatest(F.size("grams") - (width - 1), F.lit(0)))
    out = out.withColumn(_at_length(WINDOW), minima)
    for length in lengths:
        runs = F.slice(_runs(length), F.lit(1), F.greatest(F.size("hashes") - (length - 1), F.lit(0)))
        out = out.withColumn(_at_length(length), runs)
    return out.drop("hashes", "grams")


def _window_text(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", start + 1, length), " ")


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, length, window (its words) and fingerprint: one row for each different window of an item."""
    prepared = _with_windows(items.select("item_id", "text"), [])
    # the window's words are made before the explode, which would copy all words to each row; an outer
    # explode, or a filter on the array's size is inferred, which computes everything twice
    windows = F.transform(_at_length(WINDOW), lambda x, i: F.struct(_window_text(i, F.lit(WINDOW)).alias("window"), x.alias("fingerprint")))
    long = prepared.select("item_id", F.lit(WINDOW).alias("length"), F.explode_outer(windows).alias("w"))
    long = long.select("item_id", "length", "w.window", "w.fingerprint").filter("window IS NOT NULL")
    n = F.size("words")
    plain = items.select("item_id", "text").withColumn("words", words(F.col("text")))
    short = plain.filter((n > 0) & (n < WINDOW))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    one = F.lit(None).cast("long")
    for length in range(1, WINDOW):
        one = F.when(n == length, F.xxhash64(F.lit(-length), *(F.get(hashes, F.lit(j)) for j in range(length)))).otherwise(one)
    short = short.select("item_id", n.alias("length"), F.array_join("words", " ").alias("window"), one.alias("fingerprint"))
    return long.union(short).distinct()


def _fingerprints(lengths: list[int]) -> Column:
    return F.concat(*(F.col(_at_length(n)) for n in [WINDOW, *lengths]))


def _places(prepared: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """Place -1 for each row of prepared, and a row for each place whose fingerprint is wanted: KEY, n_words, start, length."""
    # NULL marks the document itself: one pass gives documents and places. An outer explode of an array that
    # is never empty: from others a filter on their size is inferred, which computes the arrays twice.
    marks = F.posexplode_outer(F.concat(F.array(F.lit(None).cast("long")), _fingerprints(lengths))).alias("at", "mark")
    marked = prepared.select(*KEY, "n_words", marks)
    found = marked.join(wanted, marked.mark == wanted.fingerprint, "left").filter("mark IS NULL OR length IS NOT NULL")
    # which length and start an entry stands for follows from the number of words
    start, own, before = F.col("at") - 1, F.lit(WINDOW), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0))
    for length in lengths:
        here = F.col("at") - 1 >= before
        start, own = F.when(here, F.col("at") - 1 - before).otherwise(start), F.when(here, length).otherwise(own)
        before = before + F.greatest(F.col("n_words") - (length - 1), F.lit(0))
    is_document = F.col("mark").isNull()
    placed = found.select(*KEY, "n_words", F.when(is_document, F.lit(-1)).otherwise(start).cast("int").alias("start"), own.alias("own"), "length")
    return placed.filter("start = -1 OR own = length").select(*KEY, "n_words", "start", "length")


def find_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, hits).

    documents: doc_id, text_hash, n_words, a row for each row of docs.
    hits: doc_id, text_hash, start, length, window for each place of an item's window,
    once for each key.
    """
    windows = written(item_windows(items), "item-windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect() if r.length < WINDOW)
    wanted = windows.select("fingerprint", "length").distinct()
    few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    keyed = with_key(docs)
    if few:
        places = written(_places(_with_windows(keyed, lengths), F.broadcast(wanted), lengths), "places")
        documents = places.filter("start = -1").select(*KEY, "n_words")
    else:
        prepared = _with_windows(keyed, lengths)
        once = F.array_distinct(F.concat(F.array(F.lit(None).cast("long")), _fingerprints(lengths)))
        marked = prepared.select(*KEY, "n_words", F.explode_outer(once).alias("mark"))
        marked = marked.join(wanted.select("fingerprint").distinct(), F.col("mark") == F.col("fingerprint"), "left")
        marked = written(marked.filter("mark IS NULL OR fingerprint IS NOT NULL").select(*KEY, "n_words", "mark"), "marks")
        documents = marked.filter("mark IS NULL").select(*KEY, "n_words")
        met = marked.filter("mark IS NOT NULL").select(*KEY).distinct()
        places = written(_places(_with_windows(_of_keys(keyed, met), lengths), wanted, lengths), "places")
    starts = places.filter("start >= 0").groupBy(*KEY).agg(F.collect_set(F.struct("start", "length")).alias("places"))
    starts = written(starts, "starts")
    return documents, _verified(_of_keys(keyed, starts), windows)


def _of_keys(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that rows has keys of, with the other columns of rows; rows are broadcast if they are few."""
    few = rows.select(*KEY).limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    keys = rows.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    held = keyed.join(F.broadcast(keys) if few else keys, same, "left_semi")
    if rows.columns == KEY:
        return held
    others = rows.withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"})
    return held.join(others, same).drop("of_id", "of_hash")


def _verified(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """Of documents with their places: those places whose words are an item's window, once for each key."""
    known = placed.withColumn("words", words(F.col("text"))).drop("text")
    # every place is inside; what is used twice is not moved into the lambda and found anew for each place
    window = lambda p: F.when(p["start"] < F.size("words"), _window_text(p["start"], p["length"]))
    texts = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), window(p).alias("window")))
    hits = known.select(*KEY, F.explode_outer(texts).alias("t")).select(*KEY, "t.start", "t.length", "t.window")
    hits = hits.filter("window IS NOT NULL").distinct()
    return hits.join(windows.select("window").distinct(), "window", "left_semi").select(*KEY, "start", "length", "window")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted as strings)."""
    documents, hits = find_windows(docs, items)
    by_start = Window.partitionBy(*KEY).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    before = F.coalesce(F.max(end).over(by_start), F.lit(0))
    covered = F.greatest(end - F.greatest(F.col("start"), before), F.lit(0))
    n_hit = hits.select(*KEY, covered.alias("new")).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    windows = item_windows(items).select("window", "item_id").distinct()
    named = hits.select(*KEY, "window").distinct().join(windows, "window").groupBy(*KEY, "item_id").agg(F.lit(1).alias("one"))
    named = named.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    found = n_hit.join(named, same_key(n_hit, named), "left").select(n_hit.doc_id, n_hit.text_hash, "n_hit", "item_ids")
    out = documents.join(found, same_key(documents, found), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        documents.doc_id, documents.text_hash, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids")
    )


def contamination_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, the SHA-256 of the item ids, contaminated."""
    found = contamination(docs, items)
    joined = F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", joined.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of any item, columns as they are."""
    _, hits = find_windows(docs, items)
    id_, hash_ = unused(docs, "bad_id", "bad_hash")
    bad = hits.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    return docs.join(bad, same, "left_anti")
