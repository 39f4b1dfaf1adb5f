"""License scan by diagonal voting.

All rolling hashes of `GRAM` words of a document are joined by Spark to the
places that have them in the templates, and the words are compared. A vote belongs to the diagonal that is
the document's place minus the template's. A base phrase needs all its votes on one diagonal.
For the other templates diagonals are merged in bands: a band holds diagonals less than
2 * `DRIFT` apart, and two bands overlap, so words that are put in or missing, `DRIFT` in all,
leave a span's votes in one band; a text whose words are strewn or turned around has few in any. A span is
verified by the longest run of its votes that rises both in the document and in the template:
enough of the template must stand there in its order.

What is exploded is a place with its hash and words, never an array, so a long text takes time in proportion.
The templates are a fixed table of this module: a few hundred rows, broadcast.

Defined cases: NULL and empty texts have no words and no labels. Repeated rows
each get the same result. Of equal spans in two bands one counts. A very long text is a row of an array of its words.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.llm.words import KEY, same_key, with_key, words
from kartei.plans.storage import written

GRAM = 2
#: Words that may be missing or put in, in a whole span.
DRIFT = 3
#: Share of a template's rolling hashes that must be found in a span, in their order.
LEAST_SHARE = 0.8

# The phrases whose places are counted, and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Sentences of public licenses, and SPDX-like labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}


def _grams() -> Column:
    """gram (a hash) and gram_words for each `GRAM` consecutive entries of the column words."""

    def at(word: Column, i: Column) -> Column:
        text = F.concat_ws(" ", word, *(F.get(F.col("words"), i + j) for j in range(1, GRAM)))
        return F.struct(F.xxhash64(text).alias("gram"), text.alias("gram_words"))

    return F.slice(F.transform("words", at), F.lit(1), F.greatest(F.size("words") - (GRAM - 1), F.lit(0)))


def template_places(spark: SparkSession) -> DataFrame:
    """A row for each rolling hash of a template: phrase, label, base, n_grams, at, gram, and its words."""
    rows = [(phrase, label, base) for base, group in ((True, BASE), (False, TEMPLATES)) for phrase, label in group.items()]
    table = spark.createDataFrame(rows, "phrase string, label string, base boolean").withColumn("words", words(F.col("phrase")))
    table = table.withColumn("grams", _grams())
    table = table.select("phrase", "label", "base", F.size("grams").alias("n_grams"), F.posexplode_outer("grams").alias("at", "g"))
    return table.select("phrase", "label", "base", "n_grams", "at", "g.gram", "g.gram_words")


def votes(docs: DataFrame) -> DataFrame:
    """Stored rows: place -1 with n_words for each row of docs, and a row for each vote."""
    prepared = with_key(docs).withColumn("words", words(F.col("text"))).drop("text")
    # the entry at place -1 stands for the document itself: one pass gives documents and votes;
    # an outer explode, or a filter on the array's size is inferred, which computes it twice
    itself = F.array(F.struct(F.lit(None).cast("long").alias("gram"), F.lit(None).cast("string").alias("gram_words")))
    marked = prepared.select(*KEY, F.size("words").alias("n"), F.posexplode_outer(F.concat(itself, _grams())).alias("after", "mark"))
    marked = marked.select(*KEY, "n", "after", F.col("mark.gram").alias("mark"), F.col("mark.gram_words").alias("own_words"))
    places = template_places(docs.sparkSession)
    met = marked.join(F.broadcast(places), marked.mark == places.gram, "left")
    met = met.filter(F.col("mark").isNull() | (F.col("own_words") == F.col("gram_words")))
    place = (F.col("after") - 1).cast("long")
    n = F.when(F.col("mark").isNull(), F.col("n")).cast("long")
    return written(
        met.select(*KEY, place.alias("place"), n.alias("n_words"), "phrase", "label", "base", "n_grams", F.col("at").cast("long").alias("at")), "votes"
    )


def _longest_run(found: Column) -> Column:
    """The most votes (place, at) that rise strictly in both: for each length the smallest end of a run, vote by vote."""
    by_place = F.transform(F.array_sort(F.transform(found, lambda v: F.struct(v["place"].alias("place"), (-v["at"]).alias("back")))), lambda v: -v["back"])

    def with_vote(ends: Column, at: Column) -> Column:
        shorter = F.filter(ends, lambda e: e < at)
        return F.concat(shorter, F.array(at), F.slice(ends, F.size(shorter) + 2, F.size(ends)))

    return F.size(F.aggregate(by_place, F.array().cast("array<bigint>"), with_vote))


def spans(cast: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """Accepted spans of stored votes: key, label, base, first_word, last_word, share."""
    cast = cast.filter("place >= 0").drop("n_words").distinct().withColumn("diagonal", F.col("place") - F.col("at"))
    of_phrase = [*KEY, "phrase", "label", "base", "n_grams"]
    exact = cast.filter("base").groupBy(*of_phrase, "diagonal").agg(F.countDistinct("at").alias("n")).filter("n = n_grams")
    exact = exact.select(*KEY, "label", "base", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("n_grams")).alias("last_word"), F.lit(1.0).alias("share"))
    band = F.floor(F.col("diagonal") / DRIFT).cast("long")
    loose = cast.filter("NOT base").withColumn("band", F.explode(F.array(band, band - 1)))
    # a band holds votes of a template's length of places: the sets are bounded by the template
    loose = loose.groupBy(*of_phrase, "band").agg(
        F.collect_set(F.struct("place", "at")).alias("found"), F.min("place").alias("first_word"), (F.max("place") + GRAM - 1).alias("last_word")
    )
    loose = loose.filter(F.size("found") >= F.col("n_grams") * least_share)
    share = _longest_run(F.col("found")) / F.col("n_grams")
    merged = loose.select(*KEY, "label", "base", "first_word", "last_word", share.alias("share")).filter(F.col("share") >= least_share)
    return exact.union(merged.distinct())


def license_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word and last_word of base phrases, base_labels, labels, score."""
    cast = votes(docs)
    found = spans(cast)
    base = F.col("base")
    by_doc = found.groupBy(*KEY).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    documents = cast.filter("place = -1").select(*KEY, "n_words")
    out = documents.join(by_doc, same_key(documents, by_doc), "left")
    empty, none = F.lit(""), F.lit(0)
    return out.select(
        documents.doc_id, "n_words", F.coalesce("n_base", none).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", empty).alias("base_labels"), F.coalesce("labels", empty).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
