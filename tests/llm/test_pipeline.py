"""The pipeline against brute force, and its stages on tables with clashing, NULL, empty and repeated entries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kartei.llm import decontaminate, line_dedup, simhash, toxicity
from tests.llm.test_simhash import model_bits, model_labels
from tests.llm.test_texts import LOWER, frame, rows_of, sha, words

CLASHING = ["_id", "_hash", "_n", "_kept", "_gone", "_gone_id", "_empty", "_bad_id", "_toxic_text", "n_lines", "n_dropped", "a.b", "score", "label", "component_id", "kept_id", "gone", "bad_id", "places", "toxic_text", "`x`"]
PROSE = "the river runs past an old mill where people bake bread and talk about rain or harvest under tall trees by water".split()
SHARED = "A line that many hold in common"
ITEM = " ".join(f"item{i}" for i in range(12))


def corpus():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choices(PROSE, k=n))
    rows = [(i, f"{prose(30)}\n{SHARED}\n{prose(20)}") for i in range(20)]
    rows += [(100 + i, f"{prose(12)} you stupid idiot {prose(12)}") for i in range(12)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + " end"), (202, f"{prose(9)} {ITEM} {prose(9)}"), (203, SHARED), (204, None), (205, ""), (206, rows[2][1]), (206, rows[2][1]), (None, rows[5][1]), (None, None), (None, "nobody knows this one here")]
    labels = [(i, 1, 0) for i in range(20)] + [(100 + i, 1, 1) for i in range(12)]
    return rows, labels, [(1, ITEM), (2, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items = corpus()
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def model_lines(rows):
    held = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        kept = "\n".join(x for x in (t or "").split("\n") if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i)
        if kept or not t:
            out.append((i, kept))
    return out


def model_copies(rows):
    best = {}
    for (i, t), m in zip(rows, model_labels([model_bits(t) for _, t in rows])):
        order = (i is None, i or 0)
        if m not in best or order < best[m][0]:
            best[m] = (order, (i, t))
    return [r for _, r in best.values()]


def model_clean(rows, items):
    grams = {tuple(words(t)[s : s + min(10, len(words(t)))]) for _, t in items if words(t) for s in range(len(words(t)) - min(10, len(words(t))) + 1)}
    return [(i, t) for i, t in rows if not any(tuple(words(t)[s : s + len(g)]) == g for g in grams for s in range(len(words(t))))]


def test_pipeline_equals_brute_force(spark, tables):
    from tokenizers import Tokenizer

    from kartei.llm import bpe

    rows, _, items = corpus()
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    toxic = {(r.doc_id, r.text) for r in toxicity.toxicity(docs, labels, ~toxicity.held_out(F.col("doc_id"))).filter("predicted = 1").collect()}
    assert {i for i, _ in toxic} == set(range(100, 112))
    left = model_clean(model_copies(model_lines([r for r in rows if r not in toxic])), items)
    coder = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, t in left:
        ids = coder.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(coder.decode(ids, skip_special_tokens=False))))
    got = corpus_pipeline.run(spark, tables)
    # of texts with one fingerprint any that has the smallest id may stay, so texts without an id are told by their number only
    assert sorted(rows_of(got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_carry_any_column(spark, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = docs.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING))
    got = stage(spark, odd, tables)
    assert got.columns == odd.columns and got.schema.simpleString() == odd.schema.simpleString()
    plain = rows_of(stage(spark, docs, tables))
    assert rows_of(got.select(*docs.columns)) == plain
    for row in got.select(*(F.col("`" + c.replace("`", "``") + "`") for c in CLASHING), "doc_id").collect():
        assert list(row)[:-1] == [f"{c} of {'none' if row.doc_id is None else row.doc_id}" for c in CLASHING]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("false")
    assert stage(spark, docs, tables).collect() == []


def test_a_text_of_very_many_dropped_lines(spark):
    text = "\n".join(f"this is line number {i}" for i in range(100_000))
    docs = frame(spark, [(1, text), (2, text + "\nand one more line"), (3, "x\n" * 100_000)])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(docs).collect()}
    assert got == {1: (100_000, 0, sha(text)), 2: (100_001, 100_000, sha("and one more line")), 3: (100_001, 0, sha("x\n" * 100_000))}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_a_document_that_is_one_long_item(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    text = " ".join(f"w{i}" for i in range(60_000))
    docs = frame(spark, [(1, text + " end"), (2, "w1 w2 w3"), (3, "x " + " ".join(f"w{i}" for i in range(50, 65)))])
    items = spark.createDataFrame([(1, text), (2, "w1 w2")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (60_001, 60_000, ["1", "2"]), 2: (3, 2, ["2"]), 3: (16, 15, ["1"])}


def test_one_of_each_in_a_large_group(spark):
    docs = frame(spark, [(i, "the same text for all of them") for i in range(3_000, 0, -1)] + [(None, "the same text for all of them")])
    assert [r.doc_id for r in simhash.one_of_each(docs).collect()] == [1]


def test_near_duplicates_stage_broadcasts_no_exploded_table(spark, tables, monkeypatch):
    frames, real = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda frame, name: frames.append((name, frame)) or real(frame, name))
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, tables).count() > 0
    plans = [(name, frame._jdf.queryExecution().executedPlan().toString()) for name, frame in frames]
    exploded = [name for name, plan in plans if "Generate" in plan]
    assert exploded == ["variants"]
    assert [name for name, plan in plans if "Generate" in plan and "Broadcast" in plan] == []
