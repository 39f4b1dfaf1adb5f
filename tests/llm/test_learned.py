"""Toxicity, language and quality: brute force of their parts, accuracy on rows held out, and odd tables."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kartei.llm import language, quality, toxicity

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, toxic int"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_restore_finds_the_best_path():
    rng = np.random.default_rng(1)
    model = np.log(rng.dirichlet(np.ones(28), (28, 28)))

    def score(word, cost):
        x, y, total = 0, 0, -cost
        for letter in word:
            z = toxicity._symbol(letter)
            total += model[x, y, z]
            x, y = y, z
        return total + model[x, y, 0]

    for token in ("1d10t", "l.o.s.e.r", "looooser", "a", "$c|_|m", "ooo00", "3.3.3"):
        ways = [(score("".join(p[0] for p in path), sum(p[1] for p in path)), "".join(p[0] for p in path)) for path in itertools.product(*toxicity._lattice(token))]
        assert max(ways)[0] == pytest.approx(score_of(ways, toxicity.restore(token, model)))


def score_of(ways, word):
    return max(s for s, w in ways if w == word)


def test_disguises_are_found():
    found = {t: toxicity.disguised(t.encode()) for t in ("an 1d10t here", "so l.o.s.e.r", "i d i o t", "the l o s e r, is", "a looooser", "THE!! END,!!", "plain words.", "", "ééé")}
    assert found == {"an 1d10t here": {"1d10t"}, "so l.o.s.e.r": {"l.o.s.e.r"}, "i d i o t": {"idiot"}, "the l o s e r, is": {"loser"}, "a looooser": {"looooser"}, "THE!! END,!!": set(), "plain words.": set(), "": set(), "ééé": {"ééé"}}


def test_toxicity_of_disguised_words(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=40)
        if i % 4 == 0:
            words.insert(rng.randrange(40), rng.choice(["idiot", "loser"]))
        rows.append((i, " ".join(words), "xx", "s", 9))
        labels.append((i, int(i % 4 == 0), "t"))
    base = " ".join(plain[:20])
    odd = [(900, base + " 1d10t"), (901, base + " l.o.s.e.r"), (902, base + " i d i o t"), (903, base + " looooser"), (904, base), (905, None), (906, ""), (906, ""), (None, base + " idiot"), (907, (base + " ") * 2000)]
    docs = spark.createDataFrame(rows + [(*r, "xx", "s", 9) for r in odd], DOCS)
    marks = spark.createDataFrame([*labels, (None, 1, "t"), (5_000, 1, "t"), (904, None, "t")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_scores(docs, marks).collect()
    assert len(got) == 410 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.predicted for r in got}
    assert [by_id[i] for i in (900, 901, 902, 903, 904, 905, 906, None, 907)] == [1, 1, 1, 1, 0, 0, 0, 1, 0]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.filter("score <> 's' OR toxic <> 9").count() == 0


def test_language_on_rows_held_out(spark):
    docs = table(spark, "documents")
    got = language.language_digests(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_language_counts_equal_model():
    slots = np.zeros((1, language.SLOTS), np.uint64)
    texts = ["The cat", "le chat", None, "12 34", "", "é", "x" * 100]
    for bit, known in enumerate(("the cat", "le chat")):
        for _, _, grams in language.blocks([known]):
            for s in language.slot_numbers(grams[grams != language.BLANKS]):
                slots[0][s] |= np.uint64(1 << bit)
    model = language.Filter(["en", "fr"], slots, 0)
    n, hits = model.hits(texts)
    assert hits[0, 0] == n[0] and hits[1, 1] == n[1] and hits[0, 1] < n[0]
    langs, scores = model.predict(texts)
    assert langs == ["en", "fr", "und", "und", "und", "en", "en"] and all(0 <= s <= 1 for s in scores)


def test_quality_on_rows_held_out(spark):
    labels = table(spark, "labels")
    got = quality.quality_grades(table(spark, "documents"), labels).join(labels, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("selected") == (F.col("quality") > 0)).cast("int"))).first()[0]
    assert right > 0.9
    assert got.filter("expected_grade < 0 OR expected_grade > 2 OR tail < 0 OR tail > 1").count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 300)
    model = quality.fit_ordinal(grades, np.arange(300), grades + 10, np.ones(300))
    tails = model.tails(model.weights[[10, 11, 12]]).sum(axis=1)
    assert tails[0] < 0.4 < 0.7 < tails[1] < 1.3 < 1.6 < tails[2] and model.thresholds[0] < model.thresholds[1]


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "some words", None, "s", 1), (2, None, None, "s", 1)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, labels).collect() == quality.quality_grades(docs, labels).collect() == language.language_digests(docs).collect() == []
    assert [r.predicted for r in toxicity.toxicity_scores(some, labels).collect()] == [0, 0]
    assert {r.lang_pred for r in language.language_digests(some).collect()} == {"und"}
    assert [0 <= r.tail <= 1 for r in quality.quality_grades(some, labels).collect()] == [True, True]


def test_pipeline_keeps_what_each_stage_says(spark):
    docs = table(spark, "documents")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        if name != "bpe":
            assert after.columns == docs.columns
        rows[name] = after.count()
        docs = after
    assert rows["bpe"] == rows["decontamination"] == docs.select("doc_id").distinct().count()
    assert 0 < rows["decontamination"] < rows["near_duplicates"] <= rows["line_dedup"] <= rows["toxicity"] < 1000
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, docs.collect()))


def test_quality_scores_equal_the_sum_of_features():
    rng = np.random.default_rng(5)
    weights = rng.normal(size=quality.SPACE + quality.WHOLE * quality.STEPS)
    texts = [None, "", " ", "One two two", "LOUD!!! %%% $$$ 123 123", "é ñ ß", "x" * 50, "word& " * 30_000, "0123456789" * 10]
    got = quality.Model(weights, np.zeros(2)).scores(texts)
    for text, score in zip(texts, got):
        assert score == pytest.approx(sum(weights[place] * value for place, value in quality.features(text).items()))


def test_quality_steps_tell_junk_apart():
    plain, signs, loud = (quality._steps(x) for x in ("Some words here.", "Some&&& words*** here###", "SOME WORDS HERE."))
    assert plain != signs and plain != loud and signs != loud
    assert all(len(x) == quality.WHOLE for x in (plain, signs, loud, quality._steps(None)))
    assert all(i * quality.STEPS <= place - quality.SPACE < (i + 1) * quality.STEPS for x in (plain, signs, loud) for i, place in enumerate(x))


def test_beginnings_count_up_to_three_different_words():
    words = toxicity.text_words("abcdex abcdey abcdez abcdew abcdex short", lambda token: token)
    assert {b"abcd-", b"abcd--", b"abcd---", b"abcde---", b"shor-"} <= words
    assert not {b"abcd----", b"shor--", b"short-"} & words
    assert toxicity.text_words(None, str) == toxicity.text_words("", str) == set()


def test_a_word_of_toxic_rows_only_decides_alone():
    y = np.array([1.0] * 30 + [0.0] * 270)
    rows = np.concatenate([np.arange(30), np.arange(30), np.arange(30, 40)])
    cols = np.array([0] * 30 + [1] * 30 + [1] * 10)
    bias, weights = toxicity._regression(y, rows, cols, 3)
    assert bias + weights[0] > 0 > bias and weights[2] == 0 and (weights >= 0).all()


def test_disguises_at_ends_over_gaps_and_beyond_ascii():
    cases = {"an idio+ is": {"idio+"}, "oh shi+, no": {"shi+"}, "a-$-$": {"a-$-$"}, "b l ö d": {"blöd"}, "i.d!ot": {"i.d!ot"}, "loOooser": {"looooser"}, "1di€t": {"1di€t"}, "d·u·m·m": {"d·u·m·m"}, "x\u00a01d10t\u3000y": {"1d10t"}, "«no» 5€ done! BLÖD": set()}
    assert {t: toxicity.disguised(t.encode()) for t in cases} == cases
    model = np.full((28, 28, 28), -3.0)
    assert [toxicity.restore(x, model) for x in ("idio+", "a-$-$", "id·i€t")] == ["idiot", "ass", "idiet"]
    assert toxicity.plain_words("“Blöd” BLÖD «x1y» d\u0308".encode()) == {"blöd".encode(), b"x", b"y", "d\u0308".encode()}


def counted_model(text):
    batch = pa.RecordBatch.from_pydict({"text": [text]})
    got = next(toxicity._count_trigrams(iter([batch])))
    table = np.full(28**3, 0.01)
    table[got.column(0).to_numpy()] += got.column(1).to_numpy()
    table = table.reshape(28, 28, 28)
    return np.log(table / table.sum(axis=2, keepdims=True))


def test_long_disguises_give_their_single_words():
    text = "you are an idiot and nobody here will ever want to hear what you have to say again"
    restored = toxicity._remembering(counted_model((text + " ") * 50))
    for many in (1, 3, 40):
        assert set(text.encode().split()) <= toxicity.text_words(" ".join((text * many).replace(" ", "")), restored)
    for token in ("idi" + "o" * 500 + "t", "word/" * 30 + "1d10t", "/".join(["1d10t", "x" * 90]), "youarean1d10tandnobodyherewilleverwanttohear", "傻" * 50 + "1d10t" + "傻" * 50):
        assert b"idiot" in toxicity.text_words("so " + token + ", no", restored), token


def test_borders_are_the_best_path():
    rng = np.random.default_rng(2)
    model = np.log(rng.dirichlet(np.ones(28), (28, 28)))
    for token in ("1d10t", "l.o!", "aab", "aaab", "$aaaaa"):
        paths = {}
        for path in itertools.product(*toxicity._lattice(token, True)):
            for blanks in itertools.product(("", " "), repeat=len(path) - 1):
                word = path[0][0] + "".join(b + p[0] for b, p in zip(blanks, path[1:]))
                if "  " in word or word[:1] == " ":
                    continue
                x, y, total = 0, 0, -sum(p[1] for p in path)
                for letter in word + " ":
                    total += model[x, y, toxicity._symbol(letter)]
                    x, y = y, toxicity._symbol(letter)
                paths[word] = max(total, paths.get(word, -np.inf))
        assert paths[toxicity.restore(token, model, True)] == pytest.approx(max(paths.values()))


def test_settled_beginnings_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    model = np.log(rng.dirichlet(np.ones(28), (28, 28)))
    tokens = ["".join(rng.choice(list("ab1|!o0+.$"), 200)) for _ in range(5)]
    got = [toxicity.restore(x, model, borders) for x in tokens for borders in (False, True)]
    monkeypatch.setattr(toxicity, "SETTLED", 10**9)
    assert got == [toxicity.restore(x, model, borders) for x in tokens for borders in (False, True)]


def test_quality_learns_from_all_features_of_a_text(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=3_000 * (i % 3))) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rated = spark.createDataFrame([(i, i % 3) for i in range(12)], "doc_id long, grade int")
    seen = {}

    def fit(grades, rows, cols, values):
        seen.update({i: (int(grades[i]), dict(zip(cols[rows == i].tolist(), values[rows == i].tolist()))) for i in range(len(grades))})

    monkeypatch.setattr(quality, "fit_ordinal", fit)
    quality.learn(docs, rated)
    assert len(seen) == 12 and max(len(told) for _, told in seen.values()) > 2_000
    for i, (grade, told) in seen.items():
        assert grade == i % 3 and told == pytest.approx(quality.features(texts[i]), rel=1e-6)


def test_ordinal_fit_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    grades, rows = rng.integers(0, 3, 50), np.repeat(np.arange(50), 8)
    cols, values = rng.integers(0, 40, 400), rng.random(400)
    whole = quality.fit_ordinal(grades, rows, cols, values, rounds=20)
    monkeypatch.setattr(quality, "BLOCK", 7)
    parts = quality.fit_ordinal(grades, rows, cols, values, rounds=20)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.thresholds, parts.thresholds)
