"""Line dedup, decontamination, licenses, BPE, token counts and top-k against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kartei.llm import bpe, decontaminate, licenses, line_dedup, mtree, token_counts

DOCS = "doc_id long, text string, words string, label int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_line_dedup(spark):
    long = "A line that many hold"
    rows = [(5, f"{long}\nown of five five"), (2, f" \t{long.upper()}\x0b\nshort\nshort"), (9, long), (9, long), (7, f"{long}\n{long}\r\n\nshort"), (1, None), (3, ""), (None, long)]
    rows += [(20, "Élan vital is here"), (21, "élan vital is here"), (30, "ÄÖÜÄÖÜÄÖÜ"), (31, "ÄÖÜÄÖÜÄÖÜ"), (40, "\u212aK ten letters"), (41, "K\u212a ten letters"), (42, "k\u212a ten letters"), (50, "twice in one\ntwice in one")]
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                held[key(line)].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    docs = frame(spark, rows)
    assert rows_of(line_dedup.line_digests(docs)) == sorted(want, key=str)
    three = line_dedup.repeated_lines(line_dedup.line_keys(docs), 4).collect()
    assert [r.keeper for r in three] == [2]
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert {r.doc_id for r in line_dedup.without_repeated_lines(docs).collect()} == {5, 2, 7, 1, 3, None, 20, 21, 30, 31, 40, 41, 50}


ITEMS = [(1, " ".join(f"w{i}" for i in range(30))), (2, " ".join(f"W{i}" for i in range(15, 27))), (3, "tiny item"), (33, "tiny Item!"), (4, ""), (5, None), (6, "a " * 14), (7, "lone"), (None, "no name at all")]
TEXTS = [
    (1, "x " * 5 + " ".join(f"w{i}" for i in range(3, 14)) + " end"), (2, "before " + " ".join(f"w{i}" for i in range(10, 19))), (3, "a tiny, item and lone lone"),
    (4, "a " * 40), (4, "a " * 40), (5, None), (6, ""), (7, "--- !!"), (8, " ".join(f"w{i}" for i in range(15, 26)) + " q " + " ".join(f"w{i}" for i in range(0, 12))), (None, "tiny item"), (9, "say no name at all"),
]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    want = []
    for i, t in TEXTS:
        w, hit, items = words(t), set(), set()
        for item, text in ITEMS:
            own = words(text)
            n = min(len(own), 10)
            grams = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in grams:
                    hit.update(range(s, s + n))
                    items.add(item)
        ids = sorted(str(x) for x in items if x is not None)
        want.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, length int")
    docs = frame(spark, TEXTS)
    assert rows_of(decontaminate.contamination_digests(docs, items)) == sorted(want, key=str)
    clean = decontaminate.without_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 5, 6, 7]


def test_licenses(spark):
    mit = next(t for t, label in licenses.TEMPLATES.items() if label == "mit").split()
    rows = [(1, "Under CC-BY, and CC BY again. All rights\nreserved"), (2, "general public licenses, general public License"), (3, None), (4, ""), (4, "all rights"), (5, "cc all by rights reserved"), (6, " ".join(mit)), (7, " ".join(mit[:8] + ["truly"] + mit[8:])), (8, " ".join(mit[:6])), (9, "cc by " * 3000), (None, "cc by"), (9, "cc by " * 3000)]
    got = {}
    for r in licenses.license_digests(frame(spark, rows)).collect():
        got.setdefault((r.doc_id, r.n_words), []).append(r)
    for i, t in rows:
        w = words(t)
        places = sorted((s, label) for phrase, label in licenses.BASE.items() for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split())
        for r in got[i, len(w)]:
            assert r.n_base == len(places)
            assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert r.base_labels == ",".join(sorted({label for _, label in places}))
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert len(got[9, 6000]) == 2
    assert got[6, len(mit)][0].labels == got[7, len(mit) + 1][0].labels == "mit" and got[8, 6][0].labels == ""


def run_in_order(phrase, text):
    """The most pairs of words of a template that stand in the text in their order, few other words between: by brute force."""
    grams = lambda w: list(zip(w, w[1:]))
    t, d = grams(phrase), grams(text)
    pairs = sorted((place, -at) for place, x in enumerate(d) for at, y in enumerate(t) if x == y)
    best = 0
    for low in {(place + at) // licenses.DRIFT + k for place, at in pairs for k in (0, -1)}:
        votes = [(p, -a) for p, a in pairs if low * licenses.DRIFT <= p + a < (low + 2) * licenses.DRIFT]
        runs = []
        for p, a in votes:
            runs.append(1 + max((n for n, (q, b) in zip(runs, votes) if q < p and b < a), default=0))
        best = max(best, *runs)
    return best / len(t)


def test_spans_are_verified(spark):
    rng = random.Random(9)
    phrases = {label: t.split() for t, label in licenses.TEMPLATES.items()}
    mit = phrases["mit"]
    pairs = [mit[i : i + 2] for i in range(0, len(mit) - 1)]
    texts = [sum((p + ["foreign"] for p in pairs), []), sum((p for p in reversed(pairs)), []), mit[::-1], mit[:9] + ["one", "two"] + mit[9:], mit[:5] + mit[7:], mit * 3, ["x"] * 50 + mit]
    for _ in range(60):
        text = list(rng.choice(list(phrases.values())))
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 2)] = rng.choice([[], ["odd"], ["odd", "words"], text[:3]])
        texts.append(text)
    docs = frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    got = {r.doc_id: (set(filter(None, r.labels.split(","))), r.base_labels) for r in licenses.license_digests(docs).collect()}
    for i, text in enumerate(texts):
        want = {label for label, phrase in phrases.items() if run_in_order(phrase, text) >= licenses.LEAST_SHARE}
        assert got[i][0] - set(got[i][1].split(",")) == want, text
    assert got[0][0] == got[1][0] == got[2][0] == set() and got[3][0] == got[4][0] == got[5][0] == got[6][0] == {"mit"}


def test_licenses_of_a_long_text(spark):
    text = "all rights reserved and so on " * 40_000
    [row] = licenses.license_digests(frame(spark, [(1, text)])).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (240_000, 40_000, 0, 239_994)


def test_bpe(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", " a", "the", "'s", "123", "日本", "\U0001f600", "\u0085", "...", "\t", "\x00"]
    texts = [None, "", "a", " " * 20_000, "x" * 5_000, "The same passage here. " * 400] + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id")]
    want = []
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(model.decode(ids, skip_special_tokens=False))))
    docs = frame(spark, rows)
    for chunk in (16, bpe.CHUNK):
        assert rows_of(bpe.bpe_digests(docs, chunk=chunk)) == sorted(want, key=str)
    round_trip = {r.doc_id: r.decoded for r in bpe.bpe_round_trip(docs).collect()}
    assert all(round_trip[i] == (t or "") for i, t in rows)


def test_token_counts(spark):
    from tokenizers import Tokenizer, models

    pieces = token_counts.pieces_of(token_counts.default_vocabulary())
    model = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    rng = random.Random(2)
    parts = ["<s>", "  ", "\n", "a", "the ", "日本", "é", "word.", "(b)", "\t", " ", "zz,", "it's;", "²."]
    texts = [None, "", " ", "ab" * 3_000] + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(200)]
    want = [(i, len(model.encode(token_counts.normalized(t or "")).ids)) for i, t in enumerate(texts)]
    assert rows_of(token_counts.token_counts(frame(spark, list(enumerate(texts))))) == sorted(want, key=str)
    few = [("<unk>", 0.0), ("a", -1.5), ("ab", -1.5), ("b", -0.25), ("abc", -3.0), ("c", -1.5)]
    own, other = token_counts.Counter(few), Tokenizer(models.Unigram(few, unk_id=0, byte_fallback=False))
    for _ in range(300):
        text = "".join(rng.choices("abcxy", k=rng.randint(0, 12)))
        assert own.best(text)[0] == len(other.encode(text).ids)


def model_top_k(rows, k, every):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in usable:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:k]
            want += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best)]
    return want


def test_bpe_deals_large_groups_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 2_000)
    text = "one text of many copies " * 4
    docs = frame(spark, [(None if i % 2 else i, text) for i in range(400)] + [(1_000, "another"), (1_001, None), (None, "")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = bpe._together(docs, bpe.CHUNK).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in tasks) < 200
    got = bpe.bpe_digests(docs).groupBy("doc_id", "n_tokens").count().collect()
    n = len(bpe.encoding(bpe.default_vocabulary()).encode_ordinary(text))
    assert {(r.doc_id, r.n_tokens): r["count"] for r in got if r.doc_id is None} == {(None, n): 200, (None, 0): 1}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [*range(0, 400, 2), 1_000, 1_001]


@pytest.mark.parametrize("block", [mtree.BLOCK, 12])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(mtree, "BLOCK", block)
    monkeypatch.setattr(mtree, "PAGE", 4)
    monkeypatch.setattr(mtree, "QUERIES", 5)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(400 + i, [0.0] * 5) for i in range(9)]
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 5), (504, [float("inf")] * 5), (None, [1.0] * 5), (505, [9.0]), (506, [-0.001] * 5), (120, [70.0, -3.0, 1.0, 1.0, 0.5])]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = [tuple(r) for r in mtree.embedding_top_k(table, every=10).collect()]
    assert sorted(got) == sorted(model_top_k(rows, 5, 10))


@pytest.mark.parametrize("dims, size", [(384, 2.0**11), (384, 2.0**22), (4, 2.0**14), (4, 2.0**32), (5, 1e160), (3, 1e300)])
def test_top_k_of_large_components(spark, monkeypatch, dims, size):
    monkeypatch.setattr(mtree, "BLOCK", 16)
    monkeypatch.setattr(mtree, "PAGE", 4)
    rng = random.Random(dims)
    rows = [(i, [rng.uniform(-size, size) for _ in range(dims)]) for i in range(60)]
    rows += [(70 + i, [x / size for x in rows[i][1]]) for i in range(10)] + [(80, rows[0][1]), (90, [1.7e308] * dims)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in mtree.embedding_top_k(table, every=10).collect()]
    assert sorted(got) == sorted(model_top_k(rows[:-1], 5, 10))


def test_top_k_keeps_products_exact_where_doubles_do_not(spark):
    near = 2.0**30
    rows = [(0, [near, 1 / 256]), *((i, [near, i / 256]) for i in range(1, 20))]
    got = [tuple(r) for r in mtree.embedding_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).collect()]
    assert [r[2] for r in sorted(got)] == [19, 18, 17, 16, 15]


def test_empty_tables(spark):
    docs, items = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    some = frame(spark, [(1, "a few words")])
    for df in (
        line_dedup.line_digests(docs), decontaminate.contamination_digests(docs, items), licenses.license_digests(docs), bpe.bpe_digests(docs),
        token_counts.token_counts(docs), mtree.embedding_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert df.collect() == []
    assert [r.n_words for r in decontaminate.contamination_digests(some, items).collect()] == [3]
