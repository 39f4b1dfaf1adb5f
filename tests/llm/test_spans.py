"""Word spans, filter audit, k-means and Jaccard join against brute force."""

from __future__ import annotations

import contextlib
import hashlib
import math
import os
import random
import re
import threading
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from kartei.llm import filter_audit, jaccard_join, spans, va_kmeans
from kartei.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PARTS = ["a", "b", "AB", "é", "日", "\t", " ", "\n", "\x00", "$", "x" * 70, "y" * 64, "\x85", "\xa0", "w7", "\U0001f600"]


@pytest.mark.parametrize("block", [1 << 20, 7, 64])
def test_spans(monkeypatch, block):
    monkeypatch.setattr(spans, "BLOCK", block)
    rng = random.Random(1)
    for _ in range(100):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))).encode() for _ in range(rng.randint(0, 6))]
        found = spans.words_of(texts, (spans.CAPITAL, spans.FIRST, spans.SIGN))
        owners, h = found.owners, found.hashes()
        different = spans.count_distinct(found)
        seen = {}
        for i, text in enumerate(texts):
            words = WORD.findall(text)
            at = np.flatnonzero(owners == i)
            assert [found.raw[s : s + n].tobytes() for s, n in zip(found.starts[at], found.lengths[at])] == words
            assert different[i] == len(set(words))
            assert found.counts[spans.FIRST][i] - 1 == len(text.decode())
            assert found.counts[spans.CAPITAL][i] == sum(65 <= x <= 90 for x in text)
            assert found.counts[spans.SIGN][i] == sum(x in b"#$%&*|" for x in text)
            for word, value in zip(words, h[at].tolist()):
                assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(spans, "_hashes", lambda raw, starts, lengths: np.full(len(starts), 77, np.uint64))
    found = spans.words_of([b"aa bb aa cc " + b"z" * 90 + b" " + b"y" * 90, b"", b"aa"])
    assert spans.count_distinct(found).tolist() == [5, 0, 1]


AUDITED = "doc_id long, text string, lang string, n int, part string"
LABELS = "doc_id long, quality int, toxic int, text string"


def audited_rows():
    rng = random.Random(2)
    long = " ".join(f"w{i}" for i in range(220))
    texts = [long, long + " #", long.upper(), "x " * 300, "X " * 300 + "|", "", None, "short", "short", long.replace("w1", "W1")]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(7, "short", "en"), (7, "short", "de"), (None, "short", "en"), (None, "short", "en"), (None, long, None), (90, None, "xx"), (91, "", "xx"), (3, long, "en"), (3, long, "en")]
    return rows


def audit_model(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text.encode())
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i,
        }
        parts.setdefault(lang or "", []).append((i, {k for k, v in fails.items() if v}))
    out = []
    for part, docs in parts.items():
        removed = {k: 0 for k in "ABCDE"}
        lines = []
        for order in permutations("ABCDE"):
            left = docs
            for step, k in enumerate(order, 1):
                gone, kept = [d for d in left if k in d[1]], [d for d in left if k not in d[1]]
                redundant = sum(k in d[1] for d in docs) - len(gone)
                unique = sum(d[1] == {k} for d in docs)
                removed[k] += len(gone)
                lines.append((part, "".join(order), step, len(kept), len(gone), redundant, unique, sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), k))
                left = kept
        out += [(*line[:-1], removed[line[-1]]) for line in lines]
    return out


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    rows = audited_rows()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (7, 1, 1), (7, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], AUDITED)
    got = filter_audit.audit(docs, spark.createDataFrame([(*x, "clash") for x in labels], LABELS))
    assert sorted(map(tuple, got.select(*AUDIT).collect())) == sorted(audit_model(rows, labels))


def test_filter_audit_of_an_empty_table_and_of_one_long_text(spark):
    empty, labels = spark.createDataFrame([], AUDITED), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(empty, labels).collect() == []
    long = spark.createDataFrame([(1, "Word and others " * 400_000, "en", 1, "x")], AUDITED)
    assert [r.fails for r in filter_audit.document_failures(long).collect()] == [0b00110]


def k_means_model(rows, clusters, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((square(v, m), c) for c, m in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[c]) for x in zip(*members[c])] if c in members else m for c, m in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {c: sum(d for _, k, d in found if k == c) for c in range(clusters)}
    long = lambda x: x if x < 1 << 63 else None
    return [(i, c, long(d), long(inertia[c]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


VECTORS = "vec_id long, embedding array<double>, cluster int"


@pytest.mark.parametrize("scale", [0.2, 1e9, 1e30])
def test_k_means(spark, scale):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(130)]
    rows = list(enumerate(vectors)) + [(200 + i, vectors[5]) for i in range(30)] + [(3, vectors[9]), (3, vectors[3]), (None, vectors[1]), (None, [0.5] * 64)]
    rows += [(500, None), (501, []), (502, [0.1] * 63), (503, [0.1] * 65), (504, [None, *vectors[0][1:]]), (505, [float("nan"), *vectors[0][1:]]), (506, [float("-inf"), *vectors[0][1:]]), (507, [-0.001] * 64)]
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], VECTORS)
    got = [tuple(r) for r in va_kmeans.cluster_digests(table).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    assert sorted(got, key=str) == sorted(k_means_model(rows, 40, 5), key=str)


def test_k_means_with_few_or_no_vectors(spark):
    assert va_kmeans.cluster_digests(spark.createDataFrame([], VECTORS)).collect() == []
    assert va_kmeans.cluster_digests(spark.createDataFrame([(1, [0.5], 1), (None, [0.5] * 64, 1)], VECTORS)).collect() == []
    rows = [(i, [i / 10.0] * 64) for i in (5, 2, 9)]
    got = va_kmeans.cluster_digests(spark.createDataFrame([(*r, 0) for r in rows], VECTORS)).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(x[:3] for x in k_means_model(rows, 3, 5))


@pytest.mark.parametrize("bits", [1, 4])
def test_intervals_hold_and_spare_vectors(bits):
    rng = np.random.default_rng(4)
    centres = rng.integers(-5000, 5000, (6, 8)).astype(float)
    x = np.concatenate([c + rng.integers(-40, 40, (50, 8)) for c in centres])
    cells = va_kmeans.cells_of(x, x.min(axis=0).tolist(), x.max(axis=0).tolist(), bits)
    whole, centroids, codes = x.astype(np.int64), centres.astype(np.int64), cells.numbers(x)
    least, most = va_kmeans.lookup_tables(cells, centroids, True)
    square = ((whole[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    low, high = (sum(t[d, codes[:, d]] for d in range(8)) for t in (least, most))
    assert (low <= square).all() and (square <= high).all()
    fetched = []
    cluster, n = va_kmeans.assign(codes, lambda at: fetched.extend(at) or whole[at], (least, most), centroids)
    assert (cluster == square.argmin(axis=1)).all() and n == len(fetched)
    # groups far apart are told by their cells alone, but for cells that reach from one group to the next
    assert bits == 1 or n < len(x) // 20


def jaccard_model(rows):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").encode().lower())
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for (i, _), m in zip(rows, label):
        least[m] = min((x for x in (least.get(m), i) if x is not None), default=None)
    return [(i, len(s), least[m]) for (i, _), s, m in zip(rows, sets, label)]


def jaccard_rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(6):  # families of near copies, some with a passage in common
        base = rng.choices(words, k=rng.randint(8, 90)) + words[:20] * rng.randint(0, 1)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy) + rng.choice(["", "\n", " end"])))
            n += 1
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "One two"), (104, "one  TWO"), (105, "one two three"), (106, "a b c d e"), (107, "A b c d E"), (107, "A b c d E"), (108, "é b c d e"), (109, "É b c d e")]
    return rows + [(None, rows[0][1]), (None, "alone without an id"), (110, rows[14][1]), (4, "the same id but another text")]


@pytest.mark.parametrize("few, block", [(8, 1 << 19), (1, 200), (1000, 1 << 19)])
def test_jaccard_join(spark, few, block):
    rows = jaccard_rows()
    docs = spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, n int, digest string")
    got = [tuple(r) for r in jaccard_join.near_duplicates(docs, few, block).collect()]
    assert sorted(got, key=str) == sorted(jaccard_model(rows), key=str)


def test_jaccard_join_of_an_empty_table_and_of_a_long_text(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = " ".join(f"v{i % 90_000}" for i in range(150_000))
    rows = [(2, long), (1, long + " end"), (3, "else")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n, c) for i, n, c in jaccard_model(rows)}


def test_jaccard_join_of_rows_that_are_there_many_times(spark):
    words = [f"u{i}" for i in range(80)]
    near, far = " ".join(words), " ".join([*words[:78], "x", "y"])
    rows = [(7, near)] * 30 + [(None, far)] * 12 + [(9, far), (3, "else"), (3, "else")]
    got = [tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(jaccard_model(rows), key=str)
    assert len(got) == 45 and {c for i, _, c in got if i != 3} == {7}


@pytest.mark.parametrize("few, digits", [(1, 13), (3, 25)])
def test_columns_are_counted_by_their_first_bits(few, digits):
    rng = np.random.default_rng(12)
    columns = rng.integers(0, 1 << 63, 4_000).astype(np.uint64) * np.uint64(2)
    columns[:2] = 0, 2**64 - 1
    times = rng.choice([1, 2, 3, 4, 9, 200], len(columns), p=[0.7, 0.1, 0.1, 0.05, 0.04, 0.01])
    tasks = np.array_split(rng.permutation(np.repeat(columns, times)), 3)
    rows = [r for t in tasks for r in jaccard_join.packed(t, few).to_pylist()]
    assert max(len(r["columns"]) for r in rows) < 4 * len(columns)
    shared, crowded = np.zeros((1 << digits) // 8, np.uint8).reshape(1 << jaccard_join.PART, -1), []
    for part in {r["part"] for r in rows}:
        own = pa.Table.from_pylist([r for r in rows if r["part"] == part], pa.schema([("part", pa.int32()), ("columns", pa.binary())]))
        (found,) = jaccard_join.counted(few, digits)(own).to_pylist()
        crowded += found["crowded"]
        shared[part] = np.frombuffer(found["bits"], np.uint8)
    assert sorted(crowded) == sorted((columns[times > few] >> np.uint64(22)).tolist())
    marked = jaccard_join._marked(columns, shared.ravel())
    assert marked[times > 1].all() and (digits < 25 or marked[times == 1].mean() < 0.01)


def test_jaccard_join_moves_less_than_its_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.randrange(1 << 20):x}" for _ in range(400))) for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    moved, ended = {}, threading.Event()
    before = {name for top in folders for _, _, names in os.walk(top) for name in names}

    def watch():  # Spark deletes the files of a shuffle when its query has ended
        while not ended.wait(0.03):
            for folder, _, names in (x for top in folders for x in os.walk(top)):
                for name in names:
                    with contextlib.suppress(FileNotFoundError):
                        if name.startswith("shuffle_") and name.endswith(".data") and name not in before:
                            moved[name] = os.path.getsize(f"{folder}/{name}")

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert jaccard_join.near_duplicates(docs).select("component_id").distinct().count() == len(rows)
    finally:
        ended.set()
        watcher.join()
    assert 0 < sum(moved.values()) < sum(len(text) for _, text in rows)


def test_products_and_forests():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[:15]] for a in sets])
    assert (jaccard_join.overlaps(sets, sets[:15]) == want).all()
    linked = rng.random((40, 40)) < 0.03
    linked |= linked.T
    edges = jaccard_join.forest(linked)
    assert all(linked[i, j] for i, j in edges)
    label = list(range(40))
    for _ in range(40):
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    reach = linked | np.eye(40, dtype=bool)
    for _ in range(6):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert all((label[i] == label[j]) == bool(reach[i, j]) for i in range(40) for j in range(40))
    assert len(edges) == 40 - len(set(label))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
