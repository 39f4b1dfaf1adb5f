"""SimHash: fingerprints, links and components against brute force."""

from __future__ import annotations

import random

import pytest
import xxhash

from kartei.llm import simhash
from kartei.llm.graph import components

WORDS = "ash bay cod dew elm fig gnu hay ivy jar".split()


def model_bits(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def model_labels(bits):
    """Smallest index reachable over links of at most 4 bits."""
    label = list(range(len(bits)))
    changed = True
    while changed:
        changed = False
        for i in range(len(bits)):
            for j in range(len(bits)):
                if (bits[i] ^ bits[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint_equals_model():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "One", "one two THREE", "É é\x0bx\x1fy", "a b c d"]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(40)]
    texts.append("word " * 70_000)
    for text in texts:
        assert simhash.fingerprint(text) == model_bits(text)


@pytest.mark.parametrize("crowded", [1_000, 2])
def test_links_lose_no_component(spark, crowded):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    bits = set(centres)
    for c in centres:
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            bits.add(x)
    bits = sorted(bits)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    frame = spark.createDataFrame([(b,) for b in signed], "bits long")
    linked = simhash.links(frame, crowded)
    for row in linked.collect():
        assert (row.a ^ row.b & (1 << 64) - 1).bit_count() <= 4 or ((row.a ^ row.b) & ((1 << 64) - 1)).bit_count() <= 4
    if crowded == 1_000:
        got = [tuple(r) for r in linked.collect()]
        want = {(a, b) for i, a in enumerate(signed) for j, b in enumerate(signed) if a < b and (bits[i] ^ bits[j]).bit_count() <= 4}
        assert sorted(got) == sorted(want)  # each pair once
    labels = {r.node: r.label for r in components(linked).collect()}
    model = model_labels(bits)
    groups = {}
    for s, m in zip(signed, model):
        groups.setdefault(m, set()).add(labels.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_query_rows_equal_model(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choices(WORDS, k=80)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " end") for i, t in enumerate(base)]
    rows += [(300, None), (301, ""), (302, "x"), (302, "x"), (302, base[0]), (None, base[1]), (None, "alone and without an id")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, label string")
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_digests(docs).collect()]
    bits = [model_bits(t) for _, t in rows]
    labels = model_labels(bits)
    least = {}
    for (i, _), m in zip(rows, labels):
        least[m] = min([x for x in (least.get(m), i) if x is not None], default=None)
    want = [(i, b, least[m]) for (i, _), b, m in zip(rows, bits, labels)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_of_each_keeps_the_smallest_id_and_all_columns(spark):
    rows = [(3, "a b c d e", 1), (1, "a b c d e", 2), (1, "a b c d e", 2), (2, "quite another text here", 3), (None, "a b c d e", 4), (None, "no id at all", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a b c d e", 2), (2, "quite another text here", 3), (None, "no id at all", 5)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_digests(docs).collect() == []
    assert simhash.one_of_each(docs).collect() == []


@pytest.mark.parametrize("crowded", [1_000, 2])
def test_links_broadcast_no_exploded_table(spark, monkeypatch, crowded):
    """Spark sizes variants as the fingerprints they come from; as a broadcast they would fill the driver."""
    frames, real = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda frame, name: frames.append(frame) or real(frame, name))
    different = spark.createDataFrame([(7,), (7 ^ 1,), (7 ^ 2,), (7 ^ 4,), (1 << 40,)], "bits long")
    linked = simhash.links(different, crowded)
    assert linked.count() > 0
    for frame in [*frames, linked]:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
