import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import partenum
from tarn.llm._spark import Scratch
from tarn.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if len(w) >= 5 else frozenset([tuple(w)])


def brute(texts):
    """doc_id -> (n, component); links by an inverted index, so no pair with a common feature is missed."""
    sets = {i: features(t) for i, t in texts}
    index, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sorted(sets.items()):
        overlap = defaultdict(int)
        for f in s:
            for j in index[f]:
                overlap[j] += 1
            index[f].append(i)
        for j, both in overlap.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(text, draw, rate):
    w = text.split(" ")
    for _ in range(max(1, int(rate * len(w)))):
        k = draw.randrange(len(w))
        w[k : k + 1] = draw.choice([[], [w[k], f"n{draw.random():.9f}"], [f"r{draw.random():.9f}"]]) if len(w) > 1 else w[k : k + 1]
    return " ".join(w)


def corpus(seed=3):
    draw = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [None, "", " \n", "one", "One", "one two three four", "one two three four five"]
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 30, 45, 60, 90, 150, 400]:
        for _ in range(4):
            base = " ".join(f"w{draw.randrange(10**6)}" for _ in range(n)) + (f" {passage}" if draw.random() < 0.5 else "")
            texts.append(base)
            for _ in range(draw.randrange(6)):
                texts.append(edited(draw.choice(texts[-3:]) or base, draw, draw.choice([0, 0.01, 0.03, 0.06])))
    texts += ["The same text many times over, and once more for good measure."] * 40
    chain = [f"c{k}" for k in range(60)]
    for k in range(25):  # neighbours are similar, the ends are not
        texts.append(" ".join(chain))
        chain[2 * k % 60] = f"d{k}"
    return list(enumerate(texts))


def test_similar_sets_share_a_signature():
    texts = corpus(5)
    sets = partenum.sets_of(pa.array([t for _, t in texts], pa.string()))
    raw = [features(t) for _, t in texts]
    assert [len(x) for x in raw] == sets.size.tolist()
    feature, count = np.unique(sets.feature, return_counts=True)
    for common in (feature[:0], feature[count > 20], feature[count > 1], feature):
        sig, text = partenum.signatures(sets, common)
        of = defaultdict(set)
        for s, t in zip(sig.tolist(), text.tolist(), strict=True):
            of[t].add(s)
        for i, a in enumerate(raw):
            for j in range(i):
                both = len(a & raw[j])
                if a and 100 * both >= 75 * (len(a) + len(raw[j]) - both):
                    assert of[i] & of[j], (i, j, len(a), len(raw[j]))


def test_sketches_bound_the_difference():
    texts = [t for _, t in corpus(9) if features(t)]
    sets = partenum.sets_of(pa.array(texts, pa.string()))
    sketch, raw = partenum.Sketches(pa.array(partenum.sketches(sets), pa.binary())), [features(t) for t in texts]
    draw = np.random.default_rng(1)
    i, j = draw.integers(0, len(raw), (2, 4000))
    bound = partenum.least_differences(sketch, i, sketch, j)
    apart = 0
    for a, b, least in zip(i.tolist(), j.tolist(), bound.tolist(), strict=True):
        assert least <= len(raw[a] ^ raw[b])
        apart += 100 * len(raw[a] & raw[b]) < 75 * len(raw[a] | raw[b]) and least > (len(raw[a]) + len(raw[b])) // 7
    assert apart > 3500


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 100_000))
def test_bands_cover_all_similar_sizes(a):
    for b in {a, 4 * a // 3}:
        for least, most in partenum.bands():
            if least <= a and b <= most:
                break
            assert least <= a


def test_join_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, -1) for i, t in texts], "doc_id long, text string, handle int").repartition(3)
    want = brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.join_classes(docs).collect()}
    assert got == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.op1_partenum(spark, sf).collect()} == want


def test_clashing_handles_and_blocks(spark, monkeypatch):
    """Handles of six bits: nearly all are shared by different sets, which their second hashes hold apart."""
    monkeypatch.setattr(partenum, "BLOCK", 4)  # on the driver, where blocks are dealt
    texts = corpus(11)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.join_classes(docs, handle_bits=6).collect()}
    assert got == brute(texts)


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in partenum.join_classes(docs).filter("component_id = 1").collect()) == ["1", "1", "2", "None"]
    assert partenum.join_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stored", [False, True])
def test_keep_one_goes_by_row(spark, tmp_path, stored):
    near, other, third = "a b c d e f g h", "one two three four five six seven", "p q r s t u v w x y z"
    rows = [(1, near, 0), (1, near, 1), (2, near, 2), (None, near, 3), (None, other, 4), (None, other, 5), (2, third, 6), (9, " ", 7), (9, " ", 8), (1, "x1 x2 x3 x4 x5 x6", 9), (4, "x1 x2 x3 x4 x5 x6", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3, "n")
    if stored:  # rows are told apart by their places in files then
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
        assert "numbered" not in "".join(partenum._with_row(docs, "__row").inputFiles())
    kept = partenum.keep_one(docs)
    assert kept.schema == docs.schema
    left = {r.n for r in kept.collect()}
    assert len(left & {0, 1}) == 1 and len(left & {4, 5}) == 1
    assert left - {0, 1, 4, 5} == {6, 7, 8, 9}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links, Scratch(spark, "test"), "cc").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100, 300: 100}
