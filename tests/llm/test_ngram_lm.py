import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import ngram_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")] + [None]


def brute(texts):
    """texts: (id, text, held_out). n, known, N, base and score with weights by EM over single deleted tokens."""
    single, pair = Counter(), Counter()
    for _, t, held in texts:
        if not held:
            w = split(t)
            single.update(w)
            pair.update(zip(["<", *w], w, strict=False))
    n, v = sum(single.values()), len(single)
    of = lambda h: single[None] if h == "<" else single[h]
    f, p1, p2 = [], [], []
    for _, t, held in texts:
        if not held:
            w = split(t)
            for h, x in zip(["<", *w], w, strict=False):
                f.append(of(h) - 1)
                p1.append((single[x] - 1) / max(n - 1, 1))
                p2.append((pair[h, x] - 1) / max(of(h) - 1, 1))
    weights = ngram_lm.estimate(ngram_lm.bucket_of(np.array(f)), np.ones(len(f)), np.array(p1), np.array(p2), v)
    out = {}
    for i, t, _ in texts:
        w = split(t)
        base = sum(math.log10((single[x] + 1) / (n + 1 * (v + 1))) for x in w)
        score = 0.0
        for h, x in zip(["<", *w], w, strict=False):
            l0, l1, l2 = weights[ngram_lm.bucket_of(np.array([of(h)]))[0]]
            score += math.log10(l0 / (v + 1) + l1 * single[x] / n + l2 * pair[h, x] / max(of(h), 1))
        out[i] = (len(w), sum(single[x] > 0 for x in w), n, base, score)
    return out


TEXTS = [(0, "a b a b a c", False), (1, "A b  c\nd", False), (2, None, False), (3, "", True), (4, "a b zz", True), (5, "É a b " * 400, False), (6, "c d " * 300 + "a", False)]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*x, "clash") for x in TEXTS], "doc_id long, text string, h boolean, bucket string").repartition(3)
    want = brute(TEXTS)
    got = ngram_lm.score_texts(docs, F.col("h")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=0.02)  # cells of the estimation hold tokens of nearly equal estimates


def test_probabilities_sum_to_one():
    weights = ngram_lm.estimate(np.array([0, 3, 3]), np.ones(3), np.array([0.1, 0.2, 0.1]), np.array([0, 0.5, 0.0]), 9)
    assert np.allclose(weights.sum(axis=1), 1) and weights.min() >= 0


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = ngram_lm.score_texts(docs, F.lit(True)).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and r.score <= 0 for r in rows)
    assert ngram_lm.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_query_scores_held_out_texts_better_than_the_base(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute([(i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in docs.items()])
    rows = ngram_lm.op9_deleted_interpolation(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][4], rel_tol=0.02)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
