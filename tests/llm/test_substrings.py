import hashlib
import random

import numpy as np

from tarn.llm import substrings


def brute(rows):
    """rows: (id, text) with distinct ids. id -> (n_words, kept words)."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone |= set(range(s, s + 20))
            seen.add(window)
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


def corpus():
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 33, 70)]
    texts = [None, "", " \t", "same " * 90, "same " * 25, "É " * 19, "x y " * 40]
    for _ in range(120):
        w = [word() for _ in range(draw.choice([3, 25, 60, 200]))]
        for _ in range(draw.randrange(3)):
            k = draw.randrange(len(w))
            w[k:k] = draw.choice(passages)
        texts.append(draw.choice([" ", "\n", "  "]).join(w))
        if draw.random() < 0.2:
            texts.append(texts[-1])
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)]


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, bucket string").repartition(3)
    want = brute(rows)
    got = substrings.remove_repeats(docs, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept.encode()) == (n, n - len(kept), b" ".join(kept)), r.doc_id
        assert sum(e - b for b, e in r.spans) == r.n_removed


def test_equals_brute_force(spark):
    check(spark, corpus())


def test_many_small_groups(spark):
    check(spark, corpus()[:60], group_suffixes=40)


def test_prefixes_split_what_is_too_large():
    cells = np.zeros(1 << substrings.CELL_BITS, np.int64)
    cells[[1, 2, 3, 900]] = [30, 30, 500, 20]
    p = substrings.Prefixes.of(cells, 64)
    head = lambda cell, second: np.uint64(cell << (64 - substrings.CELL_BITS) | second)
    of = lambda cell, second=0: int(p(np.array([head(cell, second)], np.uint64))[0])
    assert of(1) == of(2) != of(3) and of(3, 0) != of(3, 0xFFFFFFFF) and p.bits[3] == 3
    assert len({of(3, k << 29) for k in range(8)} | {of(2), of(900)}) == 10 and of(900) < p.count


def test_repeated_ids_and_empty_table(spark):
    text = " ".join(f"t{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == [("1", 30, 0), ("1", 30, 30), ("None", 0, 0), ("None", 30, 30)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    rows = substrings.op2_suffix_trees(spark, sf).collect()
    assert len(rows) == len(want) and any(r.n_removed for r in rows)
    for r in rows:
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
