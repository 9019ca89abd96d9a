import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import Row

from tarn.llm import decontaminate as d
from tarn.llm._words import ALNUM_LOWER, words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(text, items, window):
    doc = split(text)
    hit, found = set(), set()
    for item_id, body in items:
        item = split(body)
        size = min(window, len(item))
        for i in range(len(item) - size + 1 if item else 0):
            for j in range(len(doc) - size + 1):
                if doc[j : j + size] == item[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item_id))
    return len(doc), hit, found


texts = st.lists(st.sampled_from(["a", "b", "c", "É"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=5), st.lists(texts, max_size=6), st.integers(1, 5))
def test_automaton_equals_brute_force(items, docs, window):
    named = list(enumerate(items))
    held = [(str(k), words(pa.array([x]), ALNUM_LOWER).hash) for k, x in named]
    held = [(k, x) for k, x in held if len(x)]
    matcher = d.Matcher.of([k for k, _ in held], [x for _, x in held], window)
    found = words(pa.array(docs, pa.string()), ALNUM_LOWER)
    mask, got = matcher.hits(found)
    for i, text in enumerate(docs):
        n, hit, ids = brute(text, named, window)
        assert found.per_text[i] == n
        assert set((mask[found.first[i] : found.first[i + 1]]).nonzero()[0]) == hit
        assert got[i] == ids


PASSAGE = "one two three four five six seven eight nine ten eleven"
DOCS = [(1, f"Before, {PASSAGE.upper()} after it all " + "x y z " * 9), (2, None), (3, ""), (4, PASSAGE), (4, PASSAGE), (5, "clean text — nothing here"), (6, "é short ITEM, yes " + "w " * 30), (None, PASSAGE)]
ITEMS = [("b", PASSAGE), ("a", PASSAGE), ("c", "short item"), ("d", None), ("e", "...")]


def frames(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, items="clash", n_words=7) for i, t in DOCS], "doc_id long, text string, items string, n_words int")
    return docs, spark.createDataFrame(ITEMS, "item_id string, text string")


def test_find_over_edge_cases_and_blocks(spark):
    docs, items = frames(spark)
    for block in (d.BLOCK_WORDS, 5):
        rows = d.find(docs, items, block_words=block).collect()
        assert len(rows) == len(DOCS)
        for row in rows:
            text = next(t for i, t in DOCS if i == row.doc_id)
            n, hit, ids = brute(text, ITEMS, d.WINDOW)
            assert (row.n_words, {w for b, e in row.spans for w in range(b, e)}, row["items"]) == (n, hit, sorted(ids))


def test_remove_cuts_spans_and_drops_covered_texts(spark):
    docs, items = frames(spark)
    kept = {r.doc_id: r.text for r in d.remove(docs, items).collect()}
    assert kept == {1: "Before,  after it all " + "x y z " * 9, 2: None, 3: "", 5: DOCS[5][1], 6: "é , yes " + "w " * 30}
    assert d.remove(docs, items).schema == docs.schema


def test_remove_judges_and_cuts_the_union_of_all_blocks(spark):
    w = [f"w{k}" for k in range(40)]
    text = " ".join(w)
    item = lambda b, e: " ".join(w[b:e])
    cases = [
        # 30 % in each of two blocks: 60 % covered
        ([item(0, 12), item(20, 32)], None),
        # an overlap of two blocks' items: both are cut whole
        ([item(0, 12), item(5, 15)], " " + " ".join(w[15:])),
        # words that only come together over a cut are no hit
        ([item(10, 20), item(5, 10) + " " + item(20, 25)], " ".join(w[:10]) + "  " + " ".join(w[20:])),
    ]
    docs = spark.createDataFrame([(1, text, "clash"), (2, None, "x"), (3, "é", "x")], "doc_id long, text string, Spans string")
    for bodies, want in cases:
        items = spark.createDataFrame(list(enumerate(bodies)), "item_id int, text string").coalesce(1)
        for block in (10, d.BLOCK_WORDS):
            out = d.remove(docs, items, block_words=block)
            assert out.schema == docs.schema
            kept = {r.doc_id: (r.text, r.Spans) for r in out.collect()}
            assert kept.pop(2) == (None, "x") and kept.pop(3) == ("é", "x")
            assert kept == ({} if want is None else {1: (want, "clash")})


def test_no_items_and_no_docs(spark):
    docs, items = frames(spark)
    assert d.find(docs, items.limit(0)).filter("size(spans) > 0 or size(items) > 0").count() == 0
    assert d.find(docs.limit(0), items).count() == 0
    assert d.remove(docs, items.limit(0)).count() == len(DOCS)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    grams = {}
    for k, body in items:
        w = split(body)
        for i in range(max(0, len(w) - 9)):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    rows = d.op6_decontaminate(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        w, hit, ids = split(texts[r.doc_id]), set(), set()
        for j in range(len(w) - 9):
            if tuple(w[j : j + 10]) in grams:
                hit |= set(range(j, j + 10))
                ids |= grams[tuple(w[j : j + 10])]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_periodic_items_take_linear_time():
    n = 40_000
    matcher = d.Matcher.of(["same", "two"], [words(pa.array([x]), ALNUM_LOWER).hash for x in ("w " * n, "w v " * n)], d.WINDOW)
    began = time.process_time()
    mask, items = matcher.hits(words(pa.array(["w " * n + "v w " * n, "v " * 20]), ALNUM_LOWER))
    assert time.process_time() - began < 20  # with a climb of all suffixes at each word: many minutes
    assert mask[: 3 * n].all() and not mask[3 * n :].any() and items == [{"same", "two"}, set()]
