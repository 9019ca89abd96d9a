import zlib
from collections import defaultdict

from tarn.llm import shards


def check(rows, texts, n=shards.SHARDS):
    """texts: (doc_id, text); the law and all invariants."""
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots, sizes = defaultdict(list), [0] * n
    for r in rows:
        assert 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max((r["size"] for r in rows), default=0)
    assert all(abs(x - sum(sizes) / n) <= largest + 1 for x in sizes)
    return sizes


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, size int, key int")
    return check(shards.shard_documents(docs).collect(), texts)


def test_edge_cases(spark):
    assert run(spark, []) == [0] * 8
    run(spark, [(1, None), (2, ""), (None, "é" * 2000), (2, ""), (3, "x")])


def test_hot_group_is_subdivided(spark):
    texts = [(i, "the same text" if i % 3 else f"text {i}") for i in range(4000)]
    sizes = run(spark, texts)
    assert max(sizes) < 1.02 * min(sizes)


def test_hot_group_of_one_id_is_subdivided(spark):
    sizes = run(spark, [(7 if i % 2 else None, "the same text") for i in range(4000)])
    assert max(sizes) < 1.02 * min(sizes)


def test_hot_group_smaller_than_the_largest_record_is_not_cut(spark):
    texts = [(0, "x" * 300_000), *((i, "the same text") for i in range(1, 15_000)), *((i, f"text {i}") for i in range(15_000, 20_000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = shards.shard_documents(docs).collect()
    check(rows, texts)
    assert len({r.shard for r in rows if 0 < r.doc_id < 15_000}) == 1


def test_equal_texts_stay_together(spark):
    texts = [(i, f"text {i // 2} " + "x" * (i // 2 % 50)) for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    of = defaultdict(set)
    for r in shards.shard_documents(docs).collect():
        of[r.text_crc32].add(r.shard)
    assert sum(len(x) > 1 for x in of.values()) <= 7


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = shards.op8_sampled_splitters(spark, sf).collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
