import hashlib
from collections import Counter

from tarn.llm import lines

AZ = str.maketrans(lines._UPPER, lines._LOWER)


def key(line):
    return line.strip(lines._SPACE).translate(AZ)


def brute(texts, min_docs):
    df = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if df[key(x)] < min_docs or not key(x)) for t in texts]


TEXTS = ["A\nb\n\na ", "\ta\x0b\nÉ\nc", None, "", "\n\n", "é\nA\nA\nlast", "b\nB \n c", "É\n\xa0c", "x" * 5000 + "\nb", "x" * 5000 + "\nb"]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(None if i == 5 else i // 2, t, "clash", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, digest string, common_lines int")
    for min_docs in (1, 2, 3):
        want = brute(TEXTS, min_docs)
        rows = lines.drop_common_lines(docs, min_docs=min_docs).collect()
        assert {r.common_lines: r.text or "" for r in rows} == dict(enumerate(want))
        assert len(rows) == len(TEXTS) and {r.digest for r in rows} == {"clash"}
    assert lines.drop_common_lines(docs.limit(0)).count() == 0


def test_runs_are_compacted_and_counts_add_up(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=2)
    for batch in ([1, 2], [1, 3], [1, 2], [4, 1], [2, 4]):
        runs.add(spark.createDataFrame([(k, k) for k in batch], "h1 long, h2 long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert sorted(r.h1 for r in runs.common().collect()) == [1, 2]
    runs.close()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = brute([t for _, t in docs], lines.MIN_DOCS)
    got = sorted(lines.op10_line_dedup(spark, sf).collect())
    for (i, text), kept, row in zip(docs, want, got, strict=True):
        assert (row.doc_id, row.n_lines) == (i, len(text.split("\n")))
        assert row.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
