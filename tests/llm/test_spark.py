import os

import pytest
from pyspark.sql import functions as F

from tarn.llm import _spark, lines, ngram_lm


def written(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    tables = {t.name for t in spark.catalog.listTables() if t.name.startswith("tarn_")}
    return ({x for x in os.listdir(base)} if os.path.isdir(base) else set()) | tables


def test_a_failure_leaves_nothing_behind(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a line\nline {i}") for i in range(40)], "doc_id long, text string")
    before = written(spark)

    def fail(*_):
        raise RuntimeError("planned")

    monkeypatch.setattr(lines.LineRuns, "_push", fail)
    with pytest.raises(RuntimeError, match="planned"):
        lines.mark_common_lines(docs)
    monkeypatch.setattr(ngram_lm, "estimate", fail)
    with pytest.raises(RuntimeError, match="planned"):
        ngram_lm.score_texts(docs, F.lit(False))
    assert written(spark) == before and not _spark._WRITTEN


def test_buckets_follow_the_input(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert _spark.buckets(docs) == _spark.partitions(spark) == 4
    monkeypatch.setattr(_spark, "BUCKET_BYTES", 1 << 16)
    assert 8 < _spark.buckets(docs) < 400
    monkeypatch.setattr(_spark, "MOST_EVEN", 8)  # names are plain numbers then
    texts = docs.limit(50)
    scored = ngram_lm.score_texts(texts, F.lit(False))
    assert scored.count() == 50


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="checkpoint"):
        _spark.shared_folder(Session())
