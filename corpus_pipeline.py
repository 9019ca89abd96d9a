"""The corpus pipeline: documents through language ID, line dedup, near-duplicate removal, decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
``documents``; ``n_chars`` is brought up to date where a stage changes texts.

Defined cases: a null or empty text, or one without letters, has no language and goes in the first stage; null ids, languages and
sources are kept as they are; every row counts, and repeated ids or texts are told apart as rows, so of equal texts one
row stays (the least id, nulls last; then the least hash of the text, then the first) whatever ids they have; texts that lose all
their lines or words stay as empty texts; empty tables go through all stages as empty tables; columns beyond those of ``documents``
stay too, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, decontaminate, langid, lines, partenum
from tarn.llm._spark import Scratch, table


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return docs.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told (no letters, or unlike every known language) go. The models learn from the
    documents that have a language."""
    judged = langid.identify(docs, langid.train(docs))
    return judged.filter(~F.col("rejected")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents have lose all their places."""
    return _recounted(lines.drop_common_lines(docs), docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of near duplicates: that with the least id."""
    return partenum.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    return _recounted(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of token ids, the ids, and the SHA-256 of the bytes they decode to, which is the text's."""
    encoded = bpe.encode_texts(docs.select("doc_id", "text"), digest="decoded_sha256")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("decontamination", remove_benchmark),
    ("byte_bpe", encode),
]

#: Language models and automata are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
