"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

``LineRuns`` holds, for each line key, how many documents have it, as sorted and bucketed runs. A new
batch's keys are merge-anti-joined with the keys that the runs already know to be common (both sides
are bucketed and sorted alike, so runs are never shuffled again), and the rest becomes a run of its
own. ``FANOUT`` runs of a level are compacted into one of the next, so a batch meets few runs.

A line's key is the line stripped of white space (bytes 09-0D and 20) at both ends, A-Z lower-cased. Keys that at
least ``min_docs`` documents have lose all their lines, in every document.

Defined cases: a null or empty text is one empty line; empty keys are never common; a document counts
once for a key however often it repeats the line; every row counts as a document, repeated ids or
texts included; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import _WRITTEN, Scratch, partitions, shared_folder, table, tidy

#: Documents that make a line common.
MIN_DOCS = 10
#: Runs of one level before they are compacted into the next.
FANOUT = 2
#: Batches in which a whole table is fed to the runs.
BATCHES = 4

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(line: Column) -> Column:
    """A-Z lower-cased. ``lower`` is the faster way where all is ASCII."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def _hashed(key: Column) -> Column:
    """128 bits of a key; null for an empty one."""
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))


def keys_of(text: Column) -> Column:
    """The hashed key of each line. One transform a step: what is written twice inside a lambda is computed twice."""
    bare = F.transform(lines_of(text), lambda x: F.trim(x, F.lit(_SPACE)))
    return F.transform(F.transform(bare, _folded), _hashed)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Document counts of line hashes (h1, h2, n_docs) in levelled sorted runs."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.name, self.folder = f"tarn_lines_{uuid.uuid4().hex}", shared_folder(spark)
        self.buckets, self.written = partitions(spark), 0
        self.levels: list[list[str]] = []
        _WRITTEN.append(self)

    def discard(self) -> None:
        """Drops every run, those included that a compaction was about."""
        for k in range(1, self.written + 1):
            self._drop(f"{self.name}_{k}")

    def _write(self, counts: DataFrame) -> str:
        self.written += 1
        name = f"{self.name}_{self.written}"
        dealt = counts.repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _push(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._summed(old))
            for name in old:
                self._drop(name)
            self._push(merged, level + 1)

    def _summed(self, runs: list[str]) -> DataFrame:
        """Runs merged two by two. They are bucketed alike, so this needs no shuffle. (Not a union: Spark 4.1 takes
        a union of bucketed scans for partitioned by the key and then leaves a key's rows apart.)"""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            n_docs = F.coalesce(a["n_docs"], F.lit(0)) + F.coalesce(b["n_docs"], F.lit(0))
            return a.join(b.hint("merge"), ["h1", "h2"], "full_outer").select("h1", "h2", n_docs.alias("n_docs"))

        return reduce(merge, [self.spark.table(name) for name in runs])

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        Scratch.drop_path(self.spark, f"{self.folder}/{name}")

    def add(self, keys: DataFrame) -> None:
        """A batch: (h1, h2) once for each document and key. Keys already common need no more counting."""
        counts = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        for run in (name for level in self.levels for name in level):
            common = self.spark.table(run).filter(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            counts = counts.join(common.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(self._write(counts), 0)

    def common(self) -> DataFrame:
        """(h1, h2) of the keys that at least ``min_docs`` documents have."""
        runs = [name for level in self.levels for name in level]
        return self._summed(runs).filter(F.col("n_docs") >= self.min_docs).select("h1", "h2")

    def close(self) -> None:
        for name in [name for level in self.levels for name in level]:
            self._drop(name)
        self.levels = []


@tidy
def mark_common_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES) -> tuple[DataFrame, str, str]:
    """The documents and the positions (from 0) of their common lines, null where there are none.

    Gives the frame and the names of two added columns (free in the input): a digest of the text, and the positions.
    Hashes travel, texts only where the result is made: a common line's text is never shuffled by its key.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("digest"), keys_of(F.col(text)).alias("keys"))
    batch = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(batches)).cast("int")
    keyed = scratch.write(source.withColumn("batch", batch), "keys", ("batch",))
    runs = LineRuns(spark, min_docs)
    for k in range(batches):
        once = keyed.filter(F.col("batch") == k).select(F.explode(F.array_distinct("keys")).alias("k")).filter("k is not null")
        runs.add(once.select("k.h1", "k.h2"))
    common = scratch.write(runs.common(), "common")
    runs.close()
    at = keyed.select("doc_id", "digest", F.posexplode("keys").alias("at", "k")).select("doc_id", "digest", "at", "k.h1", "k.h2")
    dropped = at.join(common, ["h1", "h2"], "left_semi").groupBy("doc_id", "digest").agg(F.collect_set("at").alias("at"))
    digest, positions = _free("digest", docs.columns), _free("common_lines", docs.columns)
    dropped = dropped.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("at").alias(positions))
    whole = docs.withColumn(digest, F.xxhash64(F.col(text).cast("string")))
    joined = whole.join(dropped, whole[doc_id].eqNullSafe(dropped["__id"]) & (whole[digest] == dropped["__digest"]), "left")
    return joined.drop("__id", "__digest"), digest, positions


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {x.lower() for x in taken}:
        name = f"_{name}"
    return name


def _kept(text: Column, lines: Column, positions: Column) -> Column:
    """The text without the lines at ``positions``, in time linear in the lines where ``lines`` is a column that is there already."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
    return F.when(positions.isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))


def drop_common_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, all columns, with their common lines removed from the text."""
    marked, _, positions = mark_common_lines(docs, doc_id=doc_id, text=text, min_docs=min_docs)
    lines = _free("lines", marked.columns)
    return marked.withColumn(lines, lines_of(F.col(text))).withColumn(text, _kept(F.col(text), F.col(lines), F.col(positions))).select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, _, positions = mark_common_lines(docs)
    return marked.withColumn("lines", lines_of(F.col("text"))).select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size(positions), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(_kept(F.coalesce("text", F.lit("")), F.col("lines"), F.col(positions)), 256).alias("kept_sha256"),
    )


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM lines
), common AS (
  SELECT k FROM (SELECT DISTINCT doc_id, k FROM keyed WHERE k <> '') GROUP BY k HAVING count(*) >= {MIN_DOCS}
)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k GROUP BY doc_id
"""
