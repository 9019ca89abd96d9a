"""Shared storage and session details for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that a Python worker is handed at once.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Bytes of input (as its files have them) in a hash bucket, at most about: a task holds a bucket's texts.
BUCKET_BYTES = 128 << 20
#: Spark's bound on the buckets of a table, and the size from which on an estimate says that the size is not known.
MOST_BUCKETS, UNKNOWN_BYTES = 100_000, 1 << 52
MOST_EVEN = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where none is and all run on one machine (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tarn-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Long texts must not add up in a worker: bound the Arrow batches of this session."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        with contextlib.suppress(Exception):  # a build without the byte bound keeps the row bound
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


#: What the operators that run just now have written, for ``tidy``.
_WRITTEN: list = []


def tidy(operator: Callable) -> Callable:
    """An operator that fails leaves no tables and folders behind (what it returns stays: its frames read it)."""

    @functools.wraps(operator)
    def inner(*args, **kwargs):
        mark = len(_WRITTEN)
        try:
            return operator(*args, **kwargs)
        except BaseException:
            for held in _WRITTEN[mark:]:
                with contextlib.suppress(Exception):  # the first error is the one to tell
                    held.discard()
            raise
        finally:
            if not mark:
                _WRITTEN.clear()

    return inner


def _trim() -> None:
    """Gives a Python worker's free memory back, which its allocators keep otherwise while it waits for more work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def over_batches(work: Callable) -> Callable:
    """A function of a stream of batches that gives memory back at its end."""

    def inner(stream: Iterator) -> Iterator:
        try:
            yield from work(stream)
        finally:
            _trim()

    return inner


def over_group(work: Callable) -> Callable:
    def inner(group):
        try:
            return work(group)
        finally:
            _trim()

    return inner


def over_groups(work: Callable) -> Callable:
    def inner(left, right):
        try:
            return work(left, right)
        finally:
            _trim()

    return inner


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive lost executors.

    ``drop`` deletes one early; what is returned to a caller is kept.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/tarn-{name}-{uuid.uuid4().hex}"
        _WRITTEN.append(self)

    def discard(self) -> None:
        self.drop_path(self.spark, self.path)

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        target = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.drop_path(self.spark, f"{self.path}/{name}")

    @staticmethod
    def drop_path(spark: SparkSession, name: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that Spark's hash partitioning deals to n partitions, one to each.

    Groups named 0, 1, 2, ... would leave a third of the partitions empty and give others two or three. (Beyond
    ``MOST_EVEN`` they are named so: there are more of them than partitions then.)
    """
    if n > MOST_EVEN:
        return list(range(n))
    found: dict[int, int] = {}
    begin, step = 0, 16 * n + 64
    while len(found) < n:
        rows = spark.range(begin, begin + step).groupBy(F.expr(f"pmod(hash(id), {n})").alias("p")).agg(F.min("id").alias("id"))
        for row in rows.collect():
            found.setdefault(row["p"], row["id"])
        begin += step
    return [found[p] for p in range(n)]


class Bucketed:
    """Rows in hash buckets (column ``bucket``), written once as a table of the shared folder, a file a bucket.

    ``groupBy("bucket")`` on ``frame`` reads them in place, however often, without a shuffle.
    """

    def __init__(self, source: DataFrame, by: tuple, keys: list[int]) -> None:
        self.spark = source.sparkSession
        self.name = f"tarn_buckets_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        _WRITTEN.append(self)
        place = F.pmod(F.xxhash64(*by), F.lit(len(keys)))
        named = place if len(keys) > MOST_EVEN else F.get(F.array(*(F.lit(k).cast("bigint") for k in keys)), place.cast("int"))
        source = source.withColumn("bucket", named)
        # by bucket first: else each task writes a file for each bucket, the square of the input in files
        source.repartition(len(keys), "bucket").write.bucketBy(len(keys), "bucket").option("path", self.path).saveAsTable(self.name)
        self.frame = self.spark.table(self.name)
        del source
        release(self.spark)

    def discard(self) -> None:
        self.drop()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        Scratch.drop_path(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referred to, before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle: what the session (or cluster) sets for its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def buckets(source: DataFrame) -> int:
    """Hash buckets for an input: one a partition, more where that makes them larger than ``BUCKET_BYTES`` (as far as Spark knows
    the input's size, and as many as it allows a table)."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // BUCKET_BYTES) if size < UNKNOWN_BYTES else 1
    return max(partitions(source.sparkSession), min(wanted, MOST_BUCKETS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(stream: Iterator) -> Iterator:
    """Only batches with rows."""
    return (b for b in stream if b.num_rows)
