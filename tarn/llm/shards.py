"""Sharding by sampled splitters. DataFrame operations only.

A size-weighted sample of the records' keys gives quantile boundaries; records are dealt to the ranges
between them. A key that fills more than a range gets one of its own. A range that proves overfull is subdivided: by a second
hash of the key, so that equal texts stay together, or where it holds a single key by a hash of id and row. Exact sums over
ranges then give every record its place in one global order, and shard s takes what begins in the s-th of equal
stretches of bytes (law ``bytes``).

The key is a hash of the text, so equal texts stand together; such a group is cut between shards only
when it is larger than the largest single record. Shard sizes differ from the mean by that size at most.

Defined cases: a null text has size 1 and the checksum of the empty text; repeated rows are placed
each; with fewer records than shards some shards stay empty; an empty table gives an empty result; only
id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, partitions, table, tidy

SHARDS = 8
#: Ranges are this many times the session's shuffle partitions, within bounds.
RANGES_A_PARTITION, LEAST_RANGES, MOST_RANGES = 8, 64, 4096
#: Sampled keys for each range (the sample that reaches the driver has a fixed bound in expectation).
SAMPLES_A_RANGE = 16
#: A range this many times as large as planned is subdivided.
OVERFULL = 2
_LAST = (1 << 63) - 1


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are not above the key: a binary search."""
    steps = max(1, math.ceil(math.log2(len(splitters) + 1)))
    padded = F.array(*map(F.lit, [*splitters, *[_LAST] * ((1 << steps) - 1 - len(splitters))]))
    return F.aggregate(
        F.array(*(F.lit(1 << k) for k in reversed(range(steps)))),
        F.lit(0),
        lambda low, step: F.when(F.get(padded, low + step - 1) <= key, low + step).otherwise(low),
    )


def _splitters(keyed: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of a size-weighted key sample. A key that spans several becomes a range of its own."""
    rate = ranges * SAMPLES_A_RANGE / max(total, 1)
    drawn = F.pmod(F.xxhash64("tie", "key", "doc_id"), F.lit(1 << 40)) < F.col("size") * F.lit(rate * (1 << 40))
    weight = F.greatest(F.lit(1), F.floor(F.col("size") * rate)).cast("int")
    sample = sorted(k for k, n in keyed.filter(drawn).select("key", weight).collect() for _ in range(n))
    cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    hot = {a for a, b in zip(cuts, cuts[1:], strict=False) if a == b}
    return sorted({*cuts, *(k + 1 for k in hot if k < _LAST)})


@tidy
def shard_documents(docs: DataFrame, *, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (from 0), slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = scratch.write(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(whole) + 1).cast("bigint").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.xxhash64(whole).alias("key"),
            F.xxhash64(F.lit("tie"), F.col(doc_id)).alias("tie"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "keyed",
    )
    total, largest = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ranges = min(max(RANGES_A_PARTITION * partitions(spark), LEAST_RANGES), MOST_RANGES)
    dealt = keyed.withColumn("range", _range_of(F.col("key"), _splitters(keyed, total, ranges)))
    dealt = scratch.write(dealt, "dealt")

    # overfull ranges: as many parts as they hold planned sizes; at most about as many in all as there are ranges
    planned = max(1, total // ranges)
    parts = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), (F.min("key") == F.max("key")).alias("single"))
    parts = parts.select("range", "single", F.when(F.col("bytes") > OVERFULL * planned, F.ceil(F.col("bytes") / planned)).otherwise(1).cast("int").alias("parts"))
    second = F.when(F.col("single"), F.xxhash64("tie", "row")).otherwise(F.xxhash64(F.lit("part"), "key"))
    dealt = dealt.join(F.broadcast(parts), "range").withColumn("part", F.when(F.col("parts") > 1, F.pmod(second, F.col("parts"))).otherwise(0).cast("int"))

    # exact sums: one row for each part of a range, a number bounded by MOST_RANGES
    before, whole = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("range")
    offsets = dealt.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = offsets.withColumn("bytes_before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    offsets = offsets.select("range", "part", "bytes_before", "rows_before", F.sum("bytes").over(whole).alias("range_bytes"), F.min("bytes_before").over(whole).alias("range_before"))
    inside = Window.partitionBy("range", "part").orderBy("key", "tie", "row")
    group = Window.partitionBy("range", "part", "key")
    placed = dealt.join(F.broadcast(offsets), ["range", "part"])
    placed = placed.withColumn("rank", F.col("rows_before") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("at", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # a group of equal texts begins where its first record does: in a range of its own over all its parts
    own = F.col("single") & (F.col("parts") > 1)
    small = F.when(own, F.col("range_bytes")).otherwise(F.sum("size").over(group)) <= largest
    begins = F.when(small, F.when(own, F.col("range_before")).otherwise(F.min("at").over(group))).otherwise(F.col("at"))
    placed = placed.withColumn("shard", F.floor(begins * shards / F.lit(max(total, 1))).cast("int"))
    placed = scratch.write(placed.select("doc_id", "size", "text_crc32", "shard", "rank"), "placed")
    scratch.drop("keyed", "dealt")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def op8_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
