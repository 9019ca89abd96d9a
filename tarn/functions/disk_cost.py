"""The time that a disk with heads and platters takes for a trace of block requests: seek, rotation and transfer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Disk:
    # fixed values: the modelled disk
    block_bytes: int = 4096
    rpm: int = 7200
    blocks_per_track: int = 1024
    heads: int = 4
    cylinders: int = 500_000
    track_seek_ms: float = 0.8
    full_seek_ms: float = 18.0
    transfer_mb_s: float = 150.0


def request_times(trace: DataFrame, disk: Disk | None = None, device: str = "device") -> DataFrame:
    """trace: device, seq, start_block, num_blocks. Adds cylinders (passed to and within), seek_ms, rotation_ms and transfer_ms of
    each request.

    A seek costs the root of the share of cylinders passed, between a track's and a full stroke's time; a request that does
    not follow the one before on its device waits half a turn; each cylinder border crossed costs a track's seek.
    """
    d = disk or Disk()
    per_cylinder = d.blocks_per_track * d.heads
    order = Window.partitionBy(device).orderBy("seq")
    end = F.col("start_block") + F.col("num_blocks") - 1
    cylinder = lambda block: F.floor(block / per_cylinder)
    before = F.coalesce(F.lag(end).over(order), F.lit(0))
    distance = F.abs(cylinder(F.col("start_block")) - cylinder(before))
    ratio = F.least(F.lit(1.0), distance / d.cylinders)
    seek = F.when(distance == 0, 0.0).when(distance == 1, d.track_seek_ms).otherwise(d.track_seek_ms + (d.full_seek_ms - d.track_seek_ms) * F.sqrt(ratio))
    crossed = cylinder(end) - cylinder(F.col("start_block"))
    return trace.filter("num_blocks > 0").select(
        "*",
        (distance + crossed).alias("cylinders"),
        (seek + crossed * d.track_seek_ms).alias("seek_ms"),
        F.when(F.col("start_block") == before + 1, 0.0).otherwise(0.5 * 60_000 / d.rpm).alias("rotation_ms"),
        (F.col("num_blocks") * d.block_bytes / 1e6 / d.transfer_mb_s * 1000).alias("transfer_ms"),
    )


def run_totals(requests: DataFrame, is_write: Column | None = None) -> DataFrame:
    """One row over requests with times: reads, writes, blocks, cylinders, and io, seek, rotation and transfer time in whole
    microseconds (of times rounded to nanoseconds each). Without ``is_write`` all requests are reads; without requests all are 0."""
    write = F.coalesce(is_write, F.lit(False)) if is_write is not None else F.lit(False)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    seek, rotation, transfer = (F.round(F.col(f"{kind}_ms") * 1e6).cast("bigint") for kind in ("seek", "rotation", "transfer"))
    micro = lambda ns: F.floor(total(ns) / 1000).cast("bigint")
    return requests.agg(
        total((~write).cast("int")).alias("total_reads"),
        total(write.cast("int")).alias("total_writes"),
        total("num_blocks").alias("total_blocks_processed"),
        total("cylinders").alias("total_cylinders_traveled"),
        micro(seek + rotation + transfer).alias("total_io_time_us"),
        micro(seek).alias("total_seek_time_us"),
        micro(rotation).alias("total_rotational_latency_us"),
        micro(transfer).alias("total_transfer_time_us"),
    )
