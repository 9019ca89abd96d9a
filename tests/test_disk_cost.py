import math

import pytest

from pyspark.sql import functions as F

from tarn.functions.disk_cost import Disk, request_times, run_totals


def test_requests(spark):
    d = Disk()
    per = d.blocks_per_track * d.heads
    trace = [("a", 0, 1, 4), ("a", 1, 5, 3), ("a", 2, 9 * per, 1), ("a", 3, 10 * per, per + 1), ("a", 4, 0, 0), ("b", 0, per, 2)]
    rows = {(r.device, r.seq): r for r in request_times(spark.createDataFrame(trace, "device string, seq int, start_block long, num_blocks long")).collect()}
    assert len(rows) == 5
    half = 0.5 * 60_000 / 7200
    got = lambda k: (rows[k].seek_ms, rows[k].rotation_ms, rows[k].transfer_ms)
    assert got(("a", 0)) == (0, 0, pytest.approx(4 * 4096 / 150e3))
    assert got(("a", 1)) == (0, 0, pytest.approx(3 * 4096 / 150e3))
    assert got(("a", 2))[:2] == (pytest.approx(0.8 + 17.2 * math.sqrt(9 / 500_000)), half)
    assert got(("a", 3))[:2] == (pytest.approx(0.8 + 0.8), half)
    assert got(("b", 0))[:2] == (0.8, half)


def test_totals(spark):
    d = Disk()
    per = d.blocks_per_track * d.heads
    trace = spark.createDataFrame([("a", 0, 1, 4), ("a", 1, 9 * per, 1), ("a", 2, 10 * per, per + 1)], "device string, seq int, start_block long, num_blocks long")
    got = run_totals(request_times(trace), F.col("seq") == 1).first().asDict()
    move, seek, turn = (4 + 1 + per + 1) * 4096 / 150, 800 + 17_200 * math.sqrt(9 / 500_000) + 800 + 800, 2 * 0.5 * 60e6 / 7200
    assert [got[f"total_{k}"] for k in ("reads", "writes", "blocks_processed", "cylinders_traveled")] == [2, 1, per + 6, 9 + 1 + 1]
    assert [got[f"total_{k}_time_us"] for k in ("seek", "transfer", "io")] == [int(seek), int(move), int(seek + move + turn)]
    assert got["total_rotational_latency_us"] == int(turn)
    assert set(run_totals(request_times(trace.limit(0))).first()) == {0}
