from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import Engine
from ..plans import Plan
from ..plans.nodes import Cross, Filter, HashJoin, Project, Scan, Sort


def _sorts(plan: Plan) -> bool:
    match plan:
        case Sort():
            return True
        case Filter(_, child) | Project(_, child):
            return _sorts(child)
        case Cross(left, right) | HashJoin(left, right, _, _):
            return _sorts(left) or _sorts(right)
        case Scan():
            return False
    raise TypeError(f"not a plan: {plan!r}")


def run_stream(plan: Plan, tables: Mapping[str, DataFrame]) -> DataFrame:
    """A streaming DataFrame of the plan's rows. ValueError for a plan with a sort."""
    if _sorts(plan):
        raise ValueError("an unbounded result cannot be sorted; use run_on_batches")
    return Engine(tables).run(plan)


def run_on_batches(plan: Plan, stream_table: str, stream: DataFrame, tables: Mapping[str, DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that runs the plan on each micro-batch of one table (the others are static) and hands the rows to ``sink``."""

    def on_batch(batch: DataFrame, number: int) -> None:
        sink(Engine({**{t: tables[t] for t in tables}, stream_table: batch}).run(plan), number)

    return stream.writeStream.foreachBatch(on_batch)
