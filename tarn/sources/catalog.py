"""Table ids and what they stand for. Tables are opened when first used."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Declared type names of the catalog document. Fixed values of the format.
TYPES: dict[str, T.DataType] = {"Int32": T.IntegerType(), "Int64": T.LongType(), "Float32": T.FloatType(), "Float64": T.DoubleType(), "String": T.StringType()}
NAMES = {kind.simpleString(): name for name, kind in TYPES.items()}


#: Statistics a column may have. Fixed values of the format.
STATISTICS = ("IsPhysicallyOrdered", "RangeStat", "HistogramStat", "CardinalityStat", "DensityStat")


def read_statistics(stats: list | None) -> dict[str, object]:
    """Statistics of a column by name, bounds as plain values; ValueError where one is of no known form.

    ``RangeStat``: (lower, upper). ``HistogramStat``: a list of (lower, upper, frequency).
    """

    def value(data: dict) -> object:
        ((tag, held),) = data.items()
        if tag not in TYPES:
            raise ValueError(f"unknown type {tag!r}")
        return held

    def bounds(span: dict) -> tuple:
        return value(span["lower_bound"]), value(span["upper_bound"])

    out: dict[str, object] = {}
    for stat in stats or ():
        ((name, held),) = [(stat, True)] if isinstance(stat, str) else stat.items()
        if name not in STATISTICS:
            raise ValueError(f"unknown statistic {name!r}")
        if name == "RangeStat":
            held = bounds(held)
        elif name == "HistogramStat":
            held = [(*bounds(span), n) for span, n in held["frequency_points"]]
        out[name] = held
    return out


class Catalog(Mapping[str, DataFrame]):
    def __init__(self, sources: Mapping[str, Callable[[], DataFrame]], statistics: Mapping[str, dict[str, dict[str, object]]] | None = None) -> None:
        self._sources, self._open = dict(sources), {}
        #: table -> column -> statistics that its document declares
        self.statistics = dict(statistics or {})

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._open:
            self._open[table] = self._sources[table]()
        return self._open[table]

    def __iter__(self) -> Iterator[str]:
        return iter(self._sources)

    def __len__(self) -> int:
        return len(self._sources)

    def __contains__(self, table: object) -> bool:
        return table in self._sources

    @classmethod
    def from_json(cls, text: str, open_table: Callable[[str, T.StructType], DataFrame]) -> Catalog:
        """From a catalog document: ``table_specs`` with ``file_id`` and ``column_specs`` (``column_name``, ``data_type``, ``stats``
        or none). ``open_table`` gets the file id and the declared schema."""
        sources, statistics = {}, {}
        for spec in json.loads(text)["table_specs"]:
            schema = T.StructType([T.StructField(c["column_name"], TYPES[c["data_type"]]) for c in spec["column_specs"]])
            sources[spec["file_id"]] = lambda file_id=spec["file_id"], schema=schema: open_table(file_id, schema)
            statistics[spec["file_id"]] = {c["column_name"]: read_statistics(c.get("stats")) for c in spec["column_specs"]}
        return cls(sources, statistics)


def parquet_folder(spark: SparkSession, folder: str, tables: list[str]) -> Catalog:
    """Tables ``<folder>/<table>.parquet``."""
    return Catalog({t: lambda t=t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables})
