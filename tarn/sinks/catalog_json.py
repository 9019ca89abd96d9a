"""The catalog document of some tables: names, declared types and statistics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..functions.statistics import profile
from ..sources.catalog import NAMES


def write_catalog(tables: dict[str, DataFrame], with_statistics: bool = True) -> str:
    specs = []
    for table, df in tables.items():
        stats = profile(df) if with_statistics else {}
        columns = [{"column_name": n, "data_type": NAMES.get(k, k), "stats": stats.get(n) or None} for n, k in df.dtypes]
        specs.append({"name": table, "file_id": table, "column_specs": columns})
    return json.dumps({"table_specs": specs}, indent=2)
