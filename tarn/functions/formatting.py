"""The text form of values: whole numbers plain; reals in the fewest digits that round-trip, never with an exponent and always
with a decimal point; each value followed by ``|``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_value(value: object, single: bool = False) -> str:
    """single: the value is of 32 bits. NaN prints as ``NaN.0``, infinity as ``inf``; null (an extension) as nothing."""
    if value is None or value is pd.NaT:
        return ""
    if isinstance(value, float | np.floating):
        if np.isnan(value):
            return "NaN.0"
        if np.isinf(value):
            return "inf" if value > 0 else "-inf"
        return np.format_float_positional(np.float32(value) if single else np.float64(value), unique=True, trim="0")
    return str(value)


def format_reals(column: pa.Array) -> pa.Array:
    """The text of a column of reals. Arrow gives the fewest digits; only what it writes with an exponent, NaN and infinity are
    written value by value."""
    text, single = pc.cast(column, pa.string()), pa.types.is_float32(column.type)
    odd = pc.fill_null(pc.match_substring_regex(text, "[a-z]"), False)
    text = pc.if_else(pc.match_substring(text, "."), text, pc.binary_join_element_wise(text, pa.scalar(".0"), ""))
    text = pc.fill_null(text, "")
    if pc.any(odd).as_py():
        text = pc.replace_with_mask(text, odd, pa.array([format_value(x, single) for x in column.filter(odd).to_pylist()], pa.string()))
    return text


def format_rows(df: DataFrame) -> DataFrame:
    """A column ``line`` with the rows' text, in order."""
    kinds = [f.dataType for f in df.schema]
    names = [f"v{i}" for i in range(len(kinds))]
    # strings and whole numbers are cast by Spark; reals, whose text there is not always the shortest, by Arrow
    reals = [isinstance(k, T.FloatType | T.DoubleType) for k in kinds]
    plain = df.toDF(*names).select(*(F.col(n) if r else F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n, r in zip(names, reals, strict=True)))
    if not any(reals):
        return plain.select(F.concat(*(x for n in names for x in (F.col(n), F.lit("|")))).alias("line") if names else F.lit("").alias("line"))

    def lines(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [format_reals(c) if r else c.cast(pa.string()) for c, r in zip(batch.columns, reals, strict=True)]
            line = pc.binary_join_element_wise(*texts, "", "|")  # an empty last one: each value is followed by a bar
            yield pa.RecordBatch.from_arrays([line], ["line"])

    return plain.mapInArrow(lines, "line string")
