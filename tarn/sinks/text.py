"""Result streams: a line a row, in the query's order, and ``!`` at the end."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame

from ..functions.formatting import format_rows

END = "!"


def result_lines(df: DataFrame) -> Iterator[str]:
    """Lines as they come, one partition at a time on the driver."""
    for row in format_rows(df).toLocalIterator():
        yield row["line"]
    yield END


def write_text(df: DataFrame, out: TextIO) -> int:
    """Writes the stream; gives the number of rows."""
    count = -1
    for line in result_lines(df):
        out.write(f"{line}\n")
        count += 1
    return count
