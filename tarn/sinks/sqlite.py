"""Tables into a SQLite file, in batches of bound parameters."""

from __future__ import annotations

import sqlite3
from itertools import batched

from pyspark.sql import DataFrame

BATCH = 1024
_TYPES = {"int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT"}


def write_sqlite(tables: dict[str, DataFrame], path: str) -> None:
    quote = lambda name: '"' + name.replace('"', '""') + '"'
    with sqlite3.connect(path) as db:
        for table, df in tables.items():
            columns = ", ".join(f"{quote(n)} {_TYPES.get(k, 'TEXT')}" for n, k in df.dtypes)
            db.execute(f"DROP TABLE IF EXISTS {quote(table)}")
            db.execute(f"CREATE TABLE {quote(table)} ({columns})")
            insert = f"INSERT INTO {quote(table)} VALUES ({', '.join('?' * len(df.columns))})"
            for rows in batched((tuple(r) for r in df.toLocalIterator()), BATCH):
                db.executemany(insert, rows)
    db.close()
