"""Row-block files: blocks of a fixed size, rows packed from the start, the number of rows in the last two bytes.

Numbers are little-endian, strings UTF-8 with a NUL at the end. A row lies in one block, so each block decodes on
its own and files split at block boundaries.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values of the format
BLOCK_BYTES = 4096
_CODES = {"int": "<i", "bigint": "<q", "float": "<f", "double": "<d"}


def codes(schema: T.StructType) -> list[str | None]:
    """The struct code of each column; None for strings."""
    unknown = [f.name for f in schema if f.dataType.simpleString() not in (*_CODES, "string")]
    if unknown:
        raise ValueError(f"row blocks hold no such types: {unknown}")
    return [_CODES.get(f.dataType.simpleString()) for f in schema]


def decode_block(block: bytes, columns: list[str | None]) -> Iterator[tuple]:
    (rows,) = struct.unpack_from("<H", block, len(block) - 2)
    at = 0
    for _ in range(rows):
        row = []
        for code in columns:
            if code is None:
                end = block.index(0, at)
                row.append(block[at:end].decode())
                at = end + 1
            else:
                row.append(struct.unpack_from(code, block, at)[0])
                at += struct.calcsize(code)
        yield tuple(row)


def decode_blocks(blocks: list[bytes], columns: list[str | None], names: list[str]) -> pd.DataFrame:
    """The rows of some blocks: rows of numbers only have one width and are read as arrays, others a value at a time."""
    if None in columns:
        return pd.DataFrame([row for b in blocks for row in decode_block(b, columns)], columns=names)
    record = np.dtype([(f"f{i}", code) for i, code in enumerate(columns)])
    parts = [np.frombuffer(b, record, struct.unpack_from("<H", b, len(b) - 2)[0]) for b in blocks]
    rows = np.concatenate(parts) if parts else np.zeros(0, record)
    return pd.DataFrame(dict(zip(names, (rows[f"f{i}"] for i in range(len(columns))), strict=True)), columns=names)


def encode_row(row: tuple, columns: list[str | None]) -> bytes:
    parts = []
    for value, code in zip(row, columns, strict=True):
        if value is None:
            raise ValueError("row blocks hold no nulls")
        if code is None:
            raw = value.encode()
            if 0 in raw:
                raise ValueError("row blocks hold no NUL in strings")
            parts.append(raw + b"\0")
        else:
            parts.append(struct.pack(code, value))
    return b"".join(parts)


def read_row_blocks(spark: SparkSession, path: str, schema: T.StructType, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Reads by Spark's fixed-length records, so from any file system and split at blocks."""
    columns, names = codes(schema), schema.names
    blocks = spark.createDataFrame(spark.sparkContext.binaryRecords(path, block_bytes).map(lambda b: (b,)), "block binary")

    def decode(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            yield decode_blocks([bytes(b) for b in batch["block"]], columns, names)

    return blocks.mapInPandas(decode, schema)


def pack_row_blocks(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows as blocks, in order: a column ``block``. A partition's last block may be partly filled."""
    columns = codes(df.schema)

    def close(held: list[bytes]) -> bytes:
        return b"".join(held).ljust(block_bytes - 2, b"\0") + struct.pack("<H", len(held))

    def pack(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in stream:
            blocks = []
            for row in batch.itertuples(index=False, name=None):
                raw = encode_row(row, columns)
                if len(raw) > block_bytes - 2:
                    raise ValueError(f"a row of {len(raw)} bytes does not fit into a block of {block_bytes}")
                if size + len(raw) > block_bytes - 2 or len(held) == 0xFFFF:
                    blocks.append(close(held))
                    held, size = [], 0
                held.append(raw)
                size += len(raw)
            yield pd.DataFrame({"block": blocks})
        if held:
            yield pd.DataFrame({"block": [close(held)]})

    return df.mapInPandas(pack, "block binary")


def write_row_blocks(df: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> int:
    """One file; blocks are packed on the executors and pass through the driver one partition at a time. Gives their number."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    count = 0
    try:
        for row in pack_row_blocks(df, block_bytes).toLocalIterator():
            out.write(bytearray(row["block"]))
            count += 1
    finally:
        out.close()
    return count


def write_row_block_parts(df: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> int:
    """A file for each partition, written by the executors (to any file system that Arrow opens); gives the number of blocks.

    A task writes under its attempt's name and renames at its end, so a repeated task replaces its file whole.
    ``folder`` is read back like a file.
    """

    def write(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        own = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base)
        part, n = f"{base}/part-{own.partitionId():05d}.bin", 0
        held = f"{base}/_{own.partitionId():05d}-{own.taskAttemptId()}"
        with system.open_output_stream(held) as out:
            for batch in stream:
                for block in batch["block"]:
                    out.write(bytes(block))
                    n += 1
        if n:
            system.move(held, part)
        else:
            system.delete_file(held)
        yield pd.DataFrame({"blocks": [n]})

    return pack_row_blocks(df, block_bytes).mapInPandas(write, "blocks long").groupBy().sum("blocks").first()[0] or 0
