"""Text with ``|`` between values and a sidecar that declares names and types.

A line is trimmed, all ``|`` at its end are dropped, and it is split at the others; nothing is quoted, and an
empty value inside a line is the empty string. Surplus values are ignored. A blank line, a line with too few values or a number that
does not parse fails the query: nothing is cut short or nulled silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared type keywords (any case). Fixed values of the format.
KEYWORDS: dict[str, T.DataType] = {"I32": T.IntegerType(), "I64": T.LongType(), "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "STRING": T.StringType()}


def parse_schema(text: str) -> T.StructType:
    """Two lines: names, then types."""
    lines = [line.strip().rstrip("|").split("|") for line in text.splitlines() if line.strip()]
    if len(lines) != 2 or len(lines[0]) != len(lines[1]):
        raise ValueError("a schema has a line of names and a line of as many types")
    unknown = [k for k in lines[1] if k.strip().upper() not in KEYWORDS]
    if unknown:
        raise ValueError(f"unknown types {unknown}")
    return T.StructType([T.StructField(n.strip(), KEYWORDS[k.strip().upper()], False) for n, k in zip(*lines, strict=True)])


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    return parse_schema(spark.read.text(path, wholetext=True).first()[0])


def _value(raw: Column, kind: T.DataType, line: Column) -> Column:
    if isinstance(kind, T.StringType):
        return raw
    parsed = raw.try_cast(kind)
    return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit(f"not of type {kind.simpleString()}: "), line))).otherwise(parsed)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """schema: declared, or the path of its sidecar."""
    declared = read_schema(spark, schema) if isinstance(schema, str) else schema
    line = F.col("value")
    values = F.split(F.rtrim(F.trim(line, F.lit(" \t\r\n\x0b\x0c")), F.lit("|")), r"\|")
    lines = spark.read.text(path).withColumn("v", values)
    whole = F.when(F.size("v") < len(declared), F.raise_error(F.concat(F.lit(f"fewer than {len(declared)} values: "), line))).otherwise(F.col("v"))
    rows = lines.select("value", whole.alias("v"))
    return rows.select(*(_value(F.get("v", F.lit(i)), f.dataType, line).alias(f.name) for i, f in enumerate(declared)))


def discover(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """Stem -> (data, schema) for each ``*.csv`` of the folder with a ``.schema`` beside it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = {f.getPath().getName(): f.getPath().toString() for f in files}
    return {n[:-4]: (p, names[f"{n[:-4]}.schema"]) for n, p in sorted(names.items()) if n.endswith(".csv") and f"{n[:-4]}.schema" in names}
