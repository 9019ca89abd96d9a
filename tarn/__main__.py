"""Command line: run a query document, or compile a folder of delimited text.

    python -m tarn query  --tables FOLDER QUERY.json      result text of a plan over FOLDER/*.parquet or delimited text
    python -m tarn query  --config CATALOG.json QUERY.json  the same over the row-block files beside a catalog document
    python -m tarn show   QUERY.json                      the plan, indented
    python -m tarn blocks --tables FOLDER --out FOLDER    row-block files
    python -m tarn catalog --tables FOLDER --out FOLDER   a catalog document with statistics
    python -m tarn sqlite --tables FOLDER --out FOLDER    a SQLite file
    python -m tarn all    --tables FOLDER --out FOLDER    the last three
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import Engine
from .plans import from_json, to_json
from .sinks import write_catalog, write_sqlite, write_text
from .sources import Catalog, discover, read_delimited, read_row_blocks, write_row_blocks


def open_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Delimited text with schemas, and Parquet, by stem."""
    tables = {name: read_delimited(spark, data, schema) for name, (data, schema) in discover(spark, folder).items()}
    return tables | {p.stem: spark.read.parquet(str(p)) for p in sorted(Path(folder).glob("*.parquet"))}


def open_catalog(spark: SparkSession, document: Path) -> Catalog:
    """The tables of a catalog document: ``<file id>.bin`` in its folder."""
    return Catalog.from_json(document.read_text(), lambda file_id, schema: read_row_blocks(spark, str(document.parent / f"{file_id}.bin"), schema))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarn", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["query", "show", "blocks", "catalog", "sqlite", "all"])
    parser.add_argument("query", nargs="?")
    parser.add_argument("--tables")
    parser.add_argument("--config", type=Path)
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    if args.command in ("query", "show") and not args.query:
        parser.error("a query document is needed")
    if args.command == "show":
        print(to_json(from_json(Path(args.query).read_text()), pretty=True))
        return 0
    by_config = args.command == "query" and args.config
    if not by_config and (not args.tables or (args.command != "query" and not args.out)):
        parser.error("--tables (or --config to query), and --out to compile, are needed")
    spark = SparkSession.builder.appName("tarn").getOrCreate()
    tables = open_catalog(spark, args.config) if by_config else open_folder(spark, args.tables)
    if args.command == "query":
        write_text(Engine(tables).run(Path(args.query).read_text()), sys.stdout)
        return 0
    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    if args.command in ("blocks", "all"):
        for name, df in tables.items():
            write_row_blocks(df, str(out / f"{name}.bin"))
    if args.command in ("catalog", "all"):
        (out / "catalog.json").write_text(write_catalog(tables))
    if args.command in ("sqlite", "all"):
        write_sqlite(tables, str(out / "tables.db"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
