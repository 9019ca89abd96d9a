"""Where tables come from: Parquet, delimited text with a declared schema, row-block files; and the catalog."""

from .catalog import Catalog, parquet_folder, read_statistics
from .delimited import discover, read_delimited, read_schema
from .rowblock import pack_row_blocks, read_row_blocks, write_row_block_parts, write_row_blocks

__all__ = ["Catalog", "discover", "pack_row_blocks", "parquet_folder", "read_delimited", "read_row_blocks", "read_schema", "read_statistics", "write_row_block_parts", "write_row_blocks"]
