"""Where results and catalogs go: pipe-delimited text, SQLite, a catalog document."""

from .catalog_json import write_catalog
from .sqlite import write_sqlite
from .text import result_lines, write_text

__all__ = ["result_lines", "write_catalog", "write_sqlite", "write_text"]
