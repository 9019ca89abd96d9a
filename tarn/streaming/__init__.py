"""Plans over streaming tables.

Scan, filter, project and joins of a plan run unchanged on streaming DataFrames; sorts need a bounded
input, so a plan that sorts runs on each micro-batch.
"""

from .plans import run_on_batches, run_stream

__all__ = ["run_on_batches", "run_stream"]
