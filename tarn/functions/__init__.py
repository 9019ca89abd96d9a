"""Column statistics and the text form of values."""

from .formatting import format_rows, format_value
from .statistics import cardinality, density, histogram, physical_order, profile, value_range

__all__ = ["cardinality", "density", "format_rows", "format_value", "histogram", "physical_order", "profile", "value_range"]
