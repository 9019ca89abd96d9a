"""Query plans: six operators, typed literals, a fluent builder and a JSON form."""

from .json_format import PlanFormatError, from_json, to_json
from .nodes import ColumnRef, Cross, Filter, HashJoin, Literal, Operator, Plan, Predicate, Project, Scan, Sort, SortKey, scan

__all__ = ["ColumnRef", "Cross", "Filter", "HashJoin", "Literal", "Operator", "Plan", "PlanFormatError", "Predicate", "Project", "Scan", "Sort", "SortKey", "from_json", "scan", "to_json"]
