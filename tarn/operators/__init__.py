"""Plans compiled to DataFrames."""

from .compiler import Engine, compile_plan
from .relation import PlanError, Relation

__all__ = ["Engine", "PlanError", "Relation", "compile_plan"]
