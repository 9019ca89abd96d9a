"""From plan nodes to DataFrames. Filters over products become joins, predicates and columns reach the scan, and join orders and
sides are chosen by Catalyst and adaptive execution. One physical choice is made here: products by order alone (``ordered``)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import from_json
from ..plans.nodes import Cross, Filter, HashJoin, Plan, Project, Scan, Sort
from .ordered import ordered_product
from .predicates import conjunction, equal
from .relation import Field, PlanError, Relation


def compile_plan(plan: Plan, tables: Mapping[str, DataFrame], wanted: tuple[str, ...] | None = None) -> Relation:
    """wanted: the columns that will be resolved in the result, if not all."""
    match plan:
        case Scan(table):
            if table not in tables:
                raise PlanError(f"no table {table!r}")
            return Relation.of(tables[table])
        case Filter(predicates, child):
            while isinstance(child, Filter):
                predicates, child = predicates + child.predicates, child.child
            if isinstance(child, Cross):
                a, b = compile_plan(child.left, tables), compile_plan(child.right, tables)
                if found := ordered_product(a, b, predicates, wanted):
                    return found
                below = Relation(a.df.crossJoin(b.df), a.fields + b.fields)
            else:
                below = compile_plan(child, tables)
            condition = conjunction(below, predicates)
            return below if condition is None else Relation(below.df.filter(condition), below.fields)
        case Project(columns, child):
            below = compile_plan(child, tables, tuple(name for name, _ in columns))
            found = [(below.resolve(name), to) for name, to in columns]
            return Relation(below.df, tuple(Field(to, f.id, f.type) for f, to in found))
        case Cross(left, right):
            a, b = compile_plan(left, tables), compile_plan(right, tables)
            return Relation(a.df.crossJoin(b.df), a.fields + b.fields)
        case HashJoin(left, right, left_column, right_column):
            a, b = compile_plan(left, tables), compile_plan(right, tables)
            condition = equal(a.resolve(left_column), b.resolve(right_column))
            return Relation(a.df.join(b.df, condition, "inner"), a.fields + b.fields)
        case Sort(keys, child):
            below = compile_plan(child, tables)
            order = [(F.col(below.resolve(k.column).id), k.ascending) for k in keys]
            return Relation(below.df.orderBy(*(c.asc() if up else c.desc() for c, up in order)), below.fields) if order else below
    raise TypeError(f"not a plan: {plan!r}")


class Engine:
    """Runs plans, or their JSON, over named tables."""

    def __init__(self, tables: Mapping[str, DataFrame]) -> None:
        self.tables = tables

    def run(self, query: Plan | str) -> DataFrame:
        plan = from_json(query) if isinstance(query, str) else query
        return compile_plan(plan, self.tables).to_df()
