"""Comparisons as Spark columns, decided from declared types when the plan is built.

Columns of different types never compare as equal or ordered: Spark would widen them, so such a predicate becomes a
constant. Literals are coerced to the column's type by a fixed table, whole numbers wrapping into 32 bits.
NaN compares with nothing, not even itself. Nulls, where a table has them, follow SQL.
"""

from __future__ import annotations

import operator as op
import struct
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import ColumnRef, Literal, Operator, Predicate
from .relation import Field, PlanError, Relation

_COMPARE = {Operator.EQ: op.eq, Operator.NE: op.ne, Operator.GT: op.gt, Operator.GTE: op.ge, Operator.LT: op.lt, Operator.LTE: op.le}
_REAL = (T.FloatType, T.DoubleType)
_COMPARABLE = (T.IntegerType, T.LongType, *_REAL, T.StringType, T.TimestampType, T.TimestampNTZType)


def _float32(value: float) -> float:
    return struct.unpack("<f", struct.pack("<f", value))[0]


def coerce(literal: Literal, kind: T.DataType) -> Column:
    """The literal as a value of the column's type; PlanError where there is no such value."""
    value = literal.value
    match kind, literal.kind:
        case (T.IntegerType(), "I32") | (T.LongType(), "I32" | "I64") | (T.DoubleType(), "F64") | (T.StringType(), "String"):
            pass
        case T.IntegerType(), "I64":
            value = (value + (1 << 31)) % (1 << 32) - (1 << 31)
        case T.DoubleType(), "I32" | "I64":
            value = float(value)
        case (T.FloatType() | T.DoubleType()), "F32":
            value = _float32(value)
        case (T.TimestampType() | T.TimestampNTZType()), "String":  # beyond the five basic types
            pass
        case _:
            raise PlanError(f"a literal of kind {literal.kind} does not compare with a column of type {kind.simpleString()}")
    return F.lit(value).cast(kind)


def equal(a: Field, b: Field) -> Column:
    return compare(a, Operator.EQ, b)


def compare(a: Field, operator: Operator, b: Field) -> Column:
    for field in (a, b):
        if not isinstance(field.type, _COMPARABLE):
            raise PlanError(f"column {field.name!r} of type {field.type.simpleString()} does not compare")
    if a.type != b.type:
        return F.lit(operator is Operator.NE)
    x, y = F.col(a.id), F.col(b.id)
    out = _COMPARE[operator](x, y)
    if isinstance(a.type, _REAL):
        nan = F.isnan(x) | F.isnan(y)
        out = out | nan if operator is Operator.NE else out & ~nan
    return out


def to_column(relation: Relation, predicate: Predicate) -> Column:
    field = relation.resolve(predicate.column)
    if isinstance(predicate.value, ColumnRef):
        return compare(field, predicate.operator, relation.resolve(predicate.value.name))
    if not isinstance(field.type, _COMPARABLE):
        raise PlanError(f"column {field.name!r} of type {field.type.simpleString()} does not compare")
    column = F.col(field.id)
    out = _COMPARE[predicate.operator](column, coerce(predicate.value, field.type))
    if isinstance(field.type, _REAL) and predicate.operator in (Operator.GT, Operator.GTE):
        out = out & ~F.isnan(column)
    return out


def conjunction(relation: Relation, predicates: tuple[Predicate, ...]) -> Column | None:
    columns = [to_column(relation, p) for p in predicates]
    return reduce(op.and_, columns) if columns else None
