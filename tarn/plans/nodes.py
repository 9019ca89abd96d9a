"""Plan nodes. A plan says what to compute; how is left to Catalyst."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Operator(Enum):
    EQ = "EQ"
    NE = "NE"
    GT = "GT"
    GTE = "GTE"
    LT = "LT"
    LTE = "LTE"


@dataclass(frozen=True)
class ColumnRef:
    name: str


@dataclass(frozen=True)
class Literal:
    """A value with its declared kind: I32, I64, F32, F64 or String."""

    kind: str
    value: int | float | str

    def __post_init__(self) -> None:
        wanted = {"I32": int, "I64": int, "F32": (int, float), "F64": (int, float), "String": str}
        if self.kind not in wanted:
            raise ValueError(f"unknown literal kind {self.kind!r}")
        if isinstance(self.value, bool) or not isinstance(self.value, wanted[self.kind]):
            raise ValueError(f"{self.value!r} is no {self.kind}")
        bits = {"I32": 31, "I64": 63}.get(self.kind)
        if bits and not -(1 << bits) <= self.value < 1 << bits:
            raise ValueError(f"{self.value} is out of the range of {self.kind}")


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: Operator
    value: Literal | ColumnRef


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True


def _value(value: Literal | ColumnRef | int | float | str) -> Literal | ColumnRef:
    """Python values as literals: whole numbers are I32 where they fit, others I64; reals are F64."""
    if isinstance(value, Literal | ColumnRef):
        return value
    if isinstance(value, str):
        return Literal("String", value)
    if isinstance(value, int) and not isinstance(value, bool):
        return Literal("I32" if -(1 << 31) <= value < 1 << 31 else "I64", value)
    return Literal("F64", value)


class Plan:
    """Builder methods; each gives a new plan over this one."""

    def filter(self, column: str, operator: Operator | str, value: Literal | ColumnRef | int | float | str) -> Filter:
        return self.filter_all((column, operator, value))

    def filter_all(self, *predicates: tuple) -> Filter:
        """A conjunction; without predicates it is true."""
        return Filter(tuple(Predicate(c, Operator(o) if isinstance(o, str) else o, _value(v)) for c, o, v in predicates), self)

    def project(self, *columns: str | tuple[str, str]) -> Project:
        """Selects, renames, reorders or repeats columns: names, or (from, to) pairs."""
        return Project(tuple((c, c) if isinstance(c, str) else c for c in columns), self)

    def cross(self, right: Plan) -> Cross:
        return Cross(self, right)

    def hash_join(self, right: Plan, left_column: str, right_column: str) -> HashJoin:
        return HashJoin(self, right, left_column, right_column)

    def sort(self, *keys: str | tuple[str, bool]) -> Sort:
        """Keys: names (ascending), or (name, ascending) pairs."""
        return Sort(tuple(SortKey(k) if isinstance(k, str) else SortKey(*k) for k in keys), self)


@dataclass(frozen=True)
class Scan(Plan):
    table: str


@dataclass(frozen=True)
class Filter(Plan):
    predicates: tuple[Predicate, ...]
    child: Plan


@dataclass(frozen=True)
class Project(Plan):
    columns: tuple[tuple[str, str], ...]
    child: Plan


@dataclass(frozen=True)
class Cross(Plan):
    left: Plan
    right: Plan


@dataclass(frozen=True)
class HashJoin(Plan):
    left: Plan
    right: Plan
    left_column: str
    right_column: str


@dataclass(frozen=True)
class Sort(Plan):
    keys: tuple[SortKey, ...]
    child: Plan


def scan(table: str) -> Scan:
    return Scan(table)
