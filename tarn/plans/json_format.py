"""The JSON form of plans: externally tagged, strict both ways (an unknown tag or field is an error)."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from .nodes import ColumnRef, Cross, Filter, HashJoin, Literal, Operator, Plan, Predicate, Project, Scan, Sort, SortKey


class PlanFormatError(ValueError):
    """The text is no plan."""


def _fields(body: Any, *names: str) -> list[Any]:
    if not isinstance(body, dict) or set(body) != set(names):
        raise PlanFormatError(f"expected the fields {', '.join(names)}, got {sorted(body) if isinstance(body, dict) else body!r}")
    return [body[n] for n in names]


def _tagged(body: Any) -> tuple[str, Any]:
    if not isinstance(body, dict) or len(body) != 1:
        raise PlanFormatError(f"expected one tag, got {body!r}")
    return next(iter(body.items()))


def _text(x: Any) -> str:
    if not isinstance(x, str):
        raise PlanFormatError(f"expected a string, got {x!r}")
    return x


def _list(x: Any, each: Callable[[Any], Any]) -> tuple:
    if not isinstance(x, list):
        raise PlanFormatError(f"expected a list, got {x!r}")
    return tuple(each(v) for v in x)


def _read_value(body: Any) -> Literal | ColumnRef:
    tag, value = _tagged(body)
    if tag == "Column":
        return ColumnRef(_text(value))
    try:
        return Literal(tag, value)
    except ValueError as e:
        raise PlanFormatError(str(e)) from e


def _read_predicate(body: Any) -> Predicate:
    column, operator, value = _fields(body, "column_name", "operator", "value")
    if operator not in Operator.__members__:
        raise PlanFormatError(f"unknown operator {operator!r}")
    return Predicate(_text(column), Operator[operator], _read_value(value))


def _read_pair(body: Any) -> tuple[str, str]:
    pair = _list(body, _text)
    if len(pair) != 2:
        raise PlanFormatError(f"expected [from, to], got {body!r}")
    return pair


def _read_key(body: Any) -> SortKey:
    column, ascending = _fields(body, "column_name", "ascending")
    if not isinstance(ascending, bool):
        raise PlanFormatError(f"expected true or false, got {ascending!r}")
    return SortKey(_text(column), ascending)


def _read(body: Any) -> Plan:
    tag, inner = _tagged(body)
    match tag:
        case "Scan":
            return Scan(_text(*_fields(inner, "table_id")))
        case "Filter":
            predicates, child = _fields(inner, "predicates", "underlying")
            return Filter(_list(predicates, _read_predicate), _read(child))
        case "Project":
            columns, child = _fields(inner, "column_name_map", "underlying")
            return Project(_list(columns, _read_pair), _read(child))
        case "Cross":
            left, right = _fields(inner, "left", "right")
            return Cross(_read(left), _read(right))
        case "HashJoin":
            left, right, a, b = _fields(inner, "left", "right", "left_join_col", "right_join_col")
            return HashJoin(_read(left), _read(right), _text(a), _text(b))
        case "Sort":
            keys, child = _fields(inner, "sort_specs", "underlying")
            return Sort(_list(keys, _read_key), _read(child))
    raise PlanFormatError(f"unknown operator {tag!r}")


def from_json(text: str) -> Plan:
    """The plan of a query document ``{"root": ...}``."""
    try:
        body = json.loads(text)
    except json.JSONDecodeError as e:
        raise PlanFormatError(str(e)) from e
    return _read(*_fields(body, "root"))


def _write(plan: Plan) -> dict:
    match plan:
        case Scan(table):
            return {"Scan": {"table_id": table}}
        case Filter(predicates, child):
            items = [{"column_name": p.column, "operator": p.operator.name, "value": {"Column": p.value.name} if isinstance(p.value, ColumnRef) else {p.value.kind: p.value.value}} for p in predicates]
            return {"Filter": {"predicates": items, "underlying": _write(child)}}
        case Project(columns, child):
            return {"Project": {"column_name_map": [list(c) for c in columns], "underlying": _write(child)}}
        case Cross(left, right):
            return {"Cross": {"left": _write(left), "right": _write(right)}}
        case HashJoin(left, right, a, b):
            return {"HashJoin": {"left": _write(left), "right": _write(right), "left_join_col": a, "right_join_col": b}}
        case Sort(keys, child):
            return {"Sort": {"sort_specs": [{"column_name": k.column, "ascending": k.ascending} for k in keys], "underlying": _write(child)}}
    raise TypeError(f"not a plan: {plan!r}")


def to_json(plan: Plan, pretty: bool = False) -> str:
    """One line, or an indented form for readers."""
    return json.dumps({"root": _write(plan)}, indent=2 if pretty else None, separators=None if pretty else (",", ":"))
