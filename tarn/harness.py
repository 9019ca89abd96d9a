"""Runs a list of queries against expected text output, in order or as multisets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from .operators import Engine
from .plans import Plan
from .sinks.text import END, result_lines


@dataclass(frozen=True)
class QueryCase:
    name: str
    query: Plan | str
    expected_file: str
    ordered: bool = True
    disabled: bool = False


@dataclass(frozen=True)
class Outcome:
    name: str
    status: str  # passed, failed or skipped
    detail: str = ""


def same_lines(got: Iterable[str], want: Iterable[str], ordered: bool) -> str:
    """An empty string if the lines agree, or the first difference."""
    a, b = list(got), list(want)
    if not ordered:
        a, b = sorted(a), sorted(b)
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return f"line {k + 1}: {x!r} instead of {y!r}"
    return "" if len(a) == len(b) else f"{len(a)} lines instead of {len(b)}"


def run_cases(engine: Engine, cases: Iterable[QueryCase], failures: str | None = None) -> list[Outcome]:
    """Outcomes in order; those that failed are also written to the file ``failures``."""
    out = []
    for case in cases:
        if case.disabled:
            out.append(Outcome(case.name, "skipped"))
            continue
        try:
            want = [x for x in Path(case.expected_file).read_text().splitlines() if x != END]
            got = [x for x in result_lines(engine.run(case.query)) if x != END]
            detail = same_lines(got, want, case.ordered)
        except Exception as e:  # one bad query does not end the list
            detail = f"{type(e).__name__}: {e}"
        out.append(Outcome(case.name, "failed" if detail else "passed", detail))
    if failures:
        Path(failures).write_text("".join(f"{x.name}: {x.detail}\n" for x in out if x.status == "failed"))
    return out
