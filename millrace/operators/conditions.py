"""Conditions, CASE expressions and operands given as structured values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_condition(text: str | Column | None) -> Column:
    """A condition as Spark reads it; blank means true. One WHERE in front and semicolons around it may be there."""
    if isinstance(text, Column):
        return text
    body = (text or "").strip("; \t\r\n")
    if body[:5].upper() == "WHERE" and not body[5:6].isidentifier():
        body = body[5:].lstrip()
    return F.expr(body or "true")


def operand(value) -> Column:
    """A loosely typed configuration value as a Column.

    Text is a Spark SQL expression (a literal, a name, anything else); blank text is NULL and, so that
    results stay floating-point, a decimal number is a double. Pass ``F.lit(..)`` to be explicit.
    """
    if not isinstance(value, str):
        return value if isinstance(value, Column) else F.lit(value)
    text = value.strip()
    try:
        return F.lit(float(text)) if "." in text else F.expr(text or "NULL")
    except ValueError:
        return F.expr(text)


@dataclass(frozen=True)
class Clause:
    """``field operator value``; ``value`` may be a Column to compare two columns."""

    field: str
    operator: str
    value: object = None

    def to_column(self) -> Column:
        c = F.col(self.field)
        v = self.value if isinstance(self.value, Column) else F.lit(self.value)
        tests = {
            "equals": lambda: c == v, "=": lambda: c == v,
            "not_equals": lambda: c != v, "!=": lambda: c != v,
            "gt": lambda: c > v, ">": lambda: c > v,
            "gte": lambda: c >= v, ">=": lambda: c >= v,
            "lt": lambda: c < v, "<": lambda: c < v,
            "lte": lambda: c <= v, "<=": lambda: c <= v,
            # Literal matching: % and _ in the value are not wildcards.
            "contains": lambda: c.contains(v),
            "starts_with": lambda: c.startswith(v),
            "ends_with": lambda: c.endswith(v),
            "is_null": lambda: c.isNull(),
            "is_not_null": lambda: c.isNotNull(),
        }
        if self.operator not in tests:
            raise ValueError(f"unknown operator {self.operator!r}")
        return tests[self.operator]()


@dataclass(frozen=True)
class Group:
    clauses: Sequence[Clause]
    combine: str = "AND"


@dataclass(frozen=True)
class Condition:
    """Groups of clauses; AND/OR inside each group and between groups. Empty means true."""

    groups: Sequence[Group] = field(default_factory=tuple)
    combine: str = "AND"

    def to_column(self) -> Column:
        parts = [_fold([c.to_column() for c in g.clauses], g.combine) for g in self.groups if g.clauses]
        return _fold(parts, self.combine) if parts else F.lit(True)


def _fold(parts: list[Column], combine: str) -> Column:
    if combine.upper() == "OR":
        return reduce(lambda a, b: a | b, parts)
    return reduce(lambda a, b: a & b, parts)


def case_when(cases: Sequence[tuple], otherwise=None) -> Column:
    """First matching ``(condition, value)``. Conditions are SQL text or Columns, values operands."""
    if not cases:
        return F.lit(None)
    chain = None
    for cond, then in cases:
        cond, then = as_condition(cond), operand(then)
        chain = F.when(cond, then) if chain is None else chain.when(cond, then)
    return chain.otherwise(operand(otherwise))
