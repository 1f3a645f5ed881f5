"""Logical plan nodes.

A plan is a tree of immutable nodes.  Expressions are Spark SQL texts, so a
plan can be shown, stored as JSON and run more than once.  Every use of a
table is an access of its own with its own name: a self-join or a view that
is used twice has two.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True, eq=False)
class Plan:
    """Base of all nodes; its methods put one more node on top."""

    def children(self) -> tuple[Plan, ...]:
        return tuple(v for v in vars(self).values() if isinstance(v, Plan))

    def walk(self) -> Iterator[Plan]:
        yield self
        for c in self.children():
            yield from c.walk()

    def accesses(self) -> list[str]:
        return [n.access for n in self.walk() if isinstance(n, Scan)]

    def filter(self, condition: str) -> Plan:
        return Filter(self, condition)

    def project(self, *names: str, **exprs: str) -> Plan:
        return Project(self, {**{n: f"`{n}`" for n in names}, **exprs})

    def join(self, right: Plan, on: str, how: str = "inner") -> Plan:
        return Join(self, right, on, how)

    def exists(self, right: Plan, on: Sequence[tuple[str, str]] = (), residual: str | None = None) -> Plan:
        return Exists(self, right, tuple(on), residual)

    def not_exists(self, right: Plan, on: Sequence[tuple[str, str]] = (), residual: str | None = None) -> Plan:
        return Exists(self, right, tuple(on), residual, negated=True)

    def is_in(self, column: str, right: Plan, value: str) -> Plan:
        return Exists(self, right, ((column, value),))

    def not_in(self, column: str, right: Plan, value: str) -> Plan:
        return Exists(self, right, ((column, value),), negated=True, null_aware=True)

    def mark(self, flag: str, right: Plan, on: Sequence[tuple[str, str]]) -> Plan:
        return Mark(self, right, flag, tuple(on))

    def group(self, keys: Sequence[str] | Mapping[str, str] = (), having: str | None = None, **aggs: str) -> Plan:
        keys = dict(keys) if isinstance(keys, Mapping) else {k: f"`{k}`" for k in keys}
        return Aggregate(self, keys, aggs, having)

    def scalar(self, inner: Plan, on: Sequence[tuple[str, str]] = (), **aggs: str) -> Plan:
        """The columns ``aggs`` of a scalar subquery over ``inner``, correlated by (outer, inner) column pairs or not at all."""
        keys = {f"_c_{i}_{r}": f"`{r}`" for i, (_, r) in enumerate(on)}
        sub = Aggregate(inner, keys, aggs, None)
        return Join(self, sub, " AND ".join(f"`{left}` = `{k}`" for (left, _), k in zip(on, keys, strict=True)) or "true", "left" if on else "cross")

    def distinct(self) -> Plan:
        return Distinct(self)

    def window(self, partition: Sequence[str] = (), order: Sequence[str] = (), frame: tuple[str, int | None, int | None] | None = None, **exprs: str) -> Plan:
        return Window(self, tuple(partition), tuple(order), frame, exprs)

    def union_all(self, right: Plan) -> Plan:
        return SetOp(self, right, "union", True)

    def union(self, right: Plan) -> Plan:
        return Distinct(SetOp(self, right, "union", True))

    def intersect(self, right: Plan, all: bool = False) -> Plan:
        return SetOp(self, right, "intersect", all)

    def except_(self, right: Plan, all: bool = False) -> Plan:
        return SetOp(self, right, "except", all)

    def sort(self, *order: str) -> Plan:
        return Sort(self, order)

    def limit(self, n: int | None, offset: int = 0) -> Plan:
        return Limit(self, n, offset)


@dataclass(frozen=True, eq=False)
class Scan(Plan):
    """One access of a table. ``keys`` name the columns that identify a row; without them the row's place in its file does."""

    access: str
    table: DataFrame
    keys: tuple[str, ...] | None
    prefix: str = ""
    names: Mapping[str, str] | None = None

    def name(self, column: str) -> str:
        return self.names[column] if self.names else f"{self.prefix}{column}"


@dataclass(frozen=True, eq=False)
class Filter(Plan):
    child: Plan
    condition: str


@dataclass(frozen=True, eq=False)
class Project(Plan):
    child: Plan
    columns: Mapping[str, str]


@dataclass(frozen=True, eq=False)
class Join(Plan):
    """inner, left, right, full or cross; the sides have different column names."""

    left: Plan
    right: Plan
    on: str
    how: str = "inner"


@dataclass(frozen=True, eq=False)
class Exists(Plan):
    """EXISTS / IN and their negations. ``on``: equal (outer, inner) columns; ``residual``: any further condition over both."""

    left: Plan
    right: Plan
    on: tuple[tuple[str, str], ...]
    residual: str | None = None
    negated: bool = False
    null_aware: bool = False


@dataclass(frozen=True, eq=False)
class Mark(Plan):
    """A boolean column that tells whether a match exists, for sublinks under OR."""

    left: Plan
    right: Plan
    flag: str
    on: tuple[tuple[str, str], ...]


@dataclass(frozen=True, eq=False)
class Aggregate(Plan):
    child: Plan
    keys: Mapping[str, str]
    aggs: Mapping[str, str]
    having: str | None = None


@dataclass(frozen=True, eq=False)
class Distinct(Plan):
    child: Plan


@dataclass(frozen=True, eq=False)
class Window(Plan):
    """Window functions that share one frame: None for the whole partition, else (rows | range | groups, from, to), None unbounded."""

    child: Plan
    partition: tuple[str, ...]
    order: tuple[str, ...]
    frame: tuple[str, int | None, int | None] | None
    exprs: Mapping[str, str]


@dataclass(frozen=True, eq=False)
class SetOp(Plan):
    left: Plan
    right: Plan
    kind: str
    all: bool


@dataclass(frozen=True, eq=False)
class Sort(Plan):
    child: Plan
    order: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class Limit(Plan):
    child: Plan
    n: int | None
    offset: int = 0


def scan(access: str, table: DataFrame, keys: Sequence[str] | None = None, prefix: str = "") -> Scan:
    return Scan(access, table, tuple(keys) if keys is not None else None, prefix)
