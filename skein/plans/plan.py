"""Plan objects: small, immutable and independent of a session.

A plan is a left-deep chain of inner equi-joins with filters on its operands, and residual filters. Access method and
join algorithm are hints: they may change the physical plan, never the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column


class AccessMethod(Enum):
    FULL_SCAN = "full_scan"
    INDEX_SCAN = "index_scan"


class JoinAlgorithm(Enum):
    NESTED_LOOPS = "nested_loops"
    HASH = "hash"
    BROADCAST = "broadcast"
    MERGE = "merge"


@dataclass(frozen=True)
class FilterSpec:
    """``table.attribute op literal``; ``op`` is one of = > < <= >= or a function (Column, Column) -> Column."""

    table: str
    attribute: str
    op: str | Callable[[Column, Column], Column]
    literal: object
    access: AccessMethod = AccessMethod.FULL_SCAN

    def __str__(self) -> str:
        return f"{self.table}.{self.attribute} {self.op if isinstance(self.op, str) else '?'} {self.literal}"


@dataclass(frozen=True)
class JoinSpec:
    """One operand of a join: a table, its join attribute, and filters that hold before the join.

    On the left of a later node the table names a member of the chain so far, and its filters apply to the
    intermediate result.
    """

    table: str
    attribute: str
    filters: tuple[FilterSpec, ...] = ()

    def filter_by(self, *specs: FilterSpec) -> JoinSpec:
        return replace(self, filters=(*self.filters, *specs))


@dataclass(frozen=True)
class JoinNode:
    left: JoinSpec
    right: JoinSpec
    algorithm: JoinAlgorithm | None = None


@dataclass(frozen=True)
class QueryPlan:
    joins: tuple[JoinNode, ...] = ()
    filters: tuple[FilterSpec, ...] = field(default=())

    @property
    def tables(self) -> list[str]:
        """The tables in the order they join; without joins, the filtered ones."""
        names = [self.joins[0].left.table, *(n.right.table for n in self.joins)] if self.joins else [f.table for f in self.filters]
        return list(dict.fromkeys(names))
