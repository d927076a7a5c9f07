"""Execution: a plan is validated against the registry and folded into one lazy DataFrame.

Nothing is materialised between joins; filters become ``where`` at the place the plan names and Catalyst moves them
into the scans. Result columns are called ``table__column``, so that names stay distinct through any chain.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import inner_join
from ..sources.registry import Registry
from .clauses import parse_filter_clause, parse_join_clause
from .plan import AccessMethod, FilterSpec, JoinAlgorithm, QueryPlan

_COMPARISONS = {
    "=": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}


class PlanError(ValueError):
    """A plan that does not fit its tables."""


def column(table: str, attribute: str) -> Column:
    return F.col(f"`{table}__{attribute}`")


def typed_literal(text: object, kind: T.DataType, name: str) -> Column:
    """A literal of the attribute's type. ``true`` in any case is true, every other boolean literal false."""
    if not isinstance(text, str):
        return F.lit(text)
    bare = text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"" else text
    try:
        if isinstance(kind, T.BooleanType):
            return F.lit(bare.lower() == "true")
        if isinstance(kind, T.IntegralType):
            return F.lit(int(bare)).cast(kind if abs(int(bare)) < 2**31 else T.LongType())
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.lit(float(bare))
        if isinstance(kind, T.DecimalType):
            return F.lit(bare).cast(kind)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.lit(datetime.fromisoformat(bare).isoformat(sep=" ")).cast(kind)
        if isinstance(kind, T.StringType):
            return F.lit(bare)
    except ValueError as e:
        raise PlanError(f"{text!r} is no literal for {name} of type {kind.simpleString()}") from e
    raise PlanError(f"{name} of type {kind.simpleString()} cannot be compared with a literal")


def _kind(registry: Registry, table: str, attribute: str) -> T.DataType:
    schema = registry.table(table).schema
    if attribute not in schema.names:
        raise PlanError(f"Unknown attribute: {table}.{attribute}")
    return schema[attribute].dataType


def condition(registry: Registry, spec: FilterSpec) -> Column:
    kind = _kind(registry, spec.table, spec.attribute)
    literal = typed_literal(spec.literal, kind, f"{spec.table}.{spec.attribute}")
    compare = _COMPARISONS.get(spec.op) if isinstance(spec.op, str) else spec.op
    if compare is None:
        raise PlanError(f"Unsupported predicate: {spec.op!r}")
    return compare(column(spec.table, spec.attribute), literal)


def _filtered(df: DataFrame, registry: Registry, specs: tuple[FilterSpec, ...]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [condition(registry, s) for s in specs])) if specs else df


def _leaf(registry: Registry, table: str, specs: tuple[FilterSpec, ...]) -> DataFrame:
    """A scan of one table under qualified names; an index, if asked for and built, narrows it by equality."""
    df = registry.table(table)
    for s in specs:
        if s.access is AccessMethod.INDEX_SCAN and s.op == "=" and registry.indexes.exists(table, s.attribute):
            df = registry.indexes.equality_scan(table, s.attribute, typed_literal(s.literal, _kind(registry, table, s.attribute), s.attribute))
    df = df.select(*[F.col(f"`{c}`").alias(f"{table}__{c}") for c in df.columns])
    return _filtered(df, registry, specs)


def validate(plan: QueryPlan, registry: Registry) -> None:
    """Tables, attributes, literal types, comparable join keys, and the order of the chain."""
    if not plan.joins and not plan.filters:
        raise PlanError("the plan is empty")
    if not plan.joins and len(plan.tables) > 1:
        raise PlanError("Join clause seems to be empty: filters on several tables need joins")
    reached: set[str] = set()
    for i, node in enumerate(plan.joins):
        for spec in (node.left, node.right):
            registry.table(spec.table)
            _kind(registry, spec.table, spec.attribute)
        if i and node.left.table not in reached:
            raise PlanError(f"{node.left.table} is not part of the chain before it joins {node.right.table}")
        if node.right.table in reached or node.right.table == node.left.table:
            raise PlanError(f"{node.right.table} joins twice; register it under another name for a self-join")
        a, b = (_kind(registry, s.table, s.attribute) for s in (node.left, node.right))
        if a != b and not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
            raise PlanError(f"{node.left.table}.{node.left.attribute} and {node.right.table}.{node.right.attribute} have types that do not compare")
        reached |= {node.left.table, node.right.table}
        for spec, allowed in ((node.left, reached - {node.right.table} if i else {node.left.table}), (node.right, {node.right.table})):
            for f in spec.filters:
                if f.table not in allowed:
                    raise PlanError(f"a filter on {f.table} does not apply to {spec.table}")
                condition(registry, f)
    for f in plan.filters:
        if plan.joins and f.table not in reached:
            raise PlanError(f"{f.table} is filtered but not joined")
        condition(registry, f)


def execute(plan: QueryPlan, registry: Registry, *, algorithm: JoinAlgorithm | None = None, optimizer=None) -> DataFrame:
    """The plan as a lazy DataFrame. ``algorithm`` is the hint of nodes that name none."""
    plan = optimizer(plan, registry) if optimizer else plan
    validate(plan, registry)
    if not plan.joins:
        return _leaf(registry, plan.tables[0], plan.filters)
    out = None
    for node in plan.joins:
        left = _leaf(registry, node.left.table, node.left.filters) if out is None else _filtered(out, registry, node.left.filters)
        right = _leaf(registry, node.right.table, node.right.filters)
        keys = f"{node.left.table}__{node.left.attribute}", f"{node.right.table}__{node.right.attribute}"
        out = inner_join(left, right, *keys, algorithm=node.algorithm or algorithm)
    return _filtered(out, registry, plan.filters)


def query(registry: Registry, join_clause: str = "", filter_clause: str = "", *, algorithm: JoinAlgorithm | None = None, optimizer=None) -> DataFrame:
    """A query in clauses."""
    plan = QueryPlan(tuple(parse_join_clause(join_clause)), tuple(parse_filter_clause(filter_clause)))
    return execute(plan, registry, algorithm=algorithm, optimizer=optimizer)


def by_table(df: DataFrame) -> DataFrame:
    """The joined record split into one struct column for each table."""
    tables: dict[str, list[str]] = {}
    for name in df.columns:
        table, _, attribute = name.partition("__")
        tables.setdefault(table, []).append(attribute)
    return df.select(*[F.struct(*[F.col(f"`{t}__{a}`").alias(a) for a in attributes]).alias(t) for t, attributes in tables.items()])
