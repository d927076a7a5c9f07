"""Parsers of the three clauses.

* join clause: ``planet.id:flight.planet_id flight.spacecraft_id:spacecraft.id`` -- pairs divided by white space;
* filter clause: ``flight.num > 2 & planet.id = 1`` -- conditions divided by one or more ``&``;
* index clause: ``flight.num, planet.id``.

Literals stay text here and get their type from the table's schema when the plan is executed. A literal is the rest
of its condition, so it may hold spaces; in quotes it may hold ``&``.
"""

from __future__ import annotations

import re

from .plan import FilterSpec, JoinNode, JoinSpec

OPERATORS = ("=", ">", "<", "<=", ">=")

_CONDITIONS = re.compile(r"""((?:'[^']*'|"[^"]*"|[^&'"]|['"])+)""")


class ClauseError(ValueError):
    """A clause that cannot be read."""


def _attribute(text: str, clause: str) -> tuple[str, str]:
    table, dot, attribute = text.strip().partition(".")
    if not (dot and table and attribute):
        raise ClauseError(f"expected table.attribute, found {text!r} in {clause!r}")
    return table, attribute


def parse_join_clause(clause: str) -> list[JoinNode]:
    """The join nodes, in order; an empty clause has none."""
    nodes = []
    for pair in clause.split():
        sides = pair.split(":")
        if len(sides) != 2:
            raise ClauseError(f"expected left.attribute:right.attribute, found {pair!r}")
        nodes.append(JoinNode(*(JoinSpec(*_attribute(side, clause)) for side in sides)))
    return nodes


def parse_filter_clause(clause: str) -> list[FilterSpec]:
    """The conditions, in order; they form a conjunction."""
    specs = []
    for condition in _CONDITIONS.findall(clause):
        if not condition.strip():
            continue
        words = condition.strip().split(None, 2)
        if len(words) != 3:
            raise ClauseError(f"expected table.attribute operator literal, found {condition.strip()!r}")
        name, operator, literal = words
        if operator not in OPERATORS:
            raise ClauseError(f"Unsupported predicate: {operator!r}")
        specs.append(FilterSpec(*_attribute(name, clause), operator, literal.strip()))
    return specs


def parse_index_clause(clause: str) -> list[tuple[str, str]]:
    """(table, attribute) pairs."""
    return [_attribute(part, clause) for part in clause.split(",") if part.strip()]
