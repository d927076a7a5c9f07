"""Plans: the clause language, the plan objects, their rewriting and their execution."""

from .clauses import ClauseError, parse_filter_clause, parse_index_clause, parse_join_clause
from .executor import PlanError, execute, query
from .optimizer import identity, push_down, reorder
from .plan import AccessMethod, FilterSpec, JoinAlgorithm, JoinNode, JoinSpec, QueryPlan

__all__ = [
    "AccessMethod", "ClauseError", "FilterSpec", "JoinAlgorithm", "JoinNode", "JoinSpec", "PlanError", "QueryPlan",
    "execute", "identity", "parse_filter_clause", "parse_index_clause", "parse_join_clause", "push_down", "query", "reorder",
]
