"""Inner equi-joins with a selectable algorithm."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast on request only below this many bytes by the optimizer's estimate.
BROADCAST_BYTES = 64 << 20
#: Nested loops are run on request only if the right side is below this, and both sides' product below its square.
LOOP_BYTES = 4 << 20

_HINTS = {"nested_loops": "shuffle_replicate_nl", "hash": "shuffle_hash", "merge": "merge"}


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size; without statistics it is an upper bound from the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def as_column(key: Column | str) -> Column:
    return F.col(f"`{key}`") if isinstance(key, str) else key


def inner_join(left: DataFrame, right: DataFrame, left_key: Column | str, right_key: Column | str, algorithm: Enum | str | None = None, *, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs with equal keys; duplicates multiply, null keys never match. All columns of both sides.

    ``algorithm``: ``nested_loops``, ``hash``, ``broadcast`` or ``merge``; None leaves the choice to the planner,
    which adapts it at run time. A broadcast falls back to ``hash`` if the right side may be large, and so do nested
    loops, which compare every pair of rows, if the sides may be. ``most_bytes`` is what a broadcast may have.
    """
    name = getattr(algorithm, "value", algorithm)
    if name == "broadcast":
        right = F.broadcast(right) if estimated_bytes(right) <= most_bytes else right.hint(_HINTS["hash"])
    elif name == "nested_loops":
        size = estimated_bytes(right)
        small = size <= LOOP_BYTES and size * estimated_bytes(left) <= LOOP_BYTES**2
        right = right.hint(_HINTS["nested_loops" if small else "hash"])
    elif name in _HINTS:
        right = right.hint(_HINTS[name])
    elif name is not None:
        raise ValueError(f"unknown join algorithm: {name!r}")
    return left.join(right, as_column(left_key) == as_column(right_key), "inner")
