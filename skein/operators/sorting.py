"""Sorting by one key, stable through an explicit tie-break, and what builds on an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .joins import as_column


def utf16_order(key: Column | str) -> Column:
    """A sort key that orders strings by UTF-16 code units rather than by UTF-8 bytes."""
    return F.hex(F.encode(as_column(key), "UTF-16BE"))


def sort_by(df: DataFrame, key: Column | str, *ties: Column | str) -> DataFrame:
    """Ascending by ``key``; rows with equal keys in the order of ``ties``, by default of all columns.

    A distributed table has no scan order, so a stable order has to be named. The sort is a range exchange and an
    external sort that spills.
    """
    return df.orderBy(as_column(key).asc(), *[as_column(t).asc() for t in (ties or df.columns)])


def ranked(df: DataFrame, key: Column | str, *ties: Column | str, name: str = "pos", start: int = 1) -> DataFrame:
    """``df`` with each row's position in that order.

    Rows are dealt by ranges of the order, sorted and numbered in each range, and raised by the sizes of the ranges
    before, so no task sees more than its range. The ranges are written to the shared folder, so that the numbers and the
    sizes are of the same ones; nothing is left in the cache.
    """
    order = [as_column(key), *[as_column(t) for t in (ties or df.columns)]]
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record")
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).select(record, F.monotonically_increasing_id().alias("at"))
    dealt = materialise(ranges, "ranges").select("record", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("within"))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row a range
    before = sizes.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    out = dealt.join(F.broadcast(before), "part")
    return out.select(*[F.col("record").getField(c).alias(c) for c in df.columns], (F.coalesce("before", F.lit(0)) + F.col("within") + start).cast("long").alias(name))


def first_by(df: DataFrame, key: Column | str, *ties: Column | str) -> DataFrame:
    """The one row with the least key; none of an empty table. Takes the best row of each partition only."""
    return sort_by(df, key, *ties).limit(1)


def minimum(df: DataFrame, key: Column | str, name: str = "minimum") -> DataFrame:
    """The least key in one row; null for an empty table."""
    return df.agg(F.min(as_column(key)).alias(name))


def maximum(df: DataFrame, key: Column | str, name: str = "maximum") -> DataFrame:
    """The greatest key in one row; null for an empty table."""
    return df.agg(F.max(as_column(key)).alias(name))


def skip(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """All but the first ``n`` rows in ``order``."""
    return df.orderBy(*[as_column(c) for c in order]).offset(n)
