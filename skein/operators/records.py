"""Record changes: each gives a new version of a table and leaves the old one as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` added; columns match by name."""
    return df.unionByName(rows)


def update(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The columns named get new values where ``condition`` is true."""
    unknown = set(values) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df.select(*[F.when(condition, values[c]).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Without the rows where ``condition`` is true; rows where it is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def tombstone(df: DataFrame, condition: Column) -> DataFrame:
    """All records, with a flag ``deleted`` for those that ``condition`` deletes."""
    return df.withColumn("deleted", F.coalesce(condition, F.lit(False)))


def live(df: DataFrame) -> DataFrame:
    """The records that no tombstone marks."""
    return df.where(~F.col("deleted")).drop("deleted")


def get(df: DataFrame, position: Column | str, n: int) -> DataFrame:
    """The record at position ``n``: no row if out of range."""
    return df.where((F.col(position) if isinstance(position, str) else position) == F.lit(n))


def clear(df: DataFrame) -> DataFrame:
    """The empty table of the same schema."""
    return df.limit(0)
