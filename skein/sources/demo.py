"""The demo schema: planets, spacecraft, flights and tickets, made from a seed by distributed ranges."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .registry import Registry

#: Rows at scale 1.
ROWS = {"planet": 20, "spacecraft": 4, "flight": 200, "ticket": 600}


def _below(low: int, high: Column | int, seed: int) -> Column:
    """Whole numbers from ``low`` on, ``high`` exclusive, as foreign keys are drawn: the last parent has no child."""
    return (F.lit(low) + F.floor(F.rand(seed) * (F.lit(high) - low))).cast("int")


def _between(low: float, high: float, seed: int) -> Column:
    return F.lit(low) + F.rand(seed) * (high - low)


def demo_schema(spark: SparkSession, scale: int = 1, seed: int = 42, statistics: bool = False) -> Registry:
    """A registry of the four tables; the same seed gives the same rows."""
    n = {name: rows * scale for name, rows in ROWS.items()}
    ids = lambda name: spark.range(1, n[name] + 1, numPartitions=max(1, n[name] // 1_000_000)).select(F.col("id").cast("int").alias("id"))
    registry = Registry(spark)
    registry.create_table("planet", ids("planet").select("id", F.concat(F.lit("planet "), "id").alias("name"), _between(100, 900, seed).alias("distance")))
    registry.create_table("spacecraft", ids("spacecraft").select("id", F.concat(F.lit("craft "), "id").alias("name"), _below(1, 10, seed + 1).alias("capacity")))
    registry.create_table("flight", ids("flight").select(F.col("id").alias("num"), _below(1, n["planet"], seed + 2).alias("planet_id"), _below(1, n["spacecraft"], seed + 3).alias("spacecraft_id")))
    registry.create_table("ticket", ids("ticket").select(_below(1, n["flight"], seed + 4).alias("flight_num"), F.concat(F.lit("passenger "), "id").alias("pax_name"), _between(50, 200, seed + 5).alias("price")))
    if statistics:
        for name in ROWS:
            registry.statistics.build_all(name)
    return registry
