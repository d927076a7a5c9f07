"""Exact statistics: row counts, distinct counts, value frequencies, equi-height histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise, write_table
from .joins import as_column

#: Up to so many distinct values a histogram is folded in one task; beyond it is cut by prefix sums.
FOLD_VALUES = 200_000


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def cardinality(df: DataFrame, value: Column | str) -> DataFrame:
    """The exact number of distinct values other than null."""
    return df.agg(F.count_distinct(as_column(value)).alias("cardinality"))


def value_frequencies(df: DataFrame, value: Column | str) -> DataFrame:
    """(value, frequency), partially aggregated before the exchange."""
    return df.groupBy(as_column(value).alias("value")).agg(F.count("*").alias("frequency"))


def histogram(df: DataFrame, value: Column | str, buckets: int, *, seen: Column | str | None = None) -> DataFrame:
    """Equi-height histogram: (pos, range_begin, range_end, value_count) with closed ranges.

    Values are walked in their order, or with ``seen`` in the order in which they first occur by it. A bucket closes
    with the value at which its height reaches total // buckets; a last bucket that does not reach it is not
    reported. One heavy value makes a bucket of its own. Nulls are left out.
    """
    v = as_column(value)
    rank = v if seen is None else as_column(seen)
    groups = df.select(v.alias("v"), rank.alias("r")).where("v is not null").groupBy("v").agg(F.min("r").alias("r"), F.count("*").alias("c"))
    few = groups.limit(FOLD_VALUES + 1).count() <= FOLD_VALUES
    return _fold(groups, buckets) if few else _cut(groups, buckets)


def _fold(groups: DataFrame, buckets: int) -> DataFrame:
    """One task walks the values; there are FOLD_VALUES at most."""
    kind = groups.schema["v"].dataType.simpleString()
    listed = groups.agg(F.array_sort(F.collect_list(F.struct("r", "v", "c"))).alias("g"), F.sum("c").alias("total"))
    height = F.floor(F.col("total") / buckets)
    start = F.expr(f"named_struct('done', cast(array() as array<struct<lo:{kind},hi:{kind},n:bigint>>), 'lo', cast(null as {kind}), 'n', 0L)")

    def step(state, x):
        lo = F.when(state["n"] == 0, x["v"]).otherwise(state["lo"])
        n = state["n"] + x["c"]
        full = n >= height
        done = F.when(full, F.concat(state["done"], F.array(F.struct(lo.alias("lo"), x["v"].alias("hi"), n.alias("n"))))).otherwise(state["done"])
        return F.struct(done.alias("done"), lo.alias("lo"), F.when(full, F.lit(0).cast("long")).otherwise(n).alias("n"))

    folded = listed.select(F.aggregate("g", start, step).alias("s")).select(F.posexplode("s.done").alias("pos", "b"))
    return folded.select("pos", F.col("b.lo").alias("range_begin"), F.col("b.hi").alias("range_end"), F.col("b.n").alias("value_count"))


def _cut(groups: DataFrame, buckets: int) -> DataFrame:
    """Many values: running sums over ranges, written in their order, and one look for each boundary.

    Tasks hold a range of values each; the driver holds the boundaries. The first value at which the sum reaches a
    height is less than the greatest frequency beyond it, so a look reads the few row groups around that sum only. Where
    every value closes a bucket there is nothing to look for.
    """
    spark = groups.sparkSession
    kind = groups.schema["v"].dataType.simpleString()
    ranges = groups.repartitionByRange("r", "v").sortWithinPartitions("r", "v").select("v", "c", F.monotonically_increasing_id().alias("at"))
    keyed = materialise(ranges, "values").select("v", "c", "at", F.shiftright("at", 33).alias("part"))
    sums = keyed.groupBy("part").agg(F.sum("c").alias("s"), F.count("*").alias("n"), F.max("c").alias("most"))  # one row a range
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    total, most = sums.agg(F.sum("s"), F.max("most")).head()
    height = (total or 0) // buckets
    within = Window.partitionBy("part").orderBy("at")
    running = keyed.join(F.broadcast(before), "part").select("v", "c", (F.sum("c").over(within) + F.col("before")).alias("sum"), (F.row_number().over(within) + F.col("first") - 1).alias("pos"))
    if height <= 1:
        return running.select(F.col("pos").cast("int"), F.col("v").alias("range_begin"), F.col("v").alias("range_end"), F.col("c").alias("value_count"))
    running = materialise(running.repartitionByRange("sum").sortWithinPartitions("sum"), "sums")
    at, rows = 0, []
    while at + height <= total:
        begin = running.where(F.col("sum").between(at + 1, at + most)).agg(F.min(F.struct("sum", "v"))).head()[0]
        end = running.where(F.col("sum").between(at + height, at + height + most)).agg(F.min(F.struct("sum", "v"))).head()[0]
        rows.append((len(rows), begin["v"], end["v"], end["sum"] - at))
        at = end["sum"]
    discard(running)
    return spark.createDataFrame(rows, f"pos int, range_begin {kind}, range_end {kind}, value_count bigint")


class Statistics:
    """Statistics built for the tables of a registry; what was never built reads as None."""

    def __init__(self, registry):
        self.registry = registry
        self._rows: dict[str, int] = {}
        self._attributes: dict[tuple[str, str], tuple[int, list]] = {}

    def build_table(self, table: str) -> int:
        self._rows[table] = self.registry.table(table).count()
        return self._rows[table]

    def build_attribute(self, table: str, attribute: str, buckets: int = 10) -> tuple[int, list]:
        """(cardinality, histogram rows)."""
        df = self.registry.table(table)
        found = cardinality(df, attribute).head()[0], [tuple(r) for r in histogram(df, attribute, buckets).orderBy("pos").collect()]
        self._attributes[table, attribute] = found
        return found

    def build_all(self, table: str, buckets: int = 10) -> None:
        self.build_table(table)
        for attribute in self.registry.table(table).columns:
            self.build_attribute(table, attribute, buckets)

    def row_count(self, table: str) -> int | None:
        return self._rows.get(table)

    def attribute(self, table: str, attribute: str) -> tuple[int, list] | None:
        return self._attributes.get((table, attribute))

    def save(self, path: str) -> None:
        """Into a folder, so that they outlive the session."""
        spark = self.registry.spark
        write_table(spark.createDataFrame(list(self._rows.items()), "table string, row_count long"), f"{path}/tables")
        rows = [(t, a, n, [(p, None if x is None else str(x), None if y is None else str(y), c) for p, x, y, c in h]) for (t, a), (n, h) in self._attributes.items()]
        write_table(spark.createDataFrame(rows, "table string, attribute string, cardinality long, histogram array<struct<pos:int,range_begin:string,range_end:string,value_count:long>>"), f"{path}/attributes")

    def load(self, path: str) -> None:
        """What ``save`` wrote, the ranges in the types of the registry's attributes."""
        spark = self.registry.spark
        self._rows |= dict(map(tuple, spark.read.parquet(f"{path}/tables").collect()))
        for table, attribute, n, histogram in spark.read.parquet(f"{path}/attributes").collect():
            kind = self.registry.table(table).schema[attribute].dataType
            rows = spark.createDataFrame([tuple(h) for h in histogram], "pos int, range_begin string, range_end string, value_count long")
            typed = rows.orderBy("pos").select("pos", F.col("range_begin").cast(kind), F.col("range_end").cast(kind), "value_count")
            self._attributes[table, attribute] = n, [tuple(r) for r in typed.collect()]
