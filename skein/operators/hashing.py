"""Hash tables: rows in numbered buckets, and lookup by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import write_table
from .joins import as_column

# What the JVM's hash codes of strings and booleans are made with.
_FACTOR, _TRUE, _FALSE = 31, 1231, 1237


def hash_code(key: Column | str, kind: T.DataType) -> Column:
    """The JVM's hash code of an integer, long, boolean or string (by UTF-16 units) as a long; of any other type a hash
    of Spark's."""
    k = as_column(key)
    signed = lambda low: F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)
    if isinstance(kind, T.LongType):
        return signed(k.bitwiseXOR(F.shiftrightunsigned(k, 32)).bitwiseAND(F.lit((1 << 32) - 1)))
    if isinstance(kind, T.IntegralType):
        return k.cast("long")
    if isinstance(kind, T.BooleanType):
        return F.when(k, F.lit(_TRUE)).when(~k, F.lit(_FALSE)).cast("long")
    if isinstance(kind, T.StringType):
        digits = F.hex(F.encode(k, "UTF-16BE"))
        units = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 4).cast("int") - 1)).when(k.isNotNull(), F.array().cast("array<int>"))
        unit = lambda i: F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
        return signed(F.aggregate(units, F.lit(0).cast("long"), lambda h, i: F.pmod(h * _FACTOR + unit(i), F.lit(1 << 32))))
    return F.hash(k).cast("long")


def bucket_of(key: Column | str, n: int, kind: T.DataType) -> Column:
    """The bucket number, 0 <= b < n: the hash code's absolute value modulo n."""
    return F.pmod(F.abs(hash_code(key, kind)), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Hashtable:
    """``rows`` carry their ``bucket``. A ``placed`` table is stored by it, and a lookup reads one bucket's files."""

    rows: DataFrame
    key: Column | str
    n: int
    kind: T.DataType
    placed: bool = False

    def buckets(self) -> DataFrame:
        """(bucket, row_count) for all buckets in ascending number, the empty ones, too."""
        counts = self.rows.groupBy("bucket").agg(F.count("*").alias("row_count"))
        every = self.rows.sparkSession.range(self.n).select(F.col("id").cast("int").alias("bucket"))
        return every.join(counts, "bucket", "left").select("bucket", F.coalesce("row_count", F.lit(0)).alias("row_count")).orderBy("bucket")

    def find(self, value: object) -> DataFrame:
        """All rows whose key equals ``value``."""
        sought = (value if isinstance(value, Column) else F.lit(value)).cast(self.kind)
        found = as_column(self.key) == sought
        if self.placed:
            found = found & (F.col("bucket") == bucket_of(sought, self.n, self.kind))
        return self.rows.where(found).drop("bucket")

    def bucket(self, number: int) -> DataFrame:
        return self.rows.where(F.col("bucket") == number).drop("bucket")

    def partitioned(self) -> DataFrame:
        """The rows placed by key, so that later joins and aggregations on it need no further exchange."""
        return self.rows.repartition(self.n, as_column(self.key))

    def save(self, path: str) -> Hashtable:
        """The rows in a folder for each bucket; a bucket with many rows, say of one very common key, is written by
        several tasks. What a later ``open_table`` has to know is kept beside it."""
        if not isinstance(self.key, str):
            raise ValueError("a saved hash table needs a column as its key")
        spark = self.rows.sparkSession
        rows = write_table(self.rows.hint("rebalance", "bucket"), path, "bucket")
        write_table(spark.createDataFrame([(self.key, self.n, self.kind.json())], "key string, n int, kind string"), f"{path}_about")
        return Hashtable(rows, self.key, self.n, self.kind, placed=True)


def open_table(spark: SparkSession, path: str) -> Hashtable:
    """A hash table that was saved, in this session or another."""
    key, n, kind = spark.read.parquet(f"{path}_about").head()
    return Hashtable(spark.read.parquet(path), key, n, T._parse_datatype_json_string(kind), placed=True)


def hash_table(df: DataFrame, n: int, key: Column | str) -> Hashtable:
    """``df`` in ``n`` buckets by ``key``, lazily: the bucket is a column, not a materialised table. Rows with a null
    key are in bucket 0 and found by no lookup."""
    if n < 1:
        raise ValueError("a hash table needs a bucket")
    kind = df.select(as_column(key).alias("k")).schema["k"].dataType
    return Hashtable(df.withColumn("bucket", F.coalesce(bucket_of(key, n, kind), F.lit(0))), key, n, kind)
