"""Equality indexes: tables of keys and row locations.

An index is named ``{table}_idx_{attribute}_{method}``. Saved, a ``btree`` is dealt by ranges of the key and sorted in
each, which makes its row groups narrow, so that a lookup reads those that can hold the key; a ``hash`` index is a
folder for each bucket of keys, of which a lookup reads one. A location is the record's file and row number, or what the
caller names. An equality scan looks the locations up and fetches the records from the files that they name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import exists, write_table
from .hashing import bucket_of
from .joins import as_column

METHODS = ("btree", "hash")
#: Buckets of a saved hash index.
BUCKETS = 32
#: Locations in a row of a run.
RUN = 1024
#: So many files at most are named in a filter; with more, the scan reads all and the join decides.
NAMED_FILES = 1000


class IndexError_(ValueError):
    """An index that is missing or exists already."""


def index_name(table: str, attribute: str, method: str) -> str:
    return f"{table}_idx_{attribute}_{method}"


def file_location() -> Column:
    """A record's file and row number, for file tables."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def build(df: DataFrame, key: Column | str, location: Column | str, *, unique: bool = False, method: str = "btree", order: Column | str | None = None) -> DataFrame:
    """(key, location): a row for each record, or with ``unique`` one for each key, the last by ``order``."""
    if method not in METHODS:
        raise IndexError_(f"unknown index method: {method!r}")
    place = as_column(location)
    if unique:
        rank = place if order is None else as_column(order)
        return df.select(as_column(key).alias("key"), place.alias("location"), rank.alias("rank")).where("key is not null").groupBy("key").agg(F.max_by("location", "rank").alias("location"))
    return df.select(as_column(key).alias("key"), place.alias("location")).where("key is not null")


def locations(rows: DataFrame) -> DataFrame:
    """(key, run, locations): each key's locations in runs of about ``RUN``, sorted in each; a key with many has many
    runs, so that no row or task holds them all."""
    runs = rows.groupBy("key").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    dealt = rows.join(runs, "key").withColumn("run", F.pmod(F.xxhash64("location"), F.col("runs")).cast("int"))
    return dealt.groupBy("key", "run").agg(F.sort_array(F.collect_list("location")).alias("locations"))


def explode_run(runs: DataFrame) -> DataFrame:
    """(key, location) again, one row each."""
    return runs.select("key", F.explode("locations").alias("location"))


@dataclass(frozen=True)
class Index:
    """``rows``: (key, location); a saved hash index has the bucket, too. ``place`` makes the location of a record of
    the table; None where an earlier session's caller named an expression."""

    rows: DataFrame
    place: Column | None
    placed: bool = False

    def entries(self) -> DataFrame:
        return self.rows.select("key", "location")

    def lookup(self, value: object) -> DataFrame:
        """The locations of ``value``, one for each record; none if absent."""
        kind = self.rows.schema["key"].dataType
        sought = (value if isinstance(value, Column) else F.lit(value)).cast(kind)
        found = F.col("key") == sought
        if self.placed:
            found = found & (F.col("bucket") == bucket_of(sought, BUCKETS, kind))
        return self.rows.where(found).select("location")


class Indexes:
    """The indexes over the tables of a registry; saved ones lie in the registry's folder."""

    def __init__(self, registry):
        self.registry = registry
        self._built: dict[str, Index] = {}

    def _path(self, name: str) -> str:
        return f"{self.registry.folder}/{name}"

    def create(self, table: str, attribute: str, *, method: str = "btree", location: Column | str | None = None, unique: bool = False, save: bool = False) -> Index:
        """An index by the file and row number of records, or by ``location``."""
        if self.exists(table, attribute):
            raise IndexError_(f"{table}.{attribute} has an index already")
        df = self.registry.table(table)
        if attribute not in df.columns:
            raise IndexError_(f"Unknown attribute: {table}.{attribute}")
        place = file_location() if location is None else as_column(location)
        name = index_name(table, attribute, method)
        rows = build(df, attribute, place, unique=unique, method=method)
        if save:
            if method == "hash":
                rows = rows.withColumn("bucket", bucket_of("key", BUCKETS, rows.schema["key"].dataType))
                rows = write_table(rows.hint("rebalance", "bucket"), self._path(name), "bucket")
            else:
                rows = write_table(rows.repartitionByRange("key").sortWithinPartitions("key"), self._path(name))
            named = "" if location is None else location if isinstance(location, str) else None
            write_table(self.registry.spark.createDataFrame([(named,)], "location string"), f"{self._path(name)}_about")
        self._built[name] = Index(rows, place, placed=save and method == "hash")
        return self._built[name]

    def open(self, table: str, attribute: str) -> Index:
        """The btree index if there is one, else the hash index, also one that an earlier session saved."""
        spark = self.registry.spark
        for method in METHODS:
            name = index_name(table, attribute, method)
            if name in self._built:
                return self._built[name]
            if self._saved(name):
                named = spark.read.parquet(f"{self._path(name)}_about").head()[0]
                place = file_location() if named == "" else named and as_column(named)
                self._built[name] = Index(spark.read.parquet(self._path(name)), place, placed=method == "hash")
                return self._built[name]
        raise IndexError_(f"{table}.{attribute} has no index")

    def _saved(self, name: str) -> bool:
        return self.registry.has_folder and exists(self.registry.spark, f"{self._path(name)}_about")

    def exists(self, table: str, attribute: str) -> bool:
        names = [index_name(table, attribute, m) for m in METHODS]
        return any(n in self._built or self._saved(n) for n in names)

    def create_all(self, pairs: list[tuple[str, str]], **options) -> None:
        for table, attribute in pairs:
            self.create(table, attribute, **options)

    def lookup(self, table: str, attribute: str, value: object) -> DataFrame:
        return self.open(table, attribute).lookup(value)

    def equality_scan(self, table: str, attribute: str, value: object) -> DataFrame:
        """The records with that key, fetched by the locations that the index gives. The scan opens the files only that
        these name, and in them the row groups that can hold the key."""
        index = self.open(table, attribute)
        if index.place is None:
            raise IndexError_(f"the locations of {table}.{attribute} are of an expression that is not known here")
        df, found = self.registry.table(table), index.lookup(value).distinct()
        same = F.col(f"`{attribute}`") == (value if isinstance(value, Column) else F.lit(value))
        kind = found.schema["location"].dataType
        if isinstance(kind, T.StructType) and kind.names == ["file_path", "row_index"]:
            files = [r[0] for r in found.select("location.file_path").distinct().limit(NAMED_FILES + 1).collect()]
            if len(files) <= NAMED_FILES:
                same = same & F.col("_metadata.file_path").isin(files) if files else F.lit(False)
        rows = df.where(same).select(index.place.alias("__location"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__record"))
        rows = rows.join(found, F.col("__location") == F.col("location"), "left_semi")
        return rows.select(*[F.col("__record").getField(c).alias(c) for c in df.columns])
