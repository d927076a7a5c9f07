"""The table registry: names, identifiers, scans, and the indexes and statistics over its tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh_path, materialise, write_table


class TableNotFound(LookupError):
    """A name that no table has."""


class TableExists(ValueError):
    """A name that a table has already."""


class Registry:
    """name -> DataFrame. Registering is lazy: nothing is read until a result is asked for."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        """``folder``: where saved indexes lie; a registry of another session finds them there again."""
        from ..operators.indexes import Indexes
        from ..operators.statistics import Statistics

        self.spark = spark
        self._folder = folder
        self._tables: dict[str, DataFrame] = {}
        self._oids: dict[str, int] = {}
        self._next = 1
        self.indexes = Indexes(self)
        self.statistics = Statistics(self)

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str, names: Iterable[str], *, saved: str | None = None) -> Registry:
        """Tables ``{folder}/{name}.parquet``; ``saved`` is the folder of saved indexes."""
        out = cls(spark, saved)
        for name in names:
            out.create_table(name, spark.read.parquet(f"{folder}/{name}.parquet"))
        return out

    @property
    def has_folder(self) -> bool:
        return self._folder is not None

    @property
    def folder(self) -> str:
        """Made when it is first needed, unless one was named; that one goes with the driver."""
        if self._folder is None:
            self._folder = fresh_path(self.spark, "registry")
        return self._folder

    def create_table(self, name: str, content: DataFrame | T.StructType | str) -> int:
        """Register a DataFrame, or an empty table of a schema. Returns its identifier, which is never used again."""
        if name in self._tables:
            raise TableExists(f"table {name} exists")
        df = content if isinstance(content, DataFrame) else self.spark.createDataFrame([], content)
        self._tables[name], self._oids[name] = df, self._next
        self._next += 1
        return self._oids[name]

    def replace_table(self, name: str, df: DataFrame) -> None:
        """A new version of a table, under the same identifier."""
        self.table(name)
        self._tables[name] = df

    def delete_table(self, name: str) -> None:
        """Forget a table; an unknown name is no error."""
        self._tables.pop(name, None)
        self._oids.pop(name, None)

    def table_exists(self, name: str) -> bool:
        return name in self._tables

    def table(self, name: str) -> DataFrame:
        """The full scan."""
        try:
            return self._tables[name]
        except KeyError:
            raise TableNotFound(f"table {name} is not registered") from None

    def oid(self, name: str) -> int:
        self.table(name)
        return self._oids[name]

    def tables(self) -> DataFrame:
        """The catalog: (oid, name, columns)."""
        rows = [(self._oids[n], n, df.columns) for n, df in self._tables.items()]
        return self.spark.createDataFrame(rows, "oid int, name string, columns array<string>")

    def files(self, name: str) -> list[str]:
        return self.table(name).inputFiles()

    def scan_from(self, name: str, position: Column | str, start: object) -> DataFrame:
        """The rows from a position on, by an ordered column; the comparison reaches the scan."""
        return self.table(name).where((F.col(position) if isinstance(position, str) else position) >= F.lit(start))

    def scan_pages(self, name: str, function: Callable, schema: str) -> DataFrame:
        """``function`` over the Arrow batches of each partition: (iterator of batches) -> iterator of batches."""
        return self.table(name).mapInArrow(function, schema)

    def save(self, folder: str) -> None:
        """All tables as ``{folder}/{name}.parquet``, where ``of_parquet`` finds them; each write is all or nothing."""
        for name, df in self._tables.items():
            write_table(df, f"{folder}/{name}.parquet")

    def contents(self) -> DataFrame:
        """(name, record): the records of all tables as JSON."""
        parts = [df.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("record")) for name, df in self._tables.items()]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], "name string, record string")

    def show(self, n: int = 20) -> None:
        """The contents of all tables, to the console."""
        for name, df in self._tables.items():
            print(f"---- {name}")
            df.show(n, truncate=False)


class TableBuilder:
    """Rows gathered one by one and appended to a table when closed. The driver holds ``batch`` of them at most; full
    batches are written to the shared folder."""

    def __init__(self, registry: Registry, name: str, batch: int = 100_000):
        self.registry, self.name, self.batch = registry, name, batch
        self._schema = registry.table(name).schema
        self._rows: list[tuple] = []
        self._written: list[DataFrame] = []

    def insert(self, *values: object) -> TableBuilder:
        self._rows.append(values)
        if len(self._rows) >= self.batch:
            self._written.append(materialise(self._gathered(), "batch"))
        return self

    def _gathered(self) -> DataFrame:
        rows, self._rows = self._rows, []
        return self.registry.spark.createDataFrame(rows, self._schema)

    def close(self) -> None:
        parts = [*self._written, *([self._gathered()] if self._rows else [])]
        if parts:
            self.registry.replace_table(self.name, reduce(DataFrame.unionByName, parts, self.registry.table(self.name)))
            self._written = []

    def __enter__(self) -> TableBuilder:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()
