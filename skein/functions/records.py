"""Records as columns: attributes, nesting, encoded size, equality."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of the values of fixed width in the encoded form.
WIDTHS = {"int": 4, "bigint": 8, "double": 8, "boolean": 1, "timestamp": 8, "timestamp_ntz": 8}


def attribute(df: DataFrame, path: str) -> DataFrame:
    """One attribute, also nested: ``rec.f3.f1``."""
    return df.select(F.col(path).alias(path.rsplit(".", 1)[-1]))


def nested(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``columns`` moved into a struct column ``name``."""
    return df.select(*[c for c in df.columns if c not in columns], F.struct(*columns).alias(name))


def encoded_size(df: DataFrame, *columns: str) -> Column:
    """Bytes of the encoded record: fixed widths, strings as a 4-byte length and two bytes a UTF-16 unit."""

    def size(value: Column, kind: T.DataType) -> Column:
        name = kind.simpleString()
        if name in WIDTHS:
            return F.lit(WIDTHS[name])
        if isinstance(kind, T.StringType):
            return F.lit(4) + F.octet_length(F.encode(value, "UTF-16BE"))
        if isinstance(kind, T.StructType):
            return reduce(lambda a, b: a + b, [size(value.getField(f.name), f.dataType) for f in kind])
        raise ValueError(f"no encoding for {name}")

    return reduce(lambda a, b: a + b, [size(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns or df.columns])


def record_hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def same_records(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same records, each as often."""
    return a.columns == b.columns and not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def decode(df: DataFrame, column: str, parser: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """Records of a private binary format, parsed by a Python function in Arrow batches; the slow path, for inputs only.
    A null gives a record of nulls."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    nothing = (None,) * len(kind.names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [nothing if data is None else parser(data) for data in batch.column(0).to_pylist()]
            columns = zip(*rows, strict=True) if rows else ([] for _ in kind.names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(F.col(column)).mapInArrow(parse, kind)
