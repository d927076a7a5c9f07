"""Commands: ``python -m skein.cli query|generate|sort-benchmark|hash-benchmark|join-benchmark``.

Each command ends in one DataFrame, which ``run`` returns and ``main`` prints.
"""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.hashing import hash_table, open_table
from .operators.joins import inner_join
from .operators.sorting import first_by, minimum
from .plans import JoinAlgorithm, parse_index_clause, push_down, query, reorder
from .session import session
from .sources.demo import demo_schema
from .sources.registry import Registry
from .sources.shared import fresh_path

OPTIMIZERS = {"none": None, "push-down": push_down, "reorder": reorder}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skein", description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=["query", "generate", "sort-benchmark", "hash-benchmark", "join-benchmark"])
    parser.add_argument("--data", help="a folder of parquet tables; without it the demo schema is made. generate writes it there")
    parser.add_argument("--tables", default="region,nation,customer,supplier,part,orders,lineitem")
    parser.add_argument("--scale", type=int, default=1, help="of the demo schema")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--statistics", action="store_true", help="build table statistics first, which reorder goes by")
    parser.add_argument("--join", default="", help="e.g. 'planet.id:flight.planet_id'; without join and filter all contents are shown")
    parser.add_argument("--filter", default="", help="e.g. 'planet.id = 1'")
    parser.add_argument("--index", default="", help="indexes to build first, e.g. flight.num")
    parser.add_argument("--optimizer", choices=list(OPTIMIZERS), default="push-down")
    parser.add_argument("--algorithm", choices=[a.value for a in JoinAlgorithm])
    parser.add_argument("--table", default="ticket", help="of a sort or hash benchmark")
    parser.add_argument("--key", default="price", help="of a sort or hash benchmark")
    parser.add_argument("--value", help="sought by a hash benchmark")
    parser.add_argument("--buckets", type=int, default=50)
    parser.add_argument("--limit", type=int, default=20)
    return parser


def _timed(name: str, action) -> object:
    began = time.perf_counter()
    out = action()
    print(f"{name}: {time.perf_counter() - began:.3f} s")
    return out


def _query(registry: Registry, args) -> DataFrame:
    registry.indexes.create_all(parse_index_clause(args.index), **({} if args.data else {"location": F.monotonically_increasing_id()}))
    if args.statistics:
        for name, *_ in registry.tables().select("name").collect():
            registry.statistics.build_table(name)
    if not args.join and not args.filter:
        return registry.contents()
    return query(registry, args.join, args.filter, algorithm=JoinAlgorithm(args.algorithm) if args.algorithm else None, optimizer=OPTIMIZERS[args.optimizer])


def _generate(registry: Registry, args) -> DataFrame:
    registry.save(args.data)
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("row_count")) for name, df in ((n, registry.table(n)) for n, *_ in registry.tables().select("name").collect())]
    return reduce(DataFrame.unionAll, counts)


def _sort_benchmark(registry: Registry, args) -> DataFrame:
    """The least key by sorting and by aggregation."""
    table = registry.table(args.table)
    by_sort = _timed("sort", lambda: first_by(table, args.key).select(F.col(f"`{args.key}`")).collect())
    least = _timed("minimum", lambda: minimum(table, args.key).collect())
    kind = table.schema[args.key].dataType.simpleString()
    rows = [("sort", by_sort[0][0] if by_sort else None), ("minimum", least[0][0])]
    return registry.spark.createDataFrame(rows, f"method string, least {kind}")


def _hash_benchmark(registry: Registry, args) -> DataFrame:
    """The rows that a saved hash table finds, and those of a full scan."""
    spark, table = registry.spark, registry.table(args.table)
    sought = F.lit(args.value).cast(table.schema[args.key].dataType)
    path = fresh_path(spark, "hash")
    _timed("hashing", lambda: hash_table(table, args.buckets, args.key).save(path))
    hashed = open_table(spark, path)
    found = _timed("lookup", lambda: hashed.find(sought).count())
    full = _timed("full scan", lambda: table.where(F.col(f"`{args.key}`") == sought).count())
    return spark.createDataFrame([("lookup", found), ("full scan", full)], "method string, found long")


def _join_benchmark(registry: Registry, args) -> DataFrame:
    """The rows that each algorithm joins, for a join clause of one pair."""
    (left, left_key), (right, right_key) = (side.split(".") for side in (args.join or "flight.num:ticket.flight_num").split(":"))
    rows = [(a.value, _timed(a.value, lambda a=a: inner_join(registry.table(left), registry.table(right), left_key, right_key, a).count())) for a in JoinAlgorithm]
    return registry.spark.createDataFrame(rows, "algorithm string, row_count long")


def run(argv: list[str], spark: SparkSession | None = None) -> DataFrame:
    args = _parser().parse_args(argv)
    spark = spark or session(master="local[*]" if args.data is None else None)
    demo = args.data is None or args.command == "generate"
    registry = demo_schema(spark, args.scale, args.seed) if demo else Registry.of_parquet(spark, args.data, args.tables.split(","))
    if args.command == "generate" and args.data is None:
        raise SystemExit("generate needs --data")
    commands = {"query": _query, "generate": _generate, "sort-benchmark": _sort_benchmark, "hash-benchmark": _hash_benchmark, "join-benchmark": _join_benchmark}
    return commands[args.command](registry, args)


def main(argv: list[str] | None = None) -> int:
    """Prints the result. A benchmark whose methods differ in what they find ends with 1."""
    import sys

    argv = sys.argv[1:] if argv is None else argv
    args = _parser().parse_args(argv)
    out = run(argv)
    out.show(args.limit, truncate=False)
    if args.command.endswith("-benchmark"):
        return int(out.select(out.columns[-1]).distinct().count() > 1)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
