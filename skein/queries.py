"""The registered queries of the relational engine, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import records as fields
from .operators import hashing, indexes, records, sorting, statistics
from .operators.joins import inner_join
from .plans import AccessMethod, FilterSpec, JoinAlgorithm, JoinNode, JoinSpec, QueryPlan, execute, parse_filter_clause, parse_join_clause, push_down, query, reorder
from .plans import parse_index_clause
from .sources.demo import ROWS as DEMO_ROWS
from .sources.demo import demo_schema
from .sources.registry import Registry, TableBuilder
from .sources.shared import fresh_path

COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
CHAIN = "customer.c_custkey:orders.o_custkey orders.o_orderkey:lineitem.l_orderkey"
LINE_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _registered(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _tables(spark: SparkSession, sf_dir: str) -> Registry:
    return Registry.of_parquet(spark, sf_dir, [*COLUMNS, "part", "events"])


def _qualified(*tables: str) -> str:
    return ", ".join(f"{c} AS {t}__{c}" for t in tables for c in COLUMNS[t].split())


@_registered("SELECT * FROM nation")
def scan_full(spark, sf_dir):
    return _tables(spark, sf_dir).table("nation")


@_registered("SELECT * FROM orders WHERE o_orderkey >= 14000")
def scan_positioned(spark, sf_dir):
    return _tables(spark, sf_dir).scan_from("orders", "o_orderkey", 14000)


@_registered("SELECT n_nationkey, upper(n_name) AS loud FROM nation")
def scan_pages(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def loud(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("n_nationkey"), pc.utf8_upper(b.column("n_name"))], ["n_nationkey", "loud"])

    return _tables(spark, sf_dir).scan_pages("nation", loud, "n_nationkey int, loud string")


@_registered("SELECT unnest(['region', 'nation', 'customer', 'supplier', 'orders', 'lineitem', 'part', 'events']) AS name, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS oid")
def scan_catalog(spark, sf_dir):
    return _tables(spark, sf_dir).tables().select("name", "oid")


@_registered("SELECT 'nation' AS name, true AS present UNION ALL SELECT 'gone', false UNION ALL SELECT 'region', false")
def catalog_changes(spark, sf_dir):
    registry = _tables(spark, sf_dir)
    registry.delete_table("region")
    registry.delete_table("gone")
    return spark.createDataFrame([(n, registry.table_exists(n)) for n in ("nation", "gone", "region")], "name string, present boolean")


@_registered("SELECT c_custkey, c_name FROM customer")
def attribute_extract(spark, sf_dir):
    return _tables(spark, sf_dir).table("customer").select("c_custkey", "c_name")


@_registered("SELECT s_name, s_acctbal FROM supplier")
def nested_record(spark, sf_dir):
    rows = fields.nested(_tables(spark, sf_dir).table("supplier"), "rec", "s_name", "s_acctbal")
    return rows.select(F.col("rec.s_name"), F.col("rec.s_acctbal"))


@_registered("SELECT n_nationkey, CAST(4 + 4 + 2 * length(n_name) + 4 AS INTEGER) AS encoded_size FROM nation")
def record_size(spark, sf_dir):
    nation = _tables(spark, sf_dir).table("nation")
    return nation.select("n_nationkey", fields.encoded_size(nation).cast("int").alias("encoded_size"))


@_registered(f"SELECT {', '.join(f'{t}.{c}' for t in ('nation', 'region') for c in COLUMNS[t].split())} FROM nation JOIN region ON n_regionkey = r_regionkey")
def joined_record_split(spark, sf_dir):
    from .plans.executor import by_table

    return by_table(query(_tables(spark, sf_dir), "nation.n_regionkey:region.r_regionkey")).select("nation.*", "region.*")


def _filter_query(name: str, clause: str, table: str, where: str) -> None:
    def run(spark, sf_dir):
        return query(_tables(spark, sf_dir), filter_clause=clause)

    run.__name__ = name
    _registered(f"SELECT {_qualified(table)} FROM {table} WHERE {where}")(run)


_filter_query("filter_eq", "lineitem.l_linenumber = 3", "lineitem", "l_linenumber = 3")
_filter_query("filter_gt", "orders.o_totalprice > 200000", "orders", "o_totalprice > 200000")
_filter_query("filter_lt", "customer.c_acctbal < 100.5", "customer", "c_acctbal < 100.5")
_filter_query("filter_le", "lineitem.l_linenumber <= 1", "lineitem", "l_linenumber <= 1")
_filter_query("filter_ge", "orders.o_orderkey >= 9000", "orders", "o_orderkey >= 9000")
_filter_query("filter_string", "nation.n_name >= 'N'", "nation", "n_name >= 'N'")
_filter_query("filter_timestamp", "orders.o_orderdate >= 1998-01-01", "orders", "o_orderdate >= TIMESTAMP '1998-01-01'")
_filter_query("filter_conjunction", "orders.o_totalprice > 1000 && orders.o_orderkey <= 5000 & orders.o_custkey > 100", "orders", "o_totalprice > 1000 AND o_orderkey <= 5000 AND o_custkey > 100")
_filter_query("filter_only_select", "customer.c_nationkey = 7", "customer", "c_nationkey = 7")


@_registered(f"SELECT {_qualified('customer')} FROM customer WHERE c_custkey % 7 = 3")
def filter_user_predicate(spark, sf_dir):
    spec = FilterSpec("customer", "c_custkey", lambda a, b: a % 7 == b, 3)
    return execute(QueryPlan(filters=(spec,)), _tables(spark, sf_dir))


@_registered("SELECT * FROM customer WHERE c_custkey % 10 <> 0")
def filter_live_records(spark, sf_dir):
    return records.live(records.tombstone(_tables(spark, sf_dir).table("customer"), F.col("c_custkey") % 10 == 0))


PLACED = f"""SELECT {_qualified('customer', 'orders', 'lineitem')} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE c_nationkey = 1 AND o_totalprice > 1000 AND l_linenumber <= 2"""
FILTERS = "customer.c_nationkey = 1 & orders.o_totalprice > 1000 & lineitem.l_linenumber <= 2"


def _placed(leaf: bool, inner: bool) -> QueryPlan:
    first, second = parse_join_clause(CHAIN)
    nation, price, line = parse_filter_clause(FILTERS)
    if leaf:
        first = replace(first, left=first.left.filter_by(nation), right=first.right.filter_by(price))
        second = replace(second, right=second.right.filter_by(line))
        return QueryPlan((first, second))
    if inner:
        second = replace(second, left=second.left.filter_by(nation, price))
        return QueryPlan((first, second), (line,))
    return QueryPlan((first, second), (nation, price, line))


@_registered(PLACED)
def pushdown_leaf(spark, sf_dir):
    return execute(_placed(True, False), _tables(spark, sf_dir))


@_registered(PLACED)
def pushdown_inner_node(spark, sf_dir):
    return execute(_placed(False, True), _tables(spark, sf_dir))


@_registered(PLACED)
def filters_after_join(spark, sf_dir):
    return execute(_placed(False, False), _tables(spark, sf_dir))


@_registered(PLACED)
def join_chain_3(spark, sf_dir):
    return query(_tables(spark, sf_dir), CHAIN, FILTERS, optimizer=push_down)


@_registered(f"""SELECT {_qualified('customer', 'orders', 'lineitem', 'supplier')} FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = 3 AND s_acctbal > 2000""")
def join_chain_4(spark, sf_dir):
    return query(_tables(spark, sf_dir), CHAIN + " lineitem.l_suppkey:supplier.s_suppkey", "customer.c_nationkey = 3 & supplier.s_acctbal > 2000", optimizer=push_down)


@_registered(f"""SELECT {_qualified('orders', 'customer', 'nation')} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_regionkey = 2""")
def join_reordered(spark, sf_dir):
    registry = _tables(spark, sf_dir)
    for t in ("orders", "customer", "nation"):
        registry.statistics.build_table(t)
    out = query(registry, "orders.o_custkey:customer.c_custkey customer.c_nationkey:nation.n_nationkey", "nation.n_regionkey = 2", optimizer=reorder)
    return out.select(*[f"{t}__{c}" for t in ("orders", "customer", "nation") for c in COLUMNS[t].split()])


def _join_query(name: str, left: str, right: str, keys: tuple[str, str], algorithm: JoinAlgorithm) -> None:
    def run(spark, sf_dir):
        node = JoinNode(JoinSpec(left, keys[0]), JoinSpec(right, keys[1]), algorithm)
        return execute(QueryPlan((node,)), _tables(spark, sf_dir))

    run.__name__ = name
    _registered(f"SELECT {_qualified(left, right)} FROM {left} JOIN {right} ON {keys[0]} = {keys[1]}")(run)


_join_query("join_nested_loops", "supplier", "nation", ("s_nationkey", "n_nationkey"), JoinAlgorithm.NESTED_LOOPS)
_join_query("join_hash", "orders", "customer", ("o_custkey", "c_custkey"), JoinAlgorithm.HASH)
_join_query("join_broadcast", "customer", "nation", ("c_nationkey", "n_nationkey"), JoinAlgorithm.BROADCAST)
_join_query("join_merge", "lineitem", "orders", ("l_orderkey", "o_orderkey"), JoinAlgorithm.MERGE)


@_registered("SELECT a.n_name AS n_name, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(spark, sf_dir):
    registry = _tables(spark, sf_dir)
    registry.create_table("other", registry.table("nation"))
    out = query(registry, "nation.n_regionkey:other.n_regionkey")
    return out.select(F.col("nation__n_name").alias("n_name"), F.col("other__n_name").alias("neighbour"))


@_registered("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey + 1 = c_custkey + 1")
def join_computed_key(spark, sf_dir):
    r = _tables(spark, sf_dir)
    return inner_join(r.table("orders"), r.table("customer"), F.col("o_custkey") + 1, F.col("c_custkey") + 1).select("o_orderkey", "c_name")


@_registered("SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem")
def sort_double(spark, sf_dir):
    lines = _tables(spark, sf_dir).table("lineitem")
    return sorting.ranked(lines, "l_extendedprice", *LINE_TIES).select("l_orderkey", "l_linenumber", "l_extendedprice", "pos")


@_registered("SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS pos FROM customer")
def sort_string(spark, sf_dir):
    return sorting.ranked(_tables(spark, sf_dir).table("customer"), "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment", "pos")


@_registered("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders")
def sort_timestamp(spark, sf_dir):
    return sorting.ranked(_tables(spark, sf_dir).table("orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate", "pos")


@_registered("SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def sort_top1(spark, sf_dir):
    return sorting.first_by(_tables(spark, sf_dir).table("orders"), "o_totalprice", "o_orderkey")


@_registered("SELECT min(l_extendedprice) AS minimum FROM lineitem")
def sort_minimum(spark, sf_dir):
    return sorting.minimum(_tables(spark, sf_dir).table("lineitem"), "l_extendedprice")


@_registered("SELECT * FROM nation ORDER BY n_nationkey OFFSET 20")
def sort_skip(spark, sf_dir):
    return sorting.skip(_tables(spark, sf_dir).table("nation"), 20, ["n_nationkey"])


@_registered("SELECT CAST(b AS INTEGER) AS bucket, coalesce(n, 0) AS row_count FROM range(32) r(b) LEFT JOIN (SELECT abs(c_nationkey) % 32 AS k, count(*) AS n FROM customer GROUP BY 1) ON k = b")
def hash_buckets(spark, sf_dir):
    return hashing.hash_table(_tables(spark, sf_dir).table("customer"), 32, "c_nationkey").buckets()


@_registered("SELECT * FROM orders WHERE o_custkey = 42")
def hash_find(spark, sf_dir):
    return hashing.hash_table(_tables(spark, sf_dir).table("orders"), 10, "o_custkey").find(42)


@_registered("SELECT * FROM orders WHERE o_custkey = -1")
def hash_find_missing(spark, sf_dir):
    return hashing.hash_table(_tables(spark, sf_dir).table("orders"), 10, "o_custkey").find(-1)


def _indexed(spark, sf_dir) -> Registry:
    registry = _tables(spark, sf_dir)
    registry.indexes.create("orders", "o_custkey", location="o_orderkey")
    registry.indexes.create("lineitem", "l_linenumber", method="hash", location=F.struct("l_orderkey", "l_partkey"))
    return registry


@_registered("SELECT o_custkey AS key, count(*) AS locations FROM orders GROUP BY 1")
def index_lookup_count(spark, sf_dir):
    runs = indexes.locations(_indexed(spark, sf_dir).indexes.open("orders", "o_custkey").entries())
    return runs.groupBy("key").agg(F.sum(F.size("locations")).cast("long").alias("locations"))


@_registered("SELECT o_custkey AS key, o_orderkey AS location FROM orders")
def index_overflow_runs(spark, sf_dir):
    return indexes.explode_run(indexes.locations(_indexed(spark, sf_dir).indexes.open("orders", "o_custkey").entries()))


@_registered("SELECT o_orderkey AS location FROM orders WHERE o_custkey = 17")
def index_lookup(spark, sf_dir):
    return _indexed(spark, sf_dir).indexes.lookup("orders", "o_custkey", 17)


@_registered("SELECT * FROM orders WHERE o_custkey = 17")
def index_equality_scan(spark, sf_dir):
    return _indexed(spark, sf_dir).indexes.equality_scan("orders", "o_custkey", 17)


@_registered(f"SELECT {_qualified('customer', 'orders')} FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_custkey = 17")
def index_then_join(spark, sf_dir):
    spec = FilterSpec("orders", "o_custkey", "=", "17", AccessMethod.INDEX_SCAN)
    node = JoinNode(JoinSpec("customer", "c_custkey"), JoinSpec("orders", "o_custkey", (spec,)))
    return execute(QueryPlan((node,)), _indexed(spark, sf_dir))


@_registered("SELECT o_custkey AS key, max(o_orderkey) AS location FROM orders GROUP BY 1")
def index_unique(spark, sf_dir):
    return indexes.build(_tables(spark, sf_dir).table("orders"), "o_custkey", "o_orderkey", unique=True)


@_registered("SELECT count(*) AS row_count FROM lineitem")
def stats_row_count(spark, sf_dir):
    return statistics.row_count(_tables(spark, sf_dir).table("lineitem"))


@_registered("SELECT count(DISTINCT o_custkey) AS cardinality FROM orders")
def stats_cardinality(spark, sf_dir):
    return statistics.cardinality(_tables(spark, sf_dir).table("orders"), "o_custkey")


@_registered("""WITH RECURSIVE g AS (SELECT o_custkey v, count(*) c FROM orders GROUP BY 1),
o AS (SELECT v, c, row_number() OVER (ORDER BY v) rn, (sum(c) OVER ()) // 10 bh FROM g),
r AS (SELECT rn, v lo, v hi, c::bigint h, (c >= bh) e, bh FROM o WHERE rn = 1
 UNION ALL SELECT o.rn, CASE WHEN r.e THEN o.v ELSE r.lo END, o.v, (CASE WHEN r.e THEN 0 ELSE r.h END) + o.c, ((CASE WHEN r.e THEN 0 ELSE r.h END) + o.c) >= o.bh, o.bh
 FROM r JOIN o ON o.rn = r.rn + 1)
SELECT CAST((row_number() OVER (ORDER BY rn)) - 1 AS INTEGER) AS pos, lo AS range_begin, hi AS range_end, h AS value_count FROM r WHERE e""")
def stats_histogram(spark, sf_dir):
    return statistics.histogram(_tables(spark, sf_dir).table("orders"), "o_custkey", 10)


@_registered("SELECT o_orderpriority AS value, count(*) AS frequency FROM orders GROUP BY 1")
def value_frequencies(spark, sf_dir):
    return statistics.value_frequencies(_tables(spark, sf_dir).table("orders"), "o_orderpriority")


@_registered("SELECT * FROM region UNION ALL SELECT 99, 'NOWHERE'")
def record_append(spark, sf_dir):
    registry = _tables(spark, sf_dir)
    with TableBuilder(registry, "region") as builder:
        builder.insert(99, "NOWHERE")
    return registry.table("region")


@_registered("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 1 THEN s_acctbal + 10 ELSE s_acctbal END AS s_acctbal FROM supplier")
def record_update(spark, sf_dir):
    return records.update(_tables(spark, sf_dir).table("supplier"), F.col("s_nationkey") == 1, s_acctbal=F.col("s_acctbal") + 10)


@_registered("SELECT * FROM supplier WHERE NOT (s_nationkey = 1)")
def record_delete(spark, sf_dir):
    return records.delete(_tables(spark, sf_dir).table("supplier"), F.col("s_nationkey") == 1)


@_registered("SELECT *, s_nationkey = 1 AS deleted FROM supplier")
def record_all(spark, sf_dir):
    return records.tombstone(_tables(spark, sf_dir).table("supplier"), F.col("s_nationkey") == 1)


@_registered("SELECT * FROM orders WHERE o_orderkey = 5")
def page_of_records(spark, sf_dir):
    return records.get(_tables(spark, sf_dir).table("orders"), "o_orderkey", 5)


@_registered("SELECT * FROM region WHERE false")
def record_clear(spark, sf_dir):
    return records.clear(_tables(spark, sf_dir).table("region"))


# structures that are saved, opened again and used


@_registered("SELECT * FROM orders WHERE o_custkey = 42")
def hash_saved_find(spark, sf_dir):
    path = fresh_path(spark, "orders_hash")
    hashing.hash_table(_tables(spark, sf_dir).table("orders"), 32, "o_custkey").save(path)
    return hashing.open_table(spark, path).find(42)


@_registered("SELECT * FROM customer WHERE c_name = 'Customer#000000042'")
def hash_saved_find_string(spark, sf_dir):
    path = fresh_path(spark, "customer_hash")
    hashing.hash_table(_tables(spark, sf_dir).table("customer"), 16, "c_name").save(path)
    return hashing.open_table(spark, path).find("Customer#000000042")


JVM_STRING = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (h * 31 + u) % 4294967296)"


@_registered(f"""WITH coded AS (SELECT c_name, {JVM_STRING.format('c_name')} AS h FROM customer)
SELECT c_name, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 50 AS INTEGER) AS bucket FROM coded""")
def hash_buckets_string(spark, sf_dir):
    return hashing.hash_table(_tables(spark, sf_dir).table("customer"), 50, "c_name").rows.select("c_name", "bucket")


@_registered("""WITH k AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000003007 AS key FROM orders), coded AS (SELECT o_orderkey, xor(key, key >> 32) & 4294967295 AS h FROM k)
SELECT o_orderkey, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 64 AS INTEGER) AS bucket FROM coded""")
def hash_buckets_long(spark, sf_dir):
    orders = _tables(spark, sf_dir).table("orders")
    return hashing.hash_table(orders, 64, F.col("o_orderkey").cast("long") * 1000003007).rows.select("o_orderkey", "bucket")


def _saved_index(spark, sf_dir, table: str, attribute: str, **options) -> Registry:
    """An index that one registry saves and another opens."""
    folder = fresh_path(spark, "indexes")
    Registry.of_parquet(spark, sf_dir, [table], saved=folder).indexes.create(table, attribute, save=True, **options)
    return Registry.of_parquet(spark, sf_dir, [*COLUMNS], saved=folder)


@_registered("SELECT * FROM orders WHERE o_custkey = 17")
def index_saved_btree_scan(spark, sf_dir):
    return _saved_index(spark, sf_dir, "orders", "o_custkey").indexes.equality_scan("orders", "o_custkey", 17)


@_registered("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_saved_hash_scan(spark, sf_dir):
    return _saved_index(spark, sf_dir, "customer", "c_mktsegment", method="hash").indexes.equality_scan("customer", "c_mktsegment", "BUILDING")


@_registered("SELECT l_orderkey AS location FROM lineitem WHERE l_partkey = 20")
def index_saved_lookup(spark, sf_dir):
    return _saved_index(spark, sf_dir, "lineitem", "l_partkey", location="l_orderkey").indexes.lookup("lineitem", "l_partkey", 20)


@_registered("SELECT max(o_orderkey) AS location FROM orders WHERE o_custkey = 17 HAVING count(*) > 0")
def index_saved_unique(spark, sf_dir):
    return _saved_index(spark, sf_dir, "orders", "o_custkey", location="o_orderkey", unique=True).indexes.lookup("orders", "o_custkey", 17)


@_registered(f"SELECT {_qualified('customer', 'orders')} FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_custkey = 17")
def index_saved_then_join(spark, sf_dir):
    spec = FilterSpec("orders", "o_custkey", "=", "17", AccessMethod.INDEX_SCAN)
    node = JoinNode(JoinSpec("customer", "c_custkey"), JoinSpec("orders", "o_custkey", (spec,)))
    return execute(QueryPlan((node,)), _saved_index(spark, sf_dir, "orders", "o_custkey"))


@_registered("SELECT 'orders' AS name, 'o_custkey' AS attribute, true AS present UNION ALL SELECT 'customer', 'c_name', true UNION ALL SELECT 'orders', 'o_orderkey', false")
def index_exists(spark, sf_dir):
    registry = _tables(spark, sf_dir)
    registry.indexes.create_all(parse_index_clause("orders.o_custkey, customer.c_name"), save=True)
    rows = [(t, a, registry.indexes.exists(t, a)) for t, a in (("orders", "o_custkey"), ("customer", "c_name"), ("orders", "o_orderkey"))]
    return spark.createDataFrame(rows, "name string, attribute string, present boolean")


@_registered("SELECT 'orders_idx_o_custkey_btree' AS name, count(*) AS entries FROM orders UNION ALL SELECT 'customer_idx_c_name_btree', count(*) FROM customer")
def index_clause_batch(spark, sf_dir):
    registry = _tables(spark, sf_dir)
    pairs = parse_index_clause("orders.o_custkey, customer.c_name")
    registry.indexes.create_all(pairs, save=True)
    parts = [spark.read.parquet(f"{registry.folder}/{indexes.index_name(t, a, 'btree')}").agg(F.lit(indexes.index_name(t, a, "btree")).alias("name"), F.count("*").alias("entries")) for t, a in pairs]
    return parts[0].unionAll(parts[1])


@_registered("SELECT o_orderkey AS location FROM orders WHERE o_custkey % 100 = 17")
def index_computed_key(spark, sf_dir):
    orders = _tables(spark, sf_dir).table("orders")
    return indexes.Index(indexes.build(orders, F.col("o_custkey") % 100, "o_orderkey"), F.col("o_orderkey")).lookup(17)


@_registered("SELECT * FROM orders WHERE o_custkey % 100 = 17")
def hash_find_computed_key(spark, sf_dir):
    return hashing.hash_table(_tables(spark, sf_dir).table("orders"), 8, F.col("o_custkey") % 100).find(17)


@_registered("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice % 1000, o_orderkey) AS pos FROM orders")
def sort_computed_key(spark, sf_dir):
    return sorting.ranked(_tables(spark, sf_dir).table("orders"), F.col("o_totalprice") % 1000, "o_orderkey").select("o_orderkey", "pos")


@_registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def sort_ordered(spark, sf_dir):
    return sorting.sort_by(_tables(spark, sf_dir).table("orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@_registered("SELECT max(l_extendedprice) AS maximum FROM lineitem")
def sort_maximum(spark, sf_dir):
    return sorting.maximum(_tables(spark, sf_dir).table("lineitem"), "l_extendedprice")


@_registered("SELECT month(o_orderdate) AS value, count(*) AS frequency FROM orders GROUP BY 1")
def value_frequencies_computed(spark, sf_dir):
    return statistics.value_frequencies(_tables(spark, sf_dir).table("orders"), F.month("o_orderdate"))


def _saved_statistics(spark, sf_dir, *tables: str) -> Registry:
    """Statistics that one registry saves and another reads."""
    path = fresh_path(spark, "statistics")
    registry = _tables(spark, sf_dir)
    for table in tables:
        registry.statistics.build_all(table)
    registry.statistics.save(path)
    again = _tables(spark, sf_dir)
    again.statistics.load(path)
    return again


@_registered("SELECT 'supplier' AS name, count(*) AS row_count FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation")
def stats_saved_rows(spark, sf_dir):
    found = _saved_statistics(spark, sf_dir, "supplier", "nation").statistics
    return spark.createDataFrame([(t, found.row_count(t)) for t in ("supplier", "nation")], "name string, row_count long")


@_registered(" UNION ALL ".join(f"SELECT '{c}' AS attribute, count(DISTINCT {c}) AS cardinality FROM supplier" for c in COLUMNS["supplier"].split()))
def stats_all_attributes(spark, sf_dir):
    registry = _saved_statistics(spark, sf_dir, "supplier")
    rows = [(c, registry.statistics.attribute("supplier", c)[0]) for c in COLUMNS["supplier"].split()]
    return spark.createDataFrame(rows, "attribute string, cardinality long")


@_registered(ORACLE["stats_histogram"].replace("o_custkey", "n_nationkey").replace("FROM orders", "FROM nation"))
def stats_saved_histogram(spark, sf_dir):
    found = _saved_statistics(spark, sf_dir, "nation").statistics.attribute("nation", "n_nationkey")[1]
    return spark.createDataFrame(found, "pos int, range_begin int, range_end int, value_count long")


# whole tables: saved, shown, decoded, compared


@_registered("SELECT * FROM supplier")
def table_saved(spark, sf_dir):
    folder = fresh_path(spark, "tables")
    registry = Registry(spark)
    registry.create_table("supplier", _tables(spark, sf_dir).table("supplier"))
    registry.save(folder)
    return Registry.of_parquet(spark, folder, ["supplier"]).table("supplier")


@_registered("SELECT 'nation' AS name, n_name AS value FROM nation UNION ALL SELECT 'region', r_name FROM region")
def contents_dump(spark, sf_dir):
    found = Registry.of_parquet(spark, sf_dir, ["nation", "region"]).contents()
    return found.select("name", F.coalesce(F.get_json_object("record", "$.n_name"), F.get_json_object("record", "$.r_name")).alias("value"))


@_registered("SELECT n_nationkey, n_name FROM nation")
def record_decode(spark, sf_dir):
    raw = _tables(spark, sf_dir).table("nation").select(F.concat(F.unhex(F.lpad(F.hex("n_nationkey"), 8, "0")), F.encode("n_name", "UTF-16BE")).alias("data"))
    return fields.decode(raw, "data", lambda b: (int.from_bytes(b[:4], "big"), b[4:].decode("utf-16-be")), "n_nationkey int, n_name string")


@_registered("SELECT 'same' AS pair, true AS equal UNION ALL SELECT 'less', false UNION ALL SELECT 'more often', false")
def record_equality(spark, sf_dir):
    nation = _tables(spark, sf_dir).table("nation")
    rows = [("same", fields.same_records(nation, nation.orderBy("n_name"))), ("less", fields.same_records(nation, nation.where("n_nationkey > 0"))), ("more often", fields.same_records(nation, nation.unionAll(nation)))]
    return spark.createDataFrame(rows, "pair string, equal boolean")


@_registered("SELECT count(DISTINCT (c_nationkey, c_mktsegment)) AS kinds FROM customer")
def record_hashes(spark, sf_dir):
    return _tables(spark, sf_dir).table("customer").agg(F.count_distinct(fields.record_hash("c_nationkey", "c_mktsegment")).alias("kinds"))


@_registered(" UNION ALL ".join(f"SELECT '{name}' AS name, {2 * n} AS row_count, true AS seeded" for name, n in DEMO_ROWS.items()))
def demo_tables(spark, sf_dir):
    first, second = demo_schema(spark, 2, seed=5), demo_schema(spark, 2, seed=5)
    rows = [(n, first.table(n).count(), fields.same_records(first.table(n), second.table(n))) for n in DEMO_ROWS]
    return spark.createDataFrame(rows, "name string, row_count int, seeded boolean")


@_registered(f"SELECT {_qualified('lineitem', 'orders')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_broadcast_refused(spark, sf_dir):
    """A broadcast that is asked for but not granted, as the right side is said to be large: a hash join."""
    r = _tables(spark, sf_dir)
    left, right = (r.table(t).select(*[F.col(c).alias(f"{t}__{c}") for c in COLUMNS[t].split()]) for t in ("lineitem", "orders"))
    return inner_join(left, right, "lineitem__l_orderkey", "orders__o_orderkey", "broadcast", most_bytes=1)


# the commands


@_registered(f"SELECT {_qualified('nation', 'region')} FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def cli_query(spark, sf_dir):
    from .cli import run

    return run(["query", "--data", sf_dir, "--tables", "nation,region", "--join", "nation.n_regionkey:region.r_regionkey", "--filter", "region.r_name = 'ASIA'", "--index", "nation.n_regionkey", "--statistics", "--optimizer", "reorder"], spark).select(
        *[f"{t}__{c}" for t in ("nation", "region") for c in COLUMNS[t].split()]
    )


@_registered("SELECT 'sort' AS method, min(o_totalprice) AS least FROM orders UNION ALL SELECT 'minimum', min(o_totalprice) FROM orders")
def cli_sort_benchmark(spark, sf_dir):
    from .cli import run

    return run(["sort-benchmark", "--data", sf_dir, "--table", "orders", "--key", "o_totalprice"], spark)


@_registered("SELECT unnest(['lookup', 'full scan']) AS method, (SELECT count(*) FROM orders WHERE o_custkey = 42) AS found")
def cli_hash_benchmark(spark, sf_dir):
    from .cli import run

    return run(["hash-benchmark", "--data", sf_dir, "--table", "orders", "--key", "o_custkey", "--value", "42", "--buckets", "16"], spark)


@_registered("SELECT unnest(['nested_loops', 'hash', 'broadcast', 'merge']) AS algorithm, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) AS row_count")
def cli_join_benchmark(spark, sf_dir):
    from .cli import run

    return run(["join-benchmark", "--data", sf_dir, "--join", "customer.c_nationkey:nation.n_nationkey"], spark)
