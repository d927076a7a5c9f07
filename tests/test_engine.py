"""The relational engine: exact fixtures, errors, and rules that hold for every hint and every placing of filters."""

import pytest
from pyspark.sql import functions as F

from skein import cli
from skein.functions import records as fields
from skein.operators import hashing, indexes, records, sorting, statistics
from skein.operators.joins import inner_join
from skein.plans import (
    AccessMethod,
    ClauseError,
    FilterSpec,
    JoinAlgorithm,
    JoinNode,
    JoinSpec,
    PlanError,
    QueryPlan,
    execute,
    parse_filter_clause,
    parse_index_clause,
    parse_join_clause,
    push_down,
    query,
    reorder,
)
from skein.plans.executor import by_table
from skein.sources import shared
from skein.sources.demo import demo_schema
from skein.sources.registry import Registry, TableBuilder, TableExists, TableNotFound


@pytest.fixture(scope="module")
def demo(spark):
    registry = demo_schema(spark)
    with TableBuilder(registry, "flight") as b:
        b.insert(201, 1, 2)
    return registry


CHAIN = "planet.id:flight.planet_id flight.spacecraft_id:spacecraft.id"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_clauses():
    nodes = parse_join_clause("  a.x:b.y  b.z:c.w ")
    assert [(n.left.table, n.left.attribute, n.right.table, n.right.attribute) for n in nodes] == [("a", "x", "b", "y"), ("b", "z", "c", "w")]
    specs = parse_filter_clause("a.x > 2 && b.y = 'p & q' &  c.z <= a b")
    assert [(s.attribute, s.op, s.literal) for s in specs] == [("x", ">", "2"), ("y", "=", "'p & q'"), ("z", "<=", "a b")]
    assert parse_index_clause("a.x, b.y") == [("a", "x"), ("b", "y")]
    assert parse_join_clause("") == [] and parse_filter_clause("") == []
    for bad in ("a.x", "a:b", "a.x:b.y:c.z"):
        with pytest.raises(ClauseError):
            parse_join_clause(bad)
    with pytest.raises(ClauseError, match="Unsupported predicate"):
        parse_filter_clause("a.x <> 2")


def test_filters_anywhere_give_the_same_rows(spark, demo):
    first, second = parse_join_clause(CHAIN)
    planet, flight, craft = parse_filter_clause("planet.id = 1 & flight.num > 2 & spacecraft.id = 2")
    plain = QueryPlan((first, second), (planet, flight, craft))
    leaf = QueryPlan((JoinNode(first.left.filter_by(planet), first.right.filter_by(flight)), JoinNode(second.left, second.right.filter_by(craft))))
    inner = QueryPlan((first, JoinNode(second.left.filter_by(planet, flight), second.right)), (craft,))
    expected = rows(execute(plain, demo))
    assert expected and all(r[0] == 1 and r[3] > 2 and r[6] == 2 for r in expected)
    assert rows(execute(leaf, demo)) == expected == rows(execute(inner, demo)) == rows(execute(plain, demo, optimizer=push_down))
    for table in ("planet", "flight", "spacecraft"):
        demo.statistics.build_table(table)
    again = execute(plain, demo, optimizer=reorder)
    assert rows(again.select(execute(plain, demo).columns)) == expected


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id as k", "id * 2 as v").write.parquet(str(tmp_path / "t.parquet"))
    registry = Registry.of_parquet(spark, str(tmp_path), ["t"])
    plan = query(registry, filter_clause="t.k > 90").select("t__k")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,90)" in plan and "ReadSchema: struct<k:bigint>" in plan


@pytest.mark.parametrize("algorithm", [None, *JoinAlgorithm])
def test_every_join_algorithm(spark, algorithm):
    foo = spark.createDataFrame([(i, f"n{i}") for i in range(1, 11)] + [(None, "null")], "id int, name string")
    bar = spark.createDataFrame([(i % 10, i) for i in range(20)] + [(None, -1)], "foo_id int, birthday int")
    assert rows(inner_join(foo, bar, "id", "foo_id", algorithm)) == sorted((i, f"n{i}", i, b) for i in range(1, 10) for b in (i, i + 10))


def test_plan_errors(spark, demo):
    for clause in ("flight.nothing = 1", "flight.num = x"):
        with pytest.raises(PlanError):
            query(demo, filter_clause=clause)
    with pytest.raises(PlanError, match="Join clause seems to be empty"):
        query(demo, filter_clause="flight.num = 1 & planet.id = 1")
    with pytest.raises(PlanError, match="not part of the chain"):
        query(demo, "planet.id:flight.planet_id ticket.flight_num:spacecraft.id")
    with pytest.raises(PlanError, match="joins twice"):
        query(demo, "planet.id:planet.id")
    with pytest.raises(PlanError, match="do not compare"):
        query(demo, "planet.name:flight.num")
    with pytest.raises(TableNotFound):
        query(demo, "planet.id:moon.planet_id")
    with pytest.raises(PlanError):
        execute(QueryPlan(), demo)


def test_boolean_literal(spark):
    registry = Registry(spark)
    registry.create_table("t", spark.createDataFrame([(1, True), (2, False)], "k int, b boolean"))
    assert rows(query(registry, filter_clause="t.b = TRUE").select("t__k")) == [(1,)]
    assert rows(query(registry, filter_clause="t.b = yes").select("t__k")) == [(2,)]


def test_user_predicate_and_index_filter(spark, demo):
    odd = FilterSpec("flight", "num", lambda a, b: a % 2 == b, 1)
    assert "?" in str(odd) and all(r[0] % 2 for r in execute(QueryPlan(filters=(odd,)), demo).collect())
    demo.indexes.create("flight", "num", location="num")
    spec = FilterSpec("flight", "num", "=", "2", AccessMethod.INDEX_SCAN)
    node = JoinNode(JoinSpec("planet", "id"), JoinSpec("flight", "planet_id", (spec,)))
    assert rows(execute(QueryPlan((node,)), demo)) == rows(query(demo, "planet.id:flight.planet_id", "flight.num = 2"))


def test_split_by_table(spark, demo):
    row = by_table(query(demo, CHAIN)).first()
    assert row["planet"]["id"] == row["flight"]["planet_id"]


def test_catalog(spark):
    registry = Registry(spark)
    with pytest.raises(TableNotFound):
        registry.table("t")
    first = registry.create_table("t", "a int, b string")
    assert registry.table("t").count() == 0 and registry.table_exists("t")
    with pytest.raises(TableExists):
        registry.create_table("t", "a int")
    registry.delete_table("t")
    registry.delete_table("t")
    assert not registry.table_exists("t") and registry.create_table("u", "a int") > first
    with TableBuilder(registry, "u") as b:
        for i in range(20):
            b.insert(i)
    assert registry.table("u").count() == registry.table("u").count() == 20
    assert rows(registry.scan_from("u", "a", 18)) == [(18,), (19,)]


def test_sorting(spark):
    df = spark.range(1, 10001).select(F.col("id").alias("v")).orderBy(F.rand(3))
    assert [r[0] for r in sorting.sort_by(df, "v").collect()] == list(range(1, 10001))
    ranked = sorting.ranked(df, "v").collect()
    assert all(r["v"] == r["pos"] for r in ranked) and len(ranked) == 10000
    assert sorting.first_by(df, "v").head()[0] == 1 and sorting.minimum(df.limit(0), "v").head()[0] is None
    assert rows(sorting.skip(df, 9998, ["v"])) == [(9999,), (10000,)]
    text = spark.createDataFrame([("�",), ("\U0001f600",)], "s string")
    assert [r[0] for r in sorting.sort_by(text, sorting.utf16_order("s")).collect()] == ["\U0001f600", "�"]


def test_hashing(spark):
    people = spark.range(1, 10001).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("p"), "id").alias("name"))
    table = hashing.hash_table(people, 10, "id")
    assert [tuple(r) for r in table.buckets().collect()] == [(b, 1000) for b in range(10)]
    assert table.find(77).count() == 1 and table.find(10001).count() == 0
    extremes = spark.createDataFrame([(-(2**31),), (2**31 - 1,), (None,)], "k int")
    assert all(0 <= r["bucket"] < 7 for r in hashing.hash_table(extremes, 7, "k").rows.collect())
    assert hashing.hash_table(people, 7, "name").find("p5").count() == 1


def test_indexes(spark):
    word = F.when(F.col("n") % 15 == 0, "fizzbuzz").when(F.col("n") % 3 == 0, "fizz").when(F.col("n") % 5 == 0, "buzz").otherwise(F.col("n").cast("string"))
    df = spark.range(1, 10001).select(F.col("id").cast("int").alias("n")).withColumn("value", word)
    registry = Registry(spark)
    registry.create_table("t", df)
    registry.indexes.create_all(parse_index_clause("t.value"), location="n")
    sizes = {w: registry.indexes.lookup("t", "value", w).count() for w in ("fizz", "buzz", "fizzbuzz", "1", "aas")}
    assert sizes == {"fizz": 2667, "buzz": 1334, "fizzbuzz": 666, "1": 1, "aas": 0}
    with pytest.raises(indexes.IndexError_):
        registry.indexes.create("t", "value", location="n")
    with pytest.raises(indexes.IndexError_):
        registry.indexes.open("t", "n")
    entries = registry.indexes.open("t", "value").entries()
    runs = indexes.locations(entries)
    assert rows(indexes.explode_run(runs)) == rows(entries) and runs.where("key = 'fizz'").count() == 3
    unique = indexes.build(spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "k int, p int"), "k", "p", unique=True, method="hash")
    assert rows(unique) == [(1, 9), (2, 3)]


def test_index_of_file_rows(spark, tmp_path):
    spark.range(10).selectExpr("id % 3 as k").write.parquet(str(tmp_path / "t.parquet"))
    registry = Registry.of_parquet(spark, str(tmp_path), ["t"])
    registry.indexes.create("t", "k")
    assert registry.indexes.lookup("t", "k", 0).distinct().count() == 4 and registry.indexes.equality_scan("t", "k", 0).count() == 4


@pytest.mark.parametrize(
    ("values", "cardinality", "expected"),
    [
        (range(1, 101), 100, [(i, 10 * i + 1, 10 * i + 10, 10) for i in range(10)]),
        ([*range(1, 51)] * 2, 50, [(i, 5 * i + 1, 5 * i + 5, 10) for i in range(10)]),
        ([1] * 100, 1, [(0, 1, 1, 100)]),
        (range(1, 96), 95, [(i, 9 * i + 1, 9 * i + 9, 9) for i in range(10)]),
        ([3, 1, 2], 3, [(0, 1, 1, 1), (1, 2, 2, 1), (2, 3, 3, 1)]),
        ([], 0, []),
    ],
)
def test_statistics(spark, monkeypatch, values, cardinality, expected):
    df = spark.createDataFrame([(v,) for v in values], "foo int")
    assert statistics.row_count(df).head()[0] == len(values)
    assert statistics.cardinality(df, "foo").head()[0] == cardinality
    assert rows(statistics.histogram(df, "foo", 10)) == expected
    monkeypatch.setattr(statistics, "FOLD_VALUES", -1)
    assert rows(statistics.histogram(df, "foo", 10)) == expected


def test_histogram_in_order_of_first_sight(spark):
    df = spark.createDataFrame([(5, 0), (1, 1), (5, 2), (9, 3)], "v int, pos int")
    assert rows(statistics.histogram(df, "v", 2, seen="pos")) == [(0, 5, 5, 2), (1, 1, 9, 2)]


def test_saved_statistics(spark, demo, tmp_path):
    demo.statistics.build_all("planet")
    assert demo.statistics.row_count("planet") == 20 and demo.statistics.attribute("planet", "id")[0] == 20
    assert demo.statistics.row_count("nothing") is None
    demo.statistics.save(str(tmp_path / "stats"))
    again = demo_schema(spark)
    again.statistics.load(str(tmp_path / "stats"))
    assert again.statistics.row_count("planet") == 20 and again.statistics.row_count("flight") == demo.statistics.row_count("flight")
    assert all(again.statistics.attribute("planet", c) == demo.statistics.attribute("planet", c) for c in ("id", "name", "distance"))


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """The files that each scan of a query opened."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles")]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_saved_hash_table_reads_one_bucket(spark, tmp_path):
    people = spark.range(1, 5001).select((F.col("id") % 700).alias("id"), F.concat(F.lit("p"), F.col("id") % 90).alias("name"))
    for key, value, missing in (("id", 77, 9000), ("name", "p5", "nobody")):
        path = str(tmp_path / key)
        hashing.hash_table(people, 16, key).save(path)
        table = hashing.open_table(spark, path)
        assert rows(table.find(value)) == rows(people.where(F.col(key) == value)) and table.find(missing).count() == 0
        assert "(bucket#" in plan_of(table.find(value)) and files_read(table.find(value)) == [1] and files_read(table.rows)[0] > 10
        assert sum(r["row_count"] for r in table.buckets().collect()) == 5000


def test_bucket_numbers_of_the_jvm(spark):
    """Known hash codes of the JVM."""
    strings = {"": 0, "a": 97, "Foo Bar": None, "polygenelubricants": -(2**31), "\U0001f600": 55357 * 31 + 56832}
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = {r["s"]: r["h"] for r in df.select("s", hashing.hash_code("s", df.schema["s"].dataType).alias("h")).collect()}
    objects = spark._jvm.java.util.Objects
    assert all(got[s] == objects.hashCode(s) for s in strings) and all(got[s] == h for s, h in strings.items() if h is not None)
    longs = [0, 1, -1, 2**40 + 7, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in longs], "x long")
    assert [r[0] for r in df.select(hashing.hash_code("x", df.schema["x"].dataType)).collect()] == [((x ^ (x % 2**64 >> 32)) + 2**31) % 2**32 - 2**31 for x in longs]


def test_saved_index_is_opened_and_read(spark, tmp_path):
    """Two files; a lookup names one, and only that is opened."""
    data, folder = str(tmp_path / "data"), str(tmp_path / "saved")
    spark.range(2000).selectExpr("id as k", "id % 10 as v", "'x' as `__record`").repartitionByRange(2, "k").write.parquet(f"{data}/t.parquet")
    for method, attribute in (("btree", "k"), ("hash", "v")):
        Registry.of_parquet(spark, data, ["t"], saved=folder).indexes.create("t", attribute, method=method, save=True)
    again = Registry.of_parquet(spark, data, ["t"], saved=folder)
    assert again.indexes.exists("t", "k") and not again.indexes.exists("t", "__record")
    with pytest.raises(indexes.IndexError_):
        again.indexes.create("t", "k")
    found = again.indexes.equality_scan("t", "k", 1500)
    assert rows(found) == [(1500, 0, "x")] and found.columns == ["k", "v", "__record"]
    assert files_read(again.table("t")) == [2] and files_read(found)[0] == 1
    assert rows(again.indexes.equality_scan("t", "v", 3)) == rows(again.table("t").where("v = 3"))
    assert files_read(again.indexes.lookup("t", "v", 3)) == [1] and again.indexes.lookup("t", "v", 3).count() == 200
    assert again.indexes.equality_scan("t", "k", -5).count() == 0


def test_nested_loops_only_for_small_sides(spark, monkeypatch):
    a, b = spark.range(50).withColumnRenamed("id", "x"), spark.range(50).withColumnRenamed("id", "y")
    assert "CartesianProduct" in plan_of(inner_join(a, b, "x", "y", "nested_loops"))
    large = spark.range(10_000_000).withColumnRenamed("id", "y")
    plan = inner_join(a, large, "x", "y", "nested_loops")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "ShuffledHashJoin" in plan
    refused = inner_join(a, b, "x", "y", "broadcast", most_bytes=1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in refused and "ShuffledHashJoin" in refused


def test_nothing_stays_in_the_cache(spark):
    sorting.ranked(spark.range(100).withColumnRenamed("id", "v"), "v").collect()
    assert spark._jsc.getPersistentRDDs().size() == 0


def test_table_builder_writes_full_batches(spark):
    registry = Registry(spark)
    registry.create_table("t", "a int, b string")
    with TableBuilder(registry, "t", batch=10) as b:
        for i in range(25):
            b.insert(i, str(i))
        assert len(b._rows) == 5
    assert rows(registry.table("t")) == [(i, str(i)) for i in range(25)]


def test_maximum(spark):
    assert sorting.maximum(spark.range(7), "id").head()[0] == 6 and sorting.maximum(spark.range(0), "id").head()[0] is None


def test_decode_in_batches(spark):
    raw = spark.createDataFrame([(bytearray([i, 7]) if i % 5 else None,) for i in range(100)], "data binary")
    got = fields.decode(raw, "data", lambda b: (b[0], str(b[1])), "x int, y string")
    assert sorted(got.collect(), key=str) == sorted([(i, "7") if i % 5 else (None, None) for i in range(100)], key=str)
    assert "BatchEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert fields.decode(raw.limit(0), "data", lambda b: (b[0], ""), "x int, y string").count() == 0


def test_a_shared_folder_is_needed_off_local_masters(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    Context.master = "local[2]"
    assert shared.shared_dir(Session()) == shared.shared_dir(Session())


def test_filters_and_joins_run_on_streams(spark, tmp_path):
    """A registered table may be a stream: the clause language over files that arrive one after another."""
    arrivals = str(tmp_path / "arrivals")
    facts = spark.range(100).selectExpr("id", "id % 4 as kind")
    facts.where("id < 60").write.parquet(arrivals)
    registry = Registry(spark)
    registry.create_table("fact", spark.readStream.schema(facts.schema).parquet(arrivals))
    registry.create_table("kind", spark.createDataFrame([(i, f"k{i}") for i in range(3)], "id long, name string"))
    out = query(registry, "fact.kind:kind.id", "fact.id >= 10 & kind.name = 'k2'", optimizer=push_down)
    stream = out.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        stream.processAllAvailable()
        facts.where("id >= 60").write.mode("append").parquet(arrivals)
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert sorted(r["fact__id"] for r in spark.table("found").collect()) == [i for i in range(10, 100) if i % 4 == 2]


def test_records(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    assert records.append(df, df).count() == 4
    assert sorted(records.update(df, F.col("k") == 1, s=F.lit("b")).collect(), key=lambda r: r[0])[0]["s"] == "b"
    assert records.delete(df, F.col("s") == "a").count() == 1
    assert records.live(records.tombstone(df, F.col("s") == "a")).count() == 1
    assert records.get(df, "k", 2).count() == 1 and records.get(df, "k", 3).count() == 0
    assert records.clear(df).count() == 0 and records.clear(df).schema == df.schema
    with pytest.raises(ValueError, match="unknown columns"):
        records.update(df, F.lit(True), z=F.lit(1))


def test_fields(spark):
    df = spark.createDataFrame([(42, "Вопрос", True)], "i int, s string, b boolean")
    assert df.select(fields.encoded_size(df)).head()[0] == 4 + 4 + 12 + 1
    nested = fields.nested(df, "rec", "i", "b")
    assert fields.attribute(nested, "rec.b").head()[0] is True
    assert fields.same_records(df, df) and not fields.same_records(df, df.limit(0))
    raw = spark.createDataFrame([(bytearray(b"\x00\x01"),)], "data binary")
    assert rows(fields.decode(raw, "data", lambda b: (b[0], b[1]), "x int, y int")) == [(0, 1)]


def test_demo_is_seeded(spark):
    a, b = demo_schema(spark), demo_schema(spark)
    assert a.table("ticket").collect() == b.table("ticket").collect() and a.table("ticket").count() == 600
    assert a.table("flight").agg(F.max("planet_id")).head()[0] <= 19


def test_commands(spark, tmp_path, capsys):
    data = str(tmp_path / "demo")
    assert {tuple(r) for r in cli.run(["generate", "--data", data, "--scale", "2"], spark).collect()} == {("planet", 40), ("spacecraft", 8), ("flight", 400), ("ticket", 1200)}
    tables = ["--data", data, "--tables", "planet,spacecraft,flight,ticket"]
    shown = cli.run(["query", *tables], spark)
    assert shown.groupBy("name").count().count() == 4
    for options in (["--index", "flight.num"], ["--statistics", "--optimizer", "reorder"], ["--algorithm", "merge", "--optimizer", "none"]):
        found = cli.run(["query", *tables, "--join", CHAIN, "--filter", "planet.id = 1", *options], spark)
        assert found.count() == spark.read.parquet(f"{data}/flight.parquet").where("planet_id = 1").count()
    for command in (["sort-benchmark"], ["hash-benchmark", "--key", "pax_name", "--value", "passenger 42"], ["join-benchmark"]):
        assert cli.main([*command, *tables]) == 0
    printed = capsys.readouterr().out
    assert "lookup" in printed and "nested_loops" in printed
    assert cli.run(["query", "--join", "planet.id:flight.planet_id", "--index", "flight.num"], spark).count() == 200
    with pytest.raises(SystemExit):
        cli.run(["generate"], spark)


def test_contents_on_the_console(spark, capsys):
    registry = Registry(spark)
    registry.create_table("t", spark.createDataFrame([(7, "seven")], "k int, s string"))
    registry.show()
    assert "---- t" in (printed := capsys.readouterr().out) and "seven" in printed
    assert [tuple(r) for r in registry.contents().collect()] == [("t", '{"k":7,"s":"seven"}')]
    assert Registry(spark).contents().count() == 0
