"""Edge cases of sources, functions, joins, search, octree and key/value jobs."""

import gc
import os
import time

import pytest
from pyspark.sql import functions as F

from quern import registry
from quern.functions import octree as cells
from quern.functions.text import parse_integer, tokens
from quern.operators import graph, joins, skew
from quern.operators.kv import KVDataset
from quern.operators.scans import numbered, running_total
from quern.sources.binary import read_binary, write_binary
from quern.sources.generators import histogram, points, unique_keys, zipf_words
from quern.sources.text import list_files, read_lines, read_pairs, read_records, write_text
from quern.storage import materialize, parts_for, release, shared_dir, small_tasks, sweep
from quern.streaming import word_counts


def test_lines_and_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a").write_bytes(b"x\r\n\n y\tz")
    (tmp_path / "in/deep/b").write_bytes(b"last")
    (tmp_path / "in/.hidden").write_bytes(b"no")
    (tmp_path / "in/_kept").write_bytes(b"u")
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "in")).collect()) == sorted(["x\r", "", " y\tz", "last", "u"])
    assert sorted(p.rsplit("/", 1)[-1] for p in list_files(spark, [str(tmp_path / "in")])) == ["_kept", "a", "b"]
    with pytest.raises(Exception):
        list_files(spark, [str(tmp_path / "missing")])


def test_tokens(spark):
    df = spark.createDataFrame([("  a  b\tc  " + "x" * 1023 + " " + "y" * 1024 + " " + "é" * 512,)], "t string")
    assert df.select(tokens(F.col("t")).alias("w")).first().w == ["a", "b\tc", "x" * 1023]


def test_integers(spark):
    df = spark.createDataFrame([("0x10",), ("010",), ("12x",), ("",), ("x",), (None,), ("0",), ("9" * 30,)], "t string")
    assert [r.n for r in df.select(parse_integer(F.col("t")).alias("n")).collect()] == [16, 8, 12, 0, 0, None, 0, None]


def test_pairs(spark, tmp_path):
    (tmp_path / "p").write_text("a 1 x\n  b   0x2\n")
    assert sorted(map(tuple, read_pairs(spark, str(tmp_path / "p")).collect())) == [("a", "1"), ("b", "0x2")]
    (tmp_path / "q").write_text("a 1\nlonely\n")
    assert read_pairs(spark, str(tmp_path / "q"), checked=False).count() == 1
    with pytest.raises(Exception, match="fewer than two"):
        read_pairs(spark, str(tmp_path / "q")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.1234567), ("b", None, 2.0)], "k string, n long, x double")
    write_text(df, str(tmp_path / "out"), single=True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a 1 0.123457", "b 2"]
    (tmp_path / "raw").write_bytes(b"\1\0\0\0\0\0\0\0\2\0\0\0")
    assert [tuple(r) for r in read_binary(spark, str(tmp_path / "raw"), "k long, v int").collect()] == [(1, 2)]
    (tmp_path / "odd").write_bytes(b"\1\0\0")
    with pytest.raises(Exception, match="whole records"):
        read_binary(spark, str(tmp_path / "odd"), "k long, v int").collect()


def test_joins(spark):
    a = spark.createDataFrame([("h", i) for i in range(200)] + [("r", 1), ("r", 1), ("l", 2), (None, 3)], "k string, v1 int")
    b = spark.createDataFrame([("h", 7), ("h", 7), ("r", 8), ("x", 9), (None, 1)], "k string, v2 int")
    want = sorted([("h", i, 7) for i in range(200)] * 2 + [("r", 1, 8)] * 2)
    for got in (joins.inner(a, b, "k"), joins.split(a, b, "k", parts=4, fans=3), joins.with_small(a, b, "k"), joins.with_small(a, b, "k", most_rows=1)):
        assert sorted(map(tuple, got.collect())) == want
    assert joins.having(a, b, "k").count() == 202 and joins.lacking(a, b, "k").count() == 2


def test_search(spark):
    pairs = spark.createDataFrame([(x, y) for x, y in ["01", "02", "13", "23", "34", "44", "01", "78"]], "key string, value string")
    edges = graph.edges_of(pairs)
    assert edges.count() == 7
    tree = graph.search(edges, 0)
    assert sorted(map(tuple, tree.collect())) == [(0, 0, 0), (1, 0, 1), (2, 0, 1), (3, 1, 2), (4, 3, 3)]
    assert graph.search(edges, 0, max_level=1).count() == 3 and graph.search(edges, 8).count() == 1
    assert dict(map(tuple, graph.all_vertices(tree, spark.range(9).withColumnRenamed("id", "v")).collect()))[7] == -1
    with pytest.raises(Exception, match="not below"):
        graph.edges_of(pairs, n=5).collect()


def test_cells(spark):
    edges = [-5.0, -4.0, 0.0, 1e-9, 4.0, 5.0]
    got = [r.c for r in spark.createDataFrame([(x,) for x in edges], "x double").select(cells.cell(F.col("x")).alias("c")).collect()]
    assert got == [0, 0, 16383, 16384, 32767, 32767]


def test_key_value_jobs(spark):
    data = KVDataset.generate(spark, lambda part: [(f"k{i % 3}", i) for i in range(part * 10, part * 10 + 10)], "k string, v long", 4, ("k",))
    sums = {f"k{j}": sum(i for i in range(40) if i % 3 == j) for j in range(3)}
    assert {r.k: r.v for r in data.combine(lambda a, b: (a[0] + b[0],)).df.collect()} == sums
    assert {r.k: r.n for r in data.reduce(lambda k, vs: [(k[0], sum(v for v, in vs))], "k string, n long").df.collect()} == sums
    assert data.union(data).count() == 80
    only = data.including(data).map(lambda rows: ((k, v) for k, v in rows if v >= 30), "k string, v long", ("k",))
    assert only.count() == 20


def test_reducer_of_many_keys(spark):
    """Batches of many keys, keys of many batches, and nulls, which leave other keys' integers exact."""
    most = 2**60 + 1
    rows = [(most + k, i) for k in range(300) for i in range(k % 3 + 1)] + [(-1, i) for i in range(25_000)] + [(None, 5), (None, None), (7, None), (7, 2)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def reduced(key, values):
        seen.add(1)
        floats = any(isinstance(v, float) for v, in values)
        yield key[0], len(values), sum(v for v, in values if v == v), floats

    got = sorted(map(tuple, KVDataset(df, ("k",)).reduce(reduced, "k long, n long, total long, floats boolean").df.collect()), key=str)
    want = [(most + k, k % 3 + 1, sum(range(k % 3 + 1)), False) for k in range(300)] + [(-1, 25_000, sum(range(25_000)), False), (None, 2, 5, True), (7, 2, 2, True)]
    assert got == sorted(want, key=str) and seen.value == 303
    keys = spark.createDataFrame([(float("nan"), "a"), (float("nan"), "b"), (None, "c"), (1.0, "d")], "k double, v string")
    assert sorted(r.n for r in KVDataset(keys, ("k",)).reduce(lambda k, vs: [(len(vs),)], "n long").df.collect()) == [1, 1, 2]
    assert [r.n for r in KVDataset(keys).reduce(lambda k, vs: [(len(vs),)], "n long").df.collect()] == [4]
    plan = KVDataset(df, ("k",)).reduce(reduced, "k long, n long, total long, floats boolean").df._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan  # which makes a frame for each key


def test_generators(spark):
    keys = unique_keys(spark, 500, seed=3)
    assert keys.select("word").distinct().count() == 500 and keys.agg(F.max("idx")).first()[0] == 499
    drawn = zipf_words(spark, 2000, 50, 0.5, seed=1, value_length=4)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, zipf_words(spark, 2000, 50, 0.5, seed=1, value_length=4).collect()))
    assert drawn.where("value between 1000 and 9999").count() == 2000 == histogram(drawn, unique_keys(spark, 50, 1, 5, 0)).agg(F.sum("cnt")).first()[0]
    assert abs(points(spark, 5000, 2).agg(F.stddev("x")).first()[0] - 0.5) < 0.03


def test_search_of_a_long_chain(spark):
    """Levels beyond any cap, a random root, and compressed rows."""
    chain = [(i, i + 1) for i in range(24)]
    edges = spark.createDataFrame(chain + [(b, a) for a, b in chain], "src long, dst long")
    assert {r.v: (r.parent, r.level) for r in graph.search(edges, 0).collect()} == {i: (max(0, i - 1), i) for i in range(25)}
    root = graph.random_root(edges, seed=7)
    assert root == graph.random_root(edges.repartition(3), seed=7) and graph.search(edges, -1, seed=7).where("level = 0").first().v == root
    rows = graph.adjacency(edges).orderBy("v").collect()
    assert [r.start for r in rows] == [0, *[2 * i - 1 for i in range(1, 25)]] and rows[3].targets == [2, 4]
    with pytest.raises(ValueError):
        graph.random_root(edges.limit(0))


def test_degrees_are_counted_in_parts_that_rows_call_for(spark, sf, monkeypatch):
    """Neither the pairs nor the vertices of a task grow with the table."""
    assert parts_for(spark, 0) == 4 and parts_for(spark, 5_000_001) == 11
    rows = []
    monkeypatch.setattr(registry, "parts_for", lambda spark, n: rows.append(n) or 7)
    plan = registry.QUERIES["degree"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(dealt) >= 2 and all(", 7), REPARTITION_BY_NUM" in line for line in dealt) and set(rows) == {spark.read.parquet(f"{sf}/lineitem.parquet").count()}


def test_search_in_small_tasks(spark):
    """A vertex joined to all, in tasks of a bound; the session's settings are as before, also after an error."""
    keys = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"]
    before = [spark.conf.get(k) for k in keys]
    spokes = spark.range(1, 2001).selectExpr("cast(0 AS bigint) AS src", "id AS dst")
    tree = graph.search(spokes.union(spokes.selectExpr("dst AS src", "src AS dst")), 5)
    assert sorted(map(tuple, tree.groupBy("level").count().collect())) == [(0, 1), (1, 1), (2, 1999)] and tree.where("level = 2 AND parent <> 0").isEmpty()
    with pytest.raises(ZeroDivisionError), small_tasks(spark, 10_000_000):
        assert [spark.conf.get(k) for k in keys] == ["20", str(16 << 20), str(16 << 20), str(64 << 20)]
        1 / 0
    assert [spark.conf.get(k) for k in keys] == before


def test_written_edges_are_searched_as_they_are(spark):
    """A table of edges isn't written (and its source not made) again by the search in it."""
    folder = shared_dir(spark).removeprefix("file:")
    edges = graph.written(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    before = {n for n in os.listdir(folder) if n.startswith("edges-")}
    assert graph.search(edges, 0).count() == 3 and graph.written(edges) is edges
    assert not {n for n in os.listdir(folder) if n.startswith("edges-")} - before
    assert graph.search(edges.selectExpr("dst AS src", "src AS dst"), 2).count() == 3


def test_records_of_a_boundary_of_the_users(spark, tmp_path):
    """Records of five bytes, whatever they are, across chunks; and files that Spark's readers pass over."""
    (tmp_path / "a").write_bytes(b"ab\nde" * 1000)
    (tmp_path / "_b").write_bytes(b"12345678")

    def fives(chunk, last):
        end = len(chunk) - len(chunk) % 5
        records = [chunk[i : i + 5] for i in range(0, end, 5)]
        return (records + [chunk[end:]] if last and chunk[end:] else records), b"" if last else chunk[end:]

    got = sorted(r.value for r in read_records(spark, str(tmp_path), fives, chunk=7).collect())
    assert got == sorted(["ab\nde"] * 1000 + ["12345", "678"])
    assert read_lines(spark, str(tmp_path), split_bytes=500).count() == 1002
    (tmp_path / "empty").mkdir()
    assert read_lines(spark, str(tmp_path / "empty")).count() == 0


def test_binary_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS k", "cast(id AS double) / 3 AS v").repartition(3)
    assert write_binary(df, str(tmp_path / "out")) == 1000
    assert sorted(p.name[:5] for p in (tmp_path / "out").iterdir()) == ["part-"] * 3
    assert sorted(map(tuple, read_binary(spark, str(tmp_path / "out"), "k long, v double", split_bytes=1000).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileExistsError):
        write_binary(df, str(tmp_path / "out"))


def test_joins_of_equal_rows_and_wide_sides(spark):
    heavy = spark.range(1000).selectExpr("'h' AS k", "1 AS salt")
    other = spark.createDataFrame([("h", 1), ("h", 2)], "k string, v int")
    assert joins.split(heavy, other, "k", parts=4, fans=8).count() == 2000
    wide = spark.createDataFrame([("h", "x" * 5000)], "k string, w string")
    plan = joins.with_small(heavy, wide, "k", most_bytes=1000)._jdf.queryExecution().toString()
    assert "ResolvedHint" not in plan and joins.with_small(heavy, wide, "k", most_bytes=1000).count() == 1000


def test_users_database_scans_and_lifetime(spark, tmp_path):
    data = KVDataset(spark.range(50).selectExpr("id AS k", "id % 3 AS v").repartition(2), ("k",))
    data.output(str(tmp_path / "text"))
    data.output(str(tmp_path / "raw"), "binary")
    data.output(str(tmp_path / "columns"), "parquet")
    for form in ("text", "binary", "parquet"):
        seen = spark.sparkContext.accumulator(0)
        data.scan_output(str(tmp_path / {"text": "text", "binary": "raw", "parquet": "columns"}[form]), lambda r, seen=seen: seen.add(int(str(r[0]).split(" ")[0])), form)
        assert seen.value == sum(range(50))
    with data as kept:
        assert kept.df.storageLevel.useMemory and kept.count() == 50
    assert not data.df.storageLevel.useMemory

    class Failing:
        def put(self, record):
            raise ValueError("full")

        def close(self):
            open(f"{tmp_path}/closed", "w").close()

    with pytest.raises(Exception, match="full"):
        data.into(lambda part: Failing())
    assert (tmp_path / "closed").exists()


def test_running_totals(spark):
    df = spark.range(500).selectExpr("id * 7 % 500 AS id", "id % 5 AS n").repartition(4)
    got = sorted(map(tuple, running_total(df, "id", "n").select("id", "n", "before").collect()))
    assert [b for _, _, b in got] == [sum(n for _, n, _ in got[:i]) for i in range(500)]
    assert sorted(r.idx for r in numbered(df, "id").collect()) == list(range(500))
    assert running_total(df.limit(0), "id", "n").count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Fake)


def test_written_tables_go_when_nothing_reads_them(spark):
    def collected():
        for _ in range(3):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)
        sweep(spark)

    one, two = (materialize(spark.range(100).selectExpr("id", f"id % {k} AS k"), "test") for k in (3, 7))
    paths = [x.written_at.removeprefix("file:").replace("//", "/") for x in (one, two)]
    joined = one.groupBy("k").count().join(two.groupBy("k").count().withColumnRenamed("count", "n"), "k")  # reads both
    two.createOrReplaceTempView("two_is_read")
    del one, two
    collected()
    assert all(map(os.path.isdir, paths)) and joined.count() == 3
    del joined
    collected()
    assert list(map(os.path.isdir, paths)) == [False, True]
    assert spark.table("two_is_read").count() == 100
    spark.catalog.dropTempView("two_is_read")
    collected()
    assert not os.path.isdir(paths[1])
    release(three := materialize(spark.range(5), "test"))
    assert not os.path.isdir(three.written_at.removeprefix("file:").replace("//", "/"))


def test_shuffle_files_of_a_written_table_go(spark):
    def shuffles():
        sc = spark.sparkContext
        return set(sc._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keySet().mkString(",").split(","))

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(setting), shuffles()
    out = materialize(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count(), "test")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
    assert out.count() == 10 and spark.conf.get(setting) == set_before


def test_streamed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("x y x\n")
    (tmp_path / "in/b").write_text("y\n")
    run = word_counts(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert dict(map(tuple, spark.table("streamed").collect())) == {"x": 2, "y": 2}


def test_bins_are_redirected():
    loads = {b: (b * 37 % 11) * (10 if b % 4 == 0 else 1) for b in range(400)}
    to = skew.redirected(loads, 4)
    total = [sum(n for b, n in loads.items() if to[b] == p) for p in range(4)]
    assert max(total) <= 1.01 * sum(loads.values()) / 4 and to.keys() == loads.keys()
    assert skew.redirected({0: 100, 1: 1}, 2) == {0: 0, 1: 1} and skew.redirected({}, 3) == {}
