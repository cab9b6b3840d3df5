"""Every query of the library by name, and the SQL that tells the same of the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import octree as cells
from quern.functions.text import index_word, lines, parse_integer, tokens
from quern.metrics import counted
from quern.operators import aggregates, graph, joins, octree, skew
from quern.operators.kv import KVDataset
from quern.plans.workloads import word_count, word_count_combined, words
from quern.sources.binary import packed, read_binary, unpacked, write_binary
from quern.sources.generators import histogram, point_lines, points, shuffled, unique_keys, word_stats, zipf_ranks, zipf_weights, zipf_words
from quern.sources.text import formatted, read_lines, read_pairs, read_points, write_text
from quern.storage import parts_for, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = "(SELECT word FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents) WHERE word <> '' AND strlen(word) < 1024)"


@query(f"SELECT word, count(*) AS cnt FROM {_WORDS} GROUP BY word")
def wordcount(spark, d):
    return word_count(_t(spark, d, "documents"))


@query(f"SELECT word, count(*) AS cnt FROM {_WORDS} GROUP BY word")
def wordcount_combiner(spark, d):
    return word_count_combined(_t(spark, d, "documents"))


@query(f"SELECT DISTINCT word FROM {_WORDS}")
def word_distinct(spark, d):
    return aggregates.distinct_keys(words(_t(spark, d, "documents")), ["word"])


@query(f"SELECT count(DISTINCT word) AS n FROM {_WORDS}")
def word_count_distinct(spark, d):
    return aggregates.count_distinct_keys(words(_t(spark, d, "documents")), ["word"])


@query("SELECT doc_id, len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '' AND strlen(w) < 1024)) AS n_tokens FROM documents")
def map_only_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(tokens(F.translate("text", "\n", " "))).cast("long").alias("n_tokens"))


@query("SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS n_lines FROM documents")
def line_records(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(lines(F.col("text"))).cast("long").alias("n_lines"))


@query("SELECT conv_id AS src, turn AS dst FROM conversations WHERE conv_id <> turn")
def self_loop_filter(spark, d):
    pairs = _t(spark, d, "conversations").selectExpr("cast(conv_id AS string) AS key", "cast(turn AS string) AS value")
    return graph.edges_of(pairs)


@query("SELECT nationkey, count(*) AS n FROM (SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nationkey")
def union_inputs(spark, d):
    both = joins.union_all(_t(spark, d, "customer").selectExpr("c_nationkey AS nationkey"), _t(spark, d, "supplier").selectExpr("s_nationkey AS nationkey"))
    return both.groupBy("nationkey").agg(F.count("*").alias("n"))


def _quantities(spark, d):
    return _t(spark, d, "lineitem").selectExpr("l_partkey AS key", "cast(l_quantity AS bigint) AS q")


@query("SELECT l_partkey AS key, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1")
def combine_sum(spark, d):
    return aggregates.combine(_quantities(spark, d), ["key"], v=F.sum("q"))


@query("SELECT l_partkey AS key, min(l_quantity::BIGINT) AS v FROM lineitem GROUP BY 1")
def combine_min(spark, d):
    return aggregates.combine(_quantities(spark, d), ["key"], v=F.min("q"))


@query("SELECT l_partkey AS key, max(l_quantity::BIGINT) AS v FROM lineitem GROUP BY 1")
def combine_max(spark, d):
    return aggregates.combine(_quantities(spark, d), ["key"], v=F.max("q"))


@query("SELECT l_suppkey AS key, count(*) AS cnt FROM lineitem GROUP BY 1 HAVING count(*) > 600")
def group_having(spark, d):
    return aggregates.count_by(_t(spark, d, "lineitem").selectExpr("l_suppkey AS key"), ["key"], above=600)


@query("SELECT key, sum((q > m)::INT)::BIGINT AS n FROM (SELECT l_partkey AS key, l_quantity AS q, avg(l_quantity) OVER (PARTITION BY l_partkey) AS m FROM lineitem) GROUP BY key")
def reduce_multi_pass(spark, d):
    return aggregates.reduce_above_mean(_quantities(spark, d), "key", "q")


@query("SELECT key, count(*) AS n FROM (SELECT l_partkey AS key, l_quantity AS q, avg(l_quantity) OVER (PARTITION BY l_partkey) AS m FROM lineitem) WHERE q > m GROUP BY key")
def reduce_callback(spark, d):
    def above(key: tuple, values: list[tuple]):
        mean = sum(v for v, in values) / len(values)
        if n := sum(v > mean for v, in values):
            yield key[0], n

    return KVDataset(_quantities(spark, d), ("key",)).reduce(above, "key long, n long").df


_SIDES = "(SELECT user_id AS k, event_id AS v1 FROM events WHERE event_id % 2 = 0) a JOIN (SELECT user_id AS k, event_id AS v2 FROM events WHERE event_id % 2 = 1) b USING (k)"


def _sides(spark, d):
    e = _t(spark, d, "events")
    return e.where("event_id % 2 = 0").selectExpr("user_id AS k", "event_id AS v1"), e.where("event_id % 2 = 1").selectExpr("user_id AS k", "event_id AS v2")


@query(f"SELECT k, v1, v2 FROM {_SIDES}")
def join_inner(spark, d):
    return joins.inner(*_sides(spark, d), "k")


@query(f"SELECT k, v1, v2 FROM {_SIDES}")
def join_split(spark, d):
    return joins.split(*_sides(spark, d), "k", parts=128)


@query("SELECT o_orderkey, c_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(spark, d):
    nation = _t(spark, d, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
    customers = joins.with_small(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey")
    orders = _t(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS c_custkey")
    return joins.inner(orders, customers, "c_custkey").select("o_orderkey", "c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def anti_join(spark, d):
    return joins.lacking(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "events").selectExpr("user_id AS c_custkey"), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def semi_join(spark, d):
    return joins.having(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "events").selectExpr("user_id AS c_custkey"), "c_custkey")


@query("SELECT event_type AS k, count(*) AS cnt FROM events GROUP BY 1 HAVING count(*) * 8 > 0.8 * (SELECT count(*) FROM events)")
def heavy_keys(spark, d):
    return skew.heavy_keys(_t(spark, d, "events").selectExpr("event_type AS k"), "k", 8)


@query("SELECT min_cnt, max_cnt, max_cnt >= 1024 AND max_cnt > 1.5 * min_cnt AS imbalanced FROM (SELECT min(c) AS min_cnt, max(c) AS max_cnt FROM (SELECT count(*) AS c FROM events GROUP BY user_id % 8))")
def skew_report(spark, d):
    return skew.skew_report(_t(spark, d, "events"), F.col("user_id") % 8)


@query("SELECT count(*) AS n, count(DISTINCT l_partkey) AS keys, 8::BIGINT AS parts, true AS even FROM lineitem")
def virtual_bins(spark, d):
    """Rows dealt by key through redirected bins: keys are whole, and no part is a twentieth above the mean."""
    dealt = skew.balanced(_t(spark, d, "lineitem").select("l_partkey"), "l_partkey", 8)
    by = aggregates.local_reduce(dealt.withColumn("n", F.lit(1).cast("long")), ["l_partkey"], n=("n", "sum")).groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("keys"))
    return by.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.count("*").alias("parts"), (F.max("n") <= 1.05 * F.avg("n")).alias("even"))


@query("""SELECT part, count(*) AS n FROM (SELECT CASE WHEN v < e THEN v // (w + 1) ELSE x + (v - e) // w END AS part FROM
(SELECT o_orderkey % 1003 AS v, 1003 // 8 AS w, 1003 % 8 AS x, (1003 // 8 + 1) * (1003 % 8) AS e FROM orders)) GROUP BY part""")
def partition_block(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_orderkey") % 1003).alias("v"))
    return skew.dealt_by(o.withColumn("part", skew.block_of(F.col("v"), 1003, 8)), F.col("part"), 8).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"))


_EDGES = "(SELECT DISTINCT l_orderkey * 2 AS s, l_partkey * 2 + 1 AS d FROM lineitem)"
_BOTH = f"l AS {_EDGES}, ed AS (SELECT s, d FROM l UNION ALL SELECT d, s FROM l)"
_BFS = f"""WITH RECURSIVE {_BOTH},
b(v, lvl) USING KEY (v) AS (SELECT (SELECT min(s) FROM ed), 0 UNION
  SELECT ed.d, min(b.lvl) + 1 FROM b JOIN ed ON b.v = ed.s WHERE ed.d NOT IN (SELECT v FROM recurring.b) GROUP BY ed.d),
t AS (SELECT b.v, coalesce(p.parent, b.v) AS parent, b.lvl AS level FROM b LEFT JOIN
  (SELECT e.d, c.lvl, min(e.s) AS parent FROM ed e JOIN b u ON u.v = e.s JOIN b c ON c.v = e.d AND u.lvl = c.lvl - 1 GROUP BY e.d, c.lvl) p ON p.d = b.v) """


def _parts(spark, d):
    return parts_for(spark, _t(spark, d, "lineitem").count())


def _graph(spark, d):
    """Rows are dealt out before they are made distinct: few are equal, and maps of them would grow with a task's input."""
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey * 2 AS src", "l_partkey * 2 + 1 AS dst")
    one = rows.repartition(_parts(spark, d), "src", "dst").distinct()
    return one.union(one.selectExpr("dst AS src", "src AS dst"))


def _tree(spark, d):
    edges = graph.written(_graph(spark, d))
    return edges, graph.search(edges, edges.agg(F.min("src")).first()[0])


@query(f"WITH {_BOTH} SELECT s AS v, count(*) AS deg FROM ed GROUP BY s")
def degree(spark, d):
    return graph.degrees(_graph(spark, d), _parts(spark, d))


@query(f"WITH {_BOTH}, r AS (SELECT s AS v, count(*) AS n, string_agg(d, ' ' ORDER BY d) AS targets FROM ed GROUP BY s) SELECT v, (sum(n) OVER (ORDER BY v) - n)::BIGINT AS start, targets FROM r")
def adjacency(spark, d):
    return graph.adjacency(_graph(spark, d)).select("v", "start", F.array_join(F.col("targets").cast("array<string>"), " ").alias("targets"))


@query(f"WITH {_BOTH} SELECT count(*) AS n FROM ed")
def edges_below_bound(spark, d):
    """Every edge is asserted to be below the number of vertices."""
    edges = _graph(spark, d)
    n = edges.agg(F.max("src")).first()[0] + 1
    return graph.edges_of(edges, "src", "dst", n=n).agg(F.count("*").alias("n"))


@query(f"WITH {_BOTH} SELECT s AS src, d AS dst FROM ed WHERE s NOT IN (SELECT p_partkey * 2 + 1 FROM part WHERE p_size < 25)")
def cut_edge_list(spark, d):
    visited = _t(spark, d, "part").where("p_size < 25").select((F.col("p_partkey") * 2 + 1).alias("v"))
    return graph.cut_edges(_graph(spark, d), visited)


@query(_BFS + "SELECT v, parent, level FROM t")
def bfs_levels(spark, d):
    return _tree(spark, d)[1]


@query(_BFS + "SELECT r.v, coalesce(t.parent, -1) AS pred FROM (SELECT unnest(range(0, (SELECT max(s) + 1 FROM ed)))::BIGINT AS v) r LEFT JOIN t ON t.v = r.v")
def bfs_all_vertices(spark, d):
    edges, tree = _tree(spark, d)
    n = edges.agg(F.max("src")).first()[0] + 1
    return graph.all_vertices(tree, spark.range(n).select(F.col("id").alias("v")))


@query(_BFS + "SELECT t.level, count(*) AS n FROM t JOIN ed ON ed.s = t.v GROUP BY t.level")
def bfs_frontier_counts(spark, d):
    edges, tree = _tree(spark, d)
    return graph.candidates_by_level(tree, edges)


@query(f"WITH {_BOTH} SELECT count(DISTINCT s) AS vertices, 1 AS level_0 FROM ed")
def bfs_random_root(spark, d):
    """A search from a seeded random root, over the graph and a vertex that is joined to all, so that all is reached."""
    edges = graph.written(_graph(spark, d))
    hub = edges.select(F.lit(-2).cast("long").alias("src"), F.col("src").alias("dst")).repartition(_parts(spark, d), "dst").distinct()
    tree = graph.search(edges.union(hub).union(hub.selectExpr("dst AS src", "src AS dst")), -1, seed=3)
    return tree.agg(F.sum((F.col("v") >= 0).cast("long")).alias("vertices"), F.sum((F.col("level") == 0).cast("int")).alias("level_0"))


_CELL = "least(32767, greatest(0, ceil(embedding[{}]::DOUBLE * 10 * 4096)::BIGINT - 1 + 16384))"
_POINTS = f"(SELECT vec_id, {_CELL.format(1)} AS px, {_CELL.format(2)} AS py, {_CELL.format(3)} AS pz FROM embeddings)"
_DENSE = f"""(SELECT level, px >> (15 - level)::INT AS ix, py >> (15 - level)::INT AS iy, pz >> (15 - level)::INT AS iz, count(*) AS cnt
FROM (SELECT px, py, pz, unnest(range(0, 16))::INT AS level FROM {_POINTS}) GROUP BY ALL
HAVING count(*) > (SELECT trunc(count(*) * CAST(0.01 AS DOUBLE))::BIGINT FROM embeddings))"""


def _points(spark, d):
    return _t(spark, d, "embeddings").selectExpr("vec_id", *[f"cast(embedding[{i}] AS double) * 10 AS {c}" for i, c in enumerate("xyz")])


@query("SELECT vec_id, " + " || ".join(f"((px >> {14 - i}) % 2 + 2 * ((py >> {14 - i}) % 2) + 4 * ((pz >> {14 - i}) % 2))::VARCHAR" for i in range(15)) + f" AS octkey FROM {_POINTS}")
def octree_keys(spark, d):
    return _points(spark, d).select("vec_id", cells.key(*[cells.cell(F.col(c)) for c in "xyz"]).alias("octkey"))


@query(f"SELECT level, ix, iy, iz, cnt FROM {_DENSE}")
def octree_level_counts(spark, d):
    return octree.dense_octants(_points(spark, d), 0.01)


@query("SELECT " + ", ".join(f"-4 + i{c} * 8 / 2.0::DOUBLE ** level AS min{c}, -4 + (i{c} + 1) * 8 / 2.0::DOUBLE ** level AS max{c}" for c in "xyz") + f", cnt FROM {_DENSE} WHERE level = (SELECT max(level) FROM {_DENSE})")
def octree_clusters(spark, d):
    return octree.clusters(_points(spark, d), 0.01)


@query("WITH c AS (SELECT r AS rank, sum(1.0::DOUBLE / r) OVER (ORDER BY r) AS s FROM (SELECT unnest(range(1, 101))::BIGINT AS r)) SELECT rank, round(s / (SELECT max(s) FROM c), 9) AS cdf FROM c")
def zipf_cdf(spark, d):
    return zipf_weights(spark, 100, 1.0).select("rank", F.round("cdf", 9).alias("cdf"))


@query("""WITH c AS (SELECT r AS rank, sum(1.0::DOUBLE / r) OVER (ORDER BY r) AS s FROM (SELECT unnest(range(1, 101))::BIGINT AS r)),
e AS (SELECT rank, s / (SELECT max(s) FROM c) AS hi, coalesce(lag(s) OVER (ORDER BY rank) / (SELECT max(s) FROM c), 0) AS lo FROM c),
u AS (SELECT (event_id * 7919 % 10007 + 0.5) / 10007 AS u FROM events)
SELECT rank, count(*) AS cnt FROM u JOIN e ON u.u >= e.lo AND u.u < e.hi GROUP BY rank""")
def zipf_sample(spark, d):
    cdf = [r.cdf for r in zipf_weights(spark, 100, 1.0).orderBy("rank").collect()]  # of a dictionary of 100
    u = (F.col("event_id") * 7919 % 10007 + 0.5) / 10007
    return _t(spark, d, "events").select(zipf_ranks(cdf, u).alias("rank")).groupBy("rank").agg(F.count("*").alias("cnt"))


_DIGITS = "substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', (p_partkey // {})::INT % 62 + 1, 1)"


@query("SELECT p_partkey AS idx, " + " || ".join(_DIGITS.format(62**k) for k in range(4)) + " AS word FROM part")
def index_words(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("idx"), index_word(F.col("p_partkey"), 4).alias("word"))


@query("""SELECT p_partkey AS idx, p_partkey AS n FROM part UNION ALL
SELECT * FROM (VALUES (-1, 16), (-2, 8), (-3, 12), (-4, 0), (-5, 0), (-6, 0), (-7, 2748), (-8, 7), (-9, NULL)) t(idx, n)""")
def parsed_integers(spark, d):
    """Part keys written in hexadecimal, octal or decimal, and read back; then texts of known values."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("0x"), F.hex(k))).when(k % 3 == 1, F.concat(F.lit("0"), F.conv(k.cast("string"), 10, 8))).otherwise(F.concat(k.cast("string"), F.lit("x9")))
    known = spark.createDataFrame(list(enumerate(["0x10", "010", "12x", "", "x", "0", " 0Xabc", "0789", "9" * 30], 1)), "i long, text string")
    rows = _t(spark, d, "part").select(k.alias("idx"), text.alias("text")).union(known.select(-F.col("i"), "text"))
    return rows.select("idx", parse_integer(F.col("text")).alias("n"))


@query(f"SELECT word || ' ' || count(*)::VARCHAR AS value FROM {_WORDS} GROUP BY word")
def text_format(spark, d):
    return wordcount(spark, d).select(formatted(wordcount(spark, d)).alias("value"))


@query("SELECT l_orderkey AS k, l_quantity AS v FROM lineitem")
def binary_round_trip(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey AS k", "l_quantity AS v")
    return unpacked(packed(rows), "k long, v double")


_TWICE = f"(SELECT word, count(*) AS cnt FROM {_WORDS} GROUP BY word)"


@query(f"SELECT (SELECT count(*) FROM documents) AS n_in, (SELECT count(*) FROM {_WORDS}) AS n_kv, (SELECT count(*) FROM {_TWICE}) AS n_kmv, (SELECT count(*) FROM {_TWICE} WHERE cnt > 1) AS n_out")
def record_counts(spark, d):
    """Records in, pairs, groups and records out of a job that keeps words found twice, each counted where it arises."""
    docs, n_in = counted(_t(spark, d, "documents"), "n_in")
    kv, n_kv = counted(words(docs), "n_kv")
    kmv, n_kmv = counted(kv.groupBy("word").agg(F.count("*").alias("cnt")), "n_kmv")
    out, n_out = counted(kmv.where("cnt > 1"), "n_out")
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(n.get["records"] for n in (n_in, n_kv, n_kmv, n_out))], "n_in long, n_kv long, n_kmv long, n_out long")


@query("SELECT (c_custkey % 4)::INT AS part, c_nationkey AS k, sum(c_custkey)::BIGINT AS total FROM customer GROUP BY ALL")
def local_reduce(spark, d):
    """Groups within each partition, rows having been dealt by key first; no exchange follows."""
    dealt = skew.dealt_by(_t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), F.col("c_custkey"), 4)
    return aggregates.local_reduce(dealt, ["k"], total=("c_custkey", "sum"))


# ---------------------------------------------------------------- files, end to end: written, read, worked on, written and read back


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _through_text(df: DataFrame, name: str) -> DataFrame:
    """df's records as lines of text files, read again."""
    path = _folder(df.sparkSession, name)
    write_text(df, path)
    return read_lines(df.sparkSession, path)


def _written(spark, lines_: DataFrame, name: str) -> str:
    path = _folder(spark, name)
    lines_.toDF("value").write.option("lineSep", "\n").text(path)
    return path


@query(f"SELECT word, count(*) AS cnt FROM {_WORDS} GROUP BY word")
def file_wordcount(spark, d):
    """Texts as files, their words counted, the counts as files, and those read as pairs."""
    lines_ = read_lines(spark, _written(spark, _t(spark, d, "documents").where("text is not null").select("text"), "texts"))
    path = _folder(spark, "counts")
    write_text(word_count(lines_, "value"), path)
    return read_pairs(spark, path).select(F.col("key").alias("word"), F.col("value").cast("long").alias("cnt"))


@query(f"SELECT k::VARCHAR || ' ' || v1::VARCHAR || ' ' || v2::VARCHAR AS value FROM {_SIDES}")
def file_join(spark, d):
    sides = [read_pairs(spark, _written(spark, x.select(formatted(x)), "side")) for x in _sides(spark, d)]
    return _through_text(joins.inner(sides[0].toDF("k", "v1"), sides[1].toDF("k", "v2"), "k"), "joined")


@query(_BFS + "SELECT v, level FROM t")
def file_bfs(spark, d):
    """An edge list in files, with a self-loop at each order, searched from the smallest vertex."""
    edges = _graph(spark, d)
    loops = edges.where("src % 2 = 0").select("src", F.col("src").alias("dst")).distinct()
    both = edges.union(loops)
    read = graph.written(graph.edges_of(read_pairs(spark, _written(spark, both.select(formatted(both)), "edges"), numbers=True)))
    tree = graph.search(read, read.agg(F.min("src")).first()[0])
    back = read_pairs(spark, _written(spark, tree.select(F.concat_ws(" ", "v", "level")), "levels"), numbers=True)
    return back.select(F.col("key").alias("v"), F.col("value").cast("int").alias("level"))


_LINE = " || ' ' || ".join(f"'{c.upper()}=(' || min{c}::VARCHAR || ',' || max{c}::VARCHAR || ']'" for c in "xyz")


@query("SELECT regexp_replace(" + _LINE + ", '[.]0([],])', '\\1', 'g') || ' ' || cnt::VARCHAR AS value FROM (" + ORACLES["octree_clusters"] + ")")
def file_octree(spark, d):
    """Points as ` x y z` lines in files, clustered, and the clusters as lines in files."""
    points = read_points(spark, _written(spark, point_lines(_points(spark, d)), "points"))
    return read_lines(spark, _written(spark, octree.as_lines(octree.clusters(points, 0.01)), "clusters"))


@query("SELECT l_orderkey AS k, l_quantity AS v FROM lineitem")
def file_binary(spark, d):
    """Raw records in files, read in splits."""
    path = _folder(spark, "records")
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey AS k", "l_quantity AS v")
    write_binary(rows, path)
    return read_binary(spark, path, "k long, v double", split_bytes=100_000)


@query("SELECT c_custkey AS k, length(c_name) AS v FROM customer")
def map_to_file(spark, d):
    """A map's records straight to files."""
    path = _folder(spark, "mapped")
    KVDataset(_t(spark, d, "customer").select("c_custkey", "c_name")).map(lambda rows: ((k, len(v)) for k, v in rows), "k long, v long", shuffle=False).output(path, "binary")
    return read_binary(spark, path, "k long, v long")


# ---------------------------------------------------------------- key/value jobs


@query("SELECT c_nationkey AS k, count(*) AS n, count(*) AS most FROM customer GROUP BY 1")
def map_shuffled(spark, d):
    """After a map with shuffle a key's records are all in one partition: the largest local count is the whole."""
    data = KVDataset(_t(spark, d, "customer").select("c_nationkey")).map(lambda rows: ((k, 1) for (k,) in rows), "k int, n long", ("k",), parts=5)
    local = aggregates.local_reduce(data.df, ["k"], n=("n", "sum"))
    return local.groupBy("k").agg(F.sum("n").alias("n"), F.max("n").alias("most"))


@query("SELECT (c_custkey % 3)::INT AS part, c_custkey AS k, c_custkey AS n FROM customer")
def map_partitioned(spark, d):
    """A map dealt by a partitioner of the user's."""
    data = KVDataset(_t(spark, d, "customer").select("c_custkey")).map(lambda rows: ((k, k) for (k,) in rows), "k long, n long", ("k",), partitioner=F.col("k"), parts=3)
    return aggregates.local_reduce(data.df, ["k"], n=("n", "sum"))


@query("SELECT n_regionkey AS k, count(*) + 1 AS n FROM nation GROUP BY 1")
def inserted_input(spark, d):
    """Another set's records as further input of one map."""
    nations = KVDataset(_t(spark, d, "nation").select("n_regionkey"))
    regions = KVDataset(_t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey")))
    return nations.including(regions).map(lambda rows: ((k, 1) for (k,) in rows), "k int, n long", ("k",)).combine_columns(n=F.sum("n")).df


@query("SELECT i % 7 AS k, sum(i)::BIGINT AS v FROM (SELECT unnest(range(0, 4000)) AS i) GROUP BY 1")
def generated_input(spark, d):
    """Records without input, from a function of the part."""
    data = KVDataset.generate(spark, lambda part: ((i % 7, i) for i in range(part * 1000, part * 1000 + 1000)), "k long, v long", 4, ("k",))
    return data.combine(lambda a, b: (a[0] + b[0],)).df


@query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer")
def scan_records(spark, d):
    """A scan adds up what it sees where it lies."""
    sc = spark.sparkContext
    n, total = sc.accumulator(0), sc.accumulator(0)
    with KVDataset(_t(spark, d, "customer").select("c_custkey"), ("c_custkey",)) as data:
        data.scan(lambda r: (n.add(1), total.add(r[0])) and None)
    return spark.createDataFrame([(n.value, total.value)], "n long, total long")


class _Summed:
    """A user's database that keeps only how many records each key has."""

    def __init__(self, seen):
        self.seen, self.n = seen, 0

    def put(self, record: tuple) -> None:
        self.n += 1

    def close(self) -> None:
        self.seen.add(self.n)


@query("SELECT count(*) AS n FROM orders")
def user_database(spark, d):
    """All records into a database of the user's, opened and closed for each partition."""
    seen = spark.sparkContext.accumulator(0)
    KVDataset(_t(spark, d, "orders").select("o_orderkey")).into(lambda part: _Summed(seen))
    return spark.createDataFrame([(seen.value,)], "n long")


@query("SELECT event_type AS k, count(*) AS cnt FROM events GROUP BY 1 HAVING count(*) * 8 > 0.8 * (SELECT count(*) FROM events)")
def scanned_split_keys(spark, d):
    found: list[tuple] = []
    skew.scan_split_keys(_t(spark, d, "events").selectExpr("event_type AS k"), "k", 8, lambda k, n: found.append((k, n)))
    return spark.createDataFrame(found, "k string, cnt long")


# ---------------------------------------------------------------- generators: what holds whatever is drawn


@query("SELECT 2000::BIGINT AS n, 2000::BIGINT AS words, 0::BIGINT AS low, 1999::BIGINT AS high")
def generated_keys(spark, d):
    keys = unique_keys(spark, 2000, seed=5)
    return keys.agg(F.count("*").alias("n"), F.count_distinct("word").alias("words"), F.min("idx").alias("low"), F.max("idx").alias("high"))


@query("SELECT 5000::BIGINT AS n, 5000::BIGINT AS counted, true AS within, true AS values_fit, true AS heavy")
def generated_words(spark, d):
    """Zipf words with values and a heavy key: their histogram over the dictionary adds up, and rank 1 is frequent."""
    drawn = zipf_words(spark, 5000, 64, 1.0, seed=2, value_length=4, heavy=0.25, indexed=True, exchange=True)
    dictionary = spark.range(64).select(index_word(F.col("id"), 5).alias("word"))
    most, total = histogram(drawn, dictionary).agg(F.max("cnt"), F.sum("cnt")).first()
    ok = drawn.agg(F.count("*").alias("n"), F.every(F.col("value").between(1000, 9999)).alias("values_fit"), (F.count_distinct("word") <= 64).alias("within"))
    return ok.select("n", F.lit(total).cast("long").alias("counted"), "within", "values_fit", F.lit(most >= 0.25 * 5000).alias("heavy"))


@query("SELECT word, count(*) AS cnt FROM (SELECT event_type AS word FROM events) GROUP BY word")
def generated_stats(spark, d):
    return word_stats(_t(spark, d, "events").selectExpr("event_type AS word"))


@query("SELECT 3000::BIGINT AS n, 3000::BIGINT AS distinct_points, true AS inside, true AS spread")
def generated_points(spark, d):
    at = points(spark, 3000, seed=4, deviation=None)
    return at.agg(
        F.count("*").alias("n"), F.count_distinct("x", "y", "z").alias("distinct_points"), F.every(F.col("x").between(-4, 4) & F.col("y").between(-4, 4) & F.col("z").between(-4, 4)).alias("inside"),
        (F.abs(F.avg("x")) < 0.2).alias("spread"))


@query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total, true AS moved FROM customer")
def exchanged(spark, d):
    """Rows in a random order: all are there, and few stay in their place."""
    c = _t(spark, d, "customer").select("c_custkey")
    order = [r.c_custkey for r in shuffled(c.limit(500), seed=1).collect()]  # of a fixed number
    return c.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"), F.lit(sum(a < b for a, b in zip(order, order[1:])) < 0.9 * len(order)).alias("moved"))
