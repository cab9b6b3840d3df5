"""Breadth-first search over directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.scans import running_total
from quern.storage import SPLIT, materialize, small_tasks


def edges_of(pairs: DataFrame, source: str = "key", target: str = "value", n: int | None = None) -> DataFrame:
    """src, dst (long) of pairs of texts or numbers, without those whose two texts are equal; with n, ids must be below it."""
    df = pairs.where(F.col(source) != F.col(target)).select(F.col(source).cast("long").alias("src"), F.col(target).cast("long").alias("dst"))
    if n is not None:
        df = df.where(F.when((F.col("src") < n) & (F.col("dst") < n), True).otherwise(F.raise_error(F.lit(f"a vertex is not below {n}")).cast("boolean")))
    return df


def written(edges: DataFrame) -> DataFrame:
    """src, dst of edges as a table to search in; one that was written already is taken as it is."""
    if getattr(edges, "written_at", None) and edges.columns == ["src", "dst"]:
        return edges
    with small_tasks(edges.sparkSession):
        return materialize(edges.select("src", "dst"), "edges", SPLIT)


def degrees(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """v, deg: how many edges leave each vertex that any leaves; counted in parts, or in as many as the session has."""
    if parts:
        edges = edges.select("src").repartition(parts, "src")
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))


def adjacency(edges: DataFrame) -> DataFrame:
    """v, start, targets: compressed sparse rows. targets are v's in order; start is where they begin when all vertices'
    lie end to end by v. A vertex's targets are held as one value, as that form asks for."""
    rows = edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("targets"))
    return running_total(rows.withColumn("n", F.size("targets")), "v", "n", "start").select("v", "start", "targets")


def cut_edges(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """edges without those that leave visited vertices (v), as a search that carries its edges along drops them."""
    return edges.join(visited.select("v"), F.col("src") == F.col("v"), "left_anti")


def random_root(edges: DataFrame, seed: int = 0) -> int:
    """A vertex that edges leave, drawn by a seeded hash, so that reruns agree."""
    found = edges.agg(F.min_by("src", F.struct(F.xxhash64(F.lit(seed), "src"), "src"))).first()[0]
    if found is None:
        raise ValueError("no edges")
    return found


def search(edges: DataFrame, root: int, max_level: int | None = None, seed: int = 0) -> DataFrame:
    """v, parent, level of each vertex reached from root (its own parent); the smallest of possible parents.

    A root below 0 stands for a random one (by seed) that edges leave.
    A round is one join of the frontier with the edges, one partial aggregation and one anti-join with what is reached;
    its result is written, so that plans stay short. Only the count of new vertices reaches the driver. What a task
    reads has a bound, whatever the number of edges, and so has what it holds.
    """
    spark = edges.sparkSession
    edges = written(edges)
    root = random_root(edges, seed) if root < 0 else root
    with small_tasks(spark, edges.count()):
        frontier = spark.range(1).select(F.lit(root).cast("long").alias("v"), F.lit(root).cast("long").alias("parent"), F.lit(0).alias("level"))
        tree, level = materialize(frontier, "level"), 0
        frontier = tree
        while max_level is None or level < max_level:
            level += 1
            found = edges.join(frontier.select("v"), F.col("src") == F.col("v")).groupBy("dst").agg(F.min("src").alias("parent"))
            new = found.join(tree.select("v"), F.col("dst") == F.col("v"), "left_anti").select(F.col("dst").alias("v"), "parent", F.lit(level).alias("level"))
            frontier = materialize(new, "level")
            if frontier.isEmpty():
                break
            tree = tree.unionByName(frontier)
            if level % 16 == 0:
                tree = materialize(tree, "tree")
    return tree


def all_vertices(tree: DataFrame, vertices: DataFrame) -> DataFrame:
    """v, pred for each of vertices (v): the parent, or -1 where it isn't reached."""
    return vertices.join(tree.select("v", "parent"), "v", "left").select("v", F.coalesce("parent", F.lit(-1).cast("long")).alias("pred"))


def candidates_by_level(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """level, n: how many edges leave the vertices of each level; levels without any are left out."""
    return tree.join(edges, F.col("v") == F.col("src")).groupBy("level").agg(F.count("*").alias("n"))
