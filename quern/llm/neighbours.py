"""Approximate nearest neighbours by collision counting on single projections, after query-aware hashing.

All vectors are indexed, in chunks: a chunk's vectors are projected on `lines` random lines, each kept as one sorted
array. A query opens a window around its own projection on each line; virtual rehashing widens all windows step by step.
A vector in the windows of more than `threshold` of the lines is a candidate; once enough are, they are verified by exact
cosine. Queries are packed in blocks, blocks in groups of bounded size; a task builds one chunk's index once and streams
one group's blocks through it, so that neither its memory nor its time grows with the table. Each query brings k rows from
each chunk, and the best k of those are kept by a window over the query's few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.shared import materialize, table

#: Vectors of an index; queries of a block; blocks of a group.
CHUNK, BLOCK, GROUP = 8192, 512, 32
#: Lines, the share of them in whose windows a candidate is, the share of a chunk that is verified at least, and a number
#: besides; how windows grow. With these, recall over sf0.1 is above 0.95 (its vectors have no near neighbours to speak of).
LINES, THRESHOLD, SHARE, LEAST, WIDEN = 64, 0.55, 0.2, 100, 1.12


def _one_each(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their ids; of an id's rows, that of the smallest vector."""
    order = np.lexsort((*vectors.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, first = np.unique(ids[order], return_index=True)
    return ids, vectors[order[first]]


class Index:
    """Sorted projections of a chunk's unit vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES, seed: int = 0):
        self.ids, self.vectors = _one_each(ids, vectors)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.lines = np.random.default_rng(seed).normal(size=(vectors.shape[1], lines))
        at = (self.vectors / self.norms[:, None]) @ self.lines
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(at, axis=0).T.copy()
        self.widths = 0.1 * WIDEN ** np.arange(80)
        self.step = 10  # where the last search ended; the next begins there

    def _windows(self, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and line, where its window begins and ends."""
        width = self.widths[step]
        return tuple(np.stack([s.searchsorted(at[:, j] + d, side) for j, s in enumerate(self.sorted)], axis=1) for d, side in ((-width, "left"), (width, "right")))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: float = THRESHOLD, share: float = SHARE, least: int = LEAST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id, the ids of its k nearest that were found, and their cosines."""
        n, lines = len(self.ids), len(self.sorted)
        query_ids, queries = _one_each(query_ids, queries)
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        at = (queries / norms[:, None]) @ self.lines
        enough, wanted = min(n, max(least + k, int(share * n))), threshold * lines
        windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of all queries of the block, by step
        for q in range(len(queries)):
            step, lo, hi, counts = self.step, None, None, None
            while True:
                if step not in windows:
                    windows[step] = self._windows(at, step)
                lo2, hi2 = windows[step][0][q].tolist(), windows[step][1][q].tolist()
                if counts is None:
                    new = [o[a:b] for o, a, b in zip(self.order, lo2, hi2, strict=True)]
                    counts = np.bincount(np.concatenate(new), minlength=n)
                else:
                    new = [x for o, a, a2, b, b2 in zip(self.order, lo, lo2, hi, hi2, strict=True) for x in (o[a2:a], o[b:b2])]
                    counts += np.bincount(np.concatenate(new), minlength=n)
                lo, hi = lo2, hi2
                found = np.flatnonzero(counts > wanted)
                if len(found) >= enough or step == len(self.widths) - 1:
                    break
                step = min(step + (1 if len(found) * 2 > enough else 3), len(self.widths) - 1)
            self.step = max(0, step - (len(found) > 1.3 * enough))
            found = found[self.ids[found] != query_ids[q]]
            cosines = np.einsum("ij,j->i", self.vectors[found], queries[q]) / (self.norms[found] * norms[q])
            best = np.lexsort((self.ids[found], -cosines))[:k]
            yield int(query_ids[q]), self.ids[found][best], cosines[best]


def _usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, v, dim of the vectors that take part: ids not null, all components finite, one of them not zero."""
    df = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return df.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)").withColumn("dim", F.size("v"))


def _packed(rows: DataFrame, part: str, parts: int) -> DataFrame:
    """part, dim, ids, vs: the rows dealt to `parts` parts by a hash of their ids, as bytes."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({part: [pdf[part].iat[0]], "dim": [pdf["dim"].iat[0]], "ids": [pdf["id"].to_numpy().astype("<i8").tobytes()], "vs": [np.concatenate(pdf["v"].to_list()).astype("<f8").tobytes()]})

    dealt = rows.withColumn(part, F.pmod(F.xxhash64(F.lit(part), "id"), F.lit(parts)).cast("int"))
    return dealt.groupBy(part, "dim").applyInPandas(each, f"{part} int, dim int, ids binary, vs binary")


def nearest(vectors: DataFrame, is_query, k: int = 5, id_: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors that is_query(id column) holds for, its k nearest.

    Nearness is the cosine of the original vectors in double precision; ties go to the smaller id. Rows of the query's
    own id are no candidates; vectors meet those of their own dimension only. Of several rows of one id, that of the
    smallest vector stands for all, as query and as candidate. Vectors that are null, zero, or have null or non-finite
    components take no part. Queries with fewer than k candidates get them all; without any, no row. Other columns of
    vectors aren't read, so their names don't matter.
    """
    rows = materialize(_usable(vectors, id_, vector), "neighbours")
    asked = rows.where(is_query(F.col("id")))
    chunks, blocks = max(1, -(-rows.count() // chunk)), max(1, -(-asked.count() // block))
    groups = -(-blocks // group)
    left = _packed(rows, "chunk", chunks).select("chunk", "dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).alias("block"), "ids", "vs")
    right = _packed(asked, "block", blocks).select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "dim", F.floor(F.col("block") / group).cast("int").alias("group"), "block", "ids", "vs")
    # of each chunk and group, the chunk's vectors come first and the group's queries after them
    met = left.union(right).repartition(chunks * groups, "chunk", "group", "dim").sortWithinPartitions("chunk", "group", "dim", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = key = None
        for batch in batches:
            for i in range(batch.num_rows):
                c, dim, g, b, ids, vs = (batch.column(j)[i] for j in range(6))
                own = (c.as_py(), g.as_py(), dim.as_py())
                ids, vs = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(vs.as_buffer(), "<f8").reshape(-1, own[2])
                if b.as_py() < 0:
                    index, key = Index(ids, vs), own
                elif own == key:  # queries of a dimension that the chunk lacks find nothing in it
                    found = list(index.search(ids, vs, k))
                    yield pa.record_batch({
                        "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])),
                        "vec_id": pa.array(np.concatenate([f[1] for f in found])), "score": pa.array(np.concatenate([f[2] for f in found])),
                    })

    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
