"""Mixing sources to target weights by Sainte-Lague apportionment.

The wanted words are dealt in equal blocks: first to sources, then to each source's shards, always to the highest
quotient weight / (2 * blocks so far + 1), and never more blocks than a shard may give. Within a shard documents lie end
to end in a seeded order, cut into blocks; the shard's quota is a whole number of passes over it and a run of blocks from
a seeded one on, going on at the beginning where the shard ends. Shards are of about 1,000 documents from the first row
on, so a source that holds a third of all rows has a third of the shards; only from max_shards on do they grow. One row
for each source (max_sources at most) and each shard reaches the driver. Sizes are counted in one pass and written,
without texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.llm.shared import WORD, lean, materialize, release, slices, table

WEIGHTS = (5, 2, 1)


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Integer seats by highest quotients weights[i] / (2 * k + 1); ties go to the smaller i. No weight, no seat."""
    total = float(sum(weights))
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    got = np.floor(np.asarray(weights, dtype=float) * seats / total + 0.5).astype(int)
    got[np.asarray(weights) <= 0] = 0
    got = got.tolist()
    over = sum(got) - seats
    if over > 0:  # give back the lowest quotients
        heap = [(w / (2 * g - 1), -i) for i, (w, g) in enumerate(zip(weights, got, strict=True)) if g]
        heapq.heapify(heap)
        for _ in range(over):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (weights[-i] / (2 * got[-i] - 1), i))
    else:
        heap = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, got, strict=True)) if w > 0]
        heapq.heapify(heap)
        for _ in range(-over):
            _, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def apportioned(weights: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """sainte_lague with at most most[i] seats for i; what is over goes to the others, as far as they may have more."""
    got, open_ = [0] * len(weights), [i for i in range(len(weights)) if weights[i] > 0 and most[i] > 0]
    left = min(seats, sum(most[i] for i in open_))
    while left > 0:
        new = sainte_lague([weights[i] for i in open_], left)
        for i, n in zip(open_, new, strict=True):
            n = min(n, most[i] - got[i])
            got[i] += n
            left -= n
        open_ = [i for i in open_ if got[i] < most[i]]
    return got


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """share * all sizes by weight; none above most * its size, the excess dealt again by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _plan(sized: DataFrame, weights: Sequence[float], share: float, most: float, block: int, shard_docs: int, max_shards: int, max_sources: int) -> tuple[DataFrame, DataFrame]:
    """(sidx, s, source_size, target, shards) by source, and (qidx, qshard, total, quota) by shard.

    sized has source, size and seeded, by which a row's shard is _shard().
    """
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows = sorted(found, key=lambda r: (r.source is None, r.source or ""))  # a code point order
    sizes, n = [r["size"] for r in rows], [r.n for r in rows]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, most)
    wide = max(shard_docs, -(-sum(n) // max_shards))
    shards = [max(1, -(-x // wide)) for x in n]
    of_source = F.broadcast(spark.createDataFrame(
        [(i, r.source, sizes[i], target[i], shards[i]) for i, r in enumerate(rows)], "sidx int, s string, source_size long, target double, shards int"))
    totals = sized.join(of_source, F.col("source").eqNullSafe(F.col("s"))).groupBy("sidx", _shard().alias("shard")).agg(F.sum("size").alias("total")).orderBy("sidx", "shard").toPandas()
    seats = sainte_lague(target, round(sum(target) / block))
    quotas = []
    for i, part in totals.groupby("sidx"):
        own = part["total"].tolist()
        dealt = apportioned(own, seats[i], [-(-int(most * t) // block) for t in own])
        quotas += [(int(i), int(s), int(t), min(q * block, int(most * t))) for s, t, q in zip(part["shard"], own, dealt, strict=True)]  # a last block may be short
    return of_source, F.broadcast(spark.createDataFrame(quotas, "qidx int, qshard int, total long, quota long"))


def _shard() -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), "seeded"), F.col("shards")).cast("int")


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _taken(sized: DataFrame, of_source: DataFrame, quotas: DataFrame, seed: int, block: int, *ties: str) -> DataFrame:
    """sized (source, size, seeded, ...) with source_size, target and taken."""
    df = sized.join(of_source, F.col("source").eqNullSafe(F.col("s"))).withColumn("shard", _shard())
    df = df.join(quotas, (F.col("sidx") == F.col("qidx")) & (F.col("shard") == F.col("qshard")))
    order = Window.partitionBy("sidx", "shard").orderBy("seeded", *ties).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("before", F.sum("size").over(order) - F.col("size"))
    passes = F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(F.lit(0))
    blocks = F.greatest(F.ceil(F.col("total") / block), F.lit(1))
    df = df.withColumn("passes", passes).withColumn("first", F.pmod(F.xxhash64(F.lit(seed), "sidx", "shard"), blocks) * block)
    df = df.withColumn("end", F.col("first") + F.col("quota") - F.col("passes") * F.col("total"))
    inside = lambda a, b: F.greatest(F.lit(0), F.least(F.col("before") + F.col("size"), b) - F.greatest(F.col("before"), a))
    rest = inside(F.col("first"), F.col("end")) + inside(F.lit(0), F.col("end") - F.col("total"))
    return df.withColumn("taken", (F.col("passes") * F.col("size") + rest).cast("long"))


OPTIONS = {"weights": WEIGHTS, "share": 1.5, "most": 2.0, "seed": 0, "block": 64, "shard_docs": 1000, "max_shards": 1 << 18, "max_sources": 100_000}


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    return docs.select("source", _size().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("seeded"), *more)


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken. options: as in OPTIONS.

    Size is the number of words (null and empty texts: 0, of which 0 are taken). Sources are ranked by code point, a
    null source last; they weigh `weights` in turn, and share `share` of all sizes. taken is most * size at most; in each
    shard two documents at most, where its run of blocks begins and ends, are taken in part. Equal rows lie next to each
    other in the seeded order, so that reruns agree; the order depends on seed, doc_id and text alone. Columns other than
    doc_id, text and source aren't read. An empty table gives no row; more than max_sources sources are an error.
    """
    o = OPTIONS | options
    sized = materialize(_sized(docs, o["seed"], F.col("doc_id")), "mix-sizes")
    plan = _plan(sized, *(o[k] for k in ("weights", "share", "most", "block", "shard_docs", "max_shards", "max_sources")))
    return _taken(sized, *plan, o["seed"], o["block"], "doc_id", "size").select("doc_id", "size", "source_size", "target", "taken")


def copies(docs: DataFrame, **options: object) -> DataFrame:
    """docs as mixed: each row whole as often as it is taken whole, and a beginning of its text for the rest.

    The beginning ends after as many words as are taken. Rows of which nothing is taken go; columns stay as they are
    (n_chars, if there, follows the text), whatever their names. Rows go through the order of their shard with all their
    columns, so that each takes what mix says of it, equal rows too.
    """
    import re

    o = OPTIONS | options
    counted = materialize(_sized(docs, o["seed"]), "mix-sizes")
    plan = _plan(counted, *(o[k] for k in ("weights", "share", "most", "block", "shard_docs", "max_shards", "max_sources")))
    release(counted)  # the plan came through the driver
    sized = _sized(docs, o["seed"], F.col("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = _taken(sized, *plan, o["seed"], o["block"], "doc_id", "size").where("taken > 0").select("row", "size", "taken")
    df = df.withColumn("words", F.explode(F.expr("transform(sequence(1, cast(ceil(taken / size) AS int)), i -> least(size, taken - (i - 1) * size))")))
    own = [f"c{i}" for i in range(len(docs.columns))]  # no name of theirs can clash so
    columns = [F.col("row")[c].alias(k) for c, k in zip(docs.columns, own, strict=True)]
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = T.StructType([T.StructField(k, docs.schema[c].dataType) for c, k in zip(docs.columns, own, strict=True)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for part in slices(batches, text):
            out, (words, size) = part.columns[: len(own)], part.columns[len(own) :]
            short = pc.less(words, size)
            if pc.any(short).as_py():
                ends = []
                for t, n in zip(out[text].filter(short).to_pylist(), words.filter(short).to_pylist(), strict=True):
                    end = 0
                    for _, m in zip(range(n), word.finditer(t), strict=False):
                        end = m.end()
                    ends.append(t[:end])
                out[text] = pc.replace_with_mask(out[text], short, pa.array(ends, pa.string()))
                if n_chars is not None:
                    out[n_chars] = pc.replace_with_mask(out[n_chars], short, pa.array(list(map(len, ends)), pa.int64()).cast(out[n_chars].type))
            yield pa.RecordBatch.from_arrays(out, names=own)

    return df.select(*columns, "words", "size").mapInArrow(lean(cut), schema).toDF(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
