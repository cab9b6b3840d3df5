"""Dense octants of 3-D points: all levels in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.octree import LEVELS, cell, low_edge
from quern.functions.text import general


def cells(points: DataFrame) -> DataFrame:
    """ix, iy, iz of each point (x, y, z) at the deepest level."""
    return points.select(cell(F.col("x")).alias("ix"), cell(F.col("y")).alias("iy"), cell(F.col("z")).alias("iz"))


def threshold(n: int, density: float) -> int:
    """The count that a dense octant must exceed; n goes through a 32-bit float, as counts of points do here."""
    import numpy as np

    return int(float(np.float32(n)) * density)


def dense_octants(points: DataFrame, density: float) -> DataFrame:
    """level, ix, iy, iz, cnt of every octant, at levels 0 to 15, with more points than the threshold.

    Points are summed by deepest cell before they are counted at all levels, so that the sixteen-fold explosion is of
    distinct cells, not of points.
    """
    df = cells(points).groupBy("ix", "iy", "iz").agg(F.count("*").alias("m"))
    limit = threshold(points.count(), density)
    at = lambda c: F.expr(f"shiftright({c}, {LEVELS} - level)").alias(c)
    df = df.select("ix", "iy", "iz", "m", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    return df.select("level", at("ix"), at("iy"), at("iz"), "m").groupBy("level", "ix", "iy", "iz").agg(F.sum("m").alias("cnt")).where(F.col("cnt") > limit)


def as_lines(found: DataFrame) -> DataFrame:
    """value: `X=(a,b] Y=(c,d] Z=(e,f] count` for each row of clusters."""
    span = lambda c: F.concat(F.lit(f"{c.upper()}=("), general(F.col(f"min{c}")), F.lit(","), general(F.col(f"max{c}")), F.lit("]"))
    return found.select(F.concat_ws(" ", *map(span, "xyz"), F.col("cnt").cast("string")).alias("value"))


def clusters(points: DataFrame, density: float) -> DataFrame:
    """minx, maxx, miny, maxy, minz, maxz, cnt of the dense octants of the deepest level that has any."""
    dense = dense_octants(points, density)
    deepest = dense.agg(F.max("level").alias("deepest"))
    df = dense.join(F.broadcast(deepest), F.col("level") == F.col("deepest"))  # one row
    out = []
    for axis in "xyz":
        low = low_edge(F.col(f"i{axis}"), F.col("level"))
        out += [low.alias(f"min{axis}"), low_edge(F.col(f"i{axis}") + 1, F.col("level")).alias(f"max{axis}")]
    return df.select(*out, "cnt")
