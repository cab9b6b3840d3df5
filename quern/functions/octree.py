"""Cells of the octree over the cube from -4 to 4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 15


def cell(coordinate: Column) -> Column:
    """The cell of a coordinate at the deepest level, 0 to 32767: half-open on the low side, clamped at the edges.

    Exact for doubles, as multiplying by 4096 only moves the exponent.
    """
    return F.least(F.lit((1 << LEVELS) - 1).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(coordinate * 4096) - 1 + (1 << (LEVELS - 1))))


def key(ix: Column, iy: Column, iz: Column) -> Column:
    """Fifteen octal digits, most significant first; a level's key is the beginning of that length."""
    bit = lambda c, i: F.shiftright(c, LEVELS - 1 - i).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(ix, i) + 2 * bit(iy, i) + 4 * bit(iz, i)).cast("string") for i in range(LEVELS)])


def low_edge(cell_: Column, level: Column) -> Column:
    return F.lit(-4.0) + cell_ * F.lit(8.0) / F.pow(F.lit(2.0), level)
