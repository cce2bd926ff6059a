"""Boxes on a page: structs of x0, y0, x1, y1 as fractions of its size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(SIDES, (x0, y0, x1, y1), strict=True)])


def union(a: Column, b: Column) -> Column:
    """The smallest box around two; null only if both are."""
    sides = [(F.least if n in ("x0", "y0") else F.greatest)(a[n], b[n]).alias(n) for n in SIDES]
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(*sides))


def enclosing(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null if it holds none."""
    known = F.filter(boxes, lambda b: b.isNotNull())
    side = lambda n: (F.array_min if n in ("x0", "y0") else F.array_max)(F.transform(known, lambda b: b[n]))
    return F.when(F.size(known) > 0, F.struct(*[side(n).alias(n) for n in SIDES]))


def vertical_overlap(a: Column, b: Column) -> Column:
    """The shared height over the lower box's height; 0 where they don't meet or one is flat."""
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    lower = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.when((shared > 0) & (lower > 0), shared / lower).otherwise(0.0)
