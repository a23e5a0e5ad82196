"""Box expressions: boxes are structs or prefixed columns l, t, r, b."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(b["r"] - b["l"], F.lit(0.0)) * F.greatest(b["b"] - b["t"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), F.lit(0.0))
    h = F.greatest(F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]), F.lit(0.0))
    return w * h


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlap_share(cell: Column, region: Column) -> Column:
    """How much of the cell lies in the region."""
    a = area(cell)
    return F.when(a > 0, intersection(cell, region) / a).otherwise(F.lit(0.0))


def quantize(x: Column, page: Column, grid: int = 512) -> Column:
    """A coordinate on a grid over the page."""
    return F.least(F.greatest(F.round(F.lit(grid) * x / page), F.lit(0)), F.lit(grid - 1)).cast("int")
