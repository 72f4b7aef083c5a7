"""Boxes on pages and easing curves as Spark columns. A box is struct<x0, y0, x1, y1>, y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def shared(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Column, b: Column) -> Column:
    """Shared area over the area of both; 0 for two empty boxes."""
    both = area(a) + area(b) - shared(a, b)
    return F.when(both > 0, shared(a, b) / both).otherwise(0.0)


def around(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def holds(b: Column, x: Column, y: Column, slop: float = 3.0) -> Column:
    return (x >= b["x0"] - slop) & (x <= b["x1"] + slop) & (y >= b["y0"] - slop) & (y <= b["y1"] + slop)


def smootherstep(x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return t * t * t * (t * (t * 6 - 15) + 10)


def smootherstep_inverse(y: Column, steps: int = 30) -> Column:
    """By bisection, ``steps`` times."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = smootherstep(mid) < y
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)


def scale_to_fit(width: Column, height: Column, to_width: float, to_height: float) -> Column:
    return F.least(F.lit(to_width) / width, F.lit(to_height) / height)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))
