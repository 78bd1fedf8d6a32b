"""Rectangles as struct<x0,y0,x1,y1>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, TOP, BOTTOM = 2.0, 4.0, 2.0


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(r: Column) -> Column:
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def overlap(a: Column, b: Column) -> Column:
    """Area that both cover."""
    return area(intersection(a, b))


def intersects(a: Column, b: Column) -> Column:
    return (F.greatest(a["x0"], b["x0"]) < F.least(a["x1"], b["x1"])) & (F.greatest(a["y0"], b["y0"]) < F.least(a["y1"], b["y1"]))


def covered(hit: Column, region: Column) -> Column:
    """Share of ``hit`` that ``region`` covers."""
    return overlap(hit, region) / F.greatest(area(hit), F.lit(1e-6))


def padded(r: Column) -> Column:
    return rect(r["x0"] - SIDE, r["y0"] - TOP, r["x1"] + SIDE, r["y1"] + BOTTOM)


def scaled(box: Column, sx: Column, sy: Column) -> Column:
    """A pixel box array in points, to one decimal."""
    return rect(*(F.round(box[i] * (sx if i % 2 == 0 else sy), 1) for i in range(4)))
