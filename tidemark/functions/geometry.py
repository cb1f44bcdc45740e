"""Rectangles as structs x0, y0, x1, y1 with exclusive upper edges, and joins of them by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 64


def intersection(a: Column, b: Column) -> Column:
    """Area that two rectangles share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return F.struct(
        F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"),
        F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"),
    )


def grow(a: Column, margin: Column, width: Column, height: Column) -> Column:
    """``a`` grown by ``margin`` on every side, clipped to the picture."""
    zero = F.lit(0)
    return F.struct(
        F.greatest(a["x0"] - margin, zero).alias("x0"), F.greatest(a["y0"] - margin, zero).alias("y0"),
        F.least(a["x1"] + margin, width).alias("x1"), F.least(a["y1"] + margin, height).alias("y1"),
    )


def gap(a: Column, b: Column) -> Column:
    """Distance between two rectangles; 0 where they touch or overlap."""
    dx = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0))
    dy = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0))
    return F.hypot(dx.cast("double"), dy.cast("double"))


def relation(a: Column, b: Column) -> Column:
    """Where two rectangles lie to each other: overlapping, beside (they share rows), above or below (they share columns), else diagonal."""
    rows = F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"])
    columns = F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])
    return F.when(rows & columns, "overlap").when(rows, "beside").when(columns & (a["y1"] <= b["y0"]), "above").when(columns, "below").otherwise("diagonal")


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot((a["x0"] + a["x1"] - b["x0"] - b["x1"]).cast("double"), (a["y0"] + a["y1"] - b["y0"] - b["y1"]).cast("double")) / 2


def cells(a: Column, size: int = CELL) -> Column:
    """Grid cells that a rectangle touches, as one number each."""
    xs = F.sequence(F.floor(a["x0"] / size), F.greatest(F.floor((a["x1"] - 1) / size), F.floor(a["x0"] / size)))
    ys = F.sequence(F.floor(a["y0"] / size), F.greatest(F.floor((a["y1"] - 1) / size), F.floor(a["y0"] / size)))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: x * F.lit(1 << 20) + y)))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, size: int = CELL) -> DataFrame:
    """Pairs of rows of ``left`` and ``right`` with equal ``on`` whose rectangles ``a`` and ``b`` intersect, with their ``area``.

    Both sides are dealt to grid cells and joined on the cell, so no pair of far rectangles is ever formed; of the cells
    that a pair shares, the one that holds the corner of the intersection makes the row.
    """
    x = left.withColumn("_cell", F.explode(cells(F.col(a), size)))
    y = right.withColumn("_cell", F.explode(cells(F.col(b), size)))
    both = x.join(y, [*on, "_cell"])
    corner = F.floor(F.greatest(F.col(a)["x0"], F.col(b)["x0"]) / size) * F.lit(1 << 20) + F.floor(F.greatest(F.col(a)["y0"], F.col(b)["y0"]) / size)
    return both.withColumn("area", intersection(F.col(a), F.col(b))).filter((F.col("area") > 0) & (F.col("_cell") == corner)).drop("_cell")
