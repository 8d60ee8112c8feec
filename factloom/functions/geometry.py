"""Boxes ``(x0, y0, x1, y1)`` in page fractions, as structs of four doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def union(boxes: Column) -> Column:
    """Enclosing box of an array of boxes; null when empty."""
    return F.when(
        F.size(boxes) > 0,
        box(
            F.array_min(F.transform(boxes, lambda b: b["x0"])),
            F.array_min(F.transform(boxes, lambda b: b["y0"])),
            F.array_max(F.transform(boxes, lambda b: b["x1"])),
            F.array_max(F.transform(boxes, lambda b: b["y1"])),
        ),
    )


def area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b["x1"] - b["x0"]) * F.greatest(zero, b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(zero, wide) * F.greatest(zero, high)


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    whole = area(a) + area(b) - both
    return F.coalesce(F.when(whole > 0, both / whole), F.lit(0.0))


def containment(predicted: Column, gold: Column) -> Column:
    """Struct coverage (share of gold inside) and dilution (predicted area over gold area)."""
    g = area(gold)
    return F.struct(
        F.coalesce(F.when(g > 0, intersection(predicted, gold) / g), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.when(g > 0, area(predicted) / g), F.lit(0.0)).alias("dilution"),
    )


def height_ratio(predicted: Column, gold: Column) -> Column:
    high = F.greatest(F.lit(1e-9), gold["y1"] - gold["y0"])
    return F.coalesce((predicted["y1"] - predicted["y0"]) / high, F.lit(0.0))
