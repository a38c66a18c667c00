"""Odd-even polygon test as one expression (no UDF, no join when the cuts are parameters)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Crossing parity over the polygon's edges."""
    n = len(points)
    crossings = F.lit(0)
    for i in range(n):
        (x1, y1), (x2, y2) = points[i], points[(i + 1) % n]
        if y1 == y2:
            continue
        lo, hi = min(y1, y2), max(y1, y2)
        at = F.lit(x1) + (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when((y >= lo) & (y < hi) & (x < at), 1).otherwise(0)
    return F.coalesce(crossings % 2 == 1, F.lit(False))


def in_polygon_array(x: Column, y: Column, points: Column) -> Column:
    """The same test against an array<struct<x,y>> column."""
    n = F.size(points)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(points, i).alias("p"), F.get(points, (i + 1) % n).alias("q")))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        between = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        return F.coalesce(between & (x < at), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1
