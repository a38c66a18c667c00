"""Bins: linear, logarithmic, by edges, with the histogram rules for values outside."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Half-open bin number; NULL outside."""
    b = F.floor((x - lo) * bins / (hi - lo)).cast("int")
    return F.when((x >= lo) & (x < hi) & ~F.isnan(x.cast("double")), F.least(b, F.lit(bins - 1)))


def clamped_bin(n: Column, last: int) -> Column:
    """Small counts, everything from ``last`` up in the last bin."""
    return F.least(n, F.lit(last)).cast("int")


def hist1d_bin(x: Column, lo: float, hi: float, bins: int) -> tuple[Column, Column]:
    """(place, bin): place is under / in / over; a value equal to ``hi`` is an entry without a bin."""
    width = (hi - lo) / bins
    place = F.when(x < lo, "under").when(x > hi, "over").otherwise("in")
    b = F.floor((x - lo) / width).cast("int")
    return place, F.when((x >= lo) & (x <= hi) & (b < bins), b)


def hist2d_cell(x: Column, lo: float, hi: float, bins: int) -> tuple[Column, Column]:
    """(side, cell) of one axis: side -1 / 0 / 1; half-open cells."""
    side = F.when(x < lo, -1).when(x >= hi, 1).otherwise(0)
    b = F.floor((x - lo) * bins / (hi - lo)).cast("int")
    return side, F.when(side == 0, F.least(b, F.lit(bins - 1)))


def q_edges(lo: int, hi: int, bins: int, log: bool) -> list[int]:
    """Whole-number charge edges in [lo, hi): about ``bins`` logarithmic ones, or equal whole widths."""
    lo = min(max(int(lo), 1 if log else 0), 65535)
    hi = min(max(int(hi), lo + 1), 65536)
    bins = min(max(int(bins), 1), 65536)
    if log:
        return sorted({int(v) for v in np.round(np.geomspace(lo, hi, bins + 1))})
    width = max(1, math.ceil((hi - lo) / bins))
    return [min(lo + width * i, 65536) for i in range(math.ceil((hi - lo) / width) + 1)]


def psd_map_edges() -> list[int]:
    """Charge edges of the PSD map: 1 to 65535, 1,025 log points, duplicates taken out."""
    return sorted({int(v) for v in np.round(np.logspace(0, math.log10(65535), 1025))})


def edge_bin(x: Column, edges: list) -> Column:
    """Index i with edges[i] <= x < edges[i+1]; NULL outside. For short edge lists (a bisecting CASE)."""

    def cut(a: int, b: int) -> Column:
        if b - a == 1:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(x < F.lit(edges[m]), cut(a, m)).otherwise(cut(m, b))

    return F.when((x >= F.lit(edges[0])) & (x < F.lit(edges[-1])), cut(0, len(edges) - 1)).cast("int")


def decade_bin(dt_ns: Column, per_decade: int = 10, decades: int = 9) -> Column:
    """Log bin of a time in ns from 1 ns; NULL outside."""
    b = F.floor(F.log10(dt_ns) * per_decade).cast("int")
    return F.when((dt_ns >= 1) & (b >= 0) & (b < per_decade * decades), b)
