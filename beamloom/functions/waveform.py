"""Reading single waveforms: gates, baseline, threshold, extremes. Arrays stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gate_span(dw: Column) -> tuple[Column, Column]:
    """(first sample, sample after the last) where a digital probe is high; NULL if never."""
    n = F.size(dw)
    first = F.array_position(dw, True)
    last = n - F.array_position(F.reverse(dw), True) + 1
    return F.when(first > 0, first - 1).cast("int"), F.when(first > 0, last).cast("int")


def baseline(wf: Column, pre_samples: int) -> Column:
    """Mean of the first half of the pre-trigger samples (4 at least)."""
    head = F.slice(wf, 1, max(4, pre_samples // 2))
    return F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / F.size(head)


def threshold_level(wf: Column, pre_samples: int, threshold: float, negative: bool) -> Column:
    return baseline(wf, pre_samples) + F.lit(-threshold if negative else threshold)
