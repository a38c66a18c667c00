"""What is asked of stored histograms and catalogues: one channel, a grid, side by side, run lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.functions.binning import q_edges
from beamloom.operators.hist import outside_totals, rebin

COMPARE_CHANNELS = 8
RUNS_LISTED = 300


def channel_spectrum(spec: DataFrame, slot: int | None, lo: int, hi: int, bins: int, log: bool) -> DataFrame:
    """Spectrum of one channel (or all) in a range and binning, with the bin edges and the counts outside.

    Works on the stored spectrum; the filter on the channel reaches its scan."""
    edges = q_edges(lo, hi, bins, log)
    one = spec if slot is None else spec.filter(F.col("slot") == slot)
    e = F.array(*[F.lit(x) for x in edges])
    b = rebin(one, edges).withColumns({"lo": F.get(e, F.col("bin")), "hi": F.get(e, F.col("bin") + 1)})
    return b.join(outside_totals(one, edges[0], edges[-1]), "slot", "left")


def compare_channels(spec: DataFrame, slots: list[int], lo: int, hi: int, bins: int, most: int | None = None) -> DataFrame:
    """The asked channels side by side, in the order asked; a view that shows COMPARE_CHANNELS says so by ``most``, and more are refused."""
    asked = list(dict.fromkeys(slots))
    if most is not None and len(asked) > most:
        raise ValueError(f"{len(asked)} channels asked, {most} at most")
    place = F.array_position(F.array(*[F.lit(s) for s in asked]), F.col("slot")).cast("int")
    return rebin(spec.filter(F.col("slot").isin(*asked)), q_edges(lo, hi, bins, False)).withColumn("place", place)


def newest_runs(catalogue: DataFrame, n: int = RUNS_LISTED) -> DataFrame:
    """The run list, newest first; the list's length is the view's."""
    return catalogue.orderBy(F.desc("start"), F.desc("run")).limit(n)


def missing_boards(listed: DataFrame, there: DataFrame, key: str = "serial") -> DataFrame:
    """(key, state): listed but not there, there but not listed."""
    a = listed.join(there, key, "left_anti").select(key, F.lit("missing").alias("state"))
    return a.unionByName(there.join(listed, key, "left_anti").select(key, F.lit("added").alias("state")))
