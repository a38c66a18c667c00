"""Counts, spectra and histograms: sparse (key, bin, n) tables that add up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions import binning as B
from beamloom.functions import hitcols as H
from beamloom.operators.ordering import Ordered, SlicePlan, plan_slices
from beamloom.schema import PS_PER_S

# The rate spectrum's time bin, window length and averaging.
FFT_BIN_PS = 10_000_000
FFT_BINS = 1 << 15
FFT_GROUP = 4
FFT_WINDOWS_PER_CALL = 16


def count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def counts_sets(hits: DataFrame) -> DataFrame:
    """Hits, piled-up hits, 1024-markers and good hits per channel, per board and in all."""
    return hits.groupingSets([["board", "slot"], ["board"], []], "board", "slot").agg(
        count(),
        F.count_if(F.col("pur")).alias("n_pur"),
        F.count_if(H.has_flag(F.col("flags"), H.FLAG_1024_COUNTED)).alias("n_1024"),
        F.count_if(~F.col("pur")).alias("n_good"),
    )


def spectrum(hits: DataFrame, key: str = "slot", value: str = "qlong") -> DataFrame:
    """Full-resolution pulse-height spectrum."""
    return hits.groupBy(key, value).agg(count())


def rebin(spec: DataFrame, edges: list[int], key: str = "slot", value: str = "qlong") -> DataFrame:
    """Spectrum in wider bins, 0 and saturated left out. Works on the spectrum, so no pass over the hits."""
    inner = (F.col(value) > 0) & (F.col(value) < H.Q_SATURATED)
    width = edges[1] - edges[0]
    if all(b - a == width for a, b in zip(edges, edges[1:-1])):
        x = F.col(value).cast("long")
        n_bins = len(edges) - 1
        b = F.when((x >= edges[0]) & (x < edges[-1]), F.least(F.floor((x - edges[0]) / width), F.lit(n_bins - 1)))
        binned = spec.filter(inner).withColumn("bin", b.cast("int"))
    else:
        binned = spec.filter(inner).join(F.broadcast(edge_table(spec, edges, value)), value)
    return binned.filter(F.col("bin").isNotNull()).groupBy(key, "bin").agg(F.sum("n").alias("n"))


def edge_table(df: DataFrame, edges: list[int], value: str) -> DataFrame:
    """(value, bin) for every charge a digitizer can give: at most 65,536 rows, so safe to broadcast."""
    e = F.array(*[F.lit(int(x)) for x in edges])
    i = F.col("id").cast("int")
    values = F.sequence(F.get(e, i), F.get(e, i + 1) - 1)
    return df.sparkSession.range(len(edges) - 1).select(F.explode(values).alias(value), i.alias("bin"))


def outside_totals(spec: DataFrame, lo: int, hi: int, key: str = "slot", value: str = "qlong") -> DataFrame:
    """Per channel: all counts, zero charge, saturated, and good counts outside [lo, hi)."""
    v = F.col(value)
    good = (v > 0) & (v < H.Q_SATURATED)
    return spec.groupBy(key).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(v == 0, F.col("n")).otherwise(0)).alias("zero"),
        F.sum(F.when(v == H.Q_SATURATED, F.col("n")).otherwise(0)).alias("saturated"),
        F.sum(F.when(good & ((v < lo) | (v >= hi)), F.col("n")).otherwise(0)).alias("outside"),
    )


def psd_map(hits: DataFrame, key: str = "slot") -> DataFrame:
    """(channel, log charge bin, PSD bin, n). Counts per charge first, so the edge lookup is on reduced rows."""
    y = H.psd_bin(F.col("qlong"), F.col("qshort"))
    fine = hits.select(key, "qlong", y.alias("y")).filter(F.col("y").isNotNull()).groupBy(key, "qlong", "y").agg(count())
    x = edge_table(hits, B.psd_map_edges(), "qlong").withColumnRenamed("bin", "x")
    return fine.join(F.broadcast(x), "qlong").groupBy(key, "x", "y").agg(F.sum("n").alias("n"))


def psd_out(hits: DataFrame, key: str = "slot") -> DataFrame:
    return hits.filter(H.psd_out(F.col("qlong"), F.col("qshort"))).groupBy(key).agg(count())


def since_previous(hits: DataFrame, key: str = "slot", unit_per_ns: float = 1000.0, plan: SlicePlan | None = None) -> DataFrame:
    """Time since the previous hit on the same channel, in log bins. Sliced per channel, so one busy channel
    is many tasks; unlike a per-batch count, the first hit of a batch does have a predecessor."""
    plan = plan or plan_slices(hits, (key,))
    dt = (F.col("ts_ps") - F.col("_prev")).cast("double") / unit_per_ns
    o = Ordered(hits.select(key, "ts_ps", "pos"), plan).prev_time("_prev").done()
    return o.filter(F.col("ts_ps") > F.col("_prev")).withColumn("bin", B.decade_bin(dt)).filter("bin is not null").groupBy(key, "bin").agg(count())


def hist1d(df: DataFrame, series: Column, x: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(series, place, bin, n): under- and overflow counted, a value equal to ``hi`` is 'in' without a bin."""
    place, b = B.hist1d_bin(x, lo, hi, bins)
    return df.filter(x.isNotNull()).groupBy(series.alias("series"), place.alias("place"), b.alias("bin")).agg(count())


def hist2d(df: DataFrame, x: Column, xr: tuple, y: Column, yr: tuple, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, side_x, side_y, bx, by, n): cells inside, and the nine in/out combinations outside them."""
    sx, bx = B.hist2d_cell(x, *xr)
    sy, by = B.hist2d_cell(y, *yr)
    inside = (sx == 0) & (sy == 0)
    return (
        df.filter(x.isNotNull() & y.isNotNull())
        .groupBy(*keys, sx.alias("side_x"), sy.alias("side_y"), F.when(inside, bx).alias("bx"), F.when(inside, by).alias("by"))
        .agg(count())
    )


def merge_parts(*parts: DataFrame) -> DataFrame:
    """Histogram tables of the same shape added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def weighted_stats(df: DataFrame, keys: list[str], w: Column, x: Column) -> DataFrame:
    """Mean and standard deviation of x weighted by w; NULL without weight.

    Powers are summed about a value of the group itself, so large offsets do not cancel: rows meet a table of one
    such value per group.
    """
    d = df.select(*keys, w.cast("double").alias("_w"), x.cast("double").alias("_x")).filter("_x is not null")
    some = d.groupBy(*keys).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    some = some.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_low") / 2 + F.col("_high") / 2).alias("_about"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    near = d.join(some, same).withColumn("_d", F.col("_x") - F.col("_about")) if keys else d.crossJoin(some).withColumn("_d", F.col("_x") - F.col("_about"))
    s = near.groupBy(*keys).agg(
        F.first("_about").alias("_about"), F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_d")).alias("_wd"), F.sum(F.col("_w") * F.col("_d") * F.col("_d")).alias("_wdd")
    )
    ok = F.col("_w") > 0
    off = F.try_divide(F.col("_wd"), F.col("_w"))
    var = F.try_divide(F.col("_wdd"), F.col("_w")) - off * off
    return s.select(*keys, F.when(ok, F.col("_about") + off).alias("mean"), F.when(ok, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sd"))


def shape_overlap(a: DataFrame, b: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Sum over bins of the smaller share. Both tables carry ``share``; a missing bin is 0."""
    j = a.select(*keys, *on, F.col("share").alias("_a")).join(b.select(*keys, *on, F.col("share").alias("_b")), keys + on, "full_outer")
    return j.groupBy(*keys).agg(F.sum(F.least(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0)))).alias("overlap"))


def rate_spectrum(hits: DataFrame, bin_ps: int = FFT_BIN_PS, bins: int = FFT_BINS, group: int = FFT_GROUP) -> DataFrame:
    """(slot, f_bin, power, hits, windows): squared FFT magnitude of the hit counts in fixed windows.

    Slot -1 is all channels together. Hits are first counted per (channel, window, time bin), which bounds a
    group by ``bins`` rows whatever the rate; windows cut by the start or end of the data are left out. The
    power is summed over windows; power / hits is flat 1 for random hits.
    """
    seg = bin_ps * bins
    k = ((F.col("ts_ps") - F.pmod(F.col("ts_ps"), F.lit(seg))) / seg).cast("long")
    b = F.floor(F.pmod(F.col("ts_ps"), F.lit(seg)) / bin_ps).cast("int")
    lo, hi = hits.agg(F.min("ts_ps"), F.max("ts_ps")).first()
    whole = (F.col("k") * seg >= F.lit(lo)) & ((F.col("k") + 1) * seg <= F.lit(hi) + 1)
    cells = hits.select("slot", k.alias("k"), b.alias("b")).filter(whole).groupBy("slot", "k", "b").agg(count())
    both = cells.unionByName(cells.groupBy("k", "b").agg(F.sum("n").alias("n")).withColumn("slot", F.lit(-1)))

    def power(pdf: pd.DataFrame) -> pd.DataFrame:
        k0 = pdf["k"].to_numpy()
        ks, row = np.unique(k0, return_inverse=True)
        m = np.zeros((ks.size, bins), np.float32)
        m[row, pdf["b"].to_numpy()] = pdf["n"].to_numpy()
        nf = bins // 2 // group
        p = (np.abs(np.fft.rfft(m, axis=1)) ** 2)[:, 1 : nf * group + 1].reshape(ks.size, nf, group).mean(axis=2).sum(axis=0)
        return pd.DataFrame({"slot": pdf["slot"].iloc[0], "f_bin": np.arange(nf), "power": p, "hits": float(m.sum()), "windows": ks.size})

    # a handful of windows per call: bounded rows, and the power is summed before it leaves
    some = (F.col("k") - F.pmod(F.col("k"), F.lit(FFT_WINDOWS_PER_CALL))).alias("_k0")
    per = both.groupBy("slot", some).applyInPandas(power, "slot int, f_bin int, power double, hits double, windows long")
    return per.groupBy("slot", "f_bin").agg(*[F.sum(c).alias(c) for c in ("power", "hits", "windows")])


def per_second(hits: DataFrame, key: str = "slot", unit: int = PS_PER_S) -> DataFrame:
    """Hits per channel and second of data time."""
    t = F.col("ts_ps")
    return hits.groupBy("run", key, ((t - F.pmod(t, F.lit(unit))) / unit).cast("long").alias("sec")).agg(count())
