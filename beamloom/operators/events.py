"""Time-keyed grouping: gap bunches, anchored windows, newest-first, event tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamloom.operators.ordering import SLICE, TIE, Ordered, SlicePlan, floor_to, plan_slices
from beamloom.session import cut

EVENT_CAP = 100
BUNCH_CAP = 1024


def bunch_cells(hits: DataFrame, window: int, keys: tuple[str, ...] = ("run",), rows_per_slice: int | None = None, numbered: bool = False) -> DataFrame:
    """(keys, cell, t_first, t_last, n, bunch_t0): which bunch each filled cell of one window's width is in.

    Hits in one such cell are never a window apart, so a bunch can only begin at a cell's first hit: cells, not
    hits, are put in order. They come from one aggregate with map-side combine (a burst or a shared time is one row),
    are written once, and are ordered in slices.
    """
    cell = floor_to(F.col("ts_ps"), max(window, 1)).alias("cell")
    cells = hits.groupBy(*keys, cell).agg(F.min("ts_ps").alias("t_first"), F.max("ts_ps").alias("t_last"), F.count(F.lit(1)).alias("n"))
    cells = cut(cells, "cells")
    plan = plan_slices(cells, keys, "cell", "cell", rows_per_slice)
    o = Ordered(cells, plan).prev_value("t_last", "_prev")
    fresh = F.col("_prev").isNull() | (F.col("t_first") - F.col("_prev") > window)
    o.running_last(F.when(fresh, F.col("t_first")), "bunch_t0")
    if numbered:
        o.running_sum(fresh.cast("long"), "bunch_id")
    return o.done().drop("_prev")


def gap_bunches(hits: DataFrame, window: int, keys: tuple[str, ...] = ("run",), rows_per_slice: int | None = None, numbered: bool = False) -> DataFrame:
    """Adds ``bunch_t0``: a new bunch starts where the time since the hit before is above ``window``.

    A bunch is named by its run and first time, which needs no numbering; ``numbered`` adds ``bunch_id``,
    1, 2, ... per run. Hits learn their bunch by an equi-join on their cell.
    """
    return with_bunches(hits, bunch_cells(hits, window, keys, rows_per_slice, numbered), window, keys)


def with_bunches(hits: DataFrame, cells: DataFrame, window: int, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Hits with the bunch of their cell."""
    ids = [c for c in ("bunch_t0", "bunch_id") if c in cells.columns]
    tagged = hits.withColumn("cell", floor_to(F.col("ts_ps"), max(window, 1)))
    return tagged.join(cells.select(*keys, "cell", *ids), [*keys, "cell"]).select(*hits.columns, *ids)


def first_open(cells: DataFrame, frontier: int, window: int) -> int | None:
    """Start of the first bunch still open at a frontier (its last hit at most ``window`` behind it); bunches of one
    run follow each other, so all hits before it are in closed bunches."""
    last = cells.groupBy("bunch_t0").agg(F.max("t_last").alias("_l")).filter(F.col("_l") + window >= frontier)
    return last.agg(F.min("bunch_t0")).first()[0]


def bunch_table(hits: DataFrame, window: int, keys: tuple[str, ...] = ("run",), numbered: bool = False) -> DataFrame:
    """One row per bunch: first and last time and number of hits. No hit is moved: bunches are sums of cells."""
    cells = bunch_cells(hits, window, keys, numbered=numbered)
    ids = [F.max("bunch_id").alias("bunch_id")] if numbered else []
    return cells.groupBy(*keys, "bunch_t0").agg(F.max("t_last").alias("t_last"), F.sum("n").alias("multi"), *ids)


def _chain_exit(nxt: np.ndarray) -> np.ndarray:
    """For each start the last element of its chain i -> nxt[i] that is still inside (pointer doubling)."""
    n = nxt.size
    last = np.arange(n)
    jump = nxt.copy()
    while True:
        inside = jump < n
        if not inside.any():
            return last
        last[inside] = last[jump[inside]]
        step = np.full(n, n)
        step[inside] = jump[jump[inside]]
        jump = step


def _exit_table(keys: list[str], ts: str, window: int):
    """Per slice: which anchor it ends with, for every place its first anchor can be."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(pdf[ts].to_numpy(np.int64))
        nxt = np.searchsorted(t, t + window, side="right")
        m = min(int(np.searchsorted(t, t[0] + window, side="right")) + 1, t.size)
        out = t[_chain_exit(nxt)[:m]]
        keep = np.r_[out[1:] != out[:-1], True]
        return pd.DataFrame(
            {**{k: [pdf[k].iloc[0]] for k in keys}, "_first": [t[0]], "_cand": [t[:m][keep]], "_exit": [out[keep]]}
        )

    return run


def _entry_table(keys: list[str], window: int):
    """Walks one row per slice of a run: the anchor still open where each slice begins."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_first", kind="stable")
        entry, anchor = [], None
        for cand, out in zip(pdf["_cand"], pdf["_exit"]):
            entry.append(anchor)
            at = 0 if anchor is None else int(np.searchsorted(cand, anchor + window, side="right"))
            if at < len(out):
                anchor = int(out[at])
        return pdf[keys].assign(_entry=pd.array(entry, dtype="Int64"))

    return run


def _assign_anchors(ts: str, window: int, cols: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        t = pdf[ts].to_numpy(np.int64)
        entry = pdf["_entry"].iloc[0]
        anchor = np.empty(t.size, np.int64)
        lo = 0
        if not pd.isna(entry):
            lo = int(np.searchsorted(t, int(entry) + window, side="right"))
            anchor[:lo] = int(entry)
        nxt = np.searchsorted(t, t + window, side="right")
        while lo < t.size:
            hi = int(nxt[lo])
            anchor[lo:hi] = t[lo]
            lo = hi
        return pdf[cols].assign(ev_t0=anchor)

    return run


def anchored_events(hits: DataFrame, window: int, plan: SlicePlan | None = None) -> DataFrame:
    """Adds ``ev_t0``: the time of the first hit of the event, which takes every hit up to ``window`` later.

    The next event starts at the first hit beyond. Each anchor depends on the one before, so a dense run is one
    long chain; still only slices are ever held: (1) every slice reports the anchor it ends with for each place
    its first anchor can be (chains merge fast, so the list is short), (2) one row per slice is walked per run,
    (3) every slice, knowing the anchor it begins with, names its events.
    """
    if window < 0:
        return hits.withColumn("ev_t0", F.col("ts_ps"))
    plan = plan or plan_slices(hits)
    ts = plan.ts
    # a slice cut by the tie-break holds one time only: its parts begin with the same anchor and agree
    keys = [*plan.keys, SLICE]
    sliced = plan.assign(hits)
    lean = sliced.select(*keys, ts).distinct()
    key_fields = [f for f in sliced.schema.fields if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))
    exits = lean.groupBy(*keys).applyInPandas(
        _exit_table(keys, ts, window),
        T.StructType(
            key_fields
            + [T.StructField("_first", T.LongType()), T.StructField("_cand", T.ArrayType(T.LongType())), T.StructField("_exit", T.ArrayType(T.LongType()))]
        ),
    )
    entries = exits.groupBy(*plan.keys).applyInPandas(
        _entry_table(keys, window), T.StructType(key_fields + [T.StructField("_entry", T.LongType())])
    )
    out = T.StructType([f for f in hits.schema.fields] + [T.StructField("ev_t0", T.LongType())])
    return sliced.join(entries, keys, "left").groupBy(*keys, TIE).applyInPandas(_assign_anchors(ts, window, hits.columns), out)


def no_grouping(hits: DataFrame, plan: SlicePlan | None = None) -> DataFrame:
    """One hit per event in time order: ``ev_id`` is the 0-based place in the run."""
    plan = plan or plan_slices(hits)
    return Ordered(hits, plan).ordinal("ev_id").done()


def newest_events(hits: DataFrame, window: int, n: int) -> DataFrame:
    """The newest ``n`` events, anchored at the latest hit and looking back up to ``window``.

    Only the newest part of the data is grouped: how far back it must reach is doubled until it holds more than
    ``n`` events, or everything. Event times in the result are those of the newest hit (``ev_t1``).
    """
    lo, hi = hits.agg(F.min("ts_ps"), F.max("ts_ps")).first()
    if hi is None:
        return hits.withColumn("ev_t1", F.col("ts_ps")).limit(0)
    reach = max(1, (hi - lo) // 1024, n * (window + 1))
    while True:
        part = hits.filter(F.col("ts_ps") >= hi - reach)
        turned = part.withColumn("_neg", -F.col("ts_ps")).withColumn("_all", F.lit(0))
        plan = plan_slices(turned, ("_all",), "_neg", "pos")
        ev = anchored_events(turned, window, plan).withColumn("ev_t1", -F.col("ev_t0")).drop("_neg", "_all", "ev_t0")
        top = ev.groupBy("ev_t1").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("ev_t1")).limit(n + 1)
        if hi - reach <= lo or top.count() > n:
            break
        reach *= 4
    keep = top.orderBy(F.desc("ev_t1")).limit(n).select("ev_t1")
    return ev.join(keep, "ev_t1", "left_semi")


def event_summary(grouped: DataFrame, keys: list[str], ts: str = "ts_ps") -> DataFrame:
    """Count, first and last time and length of each group."""
    return grouped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("multi"),
        F.min(ts).alias("t_first"),
        F.max(ts).alias("t_last"),
        (F.max(ts) - F.min(ts)).alias("span"),
    )


def multiplicity(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """How many groups have how many hits."""
    n = grouped.groupBy(*keys).agg(F.count(F.lit(1)).alias("multi"))
    return n.groupBy("multi").agg(F.count(F.lit(1)).alias("n"))


def capped_event_table(events: DataFrame, keys: list[str], cols: list[str], order: list[str], cap: int | None = None) -> DataFrame:
    """One row per event: true ``multi``, and arrays of its hits in time order, all of them or the first ``cap``.

    A cap is for formats that have one; ``multi`` tells what it left out. Spark turns ``row_number <= cap`` into a group limit ahead of the
    shuffle, so each map task sends at most ``cap`` rows of an event, however large the event is.
    """
    if cap is None:
        hits = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *cols)))
        all_hits = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("multi"), hits.alias("_h"))
        return all_hits.select(*keys, "multi", *[F.col(f"_h.{c}").alias(c) for c in cols])
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = events.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= cap)
    total = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("multi"))
    rows = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", *cols))).alias("_h"))
    return rows.join(total, keys).select(*keys, "multi", *[F.col(f"_h.{c}").alias(c) for c in cols])


def order_check(hits: DataFrame, keys: tuple[str, ...] = ("run", "board"), seq: str = "pos", ts: str = "ts_ps") -> DataFrame:
    """Rows whose time is below that of the row before them in file order."""
    plan = plan_slices(hits, keys, seq, ts)
    x = Ordered(hits, plan).prev_value(ts, "_prev").done()
    return x.withColumn("back_by", F.col("_prev") - F.col(ts)).filter(F.col("back_by") > 0).drop("_prev")


def closed_and_open(bunched: DataFrame, frontier: int, window: int) -> tuple[DataFrame, DataFrame]:
    """(closed, left over) at a frontier: a bunch is closed when its last hit is more than ``window`` behind."""
    last = bunched.groupBy("run", "bunch_t0").agg(F.max("ts_ps").alias("_last"))
    tagged = bunched.join(last, ["run", "bunch_t0"])
    done = F.col("_last") + window < frontier
    return tagged.filter(done).drop("_last"), tagged.filter(~done).drop("_last")


