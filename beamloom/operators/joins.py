"""Joins: hits with dimensions, hits with a reference channel, channels inside an event."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamloom.functions.polygon import in_polygon_array
from beamloom.operators.ordering import Ordered, SlicePlan, floor_to, plan_slices
from beamloom.session import cut


def with_cabling(hits: DataFrame, cabling: DataFrame) -> DataFrame:
    """Adds kind, plane, plane channel; a hit on an uncabled channel keeps NULL there (counted, not lost).

    A cabling table has one row per digitizer channel of the experiment (hundreds); Spark broadcasts it by its
    size, and would shuffle it if it were not small.
    """
    dim = cabling.select("serial", F.col("channel").alias("ch"), "kind", "plane", F.col("ch").alias("plane_ch"))
    return hits.join(dim, ["serial", "ch"], "left")


def subtract_offsets(hits: DataFrame, offsets: DataFrame) -> DataFrame:
    """Times on the common clock: cable offset in ns, rounded half-even to ps, taken off before any ordering."""
    o = offsets.select("serial", F.col("channel").alias("ch"), F.rint(F.col("offset_ns") * 1000).cast("long").alias("_o"))
    return hits.join(o, ["serial", "ch"], "left").withColumn("ts_ps", F.col("ts_ps") - F.coalesce("_o", F.lit(0))).drop("_o")


def calibrated(hits: DataFrame, gains: DataFrame, threshold: float) -> DataFrame:
    """Light of each hit; below threshold or without a gain the hit is left out."""
    g = gains.select("serial", F.col("channel").alias("ch"), F.col("mevee_per_count").alias("_g"))
    return hits.join(g, ["serial", "ch"], "left").withColumn("light", F.col("qlong") * F.col("_g")).filter(F.col("light") >= threshold).drop("_g")


def remapped(hits: DataFrame, strips: DataFrame) -> DataFrame:
    """Detector strip and gain-matched energy; channels mapped to -1 leave."""
    return hits.join(strips.filter("strip >= 0"), ["serial", "ch"]).withColumn("energy", F.col("qlong") * F.col("corr"))


def _met_in_band(hits: DataFrame, ref: DataFrame, width: int, ts: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, hit columns, dt and weight: hits against reference times within +-width.

    Both sides are first counted per distinct (columns, time): rows sharing a time meet as one weighted pair.
    The reference is copied to three time buckets; the join is an equi-join on (keys, bucket).
    """
    cols = [c for c in hits.columns if c not in (ts, *keys)]
    left = hits.groupBy(*keys, *cols, ts).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", floor_to(F.col(ts), width))
    near = F.explode(F.array(*[floor_to(F.col("_r"), width) + d * width for d in (-1, 0, 1)])).alias("_b")
    right = ref.select(*keys, F.col(ts).alias("_r")).groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_m")).select(*keys, "_r", "_m", near)
    j = left.join(right, [*keys, "_b"]).withColumn("dt", F.col(ts) - F.col("_r")).filter(F.abs("dt") <= width)
    return j.select(*keys, *cols, "dt", (F.col("_n") * F.col("_m")).alias("weight"))


def band_pairs(hits: DataFrame, ref: DataFrame, width: int, ts: str = "ts_ps", keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """(keys, hit columns, dt, n): hits against reference times within +-width, counted."""
    cols = [c for c in hits.columns if c not in (ts, *keys)]
    return _met_in_band(hits, ref, width, ts, keys).groupBy(*keys, *cols, "dt").agg(F.sum("weight").alias("n"))


def time_to_reference(hits: DataFrame, ref_slot: int, width: int, bins: int) -> DataFrame:
    """(slot, bin, n) of t - t_ref for all pairs within +-width; a reference hit is not paired with itself.

    Pairs are put into bins where they are made and summed there, so what is shuffled after the join is channels x bins per task.
    """
    ref = hits.filter(F.col("slot") == ref_slot)
    pairs = _met_in_band(hits.select("run", "slot", "ts_ps"), ref.select("run", "ts_ps"), width, "ts_ps", ("run",))
    b = F.floor((F.col("dt") + width) * bins / (2 * width)).cast("int")
    out = pairs.withColumn("bin", b).filter(F.col("bin") < bins).groupBy("slot", "bin").agg(F.sum("weight").alias("n"))
    own = ref.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).select("slot", F.lit(bins // 2).alias("bin"), (-F.col("n")).alias("n"))
    return out.unionByName(own).groupBy("slot", "bin").agg(F.sum("n").alias("n")).filter("n > 0")


def rf_triggers(hits: DataFrame, rf_slot: int, period: float, plan: SlicePlan | None = None) -> DataFrame:
    """One reference trigger per cycle (nearer than half a period to the trigger before: left out), with the
    local period to the next trigger."""
    rf = hits.filter(F.col("slot") == rf_slot).select("run", "ts_ps", "pos")
    plan = plan or plan_slices(rf)
    once = Ordered(rf, plan).prev_time("_p").done().filter(F.col("_p").isNull() | (F.col("ts_ps") - F.col("_p") > period / 2))
    nxt = Ordered(once.drop("_p"), plan).next_first(F.col("ts_ps"), "t_next").done()
    d = F.col("t_next") - F.col("ts_ps")
    return nxt.withColumn("period", d / F.rint(d / F.lit(period)))


def rf_phase(hits: DataFrame, rf_slot: int, period: float) -> DataFrame:
    """Adds ``phase`` in [0, 1): the hit's place between the reference triggers on either side of it.

    Before the first and after the last trigger of a run the nearest pair is used; NULL with fewer than two.
    Triggers and hits are put in one order, and the newest trigger is carried along it.
    """
    plan = plan_slices(hits)
    # read three times below: written once
    trig = cut(rf_triggers(hits, rf_slot, period, plan).select("run", "ts_ps", "t_next"), "triggers")
    ends = trig.filter(F.col("t_next").isNotNull()).groupBy("run").agg(
        F.min("ts_ps").alias("_f0"), F.min("t_next").alias("_f1"), F.max("ts_ps").alias("_l0"), F.max("t_next").alias("_l1")
    )
    rest = hits.filter(F.col("slot") != rf_slot).withColumn("_mark", F.lit(None).cast("long"))
    # a trigger sorts ahead of hits at its own time
    marks = trig.select("run", "ts_ps", F.lit(-1).cast("long").alias("pos"), F.col("ts_ps").alias("_mark"))
    both = rest.unionByName(marks, allowMissingColumns=True)
    o = Ordered(both, plan).running_last(F.col("_mark"), "_at")
    o.next_first(F.col("_mark"), "_nx")
    x = o.done().filter(F.col("_mark").isNull()).drop("_mark").join(ends, "run", "left")
    before, after = F.col("_at").isNull(), F.col("_nx").isNull()
    a = F.when(before, F.col("_f0")).when(after, F.col("_l0")).otherwise(F.col("_at"))
    b = F.when(before, F.col("_f1")).when(after, F.col("_l1")).otherwise(F.col("_nx"))
    d = (b - a).cast("double")
    local = d / F.rint(d / F.lit(float(period)))
    turns = F.try_divide((F.col("ts_ps") - a).cast("double"), local)
    return x.withColumn("phase", turns - F.floor(turns)).drop("_at", "_nx", "_f0", "_f1", "_l0", "_l1")


def in_cuts(points: DataFrame, cuts: DataFrame, x: str, y: str) -> DataFrame:
    """(point columns, cut) for every polygon holding the point. Cuts: (cut, points array<struct<x,y>>).

    Polygons are laid on a coarse grid over their bounding boxes, points meet them by grid cell: an equi-join,
    so neither the number of cuts nor of points makes it a product.
    """
    box = cuts.select(
        "cut", "points",
        F.array_min(F.transform("points", lambda p: p["x"])).alias("_x0"), F.array_max(F.transform("points", lambda p: p["x"])).alias("_x1"),
        F.array_min(F.transform("points", lambda p: p["y"])).alias("_y0"), F.array_max(F.transform("points", lambda p: p["y"])).alias("_y1"),
    )
    area = box.agg(F.min("_x0"), F.max("_x1"), F.min("_y0"), F.max("_y1")).first()
    if area is None or area[0] is None:
        return points.withColumn("cut", F.lit(None).cast("string")).filter(F.lit(False))
    n = 16
    wx, wy = max((area[1] - area[0]) / n, 1e-300), max((area[3] - area[2]) / n, 1e-300)

    def gx(c: Column) -> Column:
        return F.least(F.greatest(F.floor((c - F.lit(area[0])) / wx), F.lit(0)), F.lit(n)).cast("int")

    def gy(c: Column) -> Column:
        return F.least(F.greatest(F.floor((c - F.lit(area[2])) / wy), F.lit(0)), F.lit(n)).cast("int")

    cells = box.select("cut", "points", F.explode(F.sequence(gx(F.col("_x0")), gx(F.col("_x1")))).alias("_gx"), "_y0", "_y1")
    cells = cells.select("cut", "points", "_gx", F.explode(F.sequence(gy(F.col("_y0")), gy(F.col("_y1")))).alias("_gy"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    inside = points.filter(px.between(area[0], area[1]) & py.between(area[2], area[3]))
    j = inside.withColumn("_gx", gx(px)).withColumn("_gy", gy(py)).join(cells, ["_gx", "_gy"])
    return j.filter(in_polygon_array(px, py, F.col("points"))).drop("_gx", "_gy", "points")


def channel_pivot(hits: DataFrame, event: str, channels: dict[str, int], values: dict[str, str], order: str = "pos") -> DataFrame:
    """One row per event, a column <value>_<name> per wanted channel; the last hit of a channel in the event
    counts. A conditional aggregate: only the wanted channels travel, and no self-join."""
    aggs = []
    for name, ch in channels.items():
        for short, col in values.items():
            aggs.append(F.max_by(col, F.when(F.col("ch") == ch, F.col(order))).alias(f"{short}_{name}"))
    return hits.filter(F.col("ch").isin(*channels.values())).groupBy(event).agg(*aggs)


#: Hits of one event that one task walks; a larger event is cut into slices.
EVENT_HITS = 2_000_000
FOLD_ROWS = 1 << 15


def _pair_counts(event: np.ndarray, ch: np.ndarray, before: dict[int, int], found: dict[tuple[int, int], int]) -> dict[int, int]:
    """Adds the ordered pairs of the hits (sorted by event, in order) to ``found``; ``before``: hits per channel of the first event
    that came earlier. Returns the hits per channel of the last event."""
    names, code = np.unique(ch, return_inverse=True)
    begins = np.flatnonzero(np.append(True, event[1:] != event[:-1]))
    of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(event))))
    after = {}
    for x in {*names.tolist(), *before}:
        mine = ch == x
        seen = np.cumsum(mine) - mine  # hits of x before this one, in the batch; less those of earlier events
        seen -= seen[begins][of]
        seen[of == 0] += before.get(x, 0)
        for y, n in zip(names.tolist(), np.bincount(code, seen, len(names)).astype(np.int64).tolist()):
            if n:
                found[x, y] = found.get((x, y), 0) + n
        last = int(mine[begins[-1] :].sum()) + (before.get(x, 0) if len(begins) == 1 else 0)
        if last:
            after[x] = last
    return after


def coincidence_matrix(hits: DataFrame, event: str, order: str, channel: str = "ch", event_hits: int = EVENT_HITS) -> DataFrame:
    """(ch_x, ch_y, n) over all ordered pairs i < j of hits of an event, without making the pairs.

    A hit on channel y closes as many pairs (x, y) as hits of x came before it in its event. Hits are dealt once, by event, and a task folds
    its sorted stream: what it holds is the counts of the event that it is in and its sums, one per pair of channels, which
    are all that leaves it. Events of more than ``event_hits`` hits are ordered in slices instead, with running counts.
    """
    h = hits.select(F.col(event).alias("_ev"), F.col(order).cast("long").alias("_o"), F.col(channel).cast("long").alias("_ch"))
    big = cut(h.groupBy("_ev").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > event_hits).select("_ev"), "big-events")
    some = big.limit(1).count()
    rest = (h.join(big, "_ev", "left_anti") if some else h).filter("_ev IS NOT NULL AND _ch IS NOT NULL")
    dealt = rest.repartition("_ev").sortWithinPartitions("_ev", "_o").select("_ev", "_ch")

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        last, before = None, {}
        for b in parts:
            for at in range(0, b.num_rows, FOLD_ROWS):
                part = b.slice(at, FOLD_ROWS)
                names = part.column(0)
                codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
                first = names[0].as_py()
                before = _pair_counts(codes, part.column(1).to_numpy(), before if last is not None and last[0] == first else {}, found)
                last = (names[len(names) - 1].as_py(),)
        if found:
            (x, y), n = zip(*found), list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int64())], names=["ch_x", "ch_y", "n"])

    sums = dealt.mapInArrow(fold, "ch_x long, ch_y long, n long")
    if some:
        sums = sums.unionByName(_sliced_matrix(h.join(big, "_ev", "left_semi")))
    kind = hits.schema[channel].dataType
    return sums.groupBy("ch_x", "ch_y").agg(F.sum("n").alias("n")).select(F.col("ch_x").cast(kind).alias("ch_x"), F.col("ch_y").cast(kind).alias("ch_y"), "n")


def _sliced_matrix(h: DataFrame) -> DataFrame:
    """The same for large events: each hit beside the channels of its event, with running counts across slices."""
    h = h.withColumnRenamed("_ch", "ch_y")
    plan = plan_slices(h, ("_ev",), "_o", "_o", whole_keys=True)
    present = h.select("_ev", F.col("ch_y").alias("ch_x")).distinct()
    x = plan.assign(h).join(present, "_ev").withColumn("_is", (F.col("ch_x") == F.col("ch_y")).cast("long"))
    per_channel = replace(plan, keys=("_ev", "ch_x"))  # cut as above, before the channels are set against the hits
    upto = Ordered(x, per_channel).running_sum(F.col("_is"), "_k").done()
    return upto.groupBy("ch_x", "ch_y").agg(F.sum(F.col("_k") - F.col("_is")).alias("n")).filter("n > 0")


def compare_full(a: DataFrame, b: DataFrame, on: list[str], value: str = "n") -> DataFrame:
    """Full outer join of two tables of counts, a missing side as 0."""
    l = a.select(*on, F.col(value).alias("live"))
    r = b.select(*on, F.col(value).alias("expected"))
    return l.join(r, on, "full_outer").na.fill(0, ["live", "expected"])


def overlapping(aggs: DataFrame, slice_width: int, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """(aggregate columns, slice): every slice a time range touches; explode, no range join."""
    a, b = floor_to(F.col("t_first"), slice_width), floor_to(F.col("t_last"), slice_width)
    return aggs.withColumn("slice", F.explode(F.sequence(a, b, F.lit(slice_width).cast("long"))))


def placeholder_cabling(channels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Plane channels in order against digitizer channels in order.

    ``wanted`` is the fixed list of the tracker's channels; of the digitizer channels only as many, the first ones, are
    ordered, so each map task sends no more than that.
    """
    a = channels.orderBy("serial", "channel").limit(wanted.count()).withColumn("_i", F.row_number().over(Window.orderBy("serial", "channel")))
    b = wanted.withColumn("_i", F.row_number().over(Window.orderBy("seq")))
    return a.join(b, "_i").select("serial", "channel", "kind", "plane", "ch")
