"""Rates over time: intervals, run history, dead time, complete seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamloom.operators.scan import walk, whole

# Fixed values of the run history: bin, largest number of points, gap and share that make a bin far off.
RUN_BIN_S = 10
HISTORY_POINTS = 720
OUTLIER_GAP_S = 3600
OUTLIER_SHARE = 1e-3


def floor_div(t: Column, width: int) -> Column:
    return ((t - F.pmod(t, F.lit(width))) / width).cast("long")


def interval_rates(hits: DataFrame, key: str, width: int, units_per_s: float) -> DataFrame:
    """Trigger and accepted rate per interval: counts over the time from the last hit of the interval before
    to the last hit of this one. One row per (channel, interval) reaches the window."""
    n = hits.groupBy("run", key, floor_div(F.col("ts_ps"), width).alias("interval")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("pur")).alias("n_good"), F.max("ts_ps").alias("t_last")
    )
    w = Window.partitionBy("run", key).orderBy("interval")
    dt = (F.col("t_last") - F.lag("t_last").over(w)) / F.lit(units_per_s)
    return n.withColumn("dt_s", dt).select(
        "run", key, "interval", "n", "n_good",
        F.try_divide(F.col("n").cast("double"), F.col("dt_s")).alias("trigger_rate"),
        F.try_divide(F.col("n_good").cast("double"), F.col("dt_s")).alias("accepted_rate"),
    )


def history_bins(hits: DataFrame, bin_width: int, gap_bins: int, share: float = OUTLIER_SHARE) -> DataFrame:
    """Hits per (run, board, bin), with ``far`` true for bins cut off from the rest by a long gap and holding
    under ``share`` of the hits. Works on one row per filled bin."""
    bins = hits.groupBy("run", "board", floor_div(F.col("ts_ps"), bin_width).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    tot = bins.groupBy("run", "k").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("run").orderBy("k")
    isl = tot.withColumn("_new", F.coalesce((F.col("k") - F.lag("k").over(w) > gap_bins).cast("int"), F.lit(0)))
    isl = isl.withColumn("_g", F.sum("_new").over(w))
    size = isl.groupBy("run", "_g").agg(F.sum("n").alias("_gn"))
    alln = isl.groupBy("run").agg(F.sum("n").alias("_all"))
    size = size.join(alln, "run").withColumn("_small", F.col("_gn") < share * F.col("_all"))
    any_big = size.groupBy("run").agg(F.bool_or(~F.col("_small")).alias("_any"))
    size = size.join(any_big, "run").select("run", "_g", (F.col("_small") & F.col("_any")).alias("far"))
    flags = isl.select("run", "k", "_g").join(size, ["run", "_g"]).drop("_g")
    return bins.join(flags, ["run", "k"])


def run_history(hits: DataFrame, bin_width: int, gap_bins: int, points: int = HISTORY_POINTS) -> DataFrame:
    """The run in at most ``points`` steps: hits per board and the covered time of a step (a step cut by the
    first or last hit covers less). Far-off bins are left out; ``history_left_out`` counts their hits."""
    bins = history_bins(hits, bin_width, gap_bins)
    near = bins.filter(~F.col("far"))
    span = near.groupBy("run").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    g = F.greatest(F.lit(1), F.ceil((F.col("k1") - F.col("k0") + 1) / points)).cast("long")
    span = span.withColumn("g", g)
    edges = hits.groupBy("run").agg(F.min("ts_ps").alias("lo"), F.max("ts_ps").alias("hi"))
    step = F.floor((F.col("k") - F.col("k0")) / F.col("g")).cast("long")
    out = near.join(span, "run").withColumn("step", step).groupBy("run", "board", "step", "k0", "g").agg(F.sum("n").alias("n"))
    a = (F.col("k0") + F.col("step") * F.col("g")) * bin_width
    cov = F.least(a + F.col("g") * bin_width, F.col("hi")) - F.greatest(a, F.col("lo"))
    return out.join(edges, "run").select("run", "board", "step", "n", F.greatest(cov, F.lit(0)).cast("long").alias("covered"))


def history_left_out(hits: DataFrame, bin_width: int, gap_bins: int) -> DataFrame:
    """Hits per (run, board) that ``run_history`` leaves out, 0 where it takes all."""
    left = F.sum(F.when(F.col("far"), F.col("n")).otherwise(0)).alias("left_out")
    return history_bins(hits, bin_width, gap_bins).groupBy("run", "board").agg(left)


def mean_rates(hits: DataFrame, key: str, units_per_s: float) -> DataFrame:
    """Mean rate of each channel over its run's span."""
    span = hits.groupBy("run").agg(((F.max("ts_ps") - F.min("ts_ps")) / F.lit(units_per_s)).alias("_s"))
    n = hits.groupBy("run", key).agg(F.count(F.lit(1)).alias("n"))
    return n.join(span, "run").select("run", key, "n", F.try_divide(F.col("n").cast("double"), F.col("_s")).alias("rate"))


def triggers_at_flag(f: Column) -> Column:
    """Trigger number marked by the f-th 1024-trigger flag; the flag at the counter's 16-bit wrap is never set."""
    return F.when(f == 0, F.lit(0)).otherwise(1024 * (f + F.floor((f - 1) / 63))).cast("long")


SUMS = ("ms", "counts", "flags", "counts_at_flag", "lost_flags", "lost_n_flags")


def _trigger_number(f: int) -> int:
    return 1024 * (f + (f - 1) // 63) if f else 0


class _Window:
    """Running sums of a channel and those at the flag where its open window began."""

    def __init__(self):
        self.flags = self.counts = self.ms = self.lost = self.lost_n = 0
        self.mark: tuple[int, ...] | None = None

    def take(self, at_least: int, ms, counts, flags, counts_at_flag, lost, lost_n) -> tuple | None:
        self.flags += flags
        self.ms += ms
        self.lost += lost
        self.lost_n += lost_n
        at_flag = self.counts + (counts_at_flag or 0)
        self.counts += counts
        if not flags:
            return None
        mark = (_trigger_number(self.flags), at_flag, self.ms, self.lost_n, self.lost)
        before = self.mark
        if before is not None and mark[2] - before[2] < at_least:
            return None
        self.mark = mark
        return None if before is None else tuple(x - y for x, y in zip(mark, before))


def dead_time(intervals: DataFrame, key: str = "slot", at_least_ms: int = 1000) -> DataFrame:
    """Input rate, missed and lost share from flag to flag, per interval.

    ``intervals``: (run, key, interval, ms, counts, flags, counts_at_flag, lost_flags, lost_n_flags), already one
    row per channel and interval. A window runs from the newest flag of one interval with flags to the newest
    flag of the first later one at least ``at_least_ms`` on, where the next window begins; flags on the way let it
    grow.
    """
    x = walk(whole(intervals, *SUMS), ("run", key), "interval", SUMS, _Window, lambda w, *v: w.take(at_least_ms, *v), "_trig long, d_c long, d_ms long, d_ln long, d_lf long")
    return x.select("run", key, "interval", *_shares(F.col("_trig"), F.col("d_c"), F.col("d_ms"), F.col("d_ln"), F.col("d_lf")))


def _shares(triggers: Column, counts: Column, ms: Column, lost_n: Column, lost_flags: Column) -> list[Column]:
    lost = lost_n * 1024.0
    return [
        F.try_divide(triggers * 1000.0, ms.cast("double")).alias("input_rate"),
        F.try_divide(lost * 1000.0, ms.cast("double")).alias("lost_rate"),
        F.greatest(F.lit(0.0), 1.0 - F.try_divide(counts + lost, triggers.cast("double"))).alias("missed"),
        F.least(F.lit(1.0), F.try_divide(lost, triggers.cast("double"))).alias("lost"),
        ((lost_flags > 0) | (lost_n > 0)).alias("lost_seen"),
    ]


# Fixed values of the dead-time states: events without a flag that mean the channel writes none, and the time without one that means a low rate.
BAD_AFTER = 5 * 1024
LOW_AFTER_MS = 60_000


class _Channel:
    """What a channel shows, refresh by refresh: the open window, the last complete one, and the state."""

    def __init__(self):
        self.total = self.since = self.quiet_ms = self.begin = self.counts = self.lost = self.lost_n = self.ms = 0
        self.state = "wait"
        self.shown: tuple = (None, None, None, None, None)
        self.lost_seen = False

    def take(self, at_least: int, bad_after: int, low_after: int, ms, counts, flags, counts_at_flag, lost, lost_n, other_step) -> tuple:
        if ms <= 0:
            self.__init__()  # the first refresh after a start
            ms = 0
        closed = False
        if other_step:
            self.__init__()
            self.state = "other_step"
            return (self.state, closed, *self.shown, False)
        self.lost, self.lost_n, self.ms = self.lost + lost, self.lost_n + lost_n, self.ms + ms
        if flags:
            upto = self.since + counts_at_flag
            self.total += flags
            if self.total == flags:  # the first ones: the window opens at the newest
                self._open()
            else:
                self.counts += upto
            self.since, self.quiet_ms = counts - counts_at_flag, 0
        else:
            self.since += counts
            self.quiet_ms += ms
        if self.since >= bad_after:
            self.state = "bad_flags"
        elif self.total > self.begin and self.ms >= at_least:
            triggers = _trigger_number(self.total) - _trigger_number(self.begin)
            self.shown = (triggers, self.counts, self.ms, self.lost_n, self.lost)
            self.lost_seen = self.lost > 0 or self.lost_n > 0
            self.state, closed = "valid", True
            self._open()
        elif self.quiet_ms >= low_after:
            self.lost_seen = self.lost > 0 or self.lost_n > 0
            self.state = "low"
        return (self.state, closed, *self.shown, self.lost_seen)

    def _open(self) -> None:
        self.begin = self.total
        self.counts = self.ms = self.lost = self.lost_n = 0


def dead_time_states(intervals: DataFrame, key: str = "slot", at_least_ms: int = 1000, bad_after: int = BAD_AFTER, low_after_ms: int = LOW_AFTER_MS) -> DataFrame:
    """What every refresh of a channel shows: its state and the values of its last complete window.

    ``intervals`` as for ``dead_time``, one row per channel and refresh, optionally with ``other_step`` (flags come every 128 or 8,192
    triggers). A state stays until another takes its place: ``wait`` (no window yet), ``valid``, ``low`` (no flag for ``low_after_ms``),
    ``bad_flags`` (``bad_after`` events without a flag), ``other_step``. A window closes at the first refresh, with flags or not, that
    finds a newer flag and ``at_least_ms`` gone. A refresh of no length (``ms`` <= 0) begins anew.
    """
    rows = whole(intervals, *SUMS).withColumn("other_step", F.col("other_step") if "other_step" in intervals.columns else F.lit(False))
    rows = rows.fillna(0, ["counts_at_flag"])
    gives = "state string, closed boolean, _trig long, _c long, _ms long, _ln long, _lf long, lost_seen boolean"
    x = walk(rows, ("run", key), "interval", (*SUMS, "other_step"), _Channel, lambda w, *v: w.take(at_least_ms, bad_after, low_after_ms, *v), gives)
    shares = _shares(*[F.col(c) for c in ("_trig", "_c", "_ms", "_ln", "_lf")])[:4]
    shares = [F.when(F.col("_trig").isNotNull(), c).alias(n) for c, n in zip(shares, ("input_rate", "lost_rate", "missed", "lost"))]
    return x.select("run", key, "interval", "state", "closed", *shares, "lost_seen")


def board_states(channels: DataFrame, key: str = "board") -> DataFrame:
    """A board's refresh: ``valid`` with summed input rate, input-weighted missed share and lost share over its valid channels, else
    ``wait`` or ``low``; whether losses were seen; and the channels whose flags are stuck."""
    valid, rate = F.col("state") == "valid", F.when(F.col("state") == "valid", F.col("input_rate"))
    g = channels.groupBy("run", key, "interval").agg(
        F.when(F.bool_or(valid), F.lit("valid")).when(F.bool_or(F.col("state") == "wait"), F.lit("wait")).otherwise(F.lit("low")).alias("state"),
        F.sum(rate).alias("input_rate"),
        F.try_divide(F.sum(rate * F.col("missed")), F.sum(rate)).alias("missed"),
        F.when(F.bool_or(valid), F.least(F.lit(1.0), F.try_divide(F.sum(F.when(valid, F.col("lost_rate"))), F.sum(rate)))).alias("lost"),
        F.bool_or(F.col("state").isin("valid", "low") & F.col("lost_seen")).alias("lost_seen"),
        F.count_if(F.col("state") == "bad_flags").alias("stuck"),
    )
    return g


def board_dead_time(channels: DataFrame, key: str = "board") -> DataFrame:
    """Board values: summed input rate, input-weighted missed share, lost share."""
    return channels.groupBy("run", key, "interval").agg(
        F.sum("input_rate").alias("input_rate"),
        F.try_divide(F.sum(F.col("input_rate") * F.col("missed")), F.sum("input_rate")).alias("missed"),
        F.least(F.lit(1.0), F.try_divide(F.sum("lost_rate"), F.sum("input_rate"))).alias("lost"),
        F.bool_or("lost_seen").alias("lost_seen"),
    )


def slice_steps(slices: DataFrame, step: int) -> DataFrame:
    """Finder slices merged to fixed steps."""
    return slices.groupBy(floor_div(F.col("t0"), step).alias("step")).agg(
        F.sum("bunches").alias("bunches"), F.sum("tracks").alias("tracks"), F.sum("hits").alias("hits")
    )


def complete_seconds(seconds: DataFrame, frontier: DataFrame, unit: int) -> DataFrame:
    """Rate of a second only when every couple of its board has moved past it; NULL until then."""
    known = frontier.groupBy("run", "board").agg(F.min("newest").alias("_known"))
    return seconds.join(known, ["run", "board"], "left").select(
        *seconds.columns, F.when((F.col("sec") + 1) * unit <= F.col("_known"), F.col("n")).alias("rate")
    )
