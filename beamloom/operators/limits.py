"""Slow control: moving averages, changes, limit rules, worst levels.

An input's time is cut into slices; a slice takes the readings that its frames reach along from its neighbours (its halo),
so one busy input is many tasks and no sum is carried from slice to slice. In a slice a frame's sum is the difference
of two sums from the slice's begin, which grow with the row: built-in RANGE frames, and nothing is summed twice.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamloom.operators.ordering import Ordered, plan_slices
from beamloom.session import cut

# Order of levels, levels that are a matter of safety, an open thermocouple, intervals
# (label, interval s, averaging s), averaging of the change rule.
RANK = {"info": 0, "idle": 0, "ok": 1, "nodata": 2, "notice": 3, "problem": 4, "warn": 5, "bad": 6, "critical": 7}
SAFETY = ("warn", "bad", "critical")
TC_OPEN = 3276.0
INTERVALS = (("10s", 10, 4), ("1m", 60, 12), ("10m", 600, 60))
CHANGE_AVG_S = 60
EXACT = "decimal(38,9)"
#: A slice is so many times as long as the longest reach of its frames; a slice's halo is that part of its rows.
SLICE_REACHES = 16


def rank_of(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in RANK.items()])


def moving_means(readings: DataFrame, frames: dict[str, tuple[int, int]], key: str = "input", t: str = "t", v: str = "value", slice_reaches: int = SLICE_REACHES) -> DataFrame:
    """Adds a column per frame: the mean of the readings with now - hi < t' <= now - lo, frame = (lo, hi);
    a frame (lo, hi) with negative numbers looks forward. NULL without a reading in it."""
    back, ahead = (max(0, *x) for x in zip(*[(hi, -lo) for lo, hi in frames.values()]))
    width = max(1, slice_reaches * max(back, ahead))
    place = F.pmod(F.col(t), F.lit(width))
    own = ((F.col(t) - place) / width).cast("long")
    slices = [F.struct(own.alias("_slice"), F.lit(True).alias("_own"))]
    for reached, to in ((place >= width - back, own + 1), (place < ahead, own - 1)):
        slices.append(F.when(reached & F.col(v).isNotNull(), F.struct(to.alias("_slice"), F.lit(False).alias("_own"))))
    laid = readings.withColumn("_v", F.col(v).cast(EXACT)).withColumn("_s", F.explode(F.filter(F.array(*slices), lambda s: s.isNotNull())))
    w = Window.partitionBy(key, "_s._slice").orderBy(t)
    ends = sorted({e for f in frames.values() for e in f})
    sums = {f"_e{i}": F.sum("_v").over(w.rangeBetween(Window.unboundedPreceding, -e)) for i, e in enumerate(ends)}
    counts = {f"_c{i}": F.count("_v").over(w.rangeBetween(Window.unboundedPreceding, -e)) for i, e in enumerate(ends)}
    x = laid.select("*", *[c.alias(n) for n, c in {**sums, **counts}.items()]).filter("_s._own")
    means = []
    for name, (lo, hi) in frames.items():
        i, j = ends.index(lo), ends.index(hi)
        n, zero = F.col(f"_c{i}") - F.col(f"_c{j}"), F.lit(0).cast(EXACT)
        total = F.coalesce(f"_e{i}", zero) - F.coalesce(f"_e{j}", zero)
        means.append(F.when(n > 0, total.cast("double") / n).alias(name))
    return x.select(*readings.columns, *means)


def changes(readings: DataFrame, unit: int = 1000, key: str = "input", t: str = "t", v: str = "value") -> DataFrame:
    """Change of the moving average over 10 s, 1 min and 10 min."""
    frames = {}
    for label, w, avg in INTERVALS:
        frames[f"_r{label}"] = (0, avg * unit)
        frames[f"_p{label}"] = (w * unit, (w + avg) * unit)
    m = moving_means(readings, frames, key, t, v)
    return m.select(*readings.columns, *[(F.col(f"_r{n}") - F.col(f"_p{n}")).alias(f"change_{n}") for n, _, _ in INTERVALS])


def change_over(readings: DataFrame, within_s: int, unit: int = 1000, key: str = "input", t: str = "t", v: str = "value", since: str | None = None) -> DataFrame:
    """Adds ``change`` and ``span_s``: the last minute's mean against that of the same span ``within_s`` earlier,
    or as far back as the history (or the rule's mode, ``since``) goes."""
    avg = CHANGE_AVG_S * unit
    r = readings.filter(F.col(v).isNotNull())
    # read three times below: written once
    m = cut(moving_means(r, {"_recent": (0, avg), "_ahead": (-avg, 1)}, key, t, v), "moving-means")
    start = F.col(t) - within_s * unit
    if since:
        start = F.greatest(start, F.coalesce(F.col(since), start))
    asks = m.select("*", (start - avg).alias("_at"), F.lit(0).cast("long").alias("_q"), F.lit(None).cast("long").alias("_mark"))
    # a reading sorts after a question at its own time: the next reading "at or after"
    marks = m.select(key, F.col(t).alias("_at"), F.lit(1).cast("long").alias("_q"), F.col(t).alias("_mark"))
    both = asks.unionByName(marks, allowMissingColumns=True)
    plan = replace(plan_slices(r, (key,), t, t), ts="_at", tie="_q")
    first = Ordered(both, plan).next_first(F.col("_mark"), "_t0").done().filter("_q = 0").drop("_q", "_mark", "_at")
    past = m.select(key, F.col(t).alias("_t0"), F.col("_ahead").alias("_past")).dropDuplicates([key, "_t0"])
    x = first.drop("_ahead").join(past, [key, "_t0"], "left")
    span = F.col(t) - avg - F.col("_t0")
    ok = (span > 0) & F.col("_recent").isNotNull() & F.col("_past").isNotNull()
    return x.select(
        *readings.columns,
        F.when(ok, F.col("_recent") - F.col("_past")).alias("change"),
        F.when(ok, F.least(span / unit, F.lit(float(within_s)))).otherwise(0.0).alias("span_s"),
    )


def rule_changes(readings: DataFrame, rules: DataFrame, unit: int = 1000, key: str = "input", t: str = "t", v: str = "value", within_s: int = 600) -> DataFrame:
    """Adds ``changes``: for each change rule of the reading's input a map entry rule -> (change, span_s, within_s), each over its
    own span and, where the rule has a ``since`` (its mode began), over no reading before that.

    Rules are few; those with the same span and begin are computed at once, over the readings of their inputs only.
    """
    r = rules.filter("op = 'change'").select("rule", key, _or(rules, "within_s", "int", within_s).alias("w"), _or(rules, "since", "long", None).alias("s"))
    parts = None
    for span in r.select("w", "s").distinct().collect():
        mine = r.filter((F.col("w") == span.w) & F.col("s").eqNullSafe(F.lit(span.s))).select(key, "rule")
        own = readings.select(key, t, v).join(mine.select(key).distinct(), key, "left_semi").withColumn("_since", F.lit(span.s).cast("long"))
        c = change_over(own, span.w, unit, key, t, v, since="_since").select(key, t, "change", "span_s").dropDuplicates([key, t])
        c = c.join(mine, key).select(key, t, "rule", F.struct("change", "span_s", F.lit(float(span.w)).alias("within_s")).alias("c"))
        parts = c if parts is None else parts.unionByName(c)
    none = "map<string, struct<change: double, span_s: double, within_s: double>>"
    if parts is None:
        return readings.withColumn("changes", F.lit(None).cast(none))
    listed = parts.groupBy(key, t).agg(F.map_from_entries(F.collect_list(F.struct("rule", "c"))).alias("changes"))
    return readings.join(listed, [key, t], "left").select(*readings.columns, "changes")


def _or(df: DataFrame, name: str, kind: str, default) -> Column:
    return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in df.columns else F.lit(default).cast(kind)


def rules_in_force(rules: DataFrame, modes: DataFrame) -> DataFrame:
    """Rules whose every ``when`` entry (map mode -> value) agrees with the mode's present value, with ``since``, when the last of
    their modes began, if the modes tell (column ``since``)."""
    w = rules.select("rule", F.explode("when").alias("mode", "wanted")).join(modes, "mode", "left")
    off = w.filter(~F.col("wanted").eqNullSafe(F.col("present"))).select("rule").distinct()
    left = rules.join(off, "rule", "left_anti")
    if "since" not in modes.columns:
        return left
    return left.drop("since").join(w.groupBy("rule").agg(F.max("since").alias("since")), "rule", "left")


def evaluate(values: DataFrame, channels: DataFrame, rules: DataFrame, key: str = "input", t: str = "t", v: str = "value", change: str | None = None) -> DataFrame:
    """Level and reasons of each reading against the rules in force.

    channels (input, lo, hi, safety), rules (rule, input, op, limit, level). Ops: at_or_above, above, below,
    change (of the column ``change``, or of the rule's own entry in ``changes``, see ``rule_changes``; a span that the history doesn't
    fill yet is said among the reasons). A value outside the channel's range is a notice, a warning where a safety rule
    exists; no value with a safety rule in force is a warning, else no data.
    """
    named = F.col("rule") if "rule" in rules.columns else F.lit(None).cast("string").alias("rule")
    listed = rules.groupBy(key).agg(F.collect_list(F.struct("op", "limit", "level", named)).alias("_rules"))
    x = values.join(channels, key, "left").join(listed, key, "left")
    val = F.col(v)
    own = "changes" in values.columns
    empty = F.array().cast("array<struct<op: string, limit: double, level: string, rule: string>>")
    active = F.coalesce("_rules", empty)

    def changed(r: Column) -> Column:
        return F.try_element_at("changes", r["rule"])["change"] if own else F.col(change) if change else F.lit(None).cast("double")

    def hit(r: Column) -> Column:
        return (
            F.when(r["op"] == "at_or_above", val >= r["limit"])
            .when(r["op"] == "above", val > r["limit"])
            .when(r["op"] == "below", val < r["limit"])
            .when(r["op"] == "change", F.coalesce(F.abs(changed(r)) >= r["limit"], F.lit(False)))
            .otherwise(False)
        )

    hits = F.filter(active, hit)
    safety_now = F.exists(active, lambda r: r["level"].isin(*SAFETY))
    outside = F.coalesce((val < F.col("lo")) | (val > F.col("hi")), F.lit(False))
    floor_level = F.when(outside & F.coalesce("safety", F.lit(False)), "warn").when(outside, "notice").otherwise("ok")
    ranks = F.concat(F.array(rank_of(floor_level)), F.transform(hits, lambda r: rank_of(r["level"])))
    top = F.array_max(ranks)
    by_rank = {v: k for k, v in RANK.items() if k not in ("info", "idle")}
    level = F.coalesce(*[F.when(top == n, F.lit(k)) for n, k in by_rank.items()])
    reasons = F.concat(
        F.when(outside, F.array(F.lit("outside range"))).otherwise(F.array().cast("array<string>")),
        F.transform(hits, lambda r: F.concat(r["op"], F.lit(" "), r["limit"].cast("string"), F.lit(" ["), r["level"], F.lit("]"))),
    )
    if own:
        filled = lambda r: F.try_element_at("changes", r["rule"])
        early = F.filter(active, lambda r: F.coalesce((r["op"] == "change") & (filled(r)["span_s"] < filled(r)["within_s"]), F.lit(False)))
        reasons = F.concat(reasons, F.transform(early, lambda r: F.concat(F.lit("change "), r["limit"].cast("string"), F.lit(": only "), filled(r)["span_s"].cast("long").cast("string"), F.lit(" s of history"))))
    missing = val.isNull()
    return x.select(
        *[c for c in values.columns if c != "changes"],
        F.when(missing & safety_now, "warn").when(missing, "nodata").otherwise(level).alias("level"),
        F.array_sort(F.when(missing, F.array().cast("array<string>")).otherwise(reasons)).alias("reasons"),
    )


def summarize(items: DataFrame, keys: list[str]) -> DataFrame:
    """Worst level per group, and how many items stand at each rank of notice or worse."""
    r = rank_of(F.col("level"))
    return items.groupBy(*keys).agg(
        F.max_by("level", r).alias("worst"), F.max(r).alias("rank"), F.count(F.lit(1)).alias("n"), F.count_if(r >= RANK["notice"]).alias("n_flagged")
    )


def collapse(items: DataFrame, key: str = "grp") -> DataFrame:
    """A group as one line: its worst level, the readings' span, how many read and how many are not connected."""
    read = F.when(F.col("connected"), F.col("value"))
    return items.groupBy(key).agg(
        F.max_by("level", rank_of(F.col("level"))).alias("worst"), F.min(read).alias("low"), F.max(read).alias("high"),
        F.count(read).alias("reading"), F.count_if(~F.col("connected")).alias("unconnected"),
    )


def clock_state(runs: DataFrame) -> DataFrame:
    """Board clocks over a run from the run file's start and stop checks (arrays of board names)."""
    none = F.array().cast("array<string>")
    lost_in, lost_before = F.coalesce("stop_lost", none), F.coalesce("start_lost", none)
    unlocked = F.array_sort(F.array_union(F.coalesce("start_unlocked", none), F.coalesce("stop_unlocked", none)))
    bad = (F.size(lost_in) > 0) | (F.size(unlocked) > 0)
    level = F.when(~F.col("recorded"), "nodata").when(bad, "problem").when(F.size(lost_before) > 0, "problem").otherwise("ok")
    return runs.select("run", level.alias("level"), lost_in.alias("lost"), unlocked.alias("unlocked"))


def run_state(runs: DataFrame, quiet_after_s: int, now: Column) -> DataFrame:
    """running, stopped, stopped with problems, or no stop recorded and quiet."""
    state = (
        F.when(F.col("stop").isNotNull() & (F.size(F.coalesce("problems", F.array().cast("array<string>"))) > 0), "problems")
        .when(F.col("stop").isNotNull(), "stopped")
        .when(now - F.col("newest") > quiet_after_s, "no stop")
        .otherwise("running")
    )
    return runs.withColumn("state", state)


def failed_commands(led: DataFrame) -> DataFrame:
    """LED commands that failed, per run, with the last one."""
    bad = led.filter(~F.col("ok"))
    return bad.groupBy("run").agg(F.count(F.lit(1)).alias("failed"), F.max_by("what", "run_ms").alias("last_what"), F.max_by("error", "run_ms").alias("last_error"))


def commands_on_data_clock(led: DataFrame, rates: DataFrame, t0_s: float) -> DataFrame:
    """LED commands beside the rate of the data second they fall in."""
    s = F.col("run_ms") / 1000.0 - t0_s
    return led.withColumn("data_s", s).withColumn("sec", F.floor(s)).join(rates, ["run", "sec"], "left")
