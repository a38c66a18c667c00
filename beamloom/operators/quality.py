"""Data quality: counter gaps, file summaries, loss, health, completeness, catalogue of runs, dimension checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamloom.functions import hitcols as H
from beamloom.operators.ordering import Ordered, plan_slices
from beamloom.schema import AGG_COUNTER_MOD
from beamloom.session import cut

# A counter step up to this is a gap, a larger one damage; a small loss; warnings kept per kind.
FORWARD_STEPS = 1 << 20
SMALL_LOSS_AGGREGATES = 3
SMALL_LOSS_SHARE = 1e-3
PROBLEM_KINDS = 50


def counter_gaps(aggs: DataFrame, keys: tuple[str, ...] = ("serial",), seq: str = "seq", counter: str = "counter") -> DataFrame:
    """Adds ``missing`` aggregates before each one, in file order, over roll-over files; modulo 2^23.

    A step beyond 2^20 cannot be a gap and is marked ``damage``. The order is cut into slices and the counter
    before a seam comes from the last row of the slice before.
    """
    plan = plan_slices(aggs, keys, seq, seq)
    o = Ordered(aggs, plan).prev_value(counter, "_prev").done()
    out = o.withColumn("_step", F.pmod(F.col(counter) - F.col("_prev"), F.lit(AGG_COUNTER_MOD)))
    gap = (F.col("_step") >= 1) & (F.col("_step") <= FORWARD_STEPS)
    return out.select(
        *aggs.columns,
        F.when(gap, F.col("_step") - 1).otherwise(0).cast("long").alias("missing"),
        (F.col("_step").isNotNull() & ~gap).alias("damage"),
    )


def gap_totals(gaps: DataFrame, keys: list[str]) -> DataFrame:
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("aggregates"),
        F.count_if(F.col("missing") > 0).alias("gaps"),
        F.sum("missing").alias("missing"),
        F.count_if(F.col("damage")).alias("damaged"),
    )


def input_estimate(hits: DataFrame, key: str = "serial") -> DataFrame:
    """Input triggers from the 1024-markers (a lower bound) and the share of them written."""
    marks = F.count_if(H.has_flag(F.col("flags"), H.FLAG_1024_COUNTED))
    n = F.count(F.lit(1))
    return hits.groupBy(key).agg(n.alias("n"), (marks * 1024).alias("input_at_least"), F.try_divide(n.cast("double"), (marks * 1024).cast("double")).alias("written"))


def file_summary(hits: DataFrame, units_per_s: float, key: str = "serial") -> DataFrame:
    """Per board and in all: hits, piled-up, markers, first and last time, span, rate, bytes per hit aside."""
    g = hits.groupingSets([[key], []], key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pur")).alias("n_pur"),
        F.count_if(H.has_flag(F.col("flags"), H.FLAG_1024_COUNTED)).alias("n_1024"),
        F.count_if(H.has_flag(F.col("flags"), H.FLAG_TRIGGER_LOST)).alias("n_lost"),
        F.count_if(H.has_flag(F.col("flags"), H.FLAG_OVER_RANGE)).alias("n_over"),
        F.min("ts_ps").alias("ts_first"),
        F.max("ts_ps").alias("ts_last"),
    )
    span = (F.col("ts_last") - F.col("ts_first")) / F.lit(units_per_s)
    return g.withColumns({"span_s": span, "rate": F.try_divide(F.col("n").cast("double"), span)})


def loss_level(missing: Column, total: Column) -> Column:
    """A note for a small loss (at most 3 aggregates and under 0.1 % of the board's data), else an alarm."""
    share = F.try_divide(missing.cast("double"), total.cast("double"))
    small = (missing <= SMALL_LOSS_AGGREGATES) & (share < SMALL_LOSS_SHARE)
    return F.when(missing == 0, "ok").when(small, "notice").otherwise("warn")


def health_lines(boards: DataFrame, silent_after: int) -> DataFrame:
    """(level, board, text) from one row per board: silent while others write, lost data, other formats."""
    newest = boards.agg(F.max("newest")).first()[0]
    b = boards.withColumn("_behind", F.lit(newest) - F.col("newest"))
    rules = [
        (F.col("n") == 0, "warn", F.lit("no data")),
        (F.col("_behind") > silent_after, "warn", F.format_string("silent for %d while others write", F.col("_behind"))),
        (F.col("missing") > 0, None, F.format_string("%d aggregates missing", F.col("missing"))),
        (F.col("damaged") > 0, "warn", F.format_string("%d damaged places", F.col("damaged"))),
        (F.col("other") > 0, "warn", F.format_string("%d blocks in another format", F.col("other"))),
    ]
    lines = F.array(
        *[
            F.when(cond, F.struct((F.lit(level) if level else loss_level(F.col("missing"), F.col("aggregates"))).alias("level"), text.alias("text")))
            for cond, level, text in rules
        ]
    )
    return b.select("board", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l")).select("board", "l.level", "l.text")


def problem_episodes(steps: DataFrame) -> DataFrame:
    """(step, text) -> kinds of warning with numbers taken out: first, last, steps, episodes, last wording.

    One row per kind and step is ordered, in slices.
    """
    key = F.regexp_replace("text", r"(^|[\s(=])\d+(?:[.,]\d+)*", "$1#")
    per = steps.withColumn("kind", key).groupBy("kind", "step").agg(F.max("text").alias("text"))
    per = Ordered(per, plan_slices(per, ("kind",), "step", "step")).prev_time("_prev").done()
    new = F.coalesce((F.col("step") - F.col("_prev") > 1).cast("int"), F.lit(1))
    return per.withColumn("_new", new).groupBy("kind").agg(
        F.min("step").alias("first"), F.max("step").alias("last"), F.count(F.lit(1)).alias("steps"),
        F.sum("_new").alias("episodes"), F.max_by("text", "step").alias("text"),
    )


def keep_first_kinds(episodes: DataFrame, kinds: int = PROBLEM_KINDS) -> DataFrame:
    """The report's own limit: the first kinds seen; how many more there were is a count of the rest."""
    return episodes.orderBy("first", "kind").limit(kinds)


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key. An aggregate, so a key with very many rows never meets in one task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(F.struct(c), order)[c].alias(c) for c in rest])


def check_cabling(rows: DataFrame, boards: DataFrame, plane_channels: dict[int, int]) -> DataFrame:
    """Every cabling row with the ``problem`` that leaves it out, or NULL. Rows are judged in file order per run:
    of two rows for one digitizer channel, plane channel or the RF input the first good one stays."""
    n = F.coalesce(*[F.when(F.col("plane") == p, F.lit(c)) for p, c in plane_channels.items()])
    r = rows.join(boards.select("run", "serial", "channels"), ["run", "serial"], "left")
    trk = F.col("kind") == "trk"
    known = F.col("kind").isin("trk", "rf", "veto", "cherenkov", "lucite")
    first = (
        F.when(F.col("channels").isNull(), "board not open")
        .when((F.col("channel") < 0) | (F.col("channel") >= F.col("channels")), "no such channel")
        .when(~known, "unknown kind")
        .when(trk & (n.isNull() | (F.col("ch") < 1) | (F.col("ch") > n)), "not a tracker channel")
    )
    r = r.withColumn("_p1", first)
    ok1 = F.col("_p1").isNull()

    def before(cond: Column, *by: Column) -> Column:
        w = Window.partitionBy("run", *by).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(cond.cast("int")).over(w), F.lit(0)) > 0

    r = r.withColumn("_p2", F.when(ok1 & trk & before(ok1 & trk, F.col("plane"), F.col("ch"), trk), "plane channel taken"))
    ok2 = ok1 & F.col("_p2").isNull()
    r = r.withColumn("_p3", F.when(ok2 & (F.col("kind") == "rf") & before(ok2 & (F.col("kind") == "rf"), F.col("kind")), "second rf"))
    ok3 = ok2 & F.col("_p3").isNull()
    r = r.withColumn("_p4", F.when(ok3 & before(ok3, F.col("serial"), F.col("channel")), "given twice"))
    return r.select(*rows.columns, F.coalesce("_p1", "_p2", "_p3", "_p4").alias("problem"))


def key_differences(docs: DataFrame, order: str, key: str = "key", value: str = "value") -> DataFrame:
    """Documents as (order, key, value) rows: every key whose value is not that of the document before, where it
    appears (``before`` NULL) and where it goes (``after`` NULL). Each document is joined with the one before by key."""
    beside = neighbours(docs, order)
    d = docs.join(beside, order)
    old = d.filter("_next is not null").select(F.col("_next").alias(order), key, F.col(value).alias("before"), F.lit(True).alias("_was"))
    new = d.filter("_prev is not null").select(order, key, F.col(value).alias("after"), F.lit(True).alias("_is"))
    same = F.col("_was").isNotNull() & F.col("_is").isNotNull() & F.col("before").eqNullSafe(F.col("after"))
    return old.join(new, [order, key], "full_outer").filter(~same).select(order, key, "before", "after")


def neighbours(df: DataFrame, order: str) -> DataFrame:
    """(order, _prev, _next) of the distinct values: ordered by ranges, with one row per range for the seams."""
    values = cut(df.select(order).filter(F.col(order).isNotNull()).distinct().repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "neighbours")
    parts = Window.orderBy("_part")
    seams = values.groupBy("_part").agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    seams = seams.select("_part", F.lag("_high").over(parts).alias("_before"), F.lead("_low").over(parts).alias("_after"))
    own = Window.partitionBy("_part").orderBy(order)
    return values.join(seams, "_part").select(order, F.coalesce(F.lag(order).over(own), "_before").alias("_prev"), F.coalesce(F.lead(order).over(own), "_after").alias("_next"))


def two_sided_differences(a: DataFrame, b: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    l, r = a.select(*on, F.col(value).alias("before")), b.select(*on, F.col(value).alias("after"))
    return l.join(r, on, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def register_differences(a: DataFrame, b: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Settings images (board, index, value) against each other under the dictionary's masks; registers without
    a dictionary row (derived, read-only) are left out."""
    d = dictionary.select("index", "name", "mask")
    l = a.join(d, "index").select("board", "index", "name", F.col("value").bitwiseAND(F.col("mask")).alias("value"))
    r = b.join(d, "index").select("board", "index", "name", F.col("value").bitwiseAND(F.col("mask")).alias("value"))
    return two_sided_differences(l, r, ["board", "index", "name"])


def setup_identity(setups: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 over the sorted fields of a set-up."""
    fields = sorted(c for c in setups.columns if c not in keys)
    return setups.select(*keys, F.sha2(F.to_json(F.struct(*fields)), 256).alias("identity"))


def text_identity(content: Column) -> Column:
    """SHA-256 of a text file with its line ends made LF."""
    return F.sha2(F.regexp_replace(content, "\r\n", "\n"), 256)


def run_catalogue(files: DataFrame, records: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row per run: files, bytes, newest change, its record, and whether its summary is there and fresh.

    files (run, path, bytes, modified), records (run, start, comment, stop), summaries (run, fingerprint, complete).
    """
    f = files.groupBy("run").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"),
        F.sum(F.xxhash64("path", "bytes").cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    )
    s = summaries.select("run", F.col("fingerprint").alias("_fp"), "complete")
    state = (
        F.when(F.col("_fp").isNull(), "none").when(F.col("_fp") != F.col("fingerprint"), "stale").when(~F.col("complete"), "incomplete").otherwise("complete")
    )
    return f.join(records, "run", "left").join(s, "run", "left").withColumn("summary", state).drop("_fp", "complete")


def summaries_wanted(catalogue: DataFrame, setup_now: DataFrame | None = None) -> DataFrame:
    """Runs to read again, ranked: no or stale summary first, then incomplete ones."""
    rank = F.when(F.col("summary").isin("none", "stale"), 0).when(F.col("summary") == "incomplete", 1)
    return catalogue.withColumn("rank", rank).filter("rank is not null")


def surviving_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per run the summary that stays: a complete one is never replaced by an incomplete one of the same files;
    otherwise the new one. The live part (``live``) of the old one is carried on."""
    j = old.alias("o").join(new.alias("n"), "run", "full_outer")
    keep_old = F.col("n.complete").isNull() | (F.coalesce(F.col("o.complete"), F.lit(False)) & ~F.col("n.complete") & F.col("o.fingerprint").eqNullSafe(F.col("n.fingerprint")))

    def pick(c: str) -> Column:
        return F.when(keep_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    return j.select("run", pick("complete"), pick("fingerprint"), pick("doc"), F.coalesce(F.col("n.live"), F.col("o.live")).alias("live"), F.when(keep_old, "old").otherwise("new").alias("kept"))


def completeness(reasons: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, complete, reasons) from rule rows (run, reason); a run without a reason is complete."""
    r = reasons.filter(F.col("reason").isNotNull()).groupBy("run").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return runs.select("run").distinct().join(r, "run", "left").select(
        "run", F.col("reasons").isNull().alias("complete"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons")
    )


def written_rate(totals: DataFrame, key: str, at: str = "t", total: str = "bytes") -> DataFrame:
    """Bytes per second from successive totals; a total that fell (a new file) gives NULL."""
    plan = plan_slices(totals, (key,), at, total)
    x = Ordered(totals, plan).prev_value(total, "_pv").prev_value(at, "_pt").done()
    d, dt = F.col(total) - F.col("_pv"), F.col(at) - F.col("_pt")
    return x.withColumn("rate", F.when(d >= 0, F.try_divide(d.cast("double"), dt.cast("double")))).drop("_pv", "_pt")


def stale_since(readings: DataFrame, key: str, value: str, now: int, limit: int, at: str = "t", tie: str | None = None) -> DataFrame:
    """When each value last moved, and whether that is longer ago than ``limit``. Sliced like any ordered work.

    Readings of one time are taken in the order of ``tie``, or of their values.
    """
    plan = plan_slices(readings, (key,), at, tie or value)
    x = Ordered(readings, plan).prev_value(value, "_prev").done()
    moved = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(value)), F.col(at))
    m = x.withColumn("_m", moved).groupBy(key).agg(F.max("_m").alias("moved"), F.max(at).alias("newest"))
    return m.withColumn("stale", F.lit(now) - F.col("moved") > limit)
