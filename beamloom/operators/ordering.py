"""Ordered work over time without un-partitioned windows.

``lag`` and running frames over "all hits in time order" would put a whole run (or one busy channel) into
one task. Here time is cut into slices holding about ``rows_per_slice`` rows; windows run per slice, and
what has to cross a seam (the last time, the last bunch start, the number of rows so far) is taken from a
table with one row per slice. Results do not depend on where the cuts are.

A slice holding far more rows than planned (a burst, one hot channel) is cut again inside; rows sharing a
single time are at last cut by the tie-break column. Both cuts respect the (time, tie-break) order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_sl"
TIE = "_sl2"
ROWS_PER_SLICE = 1_000_000
MAX_SPLITS = 8


def floor_to(c: Column, width) -> Column:
    """Largest multiple of ``width`` not above ``c`` (exact for LONG, also below zero)."""
    w = F.lit(width) if isinstance(width, int) else width
    return c - F.pmod(c, w)


@dataclass
class SlicePlan:
    """How (keys, time) is cut. Holds only numbers and small local tables, so a retry cuts the same way."""

    keys: tuple[str, ...]
    ts: str
    tie: str
    width: int
    origin: int = 0
    one_slice: bool = False
    splits: list[tuple[str, DataFrame]] = field(default_factory=list)

    @property
    def cols(self) -> list[str]:
        return [*self.keys, SLICE, TIE]

    def order(self, *more: str) -> list[str]:
        return [self.ts, self.tie, *more]

    def assign(self, df: DataFrame) -> DataFrame:
        start = floor_to(F.col(self.ts) - F.lit(self.origin), self.width) + F.lit(self.origin)
        out = df.withColumn(SLICE, start.cast("long")).withColumn(TIE, F.lit(0).cast("long"))
        for kind, hot in self.splits:
            out = _apply_split(out, self, kind, hot)
        return out

    def window(self, *more: str):
        return Window.partitionBy(*self.cols).orderBy(*self.order(*more))

    def over_slices(self):
        """Window over the slice table: one row per slice, per key."""
        return Window.partitionBy(*self.keys).orderBy(SLICE, TIE)


def _apply_split(df: DataFrame, plan: SlicePlan, kind: str, hot: DataFrame) -> DataFrame:
    start, by = (SLICE, plan.ts) if kind == "time" else (TIE, plan.tie)
    out = df.join(hot, plan.cols, "left")
    finer = F.col(start) + floor_to(F.col(by) - F.col(start), F.col("_w"))
    return out.withColumn(start, F.coalesce(finer, F.col(start))).drop("_w")


def plan_slices(
    df: DataFrame,
    keys: tuple[str, ...] = ("run",),
    ts: str = "ts_ps",
    tie: str = "pos",
    rows_per_slice: int | None = None,
    whole_keys: bool = False,
) -> SlicePlan:
    """Choose the cut from the data: one pass for count and range, one for slices that came out too full.

    Both passes read only keys, time and tie-break, reduce map-side, and return a few numbers: the second one
    returns slices above four times the target, of which there are at most a quarter of the planned slices.
    """
    spark = df.sparkSession
    lean = df.select(*keys, ts, tie)
    n, lo, hi = lean.agg(F.count(F.lit(1)), F.min(ts), F.max(ts)).first()
    if not n:
        return SlicePlan(keys, ts, tie, 1, one_slice=True)
    if rows_per_slice is None:
        par = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        rows_per_slice = max(1, min(ROWS_PER_SLICE, -(-n // par)))
    pieces = max(1, -(-n // rows_per_slice))
    plan = SlicePlan(keys, ts, tie, max(1, hi - lo + 1) if whole_keys else max(1, -(-(hi - lo + 1) // pieces)), origin=lo)
    limit = 4 * rows_per_slice
    if n <= limit:
        plan.one_slice = whole_keys
        return plan
    for _ in range(MAX_SPLITS):
        cells = (
            plan.assign(lean)
            .groupBy(*plan.cols)
            .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"), F.min(tie).alias("c"), F.max(tie).alias("d"))
            .filter((F.col("n") > limit) & ((F.col("b") > F.col("a")) | (F.col("d") > F.col("c"))))
        )
        hot = cells.collect()
        if not hot:
            break
        by_time = [r for r in hot if r["b"] > r["a"]]
        kind, start, last = ("time", SLICE, "b") if by_time else ("tie", TIE, "d")
        pick = by_time or hot
        rows = []
        for r in pick:
            low = r[start] if by_time or r[TIE] else r["c"]
            rows.append((*[r[c] for c in plan.cols], max(1, (r[last] - low + 1) // -(-r["n"] // rows_per_slice))))
        fields = [f"`{k}` {lean.schema[k].dataType.simpleString()}" for k in keys]
        plan.splits.append((kind, spark.createDataFrame(rows, ", ".join([*fields, f"`{SLICE}` long", f"`{TIE}` long", "_w long"]))))
    plan.one_slice = whole_keys and not plan.splits
    return plan


class Ordered:
    """Hits cut by a plan, with window results that are right across the seams."""

    def __init__(self, df: DataFrame, plan: SlicePlan, *more_order: str):
        self.plan = plan
        self.more = more_order
        self.df = df if SLICE in df.columns else plan.assign(df)
        self._base = self.df

    def _carry(self, table: DataFrame, name: str, value: Column) -> None:
        if self.plan.one_slice:  # nothing crosses a seam
            self.df = self.df.withColumn(name, F.lit(None))
            return
        t = table.withColumn(name, value).select(*self.plan.cols, name)
        self.df = self.df.join(t, self.plan.cols, "left")

    def prev_time(self, name: str = "prev_ts") -> "Ordered":
        """Time of the row before, per key."""
        p = self.plan
        tails = self._base.groupBy(*p.cols).agg(F.max(p.ts).alias("__last"))
        self._carry(tails, "__carry", F.lag("__last").over(p.over_slices()))
        self.df = self.df.withColumn(name, F.coalesce(F.lag(p.ts).over(p.window(*self.more)), F.col("__carry"))).drop("__carry")
        return self

    def prev_value(self, col: str, name: str) -> "Ordered":
        """``col`` of the row before, per key."""
        p = self.plan
        w = p.window(*self.more)
        ends = self._base.withColumn("__next", F.lead(p.tie).over(w)).filter(F.col("__next").isNull())
        self._carry(ends.withColumnRenamed(col, "__end"), "__carry", F.lag("__end").over(p.over_slices()))
        here = F.row_number().over(w) == 1
        self.df = self.df.withColumn(name, F.when(here, F.col("__carry")).otherwise(F.lag(col).over(w))).drop("__carry")
        return self

    def running_last(self, mark: Column, name: str) -> "Ordered":
        """Newest non-null LONG ``mark`` up to and with this row. ``mark`` must not fall along the order."""
        p = self.plan
        self.df = self.df.withColumn("__mark", mark)
        ends = self.df.groupBy(*p.cols).agg(F.max("__mark").alias("__end"))
        self._carry(ends, "__carry", F.last("__end", True).over(p.over_slices().rowsBetween(Window.unboundedPreceding, -1)))
        inside = F.last("__mark", True).over(p.window(*self.more).rowsBetween(Window.unboundedPreceding, 0))
        self.df = self.df.withColumn(name, F.coalesce(inside, F.col("__carry"))).drop("__mark", "__carry")
        return self

    def running_sums(self, values: dict[str, Column]) -> "Ordered":
        """Sums of several values up to and with this row: one pass, one seam table for all of them."""
        p = self.plan
        self.df = self.df.withColumns({f"__v_{n}": v for n, v in values.items()})
        sums = self.df.groupBy(*p.cols).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
        if not p.one_slice:
            before = p.over_slices().rowsBetween(Window.unboundedPreceding, -1)
            carry = sums.select(*p.cols, *[F.sum(f"__s_{n}").over(before).alias(f"__c_{n}") for n in values])
            self.df = self.df.join(carry, p.cols, "left")
        upto = p.window(*self.more).rowsBetween(Window.unboundedPreceding, 0)
        inside = {f"__w_{n}": F.sum(f"__v_{n}").over(upto) for n in values}
        self.df = self.df.withColumns(inside)
        keep = [c for c in self.df.columns if not c.startswith(("__v_", "__c_", "__w_"))]
        totals = [
            (F.col(f"__w_{n}") if p.one_slice else F.col(f"__w_{n}") + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).alias(n) for n in values
        ]
        self.df = self.df.select(*keep, *totals)
        return self

    def running_sum(self, value: Column, name: str) -> "Ordered":
        """Sum of ``value`` up to and with this row."""
        return self.running_sums({name: value})

    def next_first(self, mark: Column, name: str) -> "Ordered":
        """Next non-null LONG ``mark`` strictly after this row. ``mark`` must not fall along the order."""
        p = self.plan
        self.df = self.df.withColumn("__mark", mark)
        heads = self.df.groupBy(*p.cols).agg(F.min("__mark").alias("__head"))
        back = Window.unboundedPreceding, -1  # running frames over the reversed order; a forward frame would rescan
        over = Window.partitionBy(*p.keys).orderBy(F.desc(SLICE), F.desc(TIE)).rowsBetween(*back)
        self._carry(heads, "__carry", F.last("__head", True).over(over))
        rev = Window.partitionBy(*p.cols).orderBy(*[F.desc(c) for c in p.order(*self.more)]).rowsBetween(*back)
        inside = F.last("__mark", True).over(rev)
        self.df = self.df.withColumn(name, F.coalesce(inside, F.col("__carry"))).drop("__mark", "__carry")
        return self

    def ordinal(self, name: str = "ord") -> "Ordered":
        """0-based place in the whole order, per key."""
        p = self.plan
        counts = self._base.groupBy(*p.cols).agg(F.count(F.lit(1)).alias("__count"))
        self._carry(counts, "__carry", F.sum("__count").over(p.over_slices().rowsBetween(Window.unboundedPreceding, -1)))
        rn = F.row_number().over(p.window(*self.more)).cast("long")
        self.df = self.df.withColumn(name, rn - 1 + F.coalesce(F.col("__carry"), F.lit(0))).drop("__carry")
        return self

    def done(self) -> DataFrame:
        return self.df.drop(SLICE, TIE)
