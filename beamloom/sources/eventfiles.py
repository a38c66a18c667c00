"""Saved events: nested tables of built events, by run and slice of time, as the input of later analyses.

One row is an event: run, ev_id (0-based place in its run), t_first, t_last, multi, and an array per quantity of its hits in
time order, traces included where hits have them. The files lie in folders per run and slice of time, so a later job that asks for runs
or a span of time lists and reads no others; a run that is written again replaces its own folders only. ``runs`` beside the
events holds one row per run: t_start, t_end, events, hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.operators.ordering import Ordered, plan_slices

#: Length of a slice in units of the events' times (600 s of picoseconds).
SLICE_PS = 600_000_000_000_000
#: Quantities of a hit, by the names they have in an event.
HIT = {"sn": "serial", "ch": "ch", "e": "qlong", "e2": "qshort"}


def build_events(grouped: DataFrame, event: str = "bunch_t0", hit: dict[str, str] = HIT, trace: str | None = None) -> DataFrame:
    """Events of hits that carry ``run``, ``event``, ts_ps and pos: one row each, hits in time order.

    Times are kept as whole nanoseconds (e_t) and the rest in picoseconds (e_f). ``trace`` names an array column; an event then has
    trace and trace_length.
    """
    take = [F.col(c).alias(n) for n, c in hit.items()] + [F.expr("ts_ps div 1000").alias("e_t"), F.pmod(F.col("ts_ps"), F.lit(1000)).cast("int").alias("e_f")]
    if trace:
        take += [F.coalesce(F.size(trace), F.lit(0)).alias("trace_length"), F.col(trace).alias("trace")]
    one = F.struct(F.col("ts_ps").alias("_t"), F.col("pos").alias("_p"), *take)
    names = [*hit, "e_t", "e_f", *(["trace_length", "trace"] if trace else [])]
    g = grouped.groupBy("run", F.col(event).alias("_ev")).agg(
        F.min("ts_ps").alias("t_first"), F.max("ts_ps").alias("t_last"), F.count(F.lit(1)).alias("multi"), F.sort_array(F.collect_list(one)).alias("_h")
    )
    rows = g.select("run", "_ev", "t_first", "t_last", "multi", *[F.col(f"_h.{n}").alias(n) for n in names])
    numbered = Ordered(rows, plan_slices(rows, ("run",), "t_first", "_ev")).ordinal("ev_id").done()
    return numbered.select("run", "ev_id", "t_first", "t_last", "multi", *names)


def write_events(events: DataFrame, folder: str, slice_width: int = SLICE_PS) -> None:
    """Writes the events and their runs; what the folder holds of these runs is replaced, other runs stay."""
    part = ((F.col("t_first") - F.pmod(F.col("t_first"), F.lit(slice_width))) / slice_width).cast("long").alias("slice")
    spark = events.sparkSession
    # sorted by place in the run, so that a file's footer bounds ids and times
    laid = events.select("*", part).repartitionByRange("run", "slice", "ev_id").sortWithinPartitions("run", "slice", "ev_id")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "slice").parquet(f"{folder}/events")
    written = events.select("run").distinct()
    summary = spark.read.schema(laid.schema).parquet(f"{folder}/events").join(written, "run", "left_semi").groupBy("run").agg(
        F.min("t_first").alias("t_start"), F.max("t_last").alias("t_end"), F.count(F.lit(1)).alias("events"), F.sum("multi").alias("hits")
    )
    summary.repartition("run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{folder}/runs")


def read_events(spark: SparkSession, *folders: str, runs: Sequence[int] | None = None, lo: int | None = None, hi: int | None = None, slice_width: int = SLICE_PS) -> DataFrame:
    """Events of one or several folders, of these runs and with t_first in [lo, hi); other folders of runs and slices aren't read."""
    out = None
    for folder in folders:
        e = spark.read.parquet(f"{folder}/events")
        if runs is not None:
            e = e.filter(F.col("run").isin(*runs))
        if lo is not None:
            e = e.filter((F.col("slice") >= lo // slice_width) & (F.col("t_first") >= lo))
        if hi is not None:
            e = e.filter((F.col("slice") <= (hi - 1) // slice_width) & (F.col("t_first") < hi))
        out = e if out is None else out.unionByName(e, allowMissingColumns=True)
    return out.drop("slice")


def read_runs(spark: SparkSession, *folders: str) -> DataFrame:
    """run, t_start, t_end, events, hits of the saved runs."""
    return spark.read.parquet(*[f"{f}/runs" for f in folders])


def hits_of(events: DataFrame, *columns: str) -> DataFrame:
    """One row per hit: run, ev_id, multi, i (place in the event) and the asked quantities; only their arrays are read."""
    cols = columns or tuple(c for c in events.columns if events.schema[c].dataType.typeName() == "array")
    return events.select("run", "ev_id", "multi", F.posexplode(F.arrays_zip(*cols)).alias("i", "h")).select("run", "ev_id", "multi", "i", *[f"h.{c}" for c in cols])
