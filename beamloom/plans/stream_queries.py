"""The streaming job over the whole hit stream, in several micro-batches, with controls on the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamloom.plans.adapters import HITS_SQL, as_hits
from beamloom.plans.catalogue import Catalogue
from beamloom.session import scratch_dir
from beamloom.streaming import live

C = Catalogue()
GAP = 300_000_000
WIDER = 2 * GAP
#: Batches of the whole stream at least, and rows of a batch at most.
BATCHES = 4
BATCH_ROWS = 50_000_000
REFERENCE = 7
DT_WIDTH = 200_000_000
DT_BINS = 40


def follow(spark, sf, back: int = 0, controls: dict[int, dict] | None = None) -> live.LiveRun:
    """Hits arrive in time order, piece by piece, every piece in as many files as tasks wrote; ``back`` makes every 16th hit of a piece
    arrive one piece later, ``controls`` are given before the piece of their number. The query stops and starts again between pieces."""
    hits = as_hits(spark, sf).select("board", "ch", "slot", "ts_ps", "pos", "qlong")
    lo, hi, rows = hits.agg(F.min("ts_ps"), F.max("ts_ps"), F.count(F.lit(1))).first()
    pieces = max(BATCHES, -(-rows // BATCH_ROWS))
    step = (hi - lo) // pieces + 1
    piece = F.expr(f"cast((ts_ps - {lo}) div {step} as int)")
    if back:
        piece = piece + F.when(F.col("pos") % 16 == 0, back).otherwise(0)
    arrival = hits.withColumn("piece", F.least(piece, F.lit(pieces - 1)))
    folder, state = scratch_dir(spark, "arrival"), scratch_dir(spark, "live")
    run = live.LiveRun(spark, state, live.LiveSettings(window=GAP, margin=GAP, dt_width=DT_WIDTH, dt_bins=DT_BINS), clock=lambda: 0.0)
    for i in range(pieces):
        run.control(**(controls or {}).get(i, {}))
        arrival.filter(F.col("piece") == i).drop("piece").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(hits.schema).parquet(folder)
        live.start(stream, run, f"{state}/checkpoint", every=None).awaitTermination()
    run.finish()
    return run


@C.query(
    "live_bunches",
    f"""WITH {HITS_SQL}, m AS (SELECT *, CASE WHEN ts_ps - lag(ts_ps) OVER (ORDER BY ts_ps, pos) <= {GAP} THEN 0 ELSE 1 END AS fr FROM hits),
    b AS (SELECT *, sum(fr) OVER (ORDER BY ts_ps, pos) AS bid FROM m) SELECT min(ts_ps) AS bunch_t0, count(*) AS multi, CAST(sum(qlong) AS BIGINT) AS q FROM b GROUP BY bid""",
)
def live_bunches(spark, sf):
    return follow(spark, sf).bunched_hits().groupBy("bunch_t0").agg(F.count(F.lit(1)).alias("multi"), F.sum("qlong").alias("q"))


@C.query("live_accounting", f"WITH {HITS_SQL} SELECT slot, count(*) AS n, count(*) AS accounted FROM hits GROUP BY slot")
def live_accounting(spark, sf):
    """With late hits: hits in bunches + late = all, per channel."""
    run = follow(spark, sf, back=1)
    inside = run.bunched_hits().groupBy("slot").agg(F.count(F.lit(1)).alias("_in"))
    t = run.totals().join(inside, "slot", "left")
    return t.select("slot", "n", (F.coalesce("_in", F.lit(0)) + F.col("late") + F.col("early")).alias("accounted"))


def _done_sql(name: str, before: str, pieces: int, window: int) -> str:
    """{name}(done): the first time that is not given out once so many pieces have come; ``before`` names the one at the batch before."""
    return f"""{name}_h AS (SELECT hits.* FROM hits, span, {before} p WHERE (ts_ps - lo) // step < {pieces} AND ts_ps >= p.done),
    {name}_m AS (SELECT ts_ps, pos, CASE WHEN ts_ps - lag(ts_ps) OVER (ORDER BY ts_ps, pos) <= {window} THEN 0 ELSE 1 END AS fr FROM {name}_h),
    {name}_b AS (SELECT min(ts_ps) AS t0, max(ts_ps) AS t1 FROM (SELECT ts_ps, sum(fr) OVER (ORDER BY ts_ps, pos) AS bid FROM {name}_m) GROUP BY bid),
    {name}_c AS (SELECT min(t) - {max(GAP, window)} AS boundary FROM (SELECT max(ts_ps) AS t FROM hits, span WHERE (ts_ps - lo) // step < {pieces} GROUP BY board, ch // 2)),
    {name} AS (SELECT CASE WHEN c.boundary > p.done THEN least(coalesce((SELECT min(t0) FROM {name}_b WHERE t1 + {window} >= c.boundary), c.boundary), c.boundary) ELSE p.done END AS done FROM {name}_c c, {before} p)"""


_LIVE_SQL = f"""{HITS_SQL}, span AS (SELECT min(ts_ps) AS lo, (max(ts_ps) - min(ts_ps)) // {BATCHES} + 1 AS step FROM hits),
    d_start AS (SELECT min(ts_ps) AS done FROM hits), {_done_sql("d1", "d_start", 1, GAP)}, {_done_sql("d2", "d1", 2, GAP)}, {_done_sql("d3", "d2", 3, WIDER)}"""


@C.query(
    "live_cleared",
    f"""WITH {_LIVE_SQL}, m AS (SELECT hits.*, CASE WHEN ts_ps - lag(ts_ps) OVER (ORDER BY ts_ps, pos) <= {WIDER} THEN 0 ELSE 1 END AS fr FROM hits, d2 WHERE ts_ps >= d2.done),
    b AS (SELECT *, sum(fr) OVER (ORDER BY ts_ps, pos) AS bid FROM m) SELECT min(ts_ps) AS bunch_t0, count(*) AS multi, CAST(sum(qlong) AS BIGINT) AS q FROM b GROUP BY bid""",
)
def live_cleared(spark, sf):
    """A wider window before the third piece: only what is given out from then on is shown, in bunches of the new window."""
    run = follow(spark, sf, controls={2: {"window": WIDER}})
    return run.bunched_hits().groupBy("bunch_t0").agg(F.count(F.lit(1)).alias("multi"), F.sum("qlong").alias("q"))


@C.query(
    "live_reference",
    f"""WITH {_LIVE_SQL}, h AS (SELECT hits.* FROM hits, d3 WHERE ts_ps >= d3.done),
    p AS (SELECT h.slot, floor((h.ts_ps - r.ts_ps + {DT_WIDTH}) * {DT_BINS} / {2 * DT_WIDTH}.0) AS b FROM h JOIN h r ON r.slot = {REFERENCE} AND abs(h.ts_ps - r.ts_ps) <= {DT_WIDTH} AND h.pos <> r.pos)
    SELECT CAST(slot AS INT) AS slot, CAST(b AS INT) AS bin, count(*) AS n FROM p WHERE b < {DT_BINS} GROUP BY slot, b""",
)
def live_reference(spark, sf):
    """Times to a reference that is changed twice: before the third piece, with the window, and again before the fourth."""
    run = follow(spark, sf, controls={2: {"window": WIDER, "reference": 3}, 3: {"reference": REFERENCE}})
    return run.times_to_reference()
