"""Event building over the whole hit stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamloom.operators import events as E
from beamloom.operators.ordering import Ordered, plan_slices
from beamloom.plans.adapters import EVENTS_SQL, HITS_SQL, as_events, as_hits
from beamloom.plans.catalogue import Catalogue

C = Catalogue()
GAP = 300_000_000
WINDOW = 400_000_000

BUNCH_SQL = f"""{HITS_SQL}, marked AS (
  SELECT *, CASE WHEN ts_ps - lag(ts_ps) OVER (PARTITION BY run ORDER BY ts_ps, pos) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM hits),
bunched AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY ts_ps, pos) AS bunch_id FROM marked)"""

ANCHOR_SQL = """WITH RECURSIVE {hits}, t AS (SELECT DISTINCT run, ts_ps FROM hits),
nx AS MATERIALIZED (SELECT run, ts_ps, min(ts_ps) OVER (PARTITION BY run ORDER BY ts_ps RANGE BETWEEN {w} + 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nts FROM t),
anchors AS (SELECT run, min(ts_ps) AS ev_t0 FROM t GROUP BY run
  UNION ALL SELECT nx.run, nx.nts FROM anchors JOIN nx ON nx.run = anchors.run AND nx.ts_ps = anchors.ev_t0 WHERE nx.nts IS NOT NULL)"""


@C.query(
    "gap_bunches",
    f"""WITH {BUNCH_SQL} SELECT run, min(ts_ps) AS bunch_t0, max(ts_ps) AS t_last, count(*) AS multi, CAST(max(bunch_id) AS BIGINT) AS bunch_id
    FROM bunched GROUP BY run, bunch_id""",
)
def gap_bunches(spark, sf):
    return E.bunch_table(as_hits(spark, sf), GAP, numbered=True)


@C.query(
    "multiplicity",
    f"""WITH {BUNCH_SQL} SELECT multi, count(*) AS n FROM (SELECT run, bunch_id, count(*) AS multi FROM bunched GROUP BY ALL) GROUP BY multi""",
)
def multiplicity(spark, sf):
    return E.bunch_table(as_hits(spark, sf), GAP).groupBy("multi").agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "anchored_events",
    ANCHOR_SQL.format(hits=HITS_SQL, w=WINDOW)
    + f""" SELECT a.run, a.ev_t0, count(*) AS multi, max(h.ts_ps) AS t_last, CAST(sum(h.qlong) AS BIGINT) AS q
    FROM anchors a JOIN hits h ON h.run = a.run AND h.ts_ps BETWEEN a.ev_t0 AND a.ev_t0 + {WINDOW} GROUP BY a.run, a.ev_t0""",
)
def anchored_events(spark, sf):
    hits = as_hits(spark, sf).select("run", "ts_ps", "pos", "qlong")
    ev = E.anchored_events(hits, WINDOW)
    return ev.groupBy("run", "ev_t0").agg(F.count(F.lit(1)).alias("multi"), F.max("ts_ps").alias("t_last"), F.sum("qlong").alias("q"))


@C.query(
    "newest_events",
    f"""WITH RECURSIVE {HITS_SQL}, t AS (SELECT DISTINCT -ts_ps AS u FROM hits),
    nx AS MATERIALIZED (SELECT u, min(u) OVER (ORDER BY u RANGE BETWEEN {WINDOW} + 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nu FROM t),
    anchors AS (SELECT min(u) AS u, 1 AS k FROM t UNION ALL SELECT nu, k + 1 FROM anchors JOIN nx USING (u) WHERE nu IS NOT NULL AND k < 50)
    SELECT -a.u AS ev_t1, count(*) AS multi, min(h.ts_ps) AS t_first FROM anchors a
    JOIN hits h ON h.ts_ps BETWEEN -a.u - {WINDOW} AND -a.u GROUP BY a.u""",
)
def newest_events(spark, sf):
    ev = E.newest_events(as_hits(spark, sf).select("run", "ts_ps", "pos"), WINDOW, 50)
    return ev.groupBy("ev_t1").agg(F.count(F.lit(1)).alias("multi"), F.min("ts_ps").alias("t_first"))


@C.query("single_hit_events", f"WITH {HITS_SQL} SELECT run, pos, ts_ps, row_number() OVER (PARTITION BY run ORDER BY ts_ps, pos) - 1 AS ev_id FROM hits")
def single_hit_events(spark, sf):
    return E.no_grouping(as_hits(spark, sf).select("run", "ts_ps", "pos"))


@C.query(
    "event_table",
    f"""WITH {EVENTS_SQL} SELECT ev, count(*) AS multi, array_to_string(list(ch ORDER BY pos), ',') AS chs,
    array_to_string(list(CAST(e AS INT) ORDER BY pos), ',') AS es FROM evs GROUP BY ev""",
)
def event_table(spark, sf):
    ev = as_events(spark, sf).withColumn("ei", F.col("e").cast("int"))
    t = E.capped_event_table(ev, ["ev"], ["ch", "ei"], ["pos"])
    return t.select("ev", "multi", F.array_join(F.col("ch").cast("array<string>"), ",").alias("chs"), F.array_join(F.col("ei").cast("array<string>"), ",").alias("es"))


@C.query(
    "event_summary",
    f"WITH {BUNCH_SQL} SELECT run, count(*) AS events, CAST(sum(n) AS BIGINT) AS hits, max(n) AS largest, max(span) AS longest FROM "
    "(SELECT run, bunch_id, count(*) AS n, max(ts_ps) - min(ts_ps) AS span FROM bunched GROUP BY run, bunch_id) GROUP BY run",
)
def event_summary(spark, sf):
    s = E.event_summary(E.gap_bunches(as_hits(spark, sf), GAP), ["run", "bunch_t0"])
    return s.groupBy("run").agg(
        F.count(F.lit(1)).alias("events"), F.sum("multi").alias("hits"), F.max("multi").alias("largest"), F.max("span").alias("longest")
    )


@C.query(
    "counter_bits",
    f"""WITH {BUNCH_SQL} SELECT run, min(ts_ps) AS bunch_t0, bool_or(slot = 5) AS veto, bool_or(slot = 6) AS cherenkov,
    count(*) > 4 AS over FROM bunched GROUP BY run, bunch_id""",
)
def counter_bits(spark, sf):
    b = E.gap_bunches(as_hits(spark, sf), GAP)
    return b.groupBy("run", "bunch_t0").agg(
        F.bool_or(F.col("slot") == 5).alias("veto"), F.bool_or(F.col("slot") == 6).alias("cherenkov"), (F.count(F.lit(1)) > 4).alias("over")
    )


@C.query(
    "order_check",
    f"""WITH {EVENTS_SQL}, x AS (SELECT supp, pos, t, lag(t) OVER (PARTITION BY supp ORDER BY pos, t) - t AS back_by FROM (
      SELECT supp, l_orderkey AS pos, epoch_us(l_shipdate) AS t FROM (SELECT l_suppkey AS supp, l_orderkey, l_shipdate FROM lineitem)))
    SELECT supp, count(*) AS n, max(back_by) AS worst FROM x WHERE back_by > 0 GROUP BY supp""",
)
def order_check(spark, sf):
    x = as_events(spark, sf).select("supp", F.col("ev").alias("pos"), "t")
    late = E.order_check(x, ("supp",), "pos", "t")
    return late.groupBy("supp").agg(F.count(F.lit(1)).alias("n"), F.max("back_by").alias("worst"))


@C.query(
    "left_over_hits",
    f"""WITH {BUNCH_SQL}, m AS (SELECT run, bunch_id, max(ts_ps) AS last FROM bunched GROUP BY ALL),
    f AS (SELECT max(ts_ps) AS fr FROM hits)
    SELECT b.run, b.pos, b.ts_ps FROM bunched b JOIN m USING (run, bunch_id), f WHERE m.last + 3 * {GAP} >= f.fr - 2 * {GAP}""",
)
def left_over_hits(spark, sf):
    hits = as_hits(spark, sf)
    frontier = hits.agg(F.max("ts_ps")).first()[0] - 2 * GAP
    _, rest = E.closed_and_open(E.gap_bunches(hits, GAP), frontier, 3 * GAP)
    return rest.select("run", "pos", "ts_ps")


@C.query(
    "time_ordered_slots",
    f"""WITH {HITS_SQL} SELECT run, slot, count(*) AS n, CAST(sum(CASE WHEN d > 3600000000 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM (
      SELECT run, slot, ts_ps - lag(ts_ps) OVER (PARTITION BY run, slot ORDER BY ts_ps, pos) AS d FROM hits) GROUP BY run, slot""",
)
def time_ordered_slots(spark, sf):
    h = as_hits(spark, sf).select("run", "slot", "ts_ps", "pos")
    o = Ordered(h, plan_slices(h, ("run", "slot"))).prev_time("p").done()
    return o.groupBy("run", "slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts_ps") - F.col("p") > 3_600_000_000).alias("gaps"))
