"""The track finder over all bunches of the hit stream.

Cabling comes from ``supplier``, the momentum map from ``customer`` (triplet and momentum from key and balance),
so both grow with the tables up to the number of channels there are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from beamloom.operators import events as E
from beamloom.operators import finder as Fi
from beamloom.operators import joins as J
from beamloom.plans.adapters import HITS_SQL, as_hits, read
from beamloom.plans.catalogue import Catalogue
from beamloom.plans.join_queries import CAB_SQL, cabling
from beamloom.session import cut

C = Catalogue()
GAP = 600_000_000
SETTINGS = Fi.Settings(ns_per_unit=1e-8)
LIGHT_P = [float(p) for p in range(20, 1501, 10)]
LIGHT_Q = [2.0 + 240.0 / p for p in LIGHT_P]

BUNCH_SQL = f"""{HITS_SQL}, {CAB_SQL}, m AS (SELECT *, CASE WHEN ts_ps - lag(ts_ps) OVER (PARTITION BY run ORDER BY ts_ps, pos) <= {GAP} THEN 0 ELSE 1 END AS fr FROM hits),
n AS (SELECT *, sum(fr) OVER (PARTITION BY run ORDER BY ts_ps, pos) AS bid FROM m),
bh AS (SELECT n.run, min(ts_ps) OVER (PARTITION BY n.run, bid) AS bunch_t0, ts_ps, kind, CAST(plane AS INT) AS plane, CAST(plane_ch AS INT) AS ch, qlong / 4096.0::DOUBLE AS light FROM n LEFT JOIN cabling USING (serial, ch)),
fired AS (SELECT run, bunch_t0, plane, ch, light, (ts_ps - bunch_t0) * 1e-8 AS t FROM bh WHERE kind = 'trk' AND light >= 0.1),
cf AS (SELECT *, CASE WHEN ch - lag(ch) OVER w = 1 THEN 0 ELSE 1 END AS nw FROM fired WINDOW w AS (PARTITION BY run, bunch_t0, plane ORDER BY ch, light, t)),
cl AS (SELECT *, sum(nw) OVER (PARTITION BY run, bunch_t0, plane ORDER BY ch, light, t ROWS UNBOUNDED PRECEDING) AS cl FROM cf),
cs AS (SELECT run, bunch_t0, plane, cl, count(*) AS n, min(ch) AS c0, sum(light) AS q FROM cl GROUP BY ALL)"""


def bunch_hits(spark, sf):
    b = E.gap_bunches(as_hits(spark, sf).select("run", "serial", "ch", "slot", "ts_ps", "pos", "qlong"), GAP)
    light = F.col("qlong") / F.lit(4096.0)
    return J.with_cabling(b, cabling(spark, sf)).select("run", "bunch_t0", "ts_ps", "kind", "plane", "plane_ch", F.when(light >= 0.1, light).alias("light"))


def momentum_map(spark, sf):
    k = F.col("c_custkey")
    rows = read(spark, sf, "customer").groupBy(
        (k % 16 + 1).cast("int").alias("ch0"), F.expr("cast((c_custkey div 16) % 16 + 1 as int)").alias("ch1"), F.expr("cast((c_custkey div 256) % 16 + 1 as int)").alias("ch2")
    ).agg((100.0 + F.max("c_acctbal") / 20.0).alias("p_mev"), F.lit(6.0).alias("sigma_mev"), F.count(F.lit(1)).cast("int").alias("n_cal"))
    return Fi.map_with_expectations(rows, LIGHT_P, LIGHT_Q, SETTINGS)


def gang(spark):
    c = spark.range(48).select(F.expr("cast(id div 16 as int)").alias("plane"), F.expr("cast(id % 16 + 1 as int)").alias("ch"))
    return c.withColumn("gang_width", F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(8)), F.col("ch") % 4 + 1))


def found(spark, sf):
    return Fi.find_tracks(bunch_hits(spark, sf), momentum_map(spark, sf), gang(spark), SETTINGS, installed=("veto", "cherenkov"))


@C.query("clusters", f"WITH {BUNCH_SQL} SELECT run, bunch_t0, plane, CAST(cl AS BIGINT) AS cl, n, c0, round(q, 6) AS q FROM cs")
def clusters(spark, sf):
    c = Fi.clusters(_fired(spark, sf))
    q = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x["light"])
    return c.select("run", "bunch_t0", "plane", F.col("cl").cast("long").alias("cl"), F.size("hits").cast("long").alias("n"), F.get("hits", F.lit(0))["ch"].alias("c0"), F.round(q, 6).alias("q"))


def _fired(spark, sf):
    b = bunch_hits(spark, sf).filter((F.col("kind") == "trk") & F.col("light").isNotNull())
    t = (F.col("ts_ps") - F.col("bunch_t0")) * SETTINGS.ns_per_unit
    return b.select("run", "bunch_t0", "plane", F.col("plane_ch").alias("ch"), "light", t.alias("t"))


@C.query(
    "cluster_readings",
    f"""WITH {BUNCH_SQL} SELECT run, bunch_t0, plane, CAST(sum(CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 3 ELSE 2 * n - 1 END) AS BIGINT) AS n FROM cs GROUP BY run, bunch_t0, plane""",
)
def cluster_readings(spark, sf):
    r = Fi.readings(Fi.clusters(_fired(spark, sf)), SETTINGS)
    return r.groupBy("run", "bunch_t0", "plane").agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "incomplete_bunches",
    f"""WITH {BUNCH_SQL}, b AS (SELECT run, bunch_t0, count(*) AS n_hits, count(*) FILTER (kind IS NULL) AS n_uncabled, bool_or(coalesce(kind = 'veto', false)) AS veto FROM bh GROUP BY ALL),
    p AS (SELECT run, bunch_t0, count(DISTINCT plane) AS planes FROM fired GROUP BY ALL)
    SELECT b.*, coalesce(planes, 0) < 3 AS incomplete FROM b LEFT JOIN p USING (run, bunch_t0)""",
)
def incomplete_bunches(spark, sf):
    d, _ = found(spark, sf)
    return d.select("run", "bunch_t0", "n_hits", "n_uncabled", "veto", (F.col("status") == "incomplete").alias("incomplete"))


@C.query("finder_statuses")
def finder_statuses(spark, sf):
    return Fi.status_counts(found(spark, sf)[0])


@C.query("finder_tracks")
def finder_tracks(spark, sf):
    return found(spark, sf)[1]


@C.query("finder_histograms")
def finder_histograms(spark, sf):
    d, t = found(spark, sf)
    return Fi.finder_histograms(d, t, Fi.clusters(_fired(spark, sf)))


@C.query("top_triplets")
def top_triplets(spark, sf):
    return Fi.top_triplets(found(spark, sf)[1])


@C.query("track_geometry")
def track_geometry(spark, sf):
    span = gang(spark).withColumns({"a_lo_mm": F.col("ch") * 5.0 - 20.0, "a_hi_mm": F.col("ch") * 5.0 - 13.0})
    return Fi.track_geometry(found(spark, sf)[1], span)


@C.query(
    "momentum_lookup",
    """WITH c AS (SELECT c_custkey % 16 + 1 AS ch0, (c_custkey // 16) % 16 + 1 AS ch1, (c_custkey // 256) % 16 + 1 AS ch2, 100 + max(c_acctbal) / 20 AS p FROM customer GROUP BY 1, 2, 3),
    g AS (SELECT *, greatest(least(p, 1500), 20) AS pc FROM c), s AS (SELECT *, floor((pc - 20) / 10) * 10 + 20 AS a FROM g)
    SELECT CAST(ch0 AS INT) AS ch0, CAST(ch1 AS INT) AS ch1, CAST(ch2 AS INT) AS ch2, round(2 + 240 / a + (pc - a) / 10 * (240 / (a + 10) - 240 / a), 6) AS light,
    round((2345.7 - 517.7)::DOUBLE / (p / sqrt(p * p + 139.57::DOUBLE * 139.57::DOUBLE) * 299.792458::DOUBLE), 6) AS dt01 FROM s""",
)
def momentum_lookup(spark, sf):
    return momentum_map(spark, sf).select("ch0", "ch1", "ch2", F.round("one_light", 6).alias("light"), F.round("dt01", 6).alias("dt01"))


CANDIDATE_SQL = f"""{BUNCH_SQL},
h AS (SELECT *, row_number() OVER (PARTITION BY run, bunch_t0, plane, cl ORDER BY ch, light, t) AS i, count(*) OVER (PARTITION BY run, bunch_t0, plane, cl) AS n,
  sum(light) OVER (PARTITION BY run, bunch_t0, plane, cl) AS q, CASE ch % 4 WHEN 0 THEN 1.25::DOUBLE WHEN 1 THEN 1.7857::DOUBLE WHEN 2 THEN 2.8571::DOUBLE ELSE 5.0::DOUBLE END AS sg FROM cl),
pr AS (SELECT a.run, a.bunch_t0, a.plane, CASE WHEN b.light > a.light THEN b.ch ELSE a.ch END AS code, a.light + b.light AS light, (a.t + b.t) / 2 AS t, greatest(a.sg, b.sg) / sqrt(2::DOUBLE) AS sg,
  CASE WHEN a.n = 2 THEN 'one' ELSE 'sub' END AS kind, a.q AS pq FROM h a JOIN h b ON a.run = b.run AND a.bunch_t0 = b.bunch_t0 AND a.plane = b.plane AND a.cl = b.cl AND b.i = a.i + 1),
r AS (SELECT run, bunch_t0, plane, ch AS code, light, t, sg, CASE n WHEN 1 THEN 'one' WHEN 2 THEN 'split' ELSE 'sub' END AS kind, q AS pq FROM h UNION ALL SELECT * FROM pr),
sz AS (SELECT run, bunch_t0, count(*) FILTER (plane = 0) * count(*) FILTER (plane = 1) * count(*) FILTER (plane = 2) AS combos FROM r GROUP BY ALL),
mp AS (SELECT c_custkey % 16 + 1 AS ch0, (c_custkey // 16) % 16 + 1 AS ch1, (c_custkey // 256) % 16 + 1 AS ch2, 100 + max(c_acctbal) / 20 AS p FROM customer GROUP BY 1, 2, 3),
mg AS (SELECT *, floor((greatest(least(p, 1500), 20) - 20) / 10) * 10 + 20 AS a, greatest(least(p, 1500), 20) AS pc, p / sqrt(p * p + 139.57::DOUBLE * 139.57::DOUBLE) * 299.792458::DOUBLE AS v FROM mp),
mx AS (SELECT *, 2 + 240 / a + (pc - a) / 10 * (240 / (a + 10) - 240 / a) AS one, (2345.7 - 517.7)::DOUBLE / v AS d01, (2895.7 - 2345.7)::DOUBLE / v AS d12 FROM mg),
cd AS (SELECT DISTINCT x.run, x.bunch_t0, ch0, ch1, ch2, p FROM r x JOIN r y ON x.run = y.run AND x.bunch_t0 = y.bunch_t0 AND x.plane = 0 AND y.plane = 1 JOIN r z ON x.run = z.run AND x.bunch_t0 = z.bunch_t0 AND z.plane = 2
  JOIN mx ON x.code = ch0 AND y.code = ch1 AND z.code = ch2 JOIN sz ON sz.run = x.run AND sz.bunch_t0 = x.bunch_t0
  WHERE combos BETWEEN 1 AND 4096 AND abs(y.t - x.t - d01) <= 3 * sqrt(x.sg * x.sg + y.sg * y.sg) AND abs(z.t - y.t - d12) <= 3 * sqrt(y.sg * y.sg + z.sg * z.sg)
  AND (x.kind <> 'split' OR x.pq / one > 1.4::DOUBLE) AND (y.kind <> 'split' OR y.pq / one > 1.4::DOUBLE) AND (z.kind <> 'split' OR z.pq / one > 1.4::DOUBLE))"""


@C.query("finder_candidates", f"WITH {CANDIDATE_SQL} SELECT run, bunch_t0, CAST(ch0 AS INT) AS code0, CAST(ch1 AS INT) AS code1, CAST(ch2 AS INT) AS code2, round(p, 6) AS p FROM cd")
def finder_candidates(spark, sf):
    rd = Fi.with_sigma(Fi.readings(Fi.clusters(_fired(spark, sf)), SETTINGS), gang(spark), SETTINGS)
    c = Fi.candidates(cut(rd, "readings"), momentum_map(spark, sf), SETTINGS)
    return c.select("run", "bunch_t0", "code0", "code1", "code2", F.round("p_mev", 6).alias("p"))


@C.query(
    "finder_decided",
    f"""WITH {CANDIDATE_SQL}, b AS (SELECT run, bunch_t0, count(*) AS n_hits FROM bh GROUP BY ALL), nc AS (SELECT run, bunch_t0, count(*) AS n_cand FROM cd GROUP BY ALL)
    SELECT CASE WHEN coalesce(combos, 0) = 0 THEN 'incomplete' WHEN combos > 4096 OR n_cand > 24 THEN 'dropped' WHEN n_cand IS NULL THEN 'none' ELSE 'candidates' END AS status, count(*) AS n, CAST(sum(n_hits) AS BIGINT) AS hits
    FROM b LEFT JOIN sz USING (run, bunch_t0) LEFT JOIN nc USING (run, bunch_t0) GROUP BY 1""",
)
def finder_decided(spark, sf):
    d, _ = found(spark, sf)
    status = F.when(F.col("status").isin("incomplete", "dropped", "none"), F.col("status")).otherwise("candidates")
    return d.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_hits").alias("hits"))
