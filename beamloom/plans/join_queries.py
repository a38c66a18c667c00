"""Joins of hits with dimensions and references, channels inside events, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamloom.operators import hist as Hi
from beamloom.operators import joins as J
from beamloom.operators import physics as P
from beamloom.plans.adapters import EVENTS_SQL, HITS_SQL, US_PER_S, as_events, as_hits, read
from beamloom.plans.catalogue import Catalogue

C = Catalogue()
REF = 5
DT = 60 * US_PER_S
PERIOD = 1000 * US_PER_S
CUTS = {
    "low": [(2.0, 2000.0), (20.0, 3000.0), (18.0, 30000.0), (5.0, 9000.0)],
    "band": [(10.0, 10000.0), (48.0, 50000.0), (48.0, 90000.0), (12.0, 25000.0)],
    "bow": [(25.0, 20000.0), (45.0, 80000.0), (45.0, 20000.0), (25.0, 80000.0)],
}
# cabling of the hit stream, from suppliers: plane by serial, every seventh supplier key leaves its channel open
CAB_SQL = """cab AS (SELECT CAST(1000 + (s_suppkey % 48) // 16 AS INT) AS serial, CAST(s_suppkey % 16 AS INT) AS ch, min(s_suppkey) AS k FROM supplier GROUP BY ALL),
cabling AS (SELECT serial, ch, CASE WHEN k % 48 = 5 THEN 'veto' WHEN k % 48 = 6 THEN 'cherenkov' ELSE 'trk' END AS kind,
  CASE WHEN k % 48 IN (5, 6) THEN -1 ELSE serial - 1000 END AS plane, ch + 1 AS plane_ch FROM (SELECT CASE WHEN k % 7 <> 3 THEN serial END AS serial, ch, k FROM cab))"""


def cabling(spark, sf):
    k = F.col("s_suppkey")
    c = read(spark, sf, "supplier").groupBy(F.expr("cast(1000 + (s_suppkey % 48) div 16 as int)").alias("serial"), (k % 16).cast("int").alias("channel")).agg(F.min(k).alias("k"))
    kind = F.when(F.col("k") % 48 == 5, "veto").when(F.col("k") % 48 == 6, "cherenkov").otherwise("trk")
    # an open channel keeps its row, on no board
    return c.withColumn("serial", F.when(F.expr("k % 7 <> 3"), F.col("serial"))).select(
        "serial", "channel", kind.alias("kind"), F.when(kind == "trk", F.col("serial") - 1000).otherwise(-1).alias("plane"), (F.col("channel") + 1).alias("ch")
    )


def cuts_table(spark):
    rows = [
        F.struct(F.lit(k).alias("cut"), F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in v]).alias("points"))
        for k, v in CUTS.items()
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _inside_sql(x: str, y: str) -> str:
    """CASE text giving the parity of crossings for each cut."""
    arms = []
    for name, pts in CUTS.items():
        terms = []
        for i, (x1, y1) in enumerate(pts):
            x2, y2 = pts[(i + 1) % len(pts)]
            terms.append(f"CASE WHEN ({y1}::DOUBLE > {y}) <> ({y2}::DOUBLE > {y}) AND {x} < {x1}::DOUBLE + (({y} - {y1}::DOUBLE) * ({x2}::DOUBLE - {x1}::DOUBLE)) / ({y2}::DOUBLE - {y1}::DOUBLE) THEN 1 ELSE 0 END")
        arms.append(f"SELECT *, '{name}' AS cut FROM evs WHERE ({' + '.join(terms)}) % 2 = 1")
    return " UNION ALL ".join(arms)


@C.query(
    "cabled_occupancy",
    f"WITH {HITS_SQL}, {CAB_SQL} SELECT kind, CAST(plane AS INT) AS plane, CAST(plane_ch AS INT) AS plane_ch, count(*) AS n FROM hits LEFT JOIN cabling USING (serial, ch) GROUP BY ALL",
)
def cabled_occupancy(spark, sf):
    from beamloom.operators.finder import occupancy

    return occupancy(J.with_cabling(as_hits(spark, sf), cabling(spark, sf)))


@C.query(
    "offset_times",
    f"""WITH {HITS_SQL}, o AS (SELECT CAST(1000 + (s_suppkey % 48) // 16 AS INT) AS serial, CAST(s_suppkey % 16 AS INT) AS ch, max(s_acctbal) AS ns FROM supplier GROUP BY ALL)
    SELECT pos, ts_ps - coalesce(CAST(round_even(ns * 1000, 0) AS BIGINT), 0) AS ts_ps FROM hits LEFT JOIN o USING (serial, ch)""",
)
def offset_times(spark, sf):
    o = read(spark, sf, "supplier").groupBy(F.expr("cast(1000 + (s_suppkey % 48) div 16 as int)").alias("serial"), F.expr("cast(s_suppkey % 16 as int)").alias("channel")).agg(F.max("s_acctbal").alias("offset_ns"))
    return J.subtract_offsets(as_hits(spark, sf), o).select("pos", "ts_ps")


@C.query(
    "calibrated_light",
    f"""WITH {HITS_SQL}, g AS (SELECT CAST(1000 + (s_suppkey % 48) // 16 AS INT) AS serial, CAST(s_suppkey % 16 AS INT) AS ch, max(s_acctbal) / 1e6 AS g FROM supplier GROUP BY ALL)
    SELECT pos, round(qlong * g, 9) AS light FROM hits JOIN g USING (serial, ch) WHERE qlong * g >= 0.1""",
)
def calibrated_light(spark, sf):
    g = read(spark, sf, "supplier").groupBy(F.expr("cast(1000 + (s_suppkey % 48) div 16 as int)").alias("serial"), F.expr("cast(s_suppkey % 16 as int)").alias("channel")).agg((F.max("s_acctbal") / F.lit(1e6)).alias("mevee_per_count"))
    return J.calibrated(as_hits(spark, sf), g, 0.1).select("pos", F.round("light", 9).alias("light"))


@C.query(
    "strip_remap",
    f"""WITH {HITS_SQL}, m AS (SELECT CAST(1000 + (s_suppkey % 48) // 16 AS INT) AS serial, CAST(s_suppkey % 16 AS INT) AS ch, max(s_nationkey) - 2 AS strip FROM supplier GROUP BY ALL)
    SELECT strip, count(*) AS n, round(sum(qlong * (1 + strip / 100.0::DOUBLE)), 4) AS energy FROM hits JOIN m USING (serial, ch) WHERE strip >= 0 GROUP BY strip""",
)
def strip_remap(spark, sf):
    m = read(spark, sf, "supplier").groupBy(F.expr("cast(1000 + (s_suppkey % 48) div 16 as int)").alias("serial"), F.expr("cast(s_suppkey % 16 as int)").alias("ch")).agg((F.max("s_nationkey") - 2).alias("strip"))
    r = J.remapped(as_hits(spark, sf), m.withColumn("corr", 1 + F.col("strip") / 100.0))
    return r.groupBy("strip").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("energy"), 4).alias("energy"))


@C.query(
    "dt_reference",
    f"""WITH {HITS_SQL}, p AS (SELECT a.slot, CAST((a.ts_ps - r.ts_ps + {DT}) * 240 // (2 * {DT}) AS INT) AS bin FROM hits a JOIN hits r
      ON r.slot = {REF} AND a.run = r.run AND a.ts_ps BETWEEN r.ts_ps - {DT} AND r.ts_ps + {DT} AND NOT (a.slot = {REF} AND a.pos = r.pos))
    SELECT slot, bin, count(*) AS n FROM p WHERE bin < 240 GROUP BY ALL""",
)
def dt_reference(spark, sf):
    return J.time_to_reference(as_hits(spark, sf), REF, DT, 240)


PHASE_SQL = f"""{HITS_SQL}, rf0 AS (SELECT run, ts_ps AS t, lag(ts_ps) OVER (PARTITION BY run ORDER BY ts_ps, pos) AS p FROM hits WHERE slot = {REF}),
rf AS (SELECT run, t, lead(t) OVER (PARTITION BY run ORDER BY t) AS nx FROM rf0 WHERE p IS NULL OR t - p > {PERIOD} / 2.0),
ends AS (SELECT run, min(t) AS f0, min(nx) AS f1, max(t) AS l0, max(nx) AS l1 FROM rf WHERE nx IS NOT NULL GROUP BY run),
ats AS (SELECT h.*, r.t AS ta, r.nx AS tb FROM hits h ASOF LEFT JOIN rf r ON h.run = r.run AND h.ts_ps >= r.t WHERE h.slot <> {REF}),
ab AS (SELECT ats.*, CASE WHEN ta IS NULL THEN f0 WHEN tb IS NULL THEN l0 ELSE ta END AS a, CASE WHEN ta IS NULL THEN f1 WHEN tb IS NULL THEN l1 ELSE tb END AS b FROM ats LEFT JOIN ends USING (run)),
ph AS (SELECT run, slot, board, qlong, pos, (ts_ps - a)::DOUBLE / ((b - a)::DOUBLE / round_even((b - a)::DOUBLE / {PERIOD}.0::DOUBLE, 0)) AS turns FROM ab)"""


@C.query("rf_phase", f"WITH {PHASE_SQL} SELECT pos, round(turns - floor(turns), 6) AS phase FROM ph")
def rf_phase(spark, sf):
    return J.rf_phase(as_hits(spark, sf), REF, PERIOD).select("pos", F.round("phase", 6).alias("phase"))


@C.query(
    "rf_map",
    f"""WITH {PHASE_SQL} SELECT board AS plane, CASE WHEN turns IS NOT NULL THEN CAST(least(floor((turns - floor(turns)) * 50), 49) AS INT) END AS tof_bin,
    CASE WHEN turns IS NOT NULL THEN CAST(least(qlong * 64 // 65536, 63) AS INT) END AS q_bin, count(*) AS n FROM ph GROUP BY ALL""",
)
def rf_map(spark, sf):
    h = J.rf_phase(as_hits(spark, sf), REF, PERIOD)
    known = F.col("phase").isNotNull()
    tof = F.least(F.floor(F.col("phase") * 50), F.lit(49)).cast("int")
    q = F.least(F.expr("cast(cast(qlong as long) * 64 div 65536 as int)"), F.lit(63))
    # least() leaves nulls out: without a phase there is no bin either
    return h.groupBy(F.col("board").alias("plane"), F.when(known, tof).alias("tof_bin"), F.when(known, q).alias("q_bin")).agg(F.count(F.lit(1)).alias("n"))


@C.query("in_cut", f"WITH {EVENTS_SQL} SELECT ev, pos, cut FROM ({_inside_sql('e', 'e2')})")
def in_cut(spark, sf):
    return J.in_cuts(as_events(spark, sf), cuts_table(spark), "e", "e2").select("ev", "pos", "cut")


@C.query(
    "cut_rates",
    f"WITH {EVENTS_SQL} SELECT cut, count(*) AS n, round(count(*) / ((max(t) - min(t)) / 1e6), 12) AS rate FROM ({_inside_sql('e', 'e2')}) GROUP BY cut",
)
def cut_rates(spark, sf):
    r = P.cut_rates(J.in_cuts(as_events(spark, sf), cuts_table(spark), "e", "e2"), "t", 1e6)
    return r.withColumn("rate", F.round("rate", 12))


@C.query(
    "channel_pairs",
    f"""WITH {EVENTS_SQL} SELECT ev, arg_max(e, pos) FILTER (ch = 1) AS e_x, arg_max(e2, pos) FILTER (ch = 1) AS t_x,
    arg_max(e, pos) FILTER (ch = 2) AS e_y, arg_max(e2, pos) FILTER (ch = 2) AS t_y FROM evs WHERE ch IN (1, 2) GROUP BY ev""",
)
def channel_pairs(spark, sf):
    return J.channel_pivot(as_events(spark, sf), "ev", {"x": 1, "y": 2}, {"e": "e", "t": "e2"})


@C.query(
    "pair_map",
    f"""WITH {EVENTS_SQL}, p AS (SELECT ev, arg_max(e, pos) FILTER (ch = 1) AS x, arg_max(e2, pos) FILTER (ch = 2) AS y FROM evs WHERE ch IN (1, 2) GROUP BY ev),
    c AS (SELECT CASE WHEN x < 0 THEN -1 WHEN x >= 50 THEN 1 ELSE 0 END AS side_x, CASE WHEN y < 0 THEN -1 WHEN y >= 100000 THEN 1 ELSE 0 END AS side_y, x, y FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
    SELECT side_x, side_y, CASE WHEN side_x = 0 AND side_y = 0 THEN CAST(floor(x * 25 / 50) AS INT) END AS bx,
    CASE WHEN side_x = 0 AND side_y = 0 THEN CAST(floor(y * 25 / 100000) AS INT) END AS by, count(*) AS n FROM c GROUP BY ALL""",
)
def pair_map(spark, sf):
    p = J.channel_pivot(as_events(spark, sf).withColumnRenamed("t", "time"), "ev", {"x": 1, "y": 2}, {"e": "e", "f": "e2"})
    return Hi.hist2d(p, F.col("e_x"), (0.0, 50.0, 25), F.col("f_y"), (0.0, 100000.0, 25))


@C.query(
    "gated_spectrum",
    f"""WITH {EVENTS_SQL}, g AS (SELECT ev, pos FROM ({_inside_sql('e', 'e2')}) WHERE cut = 'band')
    SELECT CAST(floor(e) AS INT) AS bin, count(*) AS n, count(g.pos) AS n_gated FROM evs LEFT JOIN g USING (ev, pos) GROUP BY 1""",
)
def gated_spectrum(spark, sf):
    from beamloom.functions.polygon import in_polygon

    e = as_events(spark, sf)
    inside = in_polygon(F.col("e"), F.col("e2"), CUTS["band"])
    return e.groupBy(F.floor("e").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_gated"))


@C.query(
    "coin_matrix",
    f"WITH {EVENTS_SQL} SELECT a.ch AS ch_x, b.ch AS ch_y, count(*) AS n FROM evs a JOIN evs b ON a.ev = b.ev AND a.pos < b.pos GROUP BY ALL",
)
def coin_matrix(spark, sf):
    return J.coincidence_matrix(as_events(spark, sf), "ev", "pos")


@C.query(
    "pid_map",
    f"""WITH {EVENTS_SQL}, p AS (SELECT ev, arg_max(e, pos) FILTER (ch = 3) / 4 AS de, arg_max(e, pos) FILTER (ch = 4) AS e, arg_max(t, pos) FILTER (ch = 4) - arg_max(t, pos) FILTER (ch = 3) AS tof
      FROM evs WHERE ch IN (3, 4) GROUP BY ev) SELECT ev, de, e, de + e AS total, tof FROM p""",
)
def pid_map(spark, sf):
    return P.pid_columns(as_events(spark, sf), "ev", 3, 4, de_factor=0.25)


@C.query(
    "compare_shapes",
    f"""WITH {EVENTS_SQL}, a AS (SELECT ch, floor(e) AS bin, count(*) AS n FROM evs WHERE supp % 2 = 0 GROUP BY ALL), b AS (SELECT ch, floor(e) AS bin, count(*) AS n FROM evs WHERE supp % 2 = 1 GROUP BY ALL),
    sa AS (SELECT ch, bin, n / sum(n) OVER (PARTITION BY ch) AS share FROM a), sb AS (SELECT ch, bin, n / sum(n) OVER (PARTITION BY ch) AS share FROM b)
    SELECT ch, round(sum(least(coalesce(sa.share, 0), coalesce(sb.share, 0))), 9) AS overlap FROM sa FULL JOIN sb USING (ch, bin) GROUP BY ch""",
)
def compare_shapes(spark, sf):
    def share(df):
        n = df.groupBy("ch", F.floor("e").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        tot = n.groupBy("ch").agg(F.sum("n").alias("_t"))
        return n.join(tot, "ch").select("ch", "bin", (F.col("n") / F.col("_t")).alias("share"))

    e = as_events(spark, sf)
    o = Hi.shape_overlap(share(e.filter("supp % 2 = 0")), share(e.filter("supp % 2 = 1")), ["ch"], ["bin"])
    return o.withColumn("overlap", F.round("overlap", 9))


@C.query(
    "beam_expectation",
    f"""WITH {EVENTS_SQL}, l AS (SELECT floor(e) AS bin, count(*) AS n FROM evs GROUP BY ALL),
    x AS (SELECT floor(l_discount * 500) AS bin, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_e FROM lineitem GROUP BY ALL)
    SELECT CAST(bin AS BIGINT) AS bin, coalesce(l.n, 0) AS live, round(coalesce(greatest(x.n - 0.9::DOUBLE * x.n_e, 0), 0), 6) AS expected FROM l FULL JOIN x USING (bin)""",
)
def beam_expectation(spark, sf):
    live = as_events(spark, sf).groupBy(F.floor("e").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    x = read(spark, sf, "lineitem").groupBy(F.floor(F.col("l_discount") * 500).alias("bin")).agg(F.count(F.lit(1)).alias("n0"), F.count_if(F.col("l_returnflag") == "R").alias("ne"))
    exp = x.select("bin", F.greatest(F.col("n0") - F.lit(0.9) * F.col("ne"), F.lit(0.0)).alias("n"))
    c = J.compare_full(live, exp, ["bin"])
    return c.select("bin", "live", F.round("expected", 6).alias("expected"))


@C.query(
    "aggregate_slices",
    """WITH o AS (SELECT o_custkey AS run, min(epoch_us(o_orderdate)) AS a, max(epoch_us(o_orderdate)) AS b FROM orders GROUP BY 1),
    s AS (SELECT run, unnest(range(a // 2592000000000, b // 2592000000000 + 1)) AS s FROM o) SELECT s * 2592000000000 AS slice, count(*) AS n FROM s GROUP BY s""",
)
def aggregate_slices(spark, sf):
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.min(t).alias("t_first"), F.max(t).alias("t_last"))
    return J.overlapping(o, 30 * 86_400 * US_PER_S).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "unconfigured_boards",
    "SELECT 'missing' AS state, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'open', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)
def unconfigured_boards(spark, sf):
    c = read(spark, sf, "customer")
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    a = c.join(o, "c_custkey", "left_anti").agg(F.lit("missing").alias("state"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(c.join(o, "c_custkey", "left_semi").agg(F.lit("open").alias("state"), F.count(F.lit(1)).alias("n")))


@C.query(
    "run_records",
    "SELECT l_orderkey, count(*) AS files, any_value(o_orderpriority) AS comment FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
)
def run_records(spark, sf):
    l = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("comment"))
    return l.join(o, "l_orderkey", "left")


@C.query(
    "spectrometer",
    f"""WITH {EVENTS_SQL}, w AS (SELECT ev, CAST(floor(e2) AS BIGINT) AS t, e, pos, ch FROM evs),
    p AS (SELECT ev, arg_max(e, pos) FILTER (ch = 1) AS sr, arg_max(e, pos) FILTER (ch = 2) AS sl, arg_max(t, pos) FILTER (ch = 3) AS fr, arg_max(t, pos) FILTER (ch = 4) AS fl,
      arg_max(t, pos) FILTER (ch = 5) AS br, arg_max(t, pos) FILTER (ch = 6) AS bl FROM w WHERE ch <= 6 GROUP BY ev),
    x AS (SELECT ev, CASE WHEN sr > 0 AND sl > 0 THEN (sr + sl) / 2 WHEN sr > 0 THEN sr WHEN sl > 0 THEN sl ELSE -1 END AS s_avg,
      CASE WHEN fl > 0 AND fr > 0 AND fl <> fr THEN (fl - fr)::DOUBLE / 2 / 2.1::DOUBLE END AS x1, CASE WHEN bl > 0 AND br > 0 AND bl <> br THEN (bl - br)::DOUBLE / 2 / 1.98::DOUBLE END AS x2 FROM p)
    SELECT ev, s_avg, round(x1, 6) AS x1, round(x2, 6) AS x2, round(CASE WHEN x2 > x1 THEN atan((x2 - x1) / 36) WHEN x2 < x1 THEN pi() + atan((x2 - x1) / 36) WHEN x1 = x2 THEN pi() / 2 END, 9) AS theta,
    round(0.5 * x1 + 0.5 * x2, 6) AS x_avg FROM x""",
)
def spectrometer(spark, sf):
    h = as_events(spark, sf).withColumn("t_ns", F.floor("e2").cast("long"))
    p = P.spectrometer(h, "ev", 0.0, 2.0, {"SR": 1, "SL": 2, "FR": 3, "FL": 4, "BR": 5, "BL": 6})
    return p.select("ev", "s_avg", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"), F.round("theta", 9).alias("theta"), F.round("x_avg", 6).alias("x_avg"))
