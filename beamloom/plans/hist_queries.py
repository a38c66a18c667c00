"""Counts, spectra, rates and maps over the whole hit stream and the built events."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamloom.functions import binning as B
from beamloom.functions import hitcols as H
from beamloom.operators import hist as Hi
from beamloom.operators import physics as P
from beamloom.operators import rates as R
from beamloom.plans.adapters import EVENTS_SQL, HITS_SQL, US_PER_S, as_events, as_hits, read
from beamloom.plans.catalogue import Catalogue

C = Catalogue()
LOG_EDGES = B.q_edges(1, 65536, 60, True)
EDGE_SQL = "edges AS (SELECT unnest([" + ", ".join(map(str, LOG_EDGES[:-1])) + "]) AS a, unnest([" + ", ".join(map(str, LOG_EDGES[1:])) + "]) AS b, unnest(range(" + str(len(LOG_EDGES) - 1) + ")) AS bin)"
DAY = 86_400 * US_PER_S


@C.query(
    "counts_sets",
    f"""WITH {HITS_SQL} SELECT board, slot, count(*) AS n, count(*) FILTER (pur) AS n_pur, count(*) FILTER (flags & 8 <> 0) AS n_1024,
    count(*) FILTER (NOT pur) AS n_good FROM hits GROUP BY GROUPING SETS ((board, slot), (board), ())""",
)
def counts_sets(spark, sf):
    return Hi.counts_sets(as_hits(spark, sf))


@C.query("spectrum", f"WITH {HITS_SQL} SELECT slot, qlong, count(*) AS n FROM hits GROUP BY ALL")
def spectrum(spark, sf):
    return Hi.spectrum(as_hits(spark, sf))


@C.query(
    "rebin_log",
    f"WITH {HITS_SQL}, {EDGE_SQL} SELECT slot, CAST(bin AS INT) AS bin, count(*) AS n FROM hits JOIN edges ON qlong >= a AND qlong < b WHERE qlong > 0 AND qlong < 65535 GROUP BY ALL",
)
def rebin_log(spark, sf):
    return Hi.rebin(Hi.spectrum(as_hits(spark, sf)), LOG_EDGES)


@C.query("rebin_linear", f"WITH {HITS_SQL} SELECT slot, CAST(qlong // 656 AS INT) AS bin, count(*) AS n FROM hits WHERE qlong > 0 AND qlong < 65535 GROUP BY ALL")
def rebin_linear(spark, sf):
    return Hi.rebin(Hi.spectrum(as_hits(spark, sf)), B.q_edges(0, 65536, 100, False))


@C.query(
    "spectrum_outside",
    f"""WITH {HITS_SQL} SELECT slot, count(*) AS total, count(*) FILTER (qlong = 0) AS zero, count(*) FILTER (qlong = 65535) AS saturated,
    count(*) FILTER (qlong > 0 AND qlong < 65535 AND (qlong < 500 OR qlong >= 20000)) AS outside FROM hits GROUP BY slot""",
)
def spectrum_outside(spark, sf):
    return Hi.outside_totals(Hi.spectrum(as_hits(spark, sf)), 500, 20000)


@C.query(
    "psd_map",
    f"""WITH {HITS_SQL}, e AS (SELECT DISTINCT CAST(round(pow(10, i * log10(65535) / 1024)) AS BIGINT) AS a FROM range(1025) t(i)),
    ee AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS x FROM e)
    SELECT slot, CAST(x AS INT) AS x, CAST(least((qlong - qshort) * 100 // qlong, 99) AS INT) AS y, count(*) AS n
    FROM hits ASOF JOIN ee ON qlong >= a WHERE qlong > 0 AND qlong < 65535 AND qshort < 32767 AND qshort <= qlong GROUP BY ALL""",
)
def psd_map(spark, sf):
    return Hi.psd_map(as_hits(spark, sf))


@C.query(
    "psd_out",
    f"""WITH {HITS_SQL}, x AS (SELECT slot, qlong, CASE WHEN pur THEN qlong + 1 WHEN flags = 7 THEN 32767 ELSE qshort END AS qs FROM hits)
    SELECT slot, count(*) AS n FROM x WHERE qlong > 0 AND qlong < 65535 AND (qs >= 32767 OR qs > qlong) GROUP BY slot""",
)
def psd_out(spark, sf):
    qs = F.when(F.col("pur"), F.col("qlong") + 1).when(F.col("flags") == 7, 32767).otherwise(F.col("qshort"))
    return Hi.psd_out(as_hits(spark, sf).withColumn("qshort", qs))


@C.query(
    "since_previous",
    f"""WITH {HITS_SQL}, d AS (SELECT slot, (ts_ps - lag(ts_ps) OVER (PARTITION BY slot ORDER BY ts_ps, pos)) / 1000000.0 AS dt FROM hits)
    SELECT slot, CAST(floor(log10(dt) * 10) AS INT) AS bin, count(*) AS n FROM d WHERE dt >= 1 AND floor(log10(dt) * 10) < 90 GROUP BY ALL""",
)
def since_previous(spark, sf):
    return Hi.since_previous(as_hits(spark, sf), unit_per_ns=1_000_000.0)


@C.query("rate_seconds", f"WITH {HITS_SQL} SELECT run, slot, ts_ps // 1000000 AS sec, count(*) AS n FROM hits GROUP BY ALL")
def rate_seconds(spark, sf):
    return Hi.per_second(as_hits(spark, sf), unit=US_PER_S)


@C.query(
    "trigger_rates",
    f"""WITH {HITS_SQL}, n AS (SELECT run, slot, ts_ps // {DAY} AS interval, count(*) AS n, count(*) FILTER (NOT pur) AS n_good, max(ts_ps) AS t
      FROM hits GROUP BY ALL), d AS (SELECT *, (t - lag(t) OVER (PARTITION BY run, slot ORDER BY interval)) / 1e6 AS dt FROM n)
    SELECT run, slot, interval, n, n_good, round(n / dt, 9) AS trigger_rate, round(n_good / dt, 9) AS accepted_rate FROM d""",
)
def trigger_rates(spark, sf):
    r = R.interval_rates(as_hits(spark, sf), "slot", DAY, 1e6)
    return r.withColumns({c: F.round(c, 9) for c in ("trigger_rate", "accepted_rate")})


@C.query(
    "run_history",
    f"""WITH {HITS_SQL}, b AS (SELECT run, board, ts_ps // 600000000 AS k, count(*) AS n FROM hits GROUP BY ALL),
    t AS (SELECT run, k, sum(n) AS n FROM b GROUP BY ALL),
    i AS (SELECT *, coalesce(CAST(k - lag(k) OVER (PARTITION BY run ORDER BY k) > 6 AS INT), 0) AS nw FROM t),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY run ORDER BY k) AS g FROM i),
    s AS (SELECT run, g, sum(n) AS gn FROM g GROUP BY ALL), a AS (SELECT run, sum(n) AS alln FROM t GROUP BY run),
    f AS (SELECT s.run, s.g, gn < 0.001 * alln AS small FROM s JOIN a USING (run)),
    f2 AS (SELECT run, g, small AND bool_or(NOT small) OVER (PARTITION BY run) AS far FROM f),
    nr AS (SELECT b.run, b.board, b.k, b.n FROM b JOIN g USING (run, k) JOIN f2 ON f2.run = g.run AND f2.g = g.g WHERE NOT far),
    sp AS (SELECT run, min(k) AS k0, max(k) AS k1, greatest(1, CAST(ceil((max(k) - min(k) + 1) / 72.0) AS BIGINT)) AS gg FROM nr GROUP BY run),
    e AS (SELECT run, min(ts_ps) AS lo, max(ts_ps) AS hi FROM hits GROUP BY run),
    o AS (SELECT run, board, (k - k0) // gg AS step, k0, gg, sum(n) AS n FROM nr JOIN sp USING (run) GROUP BY ALL)
    SELECT run, board, step, CAST(n AS BIGINT) AS n,
      greatest(least((k0 + step * gg) * 600000000 + gg * 600000000, hi) - greatest((k0 + step * gg) * 600000000, lo), 0) AS covered FROM o JOIN e USING (run)""",
)
def run_history(spark, sf):
    return R.run_history(as_hits(spark, sf), 600_000_000, 6, points=72)


@C.query(
    "history_left_out",
    f"""WITH {HITS_SQL}, b AS (SELECT run, board, ts_ps // 600000000 AS k, count(*) AS n FROM hits GROUP BY ALL),
    t AS (SELECT run, k, sum(n) AS n FROM b GROUP BY ALL),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY run ORDER BY k) AS g FROM (SELECT *, coalesce(CAST(k - lag(k) OVER (PARTITION BY run ORDER BY k) > 6 AS INT), 0) AS nw FROM t)),
    s AS (SELECT run, g, sum(n) < 0.001 * sum(sum(n)) OVER (PARTITION BY run) AS small FROM g GROUP BY run, g),
    f AS (SELECT run, g, small AND bool_or(NOT small) OVER (PARTITION BY run) AS far FROM s)
    SELECT run, board, CAST(sum(CASE WHEN far THEN b.n ELSE 0 END) AS BIGINT) AS left_out FROM b JOIN g USING (run, k) JOIN f ON f.run = g.run AND f.g = g.g GROUP BY run, board""",
)
def history_left_out(spark, sf):
    """The hits that run_history leaves out as far off."""
    return R.history_left_out(as_hits(spark, sf), 600_000_000, 6)


@C.query(
    "mean_rates",
    f"""WITH {HITS_SQL}, s AS (SELECT run, (max(ts_ps) - min(ts_ps)) / 1e6 AS s FROM hits GROUP BY run)
    SELECT run, board, count(*) AS n, round(count(*) / any_value(s), 9) AS rate FROM hits JOIN s USING (run) GROUP BY run, board""",
)
def mean_rates(spark, sf):
    return R.mean_rates(as_hits(spark, sf), "board", 1e6).withColumn("rate", F.round("rate", 9))


def _dead_sql(ms: int) -> str:
    return f"""{HITS_SQL}, f AS (SELECT run, slot, board, ts_ps // {DAY} AS interval, max(CASE WHEN flags & 8 <> 0 THEN ts_ps END) AS tf,
      count(*) AS counts, count(*) FILTER (flags & 8 <> 0) AS flags, count(*) FILTER (flags & 32 <> 0) AS lost_flags, count(*) FILTER (flags & 4 <> 0) AS lost_n_flags FROM hits GROUP BY ALL),
    c AS (SELECT f.run, f.slot, f.interval, count(*) AS caf FROM f JOIN hits h ON h.run = f.run AND h.slot = f.slot AND h.ts_ps // {DAY} = f.interval AND h.ts_ps <= f.tf GROUP BY ALL),
    r AS (SELECT f.*, sum(flags) OVER w AS sf, sum(counts) OVER w - counts + coalesce(caf, 0) AS sc, sum({ms}) OVER w AS sms,
      sum(lost_n_flags) OVER w AS sln, sum(lost_flags) OVER w AS slf FROM f LEFT JOIN c USING (run, slot, interval) WINDOW w AS (PARTITION BY f.run, f.slot ORDER BY f.interval)),
    m AS (SELECT *, CASE WHEN sf = 0 THEN 0 ELSE 1024 * (sf + (sf - 1) // 63) END AS trg FROM r WHERE flags > 0),
    n AS (SELECT run, slot, interval, (SELECT min(b.interval) FROM m b WHERE b.run = a.run AND b.slot = a.slot AND b.sms - a.sms >= 1000) AS nx FROM m a),
    e AS (SELECT run, slot, min(interval) AS interval FROM m GROUP BY run, slot UNION ALL SELECT e.run, e.slot, nx FROM e JOIN n ON n.run = e.run AND n.slot = e.slot AND n.interval = e.interval WHERE nx IS NOT NULL),
    d AS (SELECT run, slot, board, interval, trg - lag(trg) OVER w AS trig, sc - lag(sc) OVER w AS dc, sms - lag(sms) OVER w AS dms, sln - lag(sln) OVER w AS dln, slf - lag(slf) OVER w AS dlf
      FROM m JOIN e USING (run, slot, interval) WINDOW w AS (PARTITION BY run, slot ORDER BY interval)),
    x AS (SELECT run, slot, board, interval, trig * 1000.0::DOUBLE / dms AS input_rate, dln * 1024.0::DOUBLE * 1000 / dms AS lost_rate,
      greatest(0, 1 - (dc + dln * 1024.0::DOUBLE) / trig) AS missed, least(1, dln * 1024.0::DOUBLE / trig) AS lost, dlf > 0 OR dln > 0 AS lost_seen FROM d WHERE trig IS NOT NULL)"""


DEAD_SQL = _dead_sql(86_400_000)


def _dead_intervals(spark, sf, ms=86_400_000):
    h = as_hits(spark, sf).withColumn("interval", F.expr(f"ts_ps div {DAY}"))
    flag = H.has_flag(F.col("flags"), H.FLAG_1024_COUNTED)
    newest = h.filter(flag).groupBy("run", "slot", "interval").agg(F.max("ts_ps").alias("tf"))
    return h.join(newest, ["run", "slot", "interval"], "left").groupBy("run", "slot", "board", "interval").agg(
        F.count(F.lit(1)).alias("counts"),
        F.count_if(flag).alias("flags"),
        F.count_if(F.col("ts_ps") <= F.col("tf")).alias("counts_at_flag"),
        F.count_if(H.has_flag(F.col("flags"), H.FLAG_TRIGGER_LOST)).alias("lost_flags"),
        F.count_if(H.has_flag(F.col("flags"), H.FLAG_LOST_COUNTED)).alias("lost_n_flags"),
    ).withColumn("ms", F.lit(ms).cast("long"))


def _dead_channels(spark, sf, ms=86_400_000):
    return R.dead_time(_dead_intervals(spark, sf, ms))


@C.query(
    "dead_time",
    f"WITH RECURSIVE {DEAD_SQL} SELECT run, slot, interval, round(input_rate, 9) AS input_rate, round(lost_rate, 9) AS lost_rate, round(missed, 9) AS missed, round(lost, 9) AS lost, lost_seen FROM x",
)
def dead_time(spark, sf):
    d = _dead_channels(spark, sf)
    return d.withColumns({c: F.round(c, 9) for c in ("input_rate", "lost_rate", "missed", "lost")})


@C.query(
    "dead_time_short",
    f"WITH RECURSIVE {_dead_sql(400)} SELECT run, slot, interval, round(input_rate, 6) AS input_rate, round(lost_rate, 6) AS lost_rate, round(missed, 6) AS missed, round(lost, 6) AS lost, lost_seen FROM x",
)
def dead_time_short(spark, sf):
    """Intervals of 400 ms: windows grow over at least three of them."""
    d = _dead_channels(spark, sf, 400)
    return d.withColumns({c: F.round(c, 6) for c in ("input_rate", "lost_rate", "missed", "lost")})


@C.query(
    "dead_time_boards",
    f"""WITH RECURSIVE {DEAD_SQL} SELECT run, board, interval, round(sum(input_rate), 6) AS input_rate, round(sum(input_rate * missed) / sum(input_rate), 6) AS missed,
    round(least(1, sum(lost_rate) / sum(input_rate)), 6) AS lost, bool_or(lost_seen) AS lost_seen FROM x GROUP BY run, board, interval""",
)
def dead_time_boards(spark, sf):
    d = R.board_dead_time(_dead_channels(spark, sf).withColumn("board", F.expr("cast(slot div 16 as int)")))
    return d.withColumns({c: F.round(c, 6) for c in ("input_rate", "missed", "lost")})


# Thresholds that the few events of a day reach; the walk is said as a recursion over the refreshes of a channel.
STATE_MS, STATE_BAD, STATE_LOW = 400, 6, 800
_STATES_SQL = f"""{HITS_SQL}, f AS (SELECT run, slot, board, ts_ps // {DAY} AS interval, max(CASE WHEN flags & 8 <> 0 THEN ts_ps END) AS tf,
      count(*) AS counts, count(*) FILTER (flags & 8 <> 0) AS flags, count(*) FILTER (flags & 32 <> 0) AS lf, count(*) FILTER (flags & 4 <> 0) AS ln FROM hits GROUP BY ALL),
    c AS (SELECT f.run, f.slot, f.interval, count(*) AS caf FROM f JOIN hits h ON h.run = f.run AND h.slot = f.slot AND h.ts_ps // {DAY} = f.interval AND h.ts_ps <= f.tf GROUP BY ALL),
    r AS (SELECT f.run, f.slot, f.board, f.interval, counts, flags, lf, ln, coalesce(caf, 0) AS caf, f.slot % 16 = 5 AS other, row_number() OVER (PARTITION BY f.run, f.slot ORDER BY f.interval) AS i
      FROM f LEFT JOIN c USING (run, slot, interval)),
    w AS (SELECT run, slot, board, interval, CAST(0 AS BIGINT) AS i, 'wait' AS state, false AS closed, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS quiet, CAST(0 AS BIGINT) AS opened,
        CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ms, CAST(0 AS BIGINT) AS lf, CAST(0 AS BIGINT) AS ln, CAST(NULL AS BIGINT) AS trig, CAST(NULL AS BIGINT) AS sn, CAST(NULL AS BIGINT) AS sms, CAST(NULL AS BIGINT) AS sln, false AS seen
      FROM r WHERE i = 1
      UNION ALL
      SELECT run, slot, board, interval, i,
        CASE WHEN other THEN 'other_step' WHEN since2 >= {STATE_BAD} THEN 'bad_flags' WHEN fire THEN 'valid' WHEN quiet2 >= {STATE_LOW} THEN 'low' ELSE state END,
        fire, CASE WHEN other THEN 0 ELSE total2 END, CASE WHEN other THEN 0 ELSE since2 END, CASE WHEN other THEN 0 ELSE quiet2 END,
        CASE WHEN other THEN 0 WHEN fire THEN total2 ELSE opened2 END, CASE WHEN other OR fire THEN 0 ELSE n2 END, CASE WHEN other OR fire THEN 0 ELSE ms2 END,
        CASE WHEN other OR fire THEN 0 ELSE lf2 END, CASE WHEN other OR fire THEN 0 ELSE ln2 END,
        CASE WHEN other THEN NULL WHEN fire THEN 1024 * (total2 + (total2 - 1) // 63) - CASE WHEN opened2 = 0 THEN 0 ELSE 1024 * (opened2 + (opened2 - 1) // 63) END ELSE trig END,
        CASE WHEN other THEN NULL WHEN fire THEN n2 ELSE sn END, CASE WHEN other THEN NULL WHEN fire THEN ms2 ELSE sms END, CASE WHEN other THEN NULL WHEN fire THEN ln2 ELSE sln END,
        CASE WHEN other THEN false WHEN since2 < {STATE_BAD} AND (fire OR quiet2 >= {STATE_LOW}) THEN lf2 > 0 OR ln2 > 0 ELSE seen END
      FROM (SELECT *, NOT other AND since2 < {STATE_BAD} AND total2 > opened2 AND ms2 >= 1000 AS fire FROM (
        SELECT r.run, r.slot, r.board, r.interval, r.i, r.other, w.state, w.trig, w.sn, w.sms, w.sln, w.seen, w.total + r.flags AS total2,
          CASE WHEN r.flags > 0 THEN r.counts - r.caf ELSE w.since + r.counts END AS since2, CASE WHEN r.flags > 0 THEN 0 ELSE w.quiet + {STATE_MS} END AS quiet2,
          CASE WHEN r.flags > 0 AND w.total = 0 THEN r.flags ELSE w.opened END AS opened2,
          CASE WHEN r.flags > 0 AND w.total = 0 THEN 0 WHEN r.flags > 0 THEN w.n + w.since + r.caf ELSE w.n END AS n2,
          CASE WHEN r.flags > 0 AND w.total = 0 THEN 0 ELSE w.ms + {STATE_MS} END AS ms2,
          CASE WHEN r.flags > 0 AND w.total = 0 THEN 0 ELSE w.lf + r.lf END AS lf2, CASE WHEN r.flags > 0 AND w.total = 0 THEN 0 ELSE w.ln + r.ln END AS ln2
        FROM w JOIN r ON r.run = w.run AND r.slot = w.slot AND r.i = w.i + 1))),
    x AS (SELECT run, slot, board, interval, state, closed, trig * 1000.0::DOUBLE / sms AS input_rate, sln * 1024.0::DOUBLE * 1000 / sms AS lost_rate,
      CASE WHEN trig IS NOT NULL THEN greatest(0, 1 - (sn + sln * 1024.0::DOUBLE) / trig) END AS missed, CASE WHEN trig IS NOT NULL THEN least(1, sln * 1024.0::DOUBLE / trig) END AS lost, seen AS lost_seen FROM w WHERE i > 0)"""


def _states(spark, sf):
    rows = _dead_intervals(spark, sf, STATE_MS).withColumn("other_step", F.col("slot") % 16 == 5)
    return R.dead_time_states(rows, bad_after=STATE_BAD, low_after_ms=STATE_LOW)


@C.query(
    "dead_time_states",
    f"WITH RECURSIVE {_STATES_SQL} SELECT run, slot, interval, state, closed, round(input_rate, 6) AS input_rate, round(lost_rate, 6) AS lost_rate, round(missed, 6) AS missed, round(lost, 6) AS lost, lost_seen FROM x",
)
def dead_time_states(spark, sf):
    return _states(spark, sf).withColumns({c: F.round(c, 6) for c in ("input_rate", "lost_rate", "missed", "lost")})


@C.query(
    "dead_time_board_states",
    f"""WITH RECURSIVE {_STATES_SQL} SELECT run, board, interval, CASE WHEN bool_or(state = 'valid') THEN 'valid' WHEN bool_or(state = 'wait') THEN 'wait' ELSE 'low' END AS state,
    round(sum(input_rate) FILTER (state = 'valid'), 6) AS input_rate, round(sum(input_rate * missed) FILTER (state = 'valid') / sum(input_rate) FILTER (state = 'valid'), 6) AS missed,
    round(CASE WHEN bool_or(state = 'valid') THEN least(1, sum(lost_rate) FILTER (state = 'valid') / sum(input_rate) FILTER (state = 'valid')) END, 6) AS lost,
    bool_or(state IN ('valid', 'low') AND lost_seen) AS lost_seen, count(*) FILTER (state = 'bad_flags') AS stuck FROM x GROUP BY run, board, interval""",
)
def dead_time_board_states(spark, sf):
    b = R.board_states(_states(spark, sf).withColumn("board", F.expr("cast(slot div 16 as int)")))
    return b.withColumns({c: F.round(c, 6) for c in ("input_rate", "missed", "lost")})


@C.query(
    "input_estimate",
    f"""WITH {HITS_SQL} SELECT serial, count(*) AS n, 1024 * count(*) FILTER (flags & 8 <> 0) AS input_at_least,
    round(CASE WHEN count(*) FILTER (flags & 8 <> 0) = 0 THEN NULL ELSE count(*) / (1024.0 * count(*) FILTER (flags & 8 <> 0)) END, 9) AS written FROM hits GROUP BY serial""",
)
def input_estimate(spark, sf):
    from beamloom.operators.quality import input_estimate as est

    return est(as_hits(spark, sf)).withColumn("written", F.round("written", 9))


@C.query(
    "hist1d",
    """SELECT l_returnflag AS series, CASE WHEN l_quantity < 5 THEN 'under' WHEN l_quantity > 45 THEN 'over' ELSE 'in' END AS place,
    CASE WHEN l_quantity >= 5 AND l_quantity < 45 THEN CAST(floor((l_quantity - 5) / 1.0) AS INT) END AS bin, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def hist1d(spark, sf):
    return Hi.hist1d(read(spark, sf, "lineitem"), F.col("l_returnflag"), F.col("l_quantity"), 5.0, 45.0, 40)


@C.query(
    "hist2d",
    """WITH c AS (SELECT l_linenumber, CASE WHEN l_quantity < 5 THEN -1 WHEN l_quantity >= 45 THEN 1 ELSE 0 END AS side_x,
      CASE WHEN l_extendedprice < 10000 THEN -1 WHEN l_extendedprice >= 80000 THEN 1 ELSE 0 END AS side_y,
      CAST(floor((l_quantity - 5) * 20 / 40) AS INT) AS cx, CAST(floor((l_extendedprice - 10000) * 35 / 70000) AS INT) AS cy FROM lineitem)
    SELECT side_x, side_y, CASE WHEN side_x = 0 AND side_y = 0 THEN cx END AS bx, CASE WHEN side_x = 0 AND side_y = 0 THEN cy END AS by, count(*) AS n FROM c GROUP BY ALL""",
)
def hist2d(spark, sf):
    l = read(spark, sf, "lineitem")
    return Hi.hist2d(l, F.col("l_quantity"), (5.0, 45.0, 20), F.col("l_extendedprice"), (10000.0, 80000.0, 35))


@C.query("neutron_gamma", """WITH x AS (SELECT l_suppkey % 16 AS ch, l_extendedprice AS l, (l_extendedprice - l_quantity * 900) / l_extendedprice AS p FROM lineitem),
    c AS (SELECT ch, l, p, CASE WHEN l < 0 THEN -1 WHEN l >= 100000 THEN 1 ELSE 0 END AS side_x, CASE WHEN p < 0 THEN -1 WHEN p >= 1 THEN 1 ELSE 0 END AS side_y FROM x)
    SELECT CAST(ch AS INT) AS ch, side_x, side_y, CASE WHEN side_x = 0 AND side_y = 0 THEN CAST(floor(l * 50 / 100000) AS INT) END AS bx,
    CASE WHEN side_x = 0 AND side_y = 0 THEN CAST(floor(p * 100) AS INT) END AS by, count(*) AS n FROM c GROUP BY ALL""")
def neutron_gamma(spark, sf):
    l = read(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).cast("int").alias("ch"), F.col("l_extendedprice").alias("long"), (F.col("l_quantity") * 900).alias("short"))
    return P.neutron_gamma(l, "long", "short", (0.0, 100000.0, 50), (0.0, 1.0, 100), ("ch",))


@C.query(
    "board_spectra",
    f"""WITH {HITS_SQL} SELECT board, ch, CAST(least(qlong * 64 // 65536, 63) AS INT) AS e_bin, CAST(least(qshort * 64 // 65536, 63) AS INT) AS e2_bin, count(*) AS n FROM hits GROUP BY ALL""",
)
def board_spectra(spark, sf):
    return P.board_spectra(as_hits(spark, sf), 64)


@C.query(
    "merged_histograms",
    f"WITH {HITS_SQL} SELECT slot, qlong, count(*) AS n FROM hits GROUP BY ALL",
)
def merged_histograms(spark, sf):
    h = as_hits(spark, sf)
    return Hi.merge_parts(*[Hi.spectrum(h.filter(F.col("board") == b)) for b in range(3)])


@C.query(
    "shape_stats",
    f"""WITH {HITS_SQL}, s AS (SELECT slot, qlong, count(*) AS n FROM hits GROUP BY ALL), m AS (SELECT slot, sum(n * qlong)::DOUBLE / sum(n) AS mean FROM s GROUP BY slot)
    SELECT slot, round(any_value(mean), 4) AS mean, round(sqrt(sum(n * (qlong - mean) * (qlong - mean)) / sum(n)), 4) AS sd FROM s JOIN m USING (slot) GROUP BY slot""",
)
def shape_stats(spark, sf):
    s = Hi.weighted_stats(Hi.spectrum(as_hits(spark, sf)), ["slot"], F.col("n").cast("double"), F.col("qlong").cast("double"))
    return s.select("slot", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@C.query("fft_rates")
def fft_rates(spark, sf):
    return Hi.rate_spectrum(as_hits(spark, sf), bin_ps=10 * US_PER_S, bins=1 << 12)


@C.query(
    "flag_counts",
    f"""WITH {HITS_SQL} SELECT serial, count(*) FILTER (flags & 4 <> 0) AS lost_counted, count(*) FILTER (flags & 8 <> 0) AS counted_1024,
    count(*) FILTER (flags & 16 <> 0) AS over_range, count(*) FILTER (flags & 32 <> 0) AS trigger_lost, count(*) FILTER (NOT pur AND flags & 16 = 0) AS good FROM hits GROUP BY serial""",
)
def flag_counts(spark, sf):
    h = H.with_flags(as_hits(spark, sf)).withColumn("good", H.good_hit("QDC"))
    return h.groupBy("serial").agg(*[F.count_if(F.col(c)).alias(c) for c in ("lost_counted", "counted_1024", "over_range", "trigger_lost", "good")])


@C.query(
    "composed_time",
    f"""WITH {HITS_SQL} SELECT pos, (((flags::BIGINT << 31) | (ts_ps & 2147483647)) * 2000 + ((qshort & 1023) * 2000) // 1024) AS ts,
    CAST((slot // 2) * 2 + (pos & 1) AS INT) AS ch FROM hits""",
)
def composed_time(spark, sf):
    h = as_hits(spark, sf)
    ttt = F.col("ts_ps").bitwiseAND(F.lit(2147483647))
    word = F.shiftleft(F.col("pos").bitwiseAND(F.lit(1)), 31).bitwiseOR(ttt)
    return h.select(
        "pos",
        H.compose_ts_ps(ttt, F.col("flags"), F.col("qshort").bitwiseAND(F.lit(1023)), 2000).alias("ts"),
        H.couple_channel(F.expr("slot div 2"), word).alias("ch"),
    )


@C.query(
    "time_range",
    f"WITH {HITS_SQL}, e AS (SELECT min(ts_ps) AS lo, max(ts_ps) AS hi FROM hits) SELECT pos, ts_ps, slot FROM hits, e WHERE ts_ps >= lo + (hi - lo) // 4 AND ts_ps < lo + (hi - lo) // 2 AND slot <> 5 AND board IN (0, 2)",
)
def time_range(spark, sf):
    h = as_hits(spark, sf)
    lo, hi = h.agg(F.min("ts_ps"), F.max("ts_ps")).first()
    t = F.col("ts_ps")
    return h.filter((t >= lo + (hi - lo) // 4) & (t < lo + (hi - lo) // 2) & (F.col("slot") != 5) & F.col("board").isin(0, 2)).select("pos", "ts_ps", "slot")


@C.query(
    "waveform_mv",
    """SELECT vec_id, label, round(list_max(embedding)::DOUBLE * 2000 / 16384, 9) AS top_mv, round(list_min(embedding)::DOUBLE * 2000 / 16384, 9) AS low_mv, len(embedding) AS samples FROM embeddings""",
)
def waveform_mv(spark, sf):
    e = read(spark, sf, "embeddings")
    mv = H.waveform_mv(F.col("embedding").cast("array<double>"), 2.0)
    return e.select("vec_id", "label", F.round(F.array_max(mv), 9).alias("top_mv"), F.round(F.array_min(mv), 9).alias("low_mv"), F.size(mv).cast("long").alias("samples"))


@C.query("flat_hits", f"WITH {HITS_SQL} SELECT board AS bd, ch, qlong AS e, ts_ps // 1000 AS e_t FROM hits WHERE NOT pur")
def flat_hits(spark, sf):
    from beamloom.sources.sinks import flat_hits as flat

    return flat(as_hits(spark, sf), drop_pur=True)


@C.query("event_strip_sums", f"""WITH {EVENTS_SQL} SELECT ev, CAST(part % 6 AS INT) AS strip, round(sum(CASE WHEN ch % 2 = 0 THEN e END), 6) AS left_sum, round(sum(CASE WHEN ch % 2 = 1 THEN e END), 6) AS right_sum, round(sum(e), 6) AS both_sum FROM evs GROUP BY ALL""")
def event_strip_sums(spark, sf):
    ev = as_events(spark, sf).withColumn("strip", (F.col("part") % 6).cast("int"))
    s = P.strip_sums(ev.withColumn("energy", F.col("e")).withColumn("side", F.when(F.col("ch") % 2 == 0, "left").otherwise("right")), "ev")
    return s.withColumns({c: F.round(c, 6) for c in ("left_sum", "right_sum", "both_sum")})
