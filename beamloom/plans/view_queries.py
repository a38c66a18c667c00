"""Documents, views, user analyses and spectrometer spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamloom.functions import binning as B
from beamloom.operators import analyzers as A
from beamloom.operators import events as Ev
from beamloom.operators import hist as Hi
from beamloom.operators import joins as J
from beamloom.operators import limits as L
from beamloom.operators import physics as P
from beamloom.operators import quality as Q
from beamloom.operators import rates as R
from beamloom.operators import views as V
from beamloom.operators.stored import HistStore, channel_tabs
from beamloom.plans.adapters import EVENTS_SQL, HITS_SQL, as_events, as_hits, read
from beamloom.plans.catalogue import Catalogue
from beamloom.plans.event_queries import ANCHOR_SQL
from beamloom.plans.hist_queries import C as HIST
from beamloom.plans.join_queries import DT as J_DT
from beamloom.plans.join_queries import REF as J_REF
from beamloom.plans.join_queries import C as JOINS
from beamloom.session import scratch_dir
from beamloom.sources import eventfiles, raw
from beamloom.sources import sinks as K

C = Catalogue()
CHANNELS = {"SR": 1, "SL": 2, "FR": 3, "FL": 4, "BR": 5, "BL": 6}
# deuterons on carbon, protons out: masses in MeV
REACTION = P.Reaction(target=11174.86, beam=1875.61, recoil=938.27, heavy=12109.48, recoil_z=1, beam_ke=16.0, angle=20.0, field=0.7)
XS = f"""{EVENTS_SQL}, w AS (SELECT ev, CAST(floor(e2 / 100) AS BIGINT) AS t, pos, ch FROM evs),
    p AS (SELECT ev, arg_max(t, pos) FILTER (ch = 3) AS fr, arg_max(t, pos) FILTER (ch = 4) AS fl, arg_max(t, pos) FILTER (ch = 5) AS br, arg_max(t, pos) FILTER (ch = 6) AS bl FROM w WHERE ch <= 6 GROUP BY ev),
    x AS (SELECT ev, CASE WHEN fl > 0 AND fr > 0 AND fl <> fr THEN (fl - fr)::DOUBLE / 2 / 2.1::DOUBLE END AS x1, CASE WHEN bl > 0 AND br > 0 AND bl <> br THEN (bl - br)::DOUBLE / 2 / 1.98::DOUBLE END AS x2 FROM p)"""


def _tracks(spark, sf):
    return P.spectrometer(as_events(spark, sf).withColumn("t_ns", F.floor(F.col("e2") / 100).cast("long")), "ev", 0.0, 2.0, CHANNELS)


_E, _K1, _MA, _MB = (f"{v!r}::DOUBLE" for v in (REACTION.total, REACTION.k1, REACTION.recoil, REACTION.heavy))


@C.query(
    "excitation_spectrum",
    f"""WITH {XS}, t AS (SELECT 0.5 * x1 + 0.5 * x2 AS xa, CASE WHEN x2 > x1 THEN atan((x2 - x1) / 36) WHEN x2 < x1 THEN pi() + atan((x2 - x1) / 36) WHEN x1 = x2 THEN pi() / 2 END AS th FROM x),
    k AS (SELECT (xa / 1000 + {REACTION.rho0!r}::DOUBLE) * {REACTION.momentum_per_rho!r}::DOUBLE AS ka FROM t WHERE th IS NULL OR th BETWEEN 0.5 AND 1.2),
    e AS (SELECT sqrt({_E} * {_E} - {_K1} * {_K1} + {_MA} * {_MA} + 2 * {REACTION.cos!r}::DOUBLE * {_K1} * ka - 2 * {_E} * sqrt({_MA} * {_MA} + ka * ka)) - {_MB} AS ex FROM k WHERE ka IS NOT NULL)
    SELECT CAST(floor((ex + 20) * 80 / 40) AS INT) AS bin, count(*) AS n FROM e WHERE ex >= -20 AND ex < 20 GROUP BY 1""",
)
def excitation_spectrum(spark, sf):
    return P.excitation_spectrum(_tracks(spark, sf), REACTION, -20.0, 20.0, 80)


@C.query(
    "ray_plot",
    f"""WITH {XS}, d AS (SELECT i AS depth, ((-50 + 100.0::DOUBLE / 400 * i) / 42.8625::DOUBLE + 0.5) * (x2 - x1) + x1 AS xx FROM x, range(400) r(i) WHERE x1 IS NOT NULL AND x2 IS NOT NULL)
    SELECT CAST(depth AS INT) AS depth, CAST(floor((xx + 300) * 60 / 600) AS INT) AS bx, count(*) AS n FROM d WHERE xx >= -300 AND xx < 300 GROUP BY ALL""",
)
def ray_plot(spark, sf):
    return P.ray_plot(_tracks(spark, sf), (-300.0, 300.0, 60))


@C.query(
    "finder_steps",
    f"WITH {HITS_SQL} SELECT ts_ps // 86400000000 AS step, count(*) AS bunches, count(*) FILTER (pur) AS tracks, CAST(sum(qshort) AS BIGINT) AS hits FROM hits GROUP BY 1",
)
def finder_steps(spark, sf):
    s = as_hits(spark, sf).select(F.col("ts_ps").alias("t0"), F.lit(1).alias("bunches"), F.col("pur").cast("int").alias("tracks"), F.col("qshort").alias("hits"))
    return R.slice_steps(s, 86_400_000_000)


@C.query(
    "channel_view",
    f"""WITH {HITS_SQL}, s AS (SELECT slot, qlong, count(*) AS n FROM hits WHERE slot = 5 GROUP BY ALL), o AS (SELECT slot, CAST(sum(n) AS BIGINT) AS total,
      CAST(coalesce(sum(n) FILTER (qlong = 0), 0) AS BIGINT) AS zero, CAST(coalesce(sum(n) FILTER (qlong = 65535), 0) AS BIGINT) AS saturated,
      CAST(coalesce(sum(n) FILTER (qlong > 0 AND qlong < 65535 AND (qlong < 100 OR qlong >= 10000)), 0) AS BIGINT) AS outside FROM s GROUP BY slot),
    b AS (SELECT slot, CAST((qlong - 100) // 99 AS INT) AS bin, CAST(sum(n) AS BIGINT) AS n FROM s WHERE qlong >= 100 AND qlong < 10000 GROUP BY ALL)
    SELECT slot, bin, n, 100 + 99 * bin AS lo, 199 + 99 * bin AS hi, total, zero, saturated, outside FROM b JOIN o USING (slot)""",
)
def channel_view(spark, sf):
    return V.channel_spectrum(Hi.spectrum(as_hits(spark, sf)), 5, 100, 10_000, 100, False)


@C.query(
    "compare_channels",
    f"WITH {HITS_SQL} SELECT slot, CAST(qlong // 1024 AS INT) AS bin, count(*) AS n, CAST(list_position([7, 1, 30], slot) AS INT) AS place FROM hits WHERE slot IN (7, 1, 30) AND qlong > 0 AND qlong < 65535 GROUP BY ALL",
)
def compare_channels(spark, sf):
    return V.compare_channels(Hi.spectrum(as_hits(spark, sf)), [7, 1, 30, 7], 0, 65536, 64)


@C.query(
    "user_analysis",
    ANCHOR_SQL.format(hits=f"h0 AS (WITH {HITS_SQL} SELECT * FROM hits), hits AS (SELECT * FROM h0 WHERE board IN (0, 2))", w=900_000_000)
    + " SELECT multi, count(*) AS n FROM (SELECT a.run, a.ev_t0, count(*) AS multi FROM anchors a JOIN hits h ON h.run = a.run AND h.ts_ps BETWEEN a.ev_t0 AND a.ev_t0 + 900000000 GROUP BY ALL) GROUP BY multi",
)
def user_analysis(spark, sf):
    @A.analyzer("multiplicity", window=900_000_000, boards=(0, 2))
    def tables(events):
        n = events.groupBy("run", "ev_t0").agg(F.count(F.lit(1)).alias("multi"))
        return {"multi": n.groupBy("multi").agg(F.count(F.lit(1)).alias("n"))}

    hits = as_hits(spark, sf).select("run", "board", "ts_ps", "pos")
    return A.ANALYZERS["multiplicity"].run(hits)["multi"]


@C.query(
    "trace_samples",
    "SELECT vec_id, CAST(i - 1 AS INT) AS sample, CAST(CAST(floor(embedding[i]::DOUBLE * 1000) AS INT) AS SMALLINT) AS wf1 FROM embeddings, range(1, 65) r(i)",
)
def trace_samples(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("short")).alias("wf1"))
    return K.trace_rows(e, ["vec_id"])


@C.query(
    "register_text",
    """SELECT board, 'REG_' || idx AS name, '0x' || upper(lpad(to_hex(v), 8, '0')) AS hex, v AS value FROM
    (SELECT l_suppkey AS board, l_partkey % 64 AS idx, max(CAST(floor(l_extendedprice) AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2)""",
)
def register_text(spark, sf):
    g = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("board"), (F.col("l_partkey") % 64).alias("index")).agg(F.max(F.floor("l_extendedprice")).alias("value"))
    names = spark.range(64).select(F.col("id").alias("index"), F.concat(F.lit("REG_"), F.col("id").cast("string")).alias("name"))
    return K.registers_text(g, names)


@C.query(
    "file_names",
    """WITH n AS (SELECT l_orderkey % 900 + 100 AS run, l_suppkey AS serial, l_linenumber AS i FROM lineitem)
    SELECT CAST(run AS INT) AS run, CAST(serial AS INT) AS serial, 'PSD' AS dpp, 2 AS tick_ns, CAST(i AS INT) AS file_index, count(*) AS n FROM n GROUP BY ALL""",
)
def file_names(spark, sf):
    path = F.format_string("/data/exp_%03d/exp_%03d_%d_PSD_2_%03d.raw", F.col("l_orderkey") % 900 + 100, F.col("l_orderkey") % 900 + 100, F.col("l_suppkey"), F.col("l_linenumber"))
    f = read(spark, sf, "lineitem").select(path.alias("path")).withColumns(raw.name_columns())
    return f.groupBy("run", "serial", "dpp", "tick_ns", "file_index").agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "run_summary",
    f"""WITH {HITS_SQL}, b AS (SELECT run, serial, count(*) AS n, count(*) FILTER (pur) AS n_pur FROM hits GROUP BY ALL)
    SELECT run, '{{"format":"run-summary","version":1,"run":' || run || ',"boards":[' || string_agg('{{"serial":' || serial || ',"n":' || n || ',"n_pur":' || n_pur || '}}', ',' ORDER BY serial) || ']}}' AS doc FROM b GROUP BY run""",
)
def run_summary(spark, sf):
    b = as_hits(spark, sf).groupBy("run", "serial").agg(F.count(F.lit(1)).alias("n"), F.count_if("pur").alias("n_pur"))
    return K.run_summaries({"boards": b})


@C.query(
    "run_states",
    """WITH o AS (SELECT o_custkey AS run, max(epoch_us(o_orderdate)) AS newest, bool_or(o_orderstatus = 'F') AS over, bool_or(o_orderpriority = '1-URGENT') AS bad FROM orders GROUP BY 1), z AS (SELECT max(newest) AS now FROM o)
    SELECT run, CASE WHEN over AND bad THEN 'problems' WHEN over THEN 'stopped' WHEN now - newest > 5000000000000 THEN 'no stop' ELSE 'running' END AS state FROM o, z""",
)
def run_states(spark, sf):
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(
        F.max(t).alias("newest"), F.max(F.when(F.col("o_orderstatus") == "F", F.lit("t"))).alias("stop"),
        F.collect_set(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent"))).alias("problems"),
    )
    now = o.agg(F.max("newest")).first()[0]
    return L.run_state(o, 5_000_000_000_000, F.lit(now)).select("run", "state")


@C.query(
    "board_differences",
    """WITH a AS (SELECT DISTINCT l_orderkey AS serial FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS serial FROM lineitem WHERE l_returnflag = 'A')
    SELECT serial, 'missing' AS state FROM a WHERE serial NOT IN (SELECT serial FROM b) UNION ALL SELECT serial, 'added' FROM b WHERE serial NOT IN (SELECT serial FROM a)""",
)
def board_differences(spark, sf):
    l = read(spark, sf, "lineitem")
    side = lambda f: l.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("serial")).distinct()
    return V.missing_boards(side("R"), side("A"))


@C.query(
    "default_cabling",
    """WITH c AS (SELECT s_suppkey AS serial, unnest(range(16)) AS channel FROM supplier), a AS (SELECT *, row_number() OVER (ORDER BY serial, channel) AS i FROM c),
    w AS (SELECT *, row_number() OVER (ORDER BY plane, ch) AS i FROM (SELECT unnest(range(3)) AS plane), (SELECT unnest(range(1, 57)) AS ch))
    SELECT serial, CAST(channel AS INT) AS channel, 'trk' AS kind, CAST(plane AS INT) AS plane, CAST(ch AS INT) AS ch FROM a JOIN w USING (i)""",
)
def default_cabling(spark, sf):
    c = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("serial"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("channel"))
    w = spark.range(3 * 56).select(F.col("id").alias("seq"), F.lit("trk").alias("kind"), F.expr("cast(id div 56 as int)").alias("plane"), F.expr("cast(id % 56 + 1 as int)").alias("ch"))
    return J.placeholder_cabling(c, w)


@C.query(
    "document_changes",
    """WITH a AS (SELECT c_custkey AS key, c_mktsegment AS v FROM customer), b AS (SELECT o_custkey AS key, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS v FROM orders GROUP BY 1)
    SELECT key, a.v AS before, b.v AS after FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v""",
)
def document_changes(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    b = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.when(F.min("o_orderkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("value"))
    return Q.two_sided_differences(a, b, ["key"])


def _filled_store(spark, sf):
    """All histograms of all channels in a store: a batch per board, the second one twice, then another beside the merged base."""
    hits = as_hits(spark, sf)
    store = HistStore(spark, scratch_dir(spark, "histograms"), parts=1)
    store.define("q", x="charge")
    store.define("iat", x="tenths of a decade of ms")
    store.define("dt", x=[-J_DT, J_DT, 240], reference=J_REF)
    store.define("rate", x="s")
    store.define("psd", x_edges=B.psd_map_edges(), y=100)
    store.define("psd_out", x="all")
    for board in (0, 1, 1, 2):
        own = hits.filter(F.col("board") == board)
        dt = J.time_to_reference(hits.filter((F.col("board") == board) | (F.col("slot") == J_REF)), J_REF, J_DT, 240).filter(F.expr("slot div 16") == board)
        store.add(
            board,
            {
                "q": (Hi.spectrum(own), "qlong", None), "iat": (Hi.since_previous(own, unit_per_ns=1_000_000.0), "bin", None), "dt": (dt, "bin", None),
                "rate": (Hi.per_second(own, unit=1_000_000), "sec", None), "psd": (Hi.psd_map(own), "x", "y"), "psd_out": (Hi.psd_out(own).withColumn("x", F.lit(0)), "x", None),
            },
        )
    return store


@C.query("stored_histograms", f"WITH {HITS_SQL} SELECT slot, CAST(qlong AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, count(*) AS n FROM hits GROUP BY ALL")
def stored_histograms(spark, sf):
    return _filled_store(spark, sf).read("q")


TAB_SLOT = 21


def _tabs_sql() -> str:
    def stored(tab: str, name: str, x: str, y: str = "0") -> str:
        return f"SELECT '{tab}' AS tab, CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y, CAST(sum(n) AS BIGINT) AS n FROM ({(HIST.sql | JOINS.sql)[name]}) WHERE slot = {TAB_SLOT} GROUP BY ALL"

    total = f"""SELECT 'q_total' AS tab, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(unnest([sum(n), coalesce(sum(n) FILTER (qlong = 0), 0), coalesce(sum(n) FILTER (qlong = 65535), 0),
      coalesce(sum(n) FILTER (qlong > 0 AND qlong < 65535 AND (qlong < 100 OR qlong >= 10000)), 0)]) AS BIGINT) AS n FROM s WHERE slot = {TAB_SLOT} HAVING count(*) > 0"""
    shown = f"SELECT 'q' AS tab, CAST((qlong - 100) // 99 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(sum(n) AS BIGINT) AS n FROM s WHERE slot = {TAB_SLOT} AND qlong >= 100 AND qlong < 10000 GROUP BY ALL"
    edges = B.psd_map_edges()
    seen = [i for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > 100 and a < 10_000]
    psd = f"SELECT * FROM ({stored('psd', 'psd_map', 'x', 'y')}) WHERE x BETWEEN {seen[0]} AND {seen[-1]}"
    out = f"SELECT 'psd_out' AS tab, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, count(*) AS n FROM hits WHERE slot = {TAB_SLOT} AND qlong > 0 AND qlong < 65535 AND (qshort >= 32767 OR qshort > qlong) HAVING count(*) > 0"
    parts = [shown, total, stored("iat", "since_previous", "bin"), stored("dt", "dt_reference", "bin"), stored("rate", "rate_seconds", "sec"), psd, out]
    return f"WITH {HITS_SQL}, s AS (SELECT slot, qlong, count(*) AS n FROM hits GROUP BY ALL) " + " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@C.query("channel_tabs", _tabs_sql())
def channel_tabs_of_one(spark, sf):
    """Everything one channel's view shows, from the stored histograms."""
    return channel_tabs(_filled_store(spark, sf), TAB_SLOT, 100, 10_000, 100)


SAVED_GAP = 300_000_000


@C.query(
    "saved_events",
    f"""WITH {HITS_SQL}, m AS (SELECT *, CASE WHEN ts_ps - lag(ts_ps) OVER w <= {SAVED_GAP} THEN 0 ELSE 1 END AS fr FROM hits WINDOW w AS (PARTITION BY run ORDER BY ts_ps, pos)),
    b AS (SELECT *, sum(fr) OVER (PARTITION BY run ORDER BY ts_ps, pos) - 1 AS ev_id FROM m), r AS (SELECT run, min(ts_ps) AS t_start, max(ts_ps) AS t_end FROM hits GROUP BY run)
    SELECT run, CAST(ev_id AS BIGINT) AS ev_id, count(*) AS multi, min(ts_ps) AS t_first, max(ts_ps) AS t_last, any_value(t_start) AS t_start, any_value(t_end) AS t_end,
      array_to_string(list(serial * 100 + ch ORDER BY ts_ps, pos), ',') AS where_hit, array_to_string(list(qlong ORDER BY ts_ps, pos), ',') AS es, array_to_string(list((ts_ps // 1000) || '.' || (ts_ps % 1000) ORDER BY ts_ps, pos), ',') AS times
    FROM b JOIN r USING (run) GROUP BY run, ev_id""",
)
def saved_events(spark, sf):
    """Events saved, one run a second time, and read back with their runs' begin and end."""
    hits = as_hits(spark, sf)
    folder = scratch_dir(spark, "saved-events")
    built = eventfiles.build_events(Ev.gap_bunches(hits, SAVED_GAP))
    eventfiles.write_events(built, folder, slice_width=86_400_000_000)
    eventfiles.write_events(built.filter("run % 2 = 1"), folder, slice_width=86_400_000_000)
    e = eventfiles.read_events(spark, folder, slice_width=86_400_000_000).join(eventfiles.read_runs(spark, folder).select("run", "t_start", "t_end"), "run")
    where = F.transform(F.arrays_zip("sn", "ch"), lambda h: (h["sn"] * 100 + h["ch"]).cast("string"))
    times = F.transform(F.arrays_zip("e_t", "e_f"), lambda h: F.concat_ws(".", h["e_t"].cast("string"), h["e_f"].cast("string")))
    return e.select("run", "ev_id", "multi", "t_first", "t_last", "t_start", "t_end", F.array_join(where, ",").alias("where_hit"), F.array_join(F.col("e").cast("array<string>"), ",").alias("es"), F.array_join(times, ",").alias("times"))


PID_CUT = [(5.0, 5.0), (45.0, 10.0), (48.0, 48.0), (10.0, 40.0)]
OFFLINE = CHANNELS | {"AB": 7}


def _offline_sql() -> str:
    terms = []
    for i, (x1, y1) in enumerate(PID_CUT):
        x2, y2 = PID_CUT[(i + 1) % len(PID_CUT)]
        terms.append(f"CASE WHEN qt < {x1} + (dq - {y1}) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE AND dq >= {min(y1, y2)} AND dq < {max(y1, y2)} THEN 1 ELSE 0 END")
    def last(ch: int, c: str) -> str:
        return f"arg_max({c}, (t, pos)) FILTER (ch = {ch})"
    k = "WHERE kept"
    return f"""WITH {EVENTS_SQL}, w AS (SELECT ev, CAST(floor(e2 / 100) AS BIGINT) AS t, pos, ch, CAST(e AS INT) AS e FROM evs),
    p AS (SELECT ev, coalesce({last(2, "e")}, 0) AS qt, coalesce({last(7, "e")}, 0) AS dq, {last(3, "t")} AS fr, {last(4, "t")} AS fl, {last(5, "t")} AS br, {last(6, "t")} AS bl FROM w GROUP BY ev),
    x AS (SELECT *, CASE WHEN fl > 0 AND fr > 0 AND fl <> fr THEN (fl - fr)::DOUBLE / 2 / 2.1::DOUBLE END AS x1, CASE WHEN bl > 0 AND br > 0 AND bl <> br THEN (bl - br)::DOUBLE / 2 / 1.98::DOUBLE END AS x2 FROM p),
    t AS (SELECT *, 0.5 * x1 + 0.5 * x2 AS xa, CASE WHEN x2 > x1 THEN atan((x2 - x1) / 36) WHEN x2 < x1 THEN pi() + atan((x2 - x1) / 36) WHEN x1 = x2 THEN pi() / 2 END AS th FROM x),
    g AS (SELECT *, ({" + ".join(terms)}) % 2 = 1 AND (th IS NULL OR th BETWEEN 0.5 AND 1.2) AND (x1 IS NOT NULL OR x2 IS NOT NULL) AS kept, (xa / 1000 + {REACTION.rho0!r}::DOUBLE) * {REACTION.momentum_per_rho!r}::DOUBLE AS ka FROM t),
    b AS (SELECT *, CASE WHEN x1 >= -300 AND x1 < 300 THEN floor((x1 + 300) * 60 / 600) END AS b1, CASE WHEN x2 >= -300 AND x2 < 300 THEN floor((x2 + 300) * 60 / 600) END AS b2,
      CASE WHEN xa >= -300 AND xa < 300 THEN floor((xa + 300) * 60 / 600) END AS ba, CASE WHEN th >= 0.5 AND th < 1.2 THEN floor((th - 0.5) * 100 / 0.7) END AS bt,
      sqrt({_E} * {_E} - {_K1} * {_K1} + {_MA} * {_MA} + 2 * {REACTION.cos!r}::DOUBLE * {_K1} * ka - 2 * {_E} * sqrt({_MA} * {_MA} + ka * ka)) - {_MB} AS ex FROM g),
    h AS (SELECT 'pid' AS hist, floor(qt * 25 / 50) AS bx, floor(dq * 25 / 50) AS "by" FROM b WHERE qt > 0 AND dq > 0 AND qt < 50 AND dq < 50
      UNION ALL SELECT 'focal', b1, b2 FROM b {k} UNION ALL SELECT 'front', b1, 0 FROM b {k} UNION ALL SELECT 'back', b2, 0 FROM b {k} UNION ALL SELECT 'avg', ba, 0 FROM b {k}
      UNION ALL SELECT 'avg_theta', ba, bt FROM b {k} UNION ALL SELECT 'ex', CASE WHEN ex >= -20 AND ex < 20 THEN floor((ex + 20) * 80 / 40) END, 0 FROM b {k})
    SELECT hist, CAST(bx AS INT) AS bx, CAST("by" AS INT) AS "by", count(*) AS n FROM h WHERE bx IS NOT NULL AND "by" IS NOT NULL GROUP BY ALL"""


@C.query("offline_spectrometer", _offline_sql())
def offline_spectrometer(spark, sf):
    """Events saved in two folders of runs, chained, cut and analysed."""
    ev = as_events(spark, sf)
    hits = ev.select((F.col("ev") % 3).cast("int").alias("run"), "ev", F.floor(F.col("e2") / 100).cast("long").alias("t"), "pos", F.lit(0).alias("serial"), "ch", F.col("e").cast("int").alias("qlong"), F.lit(0).alias("qshort")).withColumn("ts_ps", F.col("t") * 1000)
    built = eventfiles.build_events(hits, "ev")
    a, b = scratch_dir(spark, "events-a"), scratch_dir(spark, "events-b")
    eventfiles.write_events(built.filter("run < 2"), a)
    eventfiles.write_events(built.filter("run = 2"), b)
    return P.offline_spectrometer(eventfiles.read_events(spark, a, b), REACTION, OFFLINE, (-300.0, 300.0, 60), (0.0, 50.0, 25), (-20.0, 20.0, 80), PID_CUT)
