"""Operators against plain Python on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamloom.functions import binning as B
from beamloom.functions import hitcols as H
from beamloom.functions.polygon import in_polygon
from beamloom.operators import analyzers as A
from beamloom.operators import events as E
from beamloom.operators import hist as Hi
from beamloom.operators import joins as J
from beamloom.operators import physics as P
from beamloom.operators import quality as Q
from beamloom.operators import rates as R
from beamloom.operators.events import closed_and_open, gap_bunches


def hits(spark, rows):
    return spark.createDataFrame([(0, s, t, i) for i, (s, t) in enumerate(rows)], "run int, slot int, ts_ps long, pos long")


def test_time_to_reference_counts_every_pair(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 2, 9]), r.choice([r.randrange(4000), 700])) for _ in range(300)]
    got = {(x.slot, x.bin): x.n for x in J.time_to_reference(hits(spark, rows), 9, 50, 20).collect()}
    want = Counter()
    for i, (s, t) in enumerate(rows):
        for j, (s2, t2) in enumerate(rows):
            if s2 == 9 and i != j and abs(t - t2) <= 50:
                b = (t - t2 + 50) * 20 // 100
                if b < 20:
                    want[(s, b)] += 1
    assert got == want


def test_reference_phase(spark):
    rows = [(9, 1000), (9, 1010), (9, 2000), (9, 4010), (1, 500), (1, 1500), (1, 3005), (1, 4500), (1, 2000)]
    got = {x.ts_ps: x.phase for x in J.rf_phase(hits(spark, rows), 9, 1000.0).collect()}
    # the trigger at 1010 repeats a cycle; 2000 -> 4010 is two cycles of 1005
    assert got[500] == pytest.approx(0.5) and got[1500] == pytest.approx(0.5) and got[2000] == pytest.approx(0.0)
    assert got[3005] == pytest.approx(0.0, abs=1e-9) and got[4500] == pytest.approx((4500 - 2000) / 1005 % 1)


def test_coincidences_with_one_event_holding_most_hits(spark):
    r = random.Random(5)
    rows = [(0 if r.random() < 0.7 else r.randrange(1, 9), r.randrange(4), i) for i in range(400)]
    df = spark.createDataFrame(rows, "ev int, ch int, pos long")
    got = {(x.ch_x, x.ch_y): x.n for x in J.coincidence_matrix(df, "ev", "pos").collect()}
    want = Counter((a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] == b[0])
    assert got == want


def test_polygons_agree(spark):
    pts = [(0.0, 0.0), (10.0, 1.0), (9.0, 8.0), (4.0, 3.0), (1.0, 9.0)]
    r = random.Random(1)
    xy = [(r.uniform(-1, 11), r.uniform(-1, 10)) for _ in range(400)]
    df = spark.createDataFrame(xy, "x double, y double")
    cuts = spark.createDataFrame([("a", [dict(x=x, y=y) for x, y in pts])], "cut string, points array<struct<x: double, y: double>>")

    def inside(x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        return odd

    want = sorted(p for p in xy if inside(*p))
    assert sorted((q.x, q.y) for q in J.in_cuts(df, cuts, "x", "y").collect()) == want
    assert sorted((q.x, q.y) for q in df.filter(in_polygon(F.col("x"), F.col("y"), pts)).collect()) == want


def test_rate_spectrum_against_numpy(spark):
    r = random.Random(2)
    rows = [(s, r.randrange(64 * 10 * 3 + 300)) for s in (0, 1) for _ in range(500)] + [(0, 0), (1, 64 * 10 * 3 + 320)]
    got = {(x.slot, x.f_bin): (x.power, x.hits, x.windows) for x in Hi.rate_spectrum(hits(spark, rows), 10, 64, 4).collect()}
    for slot in (0, 1, -1):
        power, n = np.zeros(8), 0
        for k in range(3):
            m = np.zeros(64)
            for s, t in rows:
                if slot in (s, -1) and k * 640 <= t < (k + 1) * 640:
                    m[(t - k * 640) // 10] += 1
            power += (np.abs(np.fft.rfft(m)) ** 2)[1:33].reshape(8, 4).mean(axis=1)
            n += m.sum()
        for b in range(8):
            assert got[(slot, b)][0] == pytest.approx(power[b], rel=1e-4) and got[(slot, b)][1:] == (n, 3)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 9.99, 10.0, 10.1)], "x double")
    got = {(h.place, h.bin): h.n for h in Hi.hist1d(df, F.lit(0), F.col("x"), 0.0, 10.0, 10).collect()}
    assert got == {("under", None): 1, ("in", 0): 1, ("in", 9): 1, ("in", None): 1, ("over", None): 1}
    two = {(h.side_x, h.side_y): h.n for h in Hi.hist2d(df, F.col("x"), (0.0, 10.0, 10), F.lit(-1.0), (0.0, 1.0, 1)).collect()}
    assert two == {(-1, -1): 1, (0, -1): 2, (1, -1): 2}


def test_edges_and_rebinning(spark):
    assert B.q_edges(0, 10, 3, False) == [0, 4, 8, 12] and B.q_edges(0, 65536, 1, False) == [0, 65536]
    e = B.q_edges(1, 65536, 50, True)
    assert e[0] == 1 and e[-1] == 65536 and e == sorted(set(e))
    spec = spark.createDataFrame([(0, q, 1) for q in (0, 1, 7, 8, 65535)], "slot int, qlong int, n long")
    assert {r.bin: r.n for r in Hi.rebin(spec, [0, 8, 65536]).collect()} == {0: 2, 1: 1}
    x = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9, 10)], "x double").withColumn("b", B.edge_bin(F.col("x"), [1, 5, 10]))
    assert [r.b for r in x.orderBy("x").collect()] == [None, 0, 1, 1, None]


def test_psd_bins(spark):
    df = spark.createDataFrame([(100, 0), (100, 100), (100, 33), (0, 0), (65535, 1), (100, 101), (40000, 32767)], "l int, s int")
    v = [(r.b, r.o) for r in df.select(H.psd_bin(F.col("l"), F.col("s")).alias("b"), H.psd_out(F.col("l"), F.col("s")).alias("o")).collect()]
    assert v == [(99, False), (0, False), (67, False), (None, False), (None, False), (None, True), (None, True)]


def test_dead_time_from_flag_to_flag(spark):
    rows = [(0, 0, 0, 1000, 1500, 1, 700, 0, 0), (0, 0, 1, 1000, 800, 0, 0, 1, 1), (0, 0, 2, 1000, 1200, 2, 900, 0, 0)]
    cols = "run int, slot int, interval long, ms long, counts long, flags long, counts_at_flag long, lost_flags long, lost_n_flags long"
    d = R.dead_time(spark.createDataFrame(rows, cols)).first()
    events = 800 + 800 + 900
    assert d.input_rate == pytest.approx(2048 * 1000 / 2000) and d.lost == pytest.approx(0.5)
    assert d.missed == pytest.approx(max(0.0, 1 - (events + 1024) / 2048)) and d.lost_seen
    t = spark.range(1).select(*[R.triggers_at_flag(F.lit(f)).alias(str(f)) for f in (0, 1, 63, 64)]).first()
    assert tuple(t) == (0, 1024, 64512, 66560)


def test_far_off_bins_leave_the_history(spark):
    rows = [(0, 0, 10 * i) for i in range(3000)] + [(0, 0, 10_000_000)]
    df = spark.createDataFrame(rows, "run int, board int, ts_ps long")
    h = R.run_history(df, 100, 36, points=10)
    assert h.agg(F.sum("n")).first()[0] == 3000 and h.count() == 10
    assert h.agg(F.sum("covered")).first()[0] == 30_000


def test_kinematics_round_trip(spark):
    k = P.Reaction(target=11174.86, beam=1875.61, recoil=938.27, heavy=12109.48, recoil_z=1, beam_ke=16.0, angle=20.0, field=0.7)
    for ex in (0.0, 3.09):
        p = k.recoil_momentum(ex)
        recoil_e = math.sqrt(k.recoil**2 + p * p)
        px, py = p * math.cos(math.radians(20)), p * math.sin(math.radians(20))
        heavy_e = math.sqrt((k.heavy + ex) ** 2 + (k.k1 - px) ** 2 + py**2)
        assert recoil_e + heavy_e == pytest.approx(k.total, abs=1e-6)
        back = spark.range(1).select(k.excitation(F.lit(p / k.momentum_per_rho))).first()[0]
        assert back == pytest.approx(ex, abs=1e-6)


def test_left_over_hits_stay_open(spark):
    df = hits(spark, [(0, 0), (0, 5), (0, 100), (0, 104)])
    closed, rest = closed_and_open(gap_bunches(df, 10), 110, 10)
    assert {r.ts_ps for r in closed.collect()} == {0, 5} and {r.ts_ps for r in rest.collect()} == {100, 104}


def test_offsets_round_half_even_and_gains_without_value(spark):
    df = spark.createDataFrame([(1, 0, 100, 10), (1, 1, 100, 10), (1, 2, 100, 10)], "serial int, ch int, ts_ps long, qlong int")
    off = spark.createDataFrame([(1, 0, 0.0005), (1, 1, 0.0015)], "serial int, channel int, offset_ns double")
    assert [r.ts_ps for r in J.subtract_offsets(df, off).orderBy("ch").collect()] == [100, 98, 100]
    g = spark.createDataFrame([(1, 0, 0.1), (1, 1, None)], "serial int, channel int, mevee_per_count double")
    assert [r.ch for r in J.calibrated(df, g, 0.1).collect()] == [0]


def test_cabling_rules(spark):
    rows = [(1, 1, 0, "trk", 0, 1), (2, 1, 1, "trk", 0, 1), (3, 9, 0, "trk", 0, 2), (4, 1, 16, "trk", 0, 2), (5, 1, 2, "trk", 3, 1), (6, 1, 0, "veto", -1, 0),
            (7, 1, 3, "rf", -1, 0), (8, 1, 4, "rf", -1, 0), (9, 1, 5, "lamp", -1, 0), (10, 1, 4, "lucite", -1, 0)]
    df = spark.createDataFrame([(0, *r) for r in rows], "run int, line int, serial int, channel int, kind string, plane int, ch int")
    b = spark.createDataFrame([(0, 1, 16)], "run int, serial int, channels int")
    got = [r.problem for r in Q.check_cabling(df, b, {0: 8, 1: 8, 2: 8}).orderBy("line").collect()]
    assert got == [None, "plane channel taken", "board not open", "no such channel", "not a tracker channel", "given twice", None, "second rf", "unknown kind", None]


def test_analyzer_registry(spark):
    @A.analyzer("count", window=5, mode="newest", boards=(0,), newest=2)
    def tables(ev):
        return {"n": ev.groupBy("ev_t1").count()}

    df = spark.createDataFrame([(0, b, t, t) for b in (0, 1) for t in (0, 3, 50, 90, 91)], "run int, board int, ts_ps long, pos long")
    assert {r.ev_t1: r["count"] for r in A.ANALYZERS["count"].run(df)["n"].collect()} == {91: 2, 50: 1}


def test_bins_are_as_many_as_asked_for(spark):
    df = spark.range(2000).select((F.col("id") + 0.5).alias("x"))
    assert Hi.hist1d(df, F.lit(0), F.col("x"), 0.0, 2000.0, 2000).filter("n = 1").count() == 2000
    assert Hi.hist2d(df, F.col("x"), (0.0, 2000.0, 2000), F.lit(0.5), (0.0, 1.0, 1)).count() == 2000


def test_deviation_of_values_far_from_zero(spark):
    df = spark.createDataFrame([(1, 1e9), (1, 1e9 + 1), (1, 1e9 + 2), (None, 5.0), (2, None)], "k int, x double")
    got = {r.k: (r.mean, r.sd) for r in Hi.weighted_stats(df, ["k"], F.lit(1), F.col("x")).collect()}
    assert got[1] == (1e9 + 1, pytest.approx((2 / 3) ** 0.5)) and got[None] == (5.0, 0.0)


def test_dead_time_windows_grow_to_a_second(spark):
    rows = [(0, 0, i, 500, 1000, 1, 1000, 0, 0) for i in range(10)]
    cols = "run int, slot int, interval long, ms long, counts long, flags long, counts_at_flag long, lost_flags long, lost_n_flags long"
    d = R.dead_time(spark.createDataFrame(rows, cols)).orderBy("interval").collect()
    assert [r.interval for r in d] == [2, 4, 6, 8]
    assert all(r.input_rate == pytest.approx(2048.0) for r in d)


def test_key_that_goes_and_comes_back(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (4, "a", "z"), (4, "b", None), (5, "b", None)], "doc long, key string, value string")
    got = {tuple(r) for r in Q.key_differences(docs, "doc").collect()}
    assert got == {(2, "b", "y", None), (4, "a", "x", "z"), (4, "b", None, None), (5, "a", "z", None)}


def test_whole_events_without_a_cap(spark):
    df = spark.range(300).select(F.lit(1).alias("ev"), F.col("id").alias("pos"), (F.col("id") * 7 % 300).alias("ts_ps"))
    r = E.capped_event_table(df, ["ev"], ["ts_ps"], ["ts_ps", "pos"]).first()
    assert r.multi == 300 and list(r.ts_ps) == list(range(300))


def test_history_counts_what_it_leaves_out(spark):
    from beamloom.operators import rates

    near, far = [(1, b, t) for b in (0, 1) for t in range(5000)], [(1, 0, 10**9), (1, 0, 10**9 + 5)]
    hits = spark.createDataFrame(near + far, "run long, board long, ts_ps long")
    left = {(r.run, r.board): r.left_out for r in rates.history_left_out(hits, 100, 10).collect()}
    assert left == {(1, 0): 2, (1, 1): 0}
    assert rates.run_history(hits, 100, 10).groupBy().sum("n").first()[0] + sum(left.values()) == len(near + far)
