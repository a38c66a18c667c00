import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from beamloom.operators import events as E
from beamloom.operators.ordering import Ordered, SlicePlan, plan_slices

SCHEMA = "run int, ts_ps long, pos long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def gaps_by_hand(rows, window):
    out, prev, start = {}, {}, {}
    for run, t, pos in sorted(rows):
        if run not in prev or t - prev[run] > window:
            start[run] = t
        prev[run] = t
        out[(run, pos)] = start[run]
    return out


def anchors_by_hand(rows, window):
    out, anchor = {}, {}
    for run, t, pos in sorted(rows):
        if run not in anchor or t - anchor[run] > window:
            anchor[run] = t
        out[(run, pos)] = anchor[run]
    return out


def random_rows(seed, n=600, span=20_000, runs=2):
    r = random.Random(seed)
    return [(r.randrange(runs), r.choice([r.randrange(span), r.randrange(span // 50)]), i) for i in range(n)]


@pytest.mark.parametrize("per_slice,window", [(20, 5), (10_000, 0)])
def test_bunches_do_not_depend_on_slices(spark, per_slice, window):
    rows = random_rows(per_slice + window)
    df = frame(spark, rows)
    want = gaps_by_hand(rows, window)
    got = {(r.run, r.pos): (r.bunch_t0, r.bunch_id) for r in E.gap_bunches(df, window, rows_per_slice=per_slice, numbered=True).collect()}
    starts = {run: sorted({t for (r, _), t in want.items() if r == run}) for run in (0, 1)}
    assert got == {k: (t, starts[k[0]].index(t) + 1) for k, t in want.items()}
    table = {(r.run, r.bunch_t0): r.multi for r in E.bunch_table(df, window).collect()}
    assert table == Counter((k[0], t) for k, t in want.items())


@pytest.mark.parametrize("per_slice,window", [(30, 120), (90, 0)])
def test_anchored_events_equal_a_sequential_scan(spark, per_slice, window):
    rows = random_rows(per_slice * 7 + window)
    df = frame(spark, rows)
    plan = plan_slices(df, rows_per_slice=per_slice)
    got = {(r.run, r.pos): r.ev_t0 for r in E.anchored_events(df, window, plan).collect()}
    assert got == anchors_by_hand(rows, window)


def test_dense_run_without_any_gap(spark):
    """Every hit is within the window of the one before: one chain over all slices, also for a strict pulser."""
    rows = [(0, 3 * i, i) for i in range(900)]
    df = frame(spark, rows)
    plan = plan_slices(df, rows_per_slice=60)
    got = {(r.run, r.pos): r.ev_t0 for r in E.anchored_events(df, 10, plan).collect()}
    assert got == anchors_by_hand(rows, 10)
    assert {r.bunch_t0 for r in E.gap_bunches(df, 3, rows_per_slice=60).collect()} == {0}


def test_window_is_inclusive_and_anchored(spark):
    rows = [(0, 0, 0), (0, 10, 1), (0, 20, 2), (0, 21, 3), (0, 32, 4)]
    ev = {r.pos: r.ev_t0 for r in E.anchored_events(frame(spark, rows), 10).collect()}
    assert ev == {0: 0, 1: 0, 2: 20, 3: 20, 4: 32}
    b = {r.pos: r.bunch_t0 for r in E.gap_bunches(frame(spark, rows), 10).collect()}
    assert b == {0: 0, 1: 0, 2: 0, 3: 0, 4: 32}


def test_a_burst_and_a_shared_time_are_cut_further(spark):
    burst = [(0, 5000 + i % 40, i) for i in range(400)]
    same = [(0, 9000, 1000 + i) for i in range(400)]
    rest = [(0, 100 * i, 3000 + i) for i in range(200)]
    rows = burst + same + rest
    df = frame(spark, rows)
    plan = plan_slices(df, rows_per_slice=25)
    kinds = {k for k, _ in plan.splits}
    assert kinds == {"time", "tie"}
    largest = plan.assign(df).groupBy(*plan.cols).count().agg(F.max("count")).first()[0]
    assert largest <= 4 * 25
    got = {(r.run, r.pos): r.bunch_t0 for r in E.gap_bunches(df, 99, rows_per_slice=5).collect()}
    assert got == gaps_by_hand(rows, 99)
    ev = {(r.run, r.pos): r.ev_t0 for r in E.anchored_events(df, 150, plan).collect()}
    assert ev == anchors_by_hand(rows, 150)
    o = Ordered(df, plan).ordinal("n").running_sum(F.col("pos"), "s")
    out = sorted(o.done().collect(), key=lambda r: (r.ts_ps, r.pos))
    assert [r.n for r in out] == list(range(len(rows)))
    total = 0
    for r in out:
        total += r.pos
        assert r.s == total


def test_next_and_last_over_seams(spark):
    rows = random_rows(5, n=200, runs=1)
    df = frame(spark, rows).withColumn("mark", F.when(F.col("pos") % 17 == 0, F.col("ts_ps")))
    plan = plan_slices(df, rows_per_slice=7)
    o = Ordered(df, plan).running_last(F.col("mark"), "before").next_first(F.col("mark"), "after")
    out = sorted(o.done().collect(), key=lambda r: (r.ts_ps, r.pos))
    seen = None
    for i, r in enumerate(out):
        seen = r.mark if r.mark is not None else seen
        assert r.before == seen
        assert r.after == next((x.mark for x in out[i + 1 :] if x.mark is not None), None)


def test_newest_events_reach_back_as_far_as_needed(spark):
    rows = [(0, 1000 * i, i) for i in range(50)] + [(0, 49_000 + i, 100 + i) for i in range(30)]
    got = E.newest_events(frame(spark, rows), 15, 12).groupBy("ev_t1").count().collect()
    anchors, a = [], None
    for _, t, _ in sorted(rows, reverse=True):
        if a is None or a - t > 15:
            a = t
            anchors.append(a)
    assert sorted(r.ev_t1 for r in got) == sorted(anchors[:12])


def test_capped_table_keeps_the_true_multiplicity(spark):
    df = frame(spark, [(0, 5, i) for i in range(101)]).withColumn("ev", F.lit(1))
    r = E.capped_event_table(df, ["ev"], ["pos"], ["ts_ps", "pos"], cap=E.EVENT_CAP).first()
    assert r.multi == 101 and r.pos == list(range(100))


def test_empty_input(spark):
    df = frame(spark, [])
    assert E.gap_bunches(df, 5).count() == 0
    assert isinstance(plan_slices(df), SlicePlan)


def test_order_check_over_seams(spark):
    t = [5, 6, 9, 8, 10, 3, 4]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(t)], "board int, pos long, ts_ps long")
    got = {r.pos: r.back_by for r in E.order_check(df, ("board",)).collect()}
    assert got == {3: 1, 5: 7}
