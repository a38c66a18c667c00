"""Saved events: round trip with traces, runs written again, and what a later job reads."""

from beamloom.operators import events as E
from beamloom.sources import eventfiles as V

COLS = "run int, serial int, ch int, ts_ps long, pos long, qlong int, qshort int, wf array<int>"


def rows(run, n=12):
    return [(run, 300 + i % 2, i % 4, 1_000_000 * (i // 3) + 137 * (i % 3), 100 - i, 10 * i, i, list(range(i % 3)) or None) for i in range(n)]


def build(spark, data):
    return V.build_events(E.gap_bunches(spark.createDataFrame(data, COLS), 1000), trace="wf")


def test_round_trip_with_traces(spark, folder):
    data = rows(1) + rows(2, 7)
    V.write_events(build(spark, data), folder, slice_width=2_000_000)
    got = {(r.run, r.ev_id): r for r in V.read_events(spark, folder, slice_width=2_000_000).collect()}
    assert len(got) == 4 + 3 and [got[1, i].t_first for i in range(4)] == [0, 1_000_000, 2_000_000, 3_000_000]
    e = got[1, 1]
    assert (e.multi, list(e.sn), list(e.ch), list(e.e), list(e.e2)) == (3, [301, 300, 301], [3, 0, 1], [30, 40, 50], [3, 4, 5])
    assert list(e.e_t) == [1000, 1000, 1000] and list(e.e_f) == [0, 137, 274]
    assert list(e.trace_length) == [0, 1, 2] and [x and list(x) for x in e.trace] == [None, [0], [0, 1]]
    runs = {r.run: (r.t_start, r.t_end, r.events, r.hits) for r in V.read_runs(spark, folder).collect()}
    assert runs == {1: (0, 3_000_274, 4, 12), 2: (0, 2_000_000, 3, 7)}
    hits = V.hits_of(V.read_events(spark, folder), "ch", "e_t").collect()
    assert len(hits) == 19 and sum(r.i == 0 for r in hits) == 7


def test_a_run_written_again_replaces_itself_only(spark, folder):
    V.write_events(build(spark, rows(1) + rows(2)), folder)
    V.write_events(build(spark, rows(2, 3)), folder)
    assert {r.run: r.events for r in V.read_runs(spark, folder).collect()} == {1: 4, 2: 1}
    assert V.read_events(spark, folder).count() == 5


def test_only_asked_runs_and_slices_are_read(spark, folder):
    V.write_events(build(spark, rows(1) + rows(2) + rows(3)), folder, slice_width=1_000_000)
    some = V.read_events(spark, folder, runs=[2], lo=1_000_000, hi=3_000_000, slice_width=1_000_000)
    assert sorted((r.run, r.ev_id) for r in some.collect()) == [(2, 1), (2, 2)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "run#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "slice#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len({f.split("/run=")[1].split("/part")[0] for f in some.inputFiles()}) >= 2
    two = V.read_events(spark, folder, folder)
    assert two.count() == 24
    assert V.read_events(spark, folder, lo=50_000_000, slice_width=1_000_000).count() == 0
