import json
import os

from pyspark.sql import functions as F

from beamloom.operators.events import gap_bunches
from beamloom.streaming import live
from beamloom.streaming.state import Numbered, SumStore

COLS = "board int, ch int, slot int, ts_ps long, pos long, qlong int"


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def rows(*items):
    return [(b, c, b * 16 + c, t, i, 1) for i, (b, c, t) in enumerate(items)]


def make(spark, folder, **kw):
    c = Clock()
    return live.LiveRun(spark, folder, live.LiveSettings(window=10, margin=20, hold_s=30, stall_s=5, **kw), clock=c), c


def given(run):
    return {(r.bunch_t0, r.pos) for r in run.bunched_hits().collect()}


def test_a_silent_couple_holds_then_is_released(spark, folder):
    run, clock = make(spark, folder)
    run.batch(spark.createDataFrame(rows((0, 0, 100), (1, 0, 105), (0, 0, 1000)), COLS), 0)
    p = run.progress()
    assert p.mode == "running" and p.done == 100  # board 1 was last seen at 105
    clock.now = 31
    more = [(0, 0, 0, 5000, 10, 1)]
    run.batch(spark.createDataFrame(more, COLS), 1)
    assert run.progress().mode == "running" and {b for b, _ in given(run)} == {100, 1000}
    late = [(1, 0, 16, 106, 11, 1)]
    run.batch(spark.createDataFrame(late, COLS), 2)
    t = {r.slot: (r.n, r.late) for r in run.totals().collect()}
    assert t[16] == (2, 1) and run.late_last_minute() == 1
    run.finish()
    assert run.progress().mode == "stopped"
    assert len(given(run)) + 1 == 5


def test_a_batch_run_twice_counts_once_and_equals_one_pass(spark, folder):
    run, _ = make(spark, folder)
    hits = rows(*[(i % 2, i % 4, 7 * i + (i * i) % 13) for i in range(120)])
    df = spark.createDataFrame(hits, COLS)
    for k in range(3):
        part = df.filter((F.col("pos") >= 40 * k) & (F.col("pos") < 40 * (k + 1)))
        run.batch(part, k)
        if k == 1:
            run.batch(part, k)
    run.finish()
    want = gap_bunches(df.withColumn("run", F.lit(0)), 10)
    assert given(run) == {(r.bunch_t0, r.pos) for r in want.collect()}
    assert run.totals().agg(F.sum("n")).first()[0] == 120


def test_early_hits_quiet_and_clear(spark, folder):
    run, clock = make(spark, folder)
    run.skip_what_is_there(500)
    run.batch(spark.createDataFrame(rows((0, 0, 400), (0, 0, 600)), COLS), 0)
    t = run.totals().first()
    assert (t.n, t.early, t.late) == (2, 1, 0)
    clock.now = 100
    run.control(clear=True)
    run.batch(spark.createDataFrame([], COLS), 1)
    assert run.progress().mode == "quiet" and given(run) == {(600, 1)}  # given out after the clear
    assert run.totals(epoch=1).count() == 0 and run.progress().epoch == 1


def test_a_clear_is_kept_by_a_batch_that_runs_again(spark, folder):
    run, _ = make(spark, folder)
    run.batch(spark.createDataFrame(rows((0, 0, 100), (0, 0, 1000)), COLS), 0)
    assert given(run) == {(100, 0)}
    run.control(clear=True)
    more = spark.createDataFrame([(0, 0, 0, 2000, 5, 1), (0, 0, 0, 3 * live.SECOND, 6, 1)], COLS)
    for _ in range(3):
        run.batch(more, 1)
        p = run.progress()
        assert (p.epoch, p.control, p.clear_sec) == (1, 0, 1) and given(run) == {(1000, 1), (2000, 5)}
        assert [(r.sec, r.n) for r in run.rates().collect()] == [(3, 1)] and run.rates(whole_run=True).count() == 2
    assert {(r.bunch_t0, r.pos) for r in run.bunched_hits(epoch=0).collect()} == {(100, 0)}
    assert run.totals().agg(F.sum("n")).first()[0] == 4 and [c["what"] for c in p.changes] == ["clear"]


def test_window_and_reference_change_with_the_next_batch(spark, folder):
    run, _ = make(spark, folder, reference=0, dt_bins=4)
    run.batch(spark.createDataFrame(rows((0, 0, 100), (0, 1, 105), (0, 0, 1000)), COLS), 0)
    assert {(r.slot, r.bin, r.n) for r in run.times_to_reference().collect()} == {(1, 3, 1)}
    run.control(window=10, reference=0)  # as they are: no change
    run.batch(spark.createDataFrame([(0, 0, 0, 1500, 10, 1)], COLS), 1)
    assert (run.progress().epoch, run.progress().ref_epoch, run.progress().control) == (0, 0, 1)
    run.control(window=200, reference=1)
    more = [(0, 0, 0, 1650, 11, 1), (0, 1, 1, 1700, 12, 1), (0, 0, 0, 9000, 13, 1), (0, 1, 1, 9000, 14, 1)]
    run.batch(spark.createDataFrame(more, COLS), 2)
    assert given(run) == {(1500, 10), (1500, 11), (1500, 12)}
    # slot 0 at -200 and -50 of the hit in slot 1, in four bins over +-200
    assert {(r.slot, r.bin, r.n) for r in run.times_to_reference().collect()} == {(0, 0, 1), (0, 1, 1)}
    run.finish()
    assert {(r.slot, r.bin, r.n) for r in run.times_to_reference().collect()} == {(0, 0, 1), (0, 1, 1), (0, 2, 1)}


def test_what_is_left_for_the_next_batch_stays_small(spark, folder):
    run, _ = make(spark, folder)
    run._counts.parts = 3
    for k in range(9):
        run.batch(spark.createDataFrame([(0, 0, 0, 1000 * (k + 1), k, 1)], COLS), k)
    assert all(len(os.listdir(f"{folder}/{name}")) <= 4 for name in ("open", "hits"))
    assert len([x for x in os.listdir(f"{folder}/progress") if x.endswith(".json")]) <= 4
    assert len(os.listdir(f"{folder}/counts/parts")) <= 8
    run.finish()
    assert run.totals().first().n == 9 and len(given(run)) == 9


def test_nothing_is_final_while_files_wait(spark, folder):
    run, clock = make(spark, folder)
    run.backlog = lambda: 2
    run.batch(spark.createDataFrame(rows((0, 0, 100), (0, 0, 1000)), COLS), 0)
    clock.now = 100
    run.batch(spark.createDataFrame([], COLS), 1)
    assert run.progress().mode == "running" and run.progress().status == "falling behind: 2 not taken yet" and given(run) == {(100, 0)}
    run.backlog = lambda: 0
    run.batch(spark.createDataFrame([], COLS), 2)
    assert run.progress().mode == "quiet" and given(run) == {(100, 0), (1000, 1)}


def test_sums_of_a_repeated_batch_and_of_merged_parts(spark, folder):
    store = SumStore(spark, folder, "k string, n long", ("n",), parts=2)
    assert store.read().count() == 0
    want = {}
    for b in range(8):
        part = spark.createDataFrame([("a", 1), (f"b{b % 2}", 10), ("a", 1)], "k string, n long")
        for _ in range(1 + b % 2):
            store.add(part, b)
        for k, n in (("a", 2), (f"b{b % 2}", 10)):
            want[k] = want.get(k, 0) + n
        assert {r.k: r.n for r in store.read().collect()} == want
    store.add(spark.createDataFrame([("a", 100)], "k string, n long"), 2)  # merged long ago
    store.compact(6)
    assert {r.k: r.n for r in store.read().collect()} == want


def test_numbered_documents(spark, folder):
    log = Numbered(spark, folder)
    assert [log.append({"i": i}) for i in range(3)] == [0, 1, 2]
    assert list(log.after(0)) == [(1, {"i": 1}), (2, {"i": 2})] and list(log.after(2)) == []
    log.put(2, {"i": "new"})
    assert log.get(2) == {"i": "new"} and log.newest() == {"i": "new"} and log.newest(below=2) == {"i": 1}


def test_how_the_end_of_a_run_is_known(spark, folder):
    data, record = f"{folder}/data", f"{folder}/run.json"
    assert live.finished_kind(spark, record, data, 0.0) is None
    os.mkdir(data)
    open(f"{data}/a.fsu", "w").close()
    os.utime(f"{data}/a.fsu", (1000, 1000))
    assert live.finished_kind(spark, record, data, 1200.0) is None and live.finished_kind(spark, record, data, 1300.0) == "guess"
    with open(record, "w") as f:
        json.dump({"run": 1, "start": {"time": "x"}}, f)
    assert live.finished_kind(spark, record, data, 1200.0) is None
    with open(record, "w") as f:
        json.dump({"run": 1, "start": {"time": "x"}, "stop": {"time": "y"}}, f)
    assert live.finished_kind(spark, record, data, 1200.0) == "stopped"


def test_waits_for_every_board(spark, folder):
    run, _ = make(spark, folder, boards=(0, 1))
    run.batch(spark.createDataFrame(rows((0, 0, 100)), COLS), 0)
    assert run.progress().mode == "waiting"
    assert live.run_finished(None, 0.0, 299.0) is False and live.run_finished(None, 0.0, 300.0) is True


def test_slow_control_batches(spark, folder):
    ch = spark.createDataFrame([("ai0", 1.0, 0.0, True, 0.0, 100.0, True), ("tc0", 1.0, 0.0, True, 0.0, 5000.0, False)],
                               "input string, scale double, offset double, connected boolean, lo double, hi double, safety boolean")
    rules = spark.createDataFrame([("r", "ai0", "change", 5.0, "bad")], "rule string, input string, op string, limit double, level string")
    sc = live.SlowControl(folder, ch, rules, within_s=120)
    for b in range(2):
        data = [("ai0", (t + 150 * b) * 1000, 10.0 + 20 * b) for t in range(0, 150, 10)] + [("tc0", 150_000 * b, 3276.7)]
        sc.batch(spark.createDataFrame([(t, i, v) for i, t, v in data], "t long, input string, raw double"), b)
    lv = spark.read.parquet(folder + "/levels")
    assert {r.level for r in lv.filter("batch = 0 and input = 'ai0'").collect()} == {"ok"}
    assert lv.filter("batch = 1 and input = 'ai0' and level = 'bad'").count() > 5
    assert {r.level for r in lv.filter("input = 'tc0'").collect()} == {"nodata"}
