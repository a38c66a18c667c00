"""Dead-time windows and states, walked over many series."""

import random

import pytest
from pyspark.sql import functions as F

from beamloom.operators import rates as R
from beamloom.operators.scan import walk

COLS = "run int, slot int, interval long, ms long, counts long, flags long, counts_at_flag long, lost_flags long, lost_n_flags long, other_step boolean"


def states(spark, rows, **kw):
    """rows: (ms, counts, flags, counts_at_flag, lost_flags, lost_n, other) of one channel."""
    df = spark.createDataFrame([(0, 0, i, *r) for i, r in enumerate(rows)], COLS)
    return R.dead_time_states(df, **kw).orderBy("interval").collect()


def test_a_window_closes_at_the_first_refresh_after_a_second(spark):
    got = states(spark, [(0, 10, 0, 0, 0, 0, False), (400, 1500, 1, 1000, 0, 0, False), (400, 900, 1, 500, 1, 1, False), (400, 100, 0, 0, 0, 0, False), (400, 50, 0, 0, 0, 0, False), (700, 900, 1, 800, 0, 0, False)])
    assert [r.state for r in got] == ["wait", "wait", "wait", "wait", "valid", "valid"] and [r.closed for r in got] == [False] * 4 + [True, False]
    a, b = got[4], got[5]
    # flags 1 to 2: 1,024 triggers; 500 events after flag 1 and 500 up to flag 2; 1,200 ms with the two refreshes without a flag
    assert a.input_rate == pytest.approx(1024 * 1000 / 1200) and a.lost == pytest.approx(1.0) and a.missed == 0 and a.lost_seen
    assert (b.input_rate, b.lost_seen) == (a.input_rate, True)  # 700 ms on: the window shown stays


def test_states_follow_each_other(spark):
    assert [r.state for r in states(spark, [(0, 0, 0, 0, 0, 0, False)] + [(30_000, 3, 0, 0, 0, 0, False)] * 3)] == ["wait", "wait", "low", "low"]
    got = states(spark, [(1000, 3000, 0, 0, 0, 0, False), (1000, 2120, 0, 0, 0, 0, False), (1000, 1500, 1, 1000, 0, 0, False), (1000, 1500, 1, 1000, 0, 1, False)])
    assert [r.state for r in got] == ["wait", "bad_flags", "bad_flags", "valid"] and got[3].lost_seen
    got = states(spark, [(1000, 1500, 1, 1000, 0, 0, False), (1000, 1000, 1, 1000, 0, 0, False), (1000, 9, 1, 9, 0, 0, True), (1000, 10, 0, 0, 0, 0, False)])
    assert [r.state for r in got] == ["wait", "valid", "other_step", "other_step"] and got[2].input_rate is None and got[3].input_rate is None
    got = states(spark, [(1000, 1500, 1, 1000, 0, 0, False), (1000, 1000, 1, 1000, 0, 0, False), (0, 5, 0, 0, 0, 0, False)])
    assert [r.state for r in got] == ["wait", "valid", "wait"]


def test_a_board_is_valid_if_one_channel_is(spark):
    rows = [(0, b, 0, s, False, v, v and 0.0, m, v and 0.5, True) for b, s, v, m in ((0, "valid", 100.0, 0.1), (0, "valid", 300.0, 0.5), (0, "bad_flags", None, None), (1, "wait", None, None), (1, "low", None, None), (2, "low", None, None))]
    df = spark.createDataFrame(rows, "run int, board int, interval int, state string, closed boolean, input_rate double, lost_rate double, missed double, lost double, lost_seen boolean")
    got = {r.board: r for r in R.board_states(df).collect()}
    assert (got[0].state, got[0].input_rate, got[0].stuck) == ("valid", 400.0, 1) and got[0].missed == pytest.approx(0.4)
    assert got[1].state == "wait" and got[2].state == "low" and got[1].lost is None and got[2].lost_seen


def test_a_walk_over_many_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(3)
        rows = [(k, i, r.randrange(5)) for k in range(9) for i in range(r.randrange(1, 60))]
        df = spark.createDataFrame(rows, "k int, i int, v int").withColumn("other", F.lit("x"))

        def step(state, v):
            state[0] = (3 * state[0] + v) % 1000
            return (state[0], str(state[0])) if v else None

        got = walk(df, ["k"], "i", ["v"], lambda: [1], step, "total long, name string").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, state = [], {}
    for k, i, v in sorted(rows):
        state[k] = (3 * state.get(k, 1) + v) % 1000
        if v:
            want.append((k, i, state[k], str(state[k])))
    assert sorted(tuple(x) for x in got) == want
