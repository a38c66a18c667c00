"""Moving means over many slices, change rules with spans of their own, and the history of the slow-control job."""

import os
import random

import pytest
from pyspark.sql import functions as F

from beamloom.operators import limits as L
from beamloom.streaming import live


def test_moving_means_do_not_depend_on_the_slices(spark):
    r = random.Random(4)
    rows = [(k, t, None if r.random() < 0.1 else round(r.random() * 100, 3)) for k in ("a", "b") for t in (r.randrange(-300, 900) for _ in range(250))]
    df = spark.createDataFrame(rows, "input string, t long, value double").withColumn("extra", F.lit(1))
    frames = {"now": (0, 7), "past": (30, 45), "ahead": (-12, 1), "wide": (0, 60)}
    want = {}
    for k, t, v in rows:
        for name, (lo, hi) in frames.items():
            inside = [x for kk, tt, x in rows if kk == k and x is not None and t - hi < tt <= t - lo]
            want[k, t, v, name] = sum(inside) / len(inside) if inside else None
    for reaches in (1, 3, 1000):
        got = L.moving_means(df, frames, slice_reaches=reaches).collect()
        assert len(got) == len(rows)
        for row in got:
            for name in frames:
                w = want[row.input, row.t, row.value, name]
                assert row[name] == (None if w is None else pytest.approx(w))


RULES = "rule string, input string, op string, limit double, level string, within_s int, when map<string, string>"


def test_each_rule_looks_back_over_its_own_span(spark):
    # a step of 10 at t = 1000 s
    r = spark.createDataFrame([("a", t * 1000, 10.0 if t > 1000 else 0.0) for t in range(0, 2000, 10)], "input string, t long, value double")
    rules = spark.createDataFrame([("long", "a", "change", 5.0, "bad", 900, {"m": "on"}), ("short", "a", "change", 5.0, "notice", 120, {}), ("other", "a", "change", 0.0, "bad", 60, {"m": "off"})], RULES)
    modes = spark.createDataFrame([("m", "on", 0)], "mode string, present string, since long")
    channels = spark.createDataFrame([("a", None, None, False)], "input string, lo double, hi double, safety boolean")
    now = L.rules_in_force(rules, modes)
    assert {x.rule for x in now.collect()} == {"long", "short"}
    got = {x.t // 1000: x for x in L.evaluate(L.rule_changes(r, now), channels, now).collect()}
    assert (got[990].level, got[1100].level, got[1900].level, got[1990].level) == ("ok", "bad", "bad", "ok")
    assert got[500].reasons == ["change 5.0: only 440 s of history"] and "change 5.0 [notice]" in got[1100].reasons and "change 5.0 [notice]" not in got[1300].reasons
    # the mode began at 1,200 s: no reading before that minute counts
    late = L.rules_in_force(rules, modes.withColumn("since", F.lit(1_200_000)))
    got = {x.t // 1000: x for x in L.evaluate(L.rule_changes(r, late), channels, late).collect()}
    assert got[1900].level == "ok" and got[1900].reasons == ["change 5.0: only 700 s of history"]
    none = L.rules_in_force(rules.filter("rule = 'other'"), modes)
    assert {x.level for x in L.evaluate(L.rule_changes(r, none), channels, none).collect()} == {"ok"}


def test_history_is_pruned_and_rules_may_change(spark, folder):
    ch = spark.createDataFrame([("ai0", 1.0, 0.0, True, None, None, False), ("ai1", 1.0, 0.0, True, None, None, False)], "input string, scale double, offset double, connected boolean, lo double, hi double, safety boolean")
    limit = [1000.0]
    rules = lambda: spark.createDataFrame([("r", "ai0", "change", limit[0], "bad", 300, {}), ("s", "ai1", "above", limit[0], "bad", None, {})], RULES)
    sc = live.SlowControl(folder, ch, rules, keep_s=100, within_s=60)

    def send(b, t, v):
        sc.batch(spark.createDataFrame([(t * 1000, "ai0", v), (t * 1000, "ai1", v)], "t long, input string, raw double"), b)
        levels = spark.read.parquet(f"{folder}/levels/batch={b}")
        return {r.input: r.level for r in levels.collect()}

    for b in range(5):
        assert send(b, 100 * b, float(b)) == {"ai0": "ok", "ai1": "ok"}
    history = spark.read.parquet(f"{folder}/history/batch=4")
    kept = {r.input: sorted(x // 1000 for x in r.ts) for r in history.groupBy("input").agg(F.collect_list("t").alias("ts")).collect()}
    assert kept == {"ai0": [100, 200, 300, 400], "ai1": [300, 400]}  # 300 + 60 s for the rule's input, else 100 + 60
    assert len(os.listdir(f"{folder}/history")) == 2
    limit[0] = 0.5
    assert send(5, 500, 9.0) == {"ai0": "bad", "ai1": "bad"}
    assert send(5, 500, 9.0) == {"ai0": "bad", "ai1": "bad"} and spark.read.parquet(f"{folder}/history/batch=5").filter("came = 5").count() == 2
