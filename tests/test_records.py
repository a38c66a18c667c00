import json
import os
import struct

from pyspark.sql import functions as F

from beamloom.operators import limits as L
from beamloom.operators import quality as Q
from beamloom.sources import records as R
from beamloom.sources import sinks as K


def put(folder, name, text):
    p = os.path.join(folder, name)
    with open(p, "w", newline="") as f:
        f.write(text)
    return p


def test_run_log(spark, folder):
    a, b = "2026.11.03 10:00:00", "2026.11.03 11:00:00"
    p = put(folder, "log.csv", f"1,{a},Start Comment: a, b,{b},Stop Comment: c, d\n2,{a},open\nnot a row\n1,{b},again, {a} is no stop\n")
    got = {r.run: r for r in R.run_log(spark, p).collect()}
    assert (got[2].start, got[2].start_comment, got[2].stop) == (a, "open", "")
    assert got[1].start == b and got[1].start_comment.startswith("again")
    files = spark.createDataFrame([("/d/x_002/f.raw", 2), ("/d/f.raw", 2), ("/e/f.raw", 2)], "path string, run int")
    logs = R.run_log(spark, p).withColumn("folder", F.lit("/d"))
    rec = {r.path: r.start for r in R.with_run_record(files, logs).collect()}
    assert rec == {"/d/x_002/f.raw": a, "/d/f.raw": a, "/e/f.raw": None}


def test_run_file_tables_and_clock(spark, folder):
    doc = dict(format="run", run=7, start=dict(time="t", comment=""), clock=dict(start=dict(unlocked=[], lost_since_last_check=["A"])),
               stop=dict(time="u", run_ms=5, problems=[], clock=dict(unlocked=["B"], lost_since_last_check=[])),
               led=dict(enabled=True, events=[dict(what="on", run_ms=3, ok=True), dict(what="off", run_ms=9, ok=False, error="no answer")]),
               boards=[dict(serial=15880, model="V1730", dpp="PSD", channels=16, registers={"0x1080": "5"})])
    put(folder, "r.json", json.dumps(doc))
    runs = R.run_files(spark, folder)
    assert R.run_boards(runs).first().serial == 15880 and R.run_registers(runs).first().value == "5"
    bad = L.failed_commands(R.run_led_events(runs)).first()
    assert (bad.failed, bad.last_what, bad.last_error) == (1, "off", "no answer")
    c = L.clock_state(R.run_clock(runs)).first()
    assert (c.level, c.unlocked) == ("problem", ["B"])


def test_settings_image(spark, folder):
    with open(os.path.join(folder, "a.bin"), "wb") as f:
        f.write(struct.pack("<2048I", *range(2046), 0xFFFFFFFF, 0x01020304))
    with open(os.path.join(folder, "b.bin"), "wb") as f:
        f.write(b"1234")
    img = R.settings_images(spark, folder)
    v = {r["index"]: r["value"] for r in img.collect()}
    assert len(v) == 2048 and v[5] == 5 and v[2046] == 0xFFFFFFFF and v[2047] == 0x01020304
    assert R.refused_images(spark, folder).first().length == 4


def test_cut_file(spark, folder):
    p = put(folder, "c.txt", "====== first cut\n1,2\n3,4\n5,0.5\n====== second\n0,0\n1,1\n#===== End of File\n9,9\n")
    got = {r.cut: [(q.x, q.y) for q in r.points] for r in R.cut_polygons(spark, p).collect()}
    assert got == {"first cut": [(1, 2), (3, 4), (5, 0.5)], "second": [(0, 0), (1, 1)]}


def test_dimension_files(spark, folder):
    cab = put(folder, "cab.csv", "serial,channel,kind,plane,ch\n1,0, trk ,0,1\n1,1,rf,,\n")
    assert [tuple(r) for r in R.cabling(spark, cab).orderBy("channel").collect()] == [(1, 0, "trk", 0, 1), (1, 1, "rf", -1, 0)]
    m = put(folder, "map.csv", "setting,ch0,ch1,ch2,p_mev,sigma_mev,n_cal\nhigh,1,2,3,300,6,5\nhigh,1,2,4,300,6,4\nhigh,1,2,5,300,6,\nlow,1,2,6,300,6,9\n")
    assert sorted(r.ch2 for r in R.momentum_map(spark, m, "high").collect()) == [3, 5]
    bare = put(folder, "map2.csv", "setting,ch0,ch1,ch2,p_mev,sigma_mev\nhigh,1,2,3,300,6\n")
    assert R.momentum_map(spark, bare, "high").first().n_cal is None
    g = put(folder, "g.csv", "serial,channel,offset_ns,source\n1,0,2.5,x\n1,0,3.5,y\n")
    assert R.per_channel(spark, g, "offset_ns").first().offset_ns == 3.5


def test_expectation_of_another_format_gives_nothing(spark, folder):
    doc = dict(format="beam/1", settings=dict(setting="high"), map=dict(a="b"), planes=dict(T0=dict(plane=0, n_channels=2, share=[0.25, 0.75], x_lo_mm=[0, 1], x_hi_mm=[1, 2])),
               momentum=dict(bin_edges_MeV=[0, 10, 20], read_with_finder_map=dict(per_beam_particle=[1.0, 2.0], by_kind={"e-": [0.5, 0.5]})))
    p = put(folder, "e.json", json.dumps(doc))
    shares, mom = R.expectation(spark, p, "beam/1")
    assert [r.share for r in shares.orderBy("ch").collect()] == [0.25, 0.75]
    assert [(r.lo, r.hi, r.n, r.n_electron) for r in mom.orderBy("bin").collect()] == [(0, 10, 1, 0.5), (10, 20, 2, 0.5)]
    assert R.expectation(spark, p, "beam/2")[0].count() == 0


def test_limits_document_and_rules(spark, folder):
    doc = dict(modes=dict(beam=dict(value="on")), channels=[dict(id="a", name="A", source="plc.ai0", scale=2.0, offset=1.0, range=[0, 100], rules=[
        dict(above=10, level="notice"), dict(at_or_above=20, level="bad", when=dict(beam="on")), dict(below=2, level="critical", when=dict(beam="off"))])])
    good, broken = put(folder, "l.json", json.dumps(doc)), put(folder, "x.json", "{")
    d = R.limits(spark, broken, good)
    ch, rules = R.limit_channels(d), L.rules_in_force(R.limit_rules(d), R.modes(d))
    assert rules.count() == 2
    v = spark.createDataFrame([("ai0", 1, 1.0), ("ai0", 2, 15.0), ("ai0", 3, 20.0), ("ai0", 4, 500.0), ("ai0", 5, None)], "input string, t long, value double")
    got = [r.level for r in L.evaluate(v, ch.select("input", "lo", "hi", "safety"), rules).orderBy("t").collect()]
    assert got == ["ok", "notice", "bad", "bad", "warn"]


def test_change_rule_needs_history_and_respects_the_mode(spark):
    ramp = [("ai0", t * 1000, 0.01 * t + (0.5 if t % 2 else -0.5)) for t in range(0, 1000, 5)]
    df = spark.createDataFrame(ramp, "input string, t long, value double")
    got = {r.t: (r.change, r.span_s) for r in L.change_over(df, 600).collect()}
    assert got[0] == (None, 0.0)
    assert abs(got[990_000][0] - 6.0) < 0.2 and got[990_000][1] == 600.0
    assert got[300_000][1] == 240.0
    since = df.withColumn("mode_start", F.lit(700_000).cast("long"))
    m = {r.t: r.span_s for r in L.change_over(since, 600, since="mode_start").collect()}
    assert m[990_000] == 290.0


def test_control_documents(spark, folder):
    put(folder, "1.json", json.dumps(dict(run=1, gain="5", boards=["a", "b"], boardFiles=dict(a="x"))))
    put(folder, "2.json", json.dumps(dict(run=2, gain="5", boards=["b"], boardFiles=dict(a="y"))))
    d = Q.key_differences(R.control_documents(spark, folder), "path")
    got = {(r.key, r.before, r.after) for r in d.collect()}
    assert {("run", "1", "2"), ("boardFiles.a", "x", "y")} <= got


def test_sinks(spark, folder):
    w = spark.createDataFrame([(1, [1, 2, 3])], "id int, wf1 array<short>")
    assert [(r.sample, r.wf1) for r in K.trace_rows(w, ["id"]).collect()] == [(0, 1), (1, 2), (2, 3)]
    put(folder, "a.csv", "x")
    files = spark.read.format("binaryFile").load(folder)
    m = {r.source: r for r in K.manifest(files, spark.createDataFrame([("a.csv",), ("b.csv",)], "source string")).collect()}
    assert m["a.csv"].bytes == 1 and m["b.csv"].missing
    doc = K.run_summaries({"boards": spark.createDataFrame([(1, 5, 2.0)], "run int, serial int, rate double")}).first().doc
    assert json.loads(doc)["boards"] == [dict(serial=5, rate=2.0)]
    p = os.path.join(folder, "s.json")
    K.write_whole(p, dict(a=float("nan"), b=[float("inf")]))
    assert json.load(open(p)) == dict(a="NaN", b=["Infinity"]) and not os.path.exists(p + ".part")
