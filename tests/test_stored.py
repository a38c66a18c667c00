"""Stored histograms: bins that stay, counts that add up once."""

import pytest

from beamloom.operators.stored import HistStore, channel_tabs


def counts(spark, *rows):
    return spark.createDataFrame(list(rows), "slot int, bin int, n long")


def test_bins_are_kept_and_batches_count_once(spark, folder):
    a, b = HistStore(spark, f"{folder}/a", parts=1), HistStore(spark, f"{folder}/b")
    for s in (a, b):
        s.define("dt", x=[-5, 5, 10])
        s.define("dt", x=[-5, 5, 10])
    with pytest.raises(ValueError, match="other bins"):
        a.define("dt", x=[-5, 5, 20])
    with pytest.raises(ValueError, match="not defined"):
        a.add(0, {"iat": (counts(spark), "bin", None)})
    for batch in (0, 1, 1, 2, 2, 3):
        a.add(batch, {"dt": (counts(spark, (1, 2, 10**batch), (1, 2, 0), (2, 7, 1)), "bin", None)})
    assert {(r.slot, r.x, r.n) for r in a.read("dt").collect()} == {(1, 2, 1111), (2, 7, 4)}
    assert HistStore(spark, f"{folder}/a").specs() == {"dt": {"x": [-5, 5, 10]}}
    b.add(0, {"dt": (counts(spark, (1, 2, 5), (3, 0, 1)), "bin", None)})
    assert {(r.slot, r.x, r.n) for r in a.merged("dt", b).collect()} == {(1, 2, 1116), (2, 7, 4), (3, 0, 1)}
    c = HistStore(spark, f"{folder}/c")
    c.define("dt", x=[0, 1, 1])
    with pytest.raises(ValueError, match="different bins"):
        a.merged("dt", c)


def test_a_channel_without_counts_and_the_light_view(spark, folder):
    s = HistStore(spark, folder)
    for hist in ("q", "iat", "dt", "rate", "psd_out"):
        s.define(hist, x="any")
    s.define("psd", x_edges=[1, 10, 100, 1000])
    assert channel_tabs(s, 1, 0, 100, 10).count() == 0
    s.add(0, {"q": (counts(spark, (1, 0, 3), (1, 5, 2), (1, 500, 4)), "bin", None), "rate": (counts(spark, (1, 7, 9), (1, 8, 1)), "bin", None), "psd": (counts(spark, (1, 0, 1), (1, 1, 1), (1, 2, 1)).withColumnRenamed("bin", "x"), "x", "x")})
    got = {(r.tab, r.x, r.n) for r in channel_tabs(s, 1, 0, 100, 10, known_until=8).collect()}
    assert got == {("q", 0, 2), ("q_total", 0, 9), ("q_total", 1, 3), ("q_total", 2, 0), ("q_total", 3, 4), ("rate", 7, 9), ("psd", 0, 1), ("psd", 1, 1)}
    assert {r.tab for r in channel_tabs(s, 1, 0, 100, 10, light=True).collect()} == {"q", "q_total", "rate"}
