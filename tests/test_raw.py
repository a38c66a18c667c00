import struct
from glob import glob

import numpy as np
from pyspark.sql import functions as F

from beamloom.operators import quality as Q
from beamloom.sources import raw
from beamloom.sources.listmode import write_listmode
from tests.rawbytes import block, board, psd_event, save, simple


def read(spark, path, **o):
    raw.register(spark)
    return spark.read.format("rawhits").options(**{k: str(v) for k, v in o.items()}).load(path)


def test_every_field_of_a_hit(spark, folder):
    ev = [psd_event(1, 0x7FFFFFFF, ext=3, flags=0b101010, fine=1023, ql=65535, pur=1, qs=32767), psd_event(0, 5, fine=512, ql=7, qs=3)]
    save(folder, board({2: block(ev)}, 0x7FFFFF))
    a, b = read(spark, folder).orderBy("pos").collect()
    assert a.ts_ps == ((3 << 31) | 0x7FFFFFFF) * 2000 + 1023 * 2000 // 1024
    assert (a.run, a.serial, a.ch, a.qlong, a.qshort, a.pur, a.flags, a.agg) == (12, 15880, 5, 65535, 32767, True, 0b101010, 0x7FFFFF)
    assert (b.ch, b.ts_ps, b.pur, b.fine_ps) == (4, 5 * 2000 + 1000, False, 1000)


def test_no_extras_other_option_and_tick(spark, folder):
    plain = block([psd_event(0, 9, ql=1, extras=False)], extras=False)
    other = block([psd_event(0, 9, ql=1)], option=5)
    save(folder, board({0: plain, 1: other}, 1), "exp_00012_15880_PSD_4_000.raw")
    (h,) = read(spark, folder).collect()
    assert (h.ts_ps, h.flags, h.fine_ps) == (36000, 0, None)
    m = raw.index_metrics(raw.read_index(spark, folder)).first()
    assert (m.hits, m.other) == (1, 1)
    strict = raw.index_metrics(raw.read_index(spark, folder, strict=True)).first()
    assert (strict.hits, strict.other) == (0, 2)


def test_damage_zero_fill_stale_copy_and_tail(spark, folder):
    good = [simple(c, 1000 * c) for c in range(1, 8)]
    half = simple(20, 1)[:7]
    stale = simple(2, 2000)
    words = good[0] + good[1] + half + good[2] + [0] * 14 + good[3] + stale + good[4] + good[5] + good[6][:9]
    save(folder, words)
    index = raw.read_index(spark, folder)
    m = raw.index_metrics(index).first()
    assert m.hits == 12 and m.aggregates == 6 and m.damaged == 3
    assert m.damaged_words == len(half) + 14 + len(stale) and m.tail_words == 9
    t = {r.agg for r in raw.read_hits(index).select("agg").distinct().collect()}
    assert t == {1, 2, 3, 4, 5, 6}


def test_gaps_over_roll_over_files_and_counter_wrap(spark, folder):
    save(folder, simple(0x7FFFFE, 10) + simple(0x7FFFFF, 1000) + simple(0, 2000) + simple(5, 3000), "exp_00012_15880_PSD_2_000.raw")
    save(folder, simple(1005, 5000) + simple(1006, 6000), "exp_00012_15880_PSD_2_001.raw")
    order = raw.file_order(raw.read_index(spark, folder))
    t = Q.gap_totals(Q.counter_gaps(order, ("run", "serial")), ["run", "serial"]).first()
    assert (t.aggregates, t.gaps, t.missing, t.damaged) == (6, 2, 4 + 999, 0)


def test_time_range_reads_only_overlapping_blocks(spark, folder):
    save(folder, [w for c in range(1, 30) for w in simple(c, 1000 * c)])
    index = raw.read_index(spark, folder)
    whole = read(spark, folder)
    lo, hi = 5_000 * 2000, 9_010 * 2000
    want = sorted(whole.filter(F.col("ts_ps").between(lo, hi - 1)).select("ts_ps").collect())
    assert sorted(raw.read_hits(index, lo, hi).select("ts_ps").collect()) == want and len(want) == 9
    assert sorted(read(spark, folder, tsFrom=lo, tsTo=hi).select("ts_ps").collect()) == want
    assert whole.count() == raw.read_hits(index).count() == 58


def test_range_split_equals_whole(spark, folder, monkeypatch):
    monkeypatch.setattr(raw, "HITS_PER_TASK", 8)
    save(folder, [w for c in range(1, 30) for w in simple(c, 1000 * c, n=5)])
    index = raw.read_index(spark, folder)
    split = raw.read_hits(index)
    assert split.rdd.getNumPartitions() > 5
    assert sorted(split.collect()) == sorted(read(spark, folder).collect())


def test_waveforms(spark, folder):
    half = [(1 << 31) | (i + 100) << 16 | 1 << 14 | i for i in range(4)]
    save(folder, board({0: block([psd_event(0, 1, wave=half)], samples=8), 1: block([psd_event(0, 2, wave=half)], samples=8, dual=True)}, 1))
    a, b = read(spark, folder, traces="true").orderBy("pos").collect()
    assert a.wf1 == [0, 100, 1, 101, 2, 102, 3, 103] and a.wf2 is None
    assert a.dw1 == [True, False] * 4 and a.dw2 == [False, True] * 4
    assert b.wf1 == [0, 1, 2, 3] and b.wf2 == [100, 101, 102, 103]


def pha_event(ch, ttt, ext, energy, info, fine=0, wave=()):
    return [(ch & 1) << 31 | ttt, *wave, ext << 16 | fine, info << 16 | energy]


def test_pulse_height_layout(spark, folder):
    wave = [(0x3FFF << 16) | 5] * 4
    ev = [pha_event(1, 9, 2, 1234, 0x200, 100), pha_event(0, 10, 0, 0, 0x2)]
    save(folder, board({1: block(ev), 2: block([pha_event(0, 11, 0, 8, 0, wave=wave)], samples=8)}, 4), "exp_00012_777_PHA_4_000.raw")
    a, b = read(spark, folder, traces="true").orderBy("pos").collect()  # the roll-over entry is no hit
    assert (a.ch, a.qlong, a.pur, a.serial) == (3, 1234, True, 777)
    assert a.ts_ps == ((2 << 31) | 9) * 4000 + 100 * 4000 // 1024
    assert b.wf1 == [0, 5] * 4


def test_group_layout(spark, folder):
    def ev(sub, t, ext, energy, pile=0, over=0):
        return [t, 5 << 16 | ext, sub << 28 | pile << 27 | over << 26 | energy]

    save(folder, board({1: block([ev(7, 0xFFFFFFFF, 1, 500), ev(0, 3, 0, 9, 1, 1)], option=0, group=True)}, 4), "exp_00012_88_QDC_16_000.raw")
    a, b = read(spark, folder).orderBy("pos").collect()
    assert (a.ch, a.ts_ps, a.qlong, a.pur, a.flags) == (15, ((1 << 32) | 0xFFFFFFFF) * 16000, 500, False, 0)
    assert (b.ch, b.pur, b.flags) == (8, True, 16)


def test_growing_file_gives_every_aggregate_once(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "cp")
    raw.register(spark)

    def step(ended=False):
        s = spark.readStream.format("rawhits").option("ended", str(ended).lower()).option("path", folder).option("maxWordsPerTrigger", 40).option("checkpoint", state).load()
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(out).count()

    aggs = [simple(c, 1000 * c) for c in range(1, 12)]
    words = [w for a in aggs for w in a]
    save(folder, words[:100])
    assert step() == 2 * (100 // len(aggs[0]))
    save(folder, words)  # same name: grown, the inode may stay
    save(folder, simple(12, 99_000), "exp_00012_15880_PSD_2_001.raw")
    assert step() == 22  # the newest aggregate waits
    assert step(ended=True) == 24
    assert spark.read.parquet(out).select("ts_ps").distinct().count() == 24
    assert len(glob(state + "/offsets/*")) >= 3  # bounded steps


def test_list_mode_files(spark, folder, tmp_path):
    rows = [(1, 15880, c, t, 100 + t % 7, 3 if c else 0, t) for c in (0, 1) for t in (50, 10, 30)]
    h = spark.createDataFrame(rows, "run int, serial int, ch int, ts_ps long, qlong int, qshort int, pos long")
    out = str(tmp_path / "lm")
    write_listmode(h, out)
    files = sorted(glob(out + "/*.bin"))
    assert not glob(out + "/.*")
    by_ch = {}
    for f in files:
        b = open(f, "rb").read()
        (mark,) = struct.unpack("<H", b[:2])
        fmt = "<HHQH" + ("H" if mark & 4 else "") + "I"
        size = struct.calcsize(fmt)
        ch = [struct.unpack(fmt, b[i : i + size]) for i in range(2, len(b), size)]
        by_ch.setdefault(ch[0][1], []).extend(ch)
        assert mark == (0xCAE1 if ch[0][1] == 0 else 0xCAE5)
    assert [r[2] for r in by_ch[0]] == [10, 30, 50] and [r[2] for r in by_ch[1]] == [10, 30, 50]
    assert by_ch[1][0][:5] == (15880, 1, 10, 103, 3)


def test_words_that_only_look_like_headers(spark, folder):
    """Data words with the mark of a header inside a block do not stop or shift the reading."""
    tricky = [psd_event(0, 100 + i, ext=0xA000, ql=0xA001, qs=1) for i in range(50)]
    save(folder, board({0: block(tricky)}, 1) + board({0: block(tricky)}, 2))
    assert read(spark, folder).count() == 100
    assert np.dtype("<u4").itemsize == 4


def test_a_burst_comes_back_whole(spark, folder):
    """20,000 hits, 16,000 of them within a millisecond, over more than 4,096 blocks of one board."""
    words = []
    for i in range(5000):
        t = 10_000_000 + i * 100 if i < 4000 else 20_000_000 + i * 100_000
        words += simple(i + 1, t, n=4)
    save(folder, words)
    index = raw.read_index(spark, folder)
    assert raw.read_hits(index).count() == 20_000
    assert raw.index_metrics(index).first().hits == 20_000


def test_damage_in_a_growing_file_cut_at_every_word():
    """Reading while the file grows gives the aggregates of one pass, whatever was written when."""
    from beamloom.sources.rawformat import Walker

    whole = [simple(c, 1000 * c) for c in range(1, 7)]
    words = np.array(whole[0] + whole[1] + whole[2][: len(whole[2]) // 2] + whole[3] + whole[4] + [0] * 9 + whole[5], np.uint32)
    once = [(at, c) for at, _, c, _ in Walker(words, "PSD")]
    assert [c for _, c in once] == [1, 2, 4, 5, 6]
    for cut in range(len(words)):
        first = Walker(words[:cut], "PSD", ended=False)
        got = [(at, c) for at, _, c, _ in first]
        rest = Walker(words, "PSD", first.pos, first.counter, first.board)
        assert got + [(at, c) for at, _, c, _ in rest] == once, cut
