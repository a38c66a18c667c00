"""Time-ordered per-channel list-mode files: writer (``format("listmode")``) and preparation.

A file holds one channel's hits of one time slice; a channel with most of the hits becomes many files, numbered in
time order. Channels without hits give no file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from beamloom.operators.ordering import SLICE, TIE, plan_slices

# File mark and the bits for a second energy and a waveform.
MARK = 0xCAE1
HAS_ENERGY2 = 0x4
HAS_TRACE = 0x8
INPUT_WAVEFORM = 1


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done, out, key, header = [], None, None, 0
        tag = os.urandom(6).hex()
        for r in rows:
            k = (r["run"], r["serial"], r["ch"], r["part"], r["part2"])
            if k != key:
                if out:
                    out.close()
                name = f"run{k[0]}_{k[1]}_{k[2]:02d}_{k[3] + (1 << 62):020d}_{k[4] + (1 << 62):020d}.bin"
                tmp = os.path.join(self.path, f".{name}.{tag}")
                out, key = open(tmp, "wb"), k
                done.append((tmp, os.path.join(self.path, name)))
                header = MARK + (HAS_ENERGY2 if r["any_energy2"] else 0) + (HAS_TRACE if r["any_trace"] else 0)
                out.write(struct.pack("<H", header))
            out.write(struct.pack("<HHQH", r["serial"] & 0xFFFF, r["ch"], r["ts_ps"], r["qlong"]))
            if header & HAS_ENERGY2:
                out.write(struct.pack("<H", r["qshort"]))
            out.write(struct.pack("<I", 0))
            if header & HAS_TRACE and r["wf1"]:
                out.write(struct.pack(f"<BI{len(r['wf1'])}h", INPUT_WAVEFORM, len(r["wf1"]), *r["wf1"]))
        if out:
            out.close()
        return Written(done)

    def commit(self, messages):
        for m in messages:
            for tmp, final in m.files if m else []:
                os.replace(tmp, final)

    def abort(self, messages):
        for m in messages:
            for tmp, _ in m.files if m else []:
                if os.path.exists(tmp):
                    os.remove(tmp)


class ListMode(DataSource):
    @classmethod
    def name(cls):
        return "listmode"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_listmode(hits: DataFrame, path: str, traces: bool = False) -> None:
    """One ordered file per (run, board, channel, slice). The header of all files of a channel is the same."""
    spark = hits.sparkSession
    spark.dataSource.register(ListMode)
    h = hits.withColumn("wf1", F.col("wf1") if traces else F.lit(None).cast("array<smallint>"))
    kinds = h.groupBy("run", "serial", "ch").agg(
        F.max(F.col("qshort") > 0).alias("any_energy2"), F.max(F.coalesce(F.size("wf1") > 0, F.lit(False))).alias("any_trace")
    )
    plan = plan_slices(h, ("run", "serial", "ch"))
    cols = ["run", "serial", "ch", SLICE, TIE]
    x = plan.assign(h.join(kinds, ["run", "serial", "ch"])).repartition(*cols).sortWithinPartitions(*cols, "ts_ps", "pos")
    out = x.select("run", "serial", "ch", F.col(SLICE).alias("part"), F.col(TIE).alias("part2"), "any_energy2", "any_trace", "ts_ps", "qlong", "qshort", "wf1")
    out.write.format("listmode").option("path", path).mode("append").save()
