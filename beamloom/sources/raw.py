"""Raw run files as DataFrames: block index, hits, growing files.

``spark.read.format("rawaggs")``   one row per block (path, place, counter, first and last time), damage, tails
``spark.read.format("rawhits")``   hits; options ``tsFrom`` / ``tsTo`` skip blocks outside the range (a pushed filter would stay
                                   in the reader for later queries on the same DataFrame, so none is taken)
``spark.readStream.format("rawhits")``  hits of growing files, whole aggregates only
:func:`read_hits`                  hits through a stored index: block ranges, not files, are the unit of work
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)
from pyspark.sql.pandas.types import to_arrow_schema

from beamloom.schema import AGGS, HITS, TRACES
from beamloom.session import cut
from beamloom.sources import rawformat as R

HITS_PER_BATCH = 250_000
HITS_PER_TASK = 2_000_000


def hits_schema(traces: bool) -> T.StructType:
    return T.StructType(HITS.fields + TRACES.fields) if traces else HITS


def _batches(pdf: pd.DataFrame, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    yield from pa.Table.from_pandas(pdf[schema.names], schema=arrow, preserve_index=False).to_batches()


def _chunks(index: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Index rows in pieces of bounded hits."""
    part = (index["nev"].cumsum() - index["nev"]) // HITS_PER_BATCH
    for _, piece in index.groupby(part, sort=True):
        yield piece


@dataclass
class FilePart(InputPartition):
    path: str
    start: int = 0
    stop: int = -1
    counter: int = -1
    board: int = -1


class _Options:
    def __init__(self, options):
        self.path = options.get("path")
        self.traces = str(options.get("traces", "false")).lower() == "true"
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.dpp = options.get("dpp")
        self.max_words = int(options.get("maxWordsPerTrigger", 1 << 25))
        self.lo, self.hi = int(options.get("tsFrom", -(1 << 62))), int(options.get("tsTo", 1 << 62))
        self.checkpoint = options.get("checkpoint")
        self.starting = options.get("startingOffsets", "earliest")
        self.ended = str(options.get("ended", "false")).lower() == "true"


class _IndexReader(DataSourceReader):
    def __init__(self, o: _Options):
        self.o = o

    def partitions(self):
        return [FilePart(p) for p in R.list_files(self.o.path)]

    def read(self, part: FilePart):
        f, w = R.describe(part.path, self.o.dpp), R.words_of(part.path)
        for t in R.index_rows(f, w, R.Walker(w, f.dpp), self.o.strict):
            yield from _batches(t, AGGS)


class RawAggs(DataSource):
    @classmethod
    def name(cls):
        return "rawaggs"

    def schema(self):
        return AGGS

    def reader(self, schema):
        return _IndexReader(_Options(self.options))


class _HitReader(DataSourceReader):
    def __init__(self, o: _Options):
        self.o = o

    def partitions(self):
        return [FilePart(p) for p in R.list_files(self.o.path)]

    def read(self, part: FilePart):
        schema = hits_schema(self.o.traces)
        f, w = R.describe(part.path, self.o.dpp), R.words_of(part.path)
        if part.stop >= 0:  # what was there when the offset was taken: the file may have grown since
            w = w[: part.stop]
        walker = R.Walker(w, f.dpp, part.start, part.counter, part.board)  # a planned stop has been confirmed
        for t in R.index_rows(f, w, walker, self.o.strict, None if part.stop < 0 else part.stop):
            t = t[t["kind"] == "hits"]
            t = t[(t["t_last"] >= self.o.lo) & (t["t_first"] < self.o.hi)]
            for piece in _chunks(t):
                hits = R.decode(f, w, piece, self.o.traces)
                yield from _batches(hits[(hits["ts_ps"] >= self.o.lo) & (hits["ts_ps"] < self.o.hi)], schema)


class _HitStream(DataSourceStreamReader):
    """Offset: per file its inode, the word after the last whole aggregate taken, that aggregate's counter, the board.

    Each trigger walks the headers of what was added, at most ``maxWordsPerTrigger`` words per file (with the option
    ``checkpoint``, the query's checkpoint folder; without it the first trigger takes all there is). A file with
    another inode, or shorter than before, is a new file. The newest aggregate of a board's newest file waits for what
    follows it, or for the option ``ended`` once the run has stopped.
    """

    def __init__(self, o: _Options):
        self.o = o
        self.seen: dict[str, list[int]] | None = None

    def initialOffset(self):
        at = {}
        if self.o.starting == "latest":
            for p in R.list_files(self.o.path):
                at[p] = self._advance(p, [os.stat(p).st_ino, 0, -1, -1], 1 << 62, self.o.ended)
        return {"files": json.dumps(at)}

    def _advance(self, path: str, state: list[int], limit: int, ended: bool) -> list[int]:
        f, w = R.describe(path, self.o.dpp), R.words_of(path)
        ino, pos, counter, board = state
        if ino != os.stat(path).st_ino or len(w) < pos:
            ino, pos, counter, board = os.stat(path).st_ino, 0, -1, -1
        walker = R.Walker(w, f.dpp, pos, counter, board, ended=ended)
        for _ in walker:
            if walker.pos - pos >= limit:
                break
        return [ino, walker.pos, walker.counter, walker.board]

    def latestOffset(self):
        if self.seen is None:
            self.seen = self._last_planned()
        # not knowing where the query stands (it may be a restart): to the end of what is written, never behind it
        limit = self.o.max_words if self.seen is not None else 1 << 62
        known = self.seen or {}
        now = {}
        files = [R.describe(p, self.o.dpp) for p in R.list_files(self.o.path)]
        newest = {(f.run, f.serial): max(g.index for g in files if (g.run, g.serial) == (f.run, f.serial)) for f in files}
        for f in files:
            ended = self.o.ended or f.index < newest[f.run, f.serial]
            now[f.path] = self._advance(f.path, known.get(f.path, [os.stat(f.path).st_ino, 0, -1, -1]), limit, ended)
        self.seen = now
        return {"files": json.dumps(now)}

    def _last_planned(self) -> dict | None:
        """The query's newest offset, from its checkpoint folder (option ``checkpoint``); {} for a fresh query."""
        if not self.o.checkpoint:
            return None
        logs = [f for f in glob(os.path.join(self.o.checkpoint, "offsets", "*")) if os.path.basename(f).isdigit()]
        if not logs:
            return json.loads(self.initialOffset()["files"])
        with open(max(logs, key=lambda f: int(os.path.basename(f))), encoding="utf-8") as f:
            return json.loads(json.loads(f.read().splitlines()[-1])["files"])

    def partitions(self, start, end):
        a, b = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for p, (ino, stop, _, _) in b.items():
            _, begin, counter, board = a[p] if p in a and a[p][0] == ino and a[p][1] <= stop else (ino, 0, -1, -1)
            if stop > begin:
                out.append(FilePart(p, begin, stop, counter, board))
        return out

    def read(self, part: FilePart):
        return _HitReader(self.o).read(part)

    def commit(self, end):
        pass


class RawHits(DataSource):
    @classmethod
    def name(cls):
        return "rawhits"

    def schema(self):
        return hits_schema(_Options(self.options).traces)

    def reader(self, schema):
        return _HitReader(_Options(self.options))

    def streamReader(self, schema):
        return _HitStream(_Options(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawAggs)
    spark.dataSource.register(RawHits)


def read_index(spark: SparkSession, path: str, stored: bool = True, **options) -> DataFrame:
    """Block index of all files; ``stored`` writes it once (it is small, and read by every later scan)."""
    register(spark)
    df = spark.read.format("rawaggs").options(path=path, **{k: str(v) for k, v in options.items()}).load()
    return cut(df, "rawindex") if stored else df


def read_hits(index: DataFrame, lo: int | None = None, hi: int | None = None, traces: bool = False, dpp: str | None = None) -> DataFrame:
    """Hits of an index with lo <= ts_ps < hi. Blocks outside are never read (the index is the zone map); block
    ranges are spread over tasks by their number of hits, so one large file is many tasks."""
    blocks = index.filter("kind = 'hits'")
    if lo is not None:
        blocks = blocks.filter(F.col("t_last") >= lo)
    if hi is not None:
        blocks = blocks.filter(F.col("t_first") < hi)
    total = blocks.agg(F.sum("nev")).first()[0] or 0
    tasks = max(1, -(-total // HITS_PER_TASK))
    schema = hits_schema(traces)

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for path, rows in pdf.groupby("path", sort=False):
                f, w = R.describe(path, dpp), R.words_of(path)
                for piece in _chunks(rows):
                    yield from _batches(R.decode(f, w, piece, traces), schema)

    spread = blocks.repartitionByRange(tasks, "path", "ev_start").sortWithinPartitions("path", "ev_start")
    out = spread.mapInArrow(run, schema)
    if lo is not None:
        out = out.filter(F.col("ts_ps") >= lo)
    if hi is not None:
        out = out.filter(F.col("ts_ps") < hi)
    return out


def file_order(index: DataFrame) -> DataFrame:
    """One row per board aggregate with its place in the chain of a board's files, for counter gaps."""
    a = index.filter(F.col("kind").isin("hits", "other", "empty")).groupBy("run", "serial", "file_index", "agg_pos").agg(F.min("counter").alias("counter"))
    return a.withColumn("seq", F.col("file_index").cast("long") * (1 << 40) + F.col("agg_pos"))


def index_metrics(index: DataFrame) -> DataFrame:
    """Per file: aggregates, blocks, hits, blocks in another format, damaged places and words, unread tail."""
    k = F.col("kind")
    return index.groupBy("path", "run", "serial", "file_index").agg(
        F.countDistinct(F.when(k.isin("hits", "other", "empty"), F.col("agg_pos"))).alias("aggregates"),
        F.count_if(k == "hits").alias("blocks"),
        F.sum(F.when(k == "hits", F.col("nev")).otherwise(0)).alias("hits"),
        F.count_if(k == "other").alias("other"),
        F.count_if(k == "damage").alias("damaged"),
        F.sum(F.when(k == "damage", F.col("words")).otherwise(0)).alias("damaged_words"),
        F.sum(F.when(k == "tail", F.col("words")).otherwise(0)).alias("tail_words"),
        F.min("t_first").alias("t_first"),
        F.max("t_last").alias("t_last"),
    )


def name_columns(path: str = "path") -> dict[str, "F.Column"]:
    """Run, serial, layout, tick and roll-over number from a path column."""
    pattern = r"_(\d{3,})_(\d+)_(PSD|PHA|QDC)_(\d+)_(\d+)\.\w+$"
    kinds = {"run": (1, "int"), "serial": (2, "int"), "dpp": (3, "string"), "tick_ns": (4, "int"), "file_index": (5, "int")}
    c = F.col(path)
    return {n: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, g).cast(t)) for n, (g, t) in kinds.items()}
