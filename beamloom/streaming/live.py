"""Live analysis of a run: each micro-batch of hits is counted, and bunched as far as the data are complete.

What a batch leaves for the next is bounded and written whole under the batch's number: ``progress`` (a small
document), ``open`` (the hits that are not given out yet) and one part of each store of sums. A batch reads those of the batch before and
nothing else, so it costs the same after ten and after a thousand batches; run again (lost executor, restarted query) it
writes the same again, and nothing is counted twice.

* every hit is counted in ``counts`` exactly once
* the *frontier* is the newest time on disk per (board, couple) and when it last moved
* bunches are final up to the *boundary*: behind the newest time of every couple that still writes, less a margin;
  couples silent for ``hold_s`` no longer hold it; a stopped run has none
* a bunch is given out once it is closed (its last hit more than the window behind the boundary). What is not closed
  stays open for the next batch, so a bunch of any length is never cut
* a hit that arrives behind what is already given out is *late*: counted, never dropped silently; hits older than a
  mid-run start are *early*. Hits in bunches + late + early + still open = all hits.
* clear, a new window and a new reference are entries of a numbered log. A batch obeys the entries after the last one that
  the batch before it obeyed, so none is lost when a batch runs again. Clear and window begin a new *epoch*, the only one that the results
  show; a new reference only begins a new histogram of times to it. Counts of the whole run stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.operators.events import bunch_cells, first_open, with_bunches
from beamloom.operators.joins import time_to_reference
from beamloom.session import cut
from beamloom.streaming.state import Files, Numbered, SumStore

# A finished run without a stop marker is one quiet for this long; changes that are remembered by name.
FINISHED_QUIET_S = 300
CHANGES_KEPT = 100
SECOND = 1_000_000_000_000


@dataclass
class Progress:
    """What one batch leaves behind for the next. Bounded by the number of couples of the boards."""

    batch: int = -1
    done: int | None = None  # bunches with their first hit before this are given out
    early_before: int | None = None
    mode: str = "waiting"
    status: str = ""
    window: int | None = None
    reference: int | None = None
    control: int = -1  # newest entry of the log that is obeyed
    epoch: int = 0
    ref_epoch: int = 0
    newest_sec: int | None = None
    clear_sec: int | None = None  # rates are shown from here on
    frontier: dict[str, list[float]] = field(default_factory=dict)  # "board/couple" -> [newest, wall]
    late_log: list[list[float]] = field(default_factory=list)
    changes: list[dict] = field(default_factory=list)


@dataclass
class LiveSettings:
    window: int
    margin: int
    hold_s: float = 30.0
    stall_s: float = 5.0
    rf_slot: int | None = None
    boards: tuple[int, ...] = ()
    reference: int | None = None
    dt_width: int | None = None  # times to the reference within +-dt_width, at most the window
    dt_bins: int = 100


class LiveRun:
    """One run followed batch by batch. ``batch(df, id)`` is the function for ``foreachBatch``.

    Input columns: board, ch, slot, ts_ps (raw time), pos, qlong and optionally toff_ps (cable offset). ``backlog`` tells how
    much is written but not yet taken (files, bytes): while it is above zero nothing is final because of silence or a stop.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: LiveSettings, clock: Callable[[], float] = time.time, stopped: Callable[[], bool] = lambda: False, backlog: Callable[[], int] = lambda: 0):
        self.spark, self.folder, self.s = spark, folder, settings
        self.clock, self.stopped, self.backlog = clock, stopped, backlog
        self.files = Files(spark, folder)
        self._saved = Numbered(spark, f"{folder}/progress", keep=4)
        self._log = Numbered(spark, f"{folder}/control")
        self._counts = SumStore(spark, f"{folder}/counts", "epoch int, slot int, sec long, n long, late long, early long", ("n", "late", "early"))
        self._dt = SumStore(spark, f"{folder}/dt", "epoch int, ref_epoch int, slot int, bin int, n long", ("n",))

    def _save(self, p: Progress) -> None:
        self._saved.put(p.batch + 1, asdict(p))

    def progress(self, before: int | None = None) -> Progress:
        """State after the newest batch (before batch ``before``)."""
        doc = self._saved.newest(None if before is None else before + 1)
        return Progress(**doc) if doc else Progress(window=self.s.window, reference=self.s.reference)

    def control(self, clear: bool = False, window: int | None = None, reference: int | None = None) -> None:
        """Entries for the next batch: start again, another bunch window, another reference slot."""
        for what, value, asked in (("window", window, window is not None), ("clear", None, clear), ("reference", reference, reference is not None)):
            if asked:
                self._log.append({"what": what, "value": value, "at": self.clock()})

    def _obey(self, p: Progress) -> None:
        for n, entry in self._log.after(p.control):
            p.control = n
            what, value = entry["what"], entry["value"]
            if value is not None and value == {"window": p.window, "reference": p.reference}[what]:
                continue  # no change
            if what == "reference":
                p.reference, p.ref_epoch = value, p.ref_epoch + 1
            else:
                p.window = value if what == "window" else p.window
                p.epoch += 1
                p.late_log = []
                p.clear_sec = None if p.newest_sec is None else p.newest_sec + 1
            if p.frontier and len(p.changes) < CHANGES_KEPT:
                p.changes.append({"what": what, "value": value, "at": entry["at"], "done": p.done, "epoch": p.epoch, "ref_epoch": p.ref_epoch})

    def _part(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def batch(self, df: DataFrame, batch_id: int, last: bool = False) -> None:
        p = self.progress(before=batch_id)
        self._obey(p)
        now = self.clock()
        toff = F.col("toff_ps") if "toff_ps" in df.columns else F.lit(0)
        tc = F.col("ts_ps") - F.coalesce(toff, F.lit(0))
        done = p.done if p.done is not None else -(1 << 62)
        early = F.col("tc") < F.lit(p.early_before if p.early_before is not None else -(1 << 62))
        kept = df.withColumn("tc", tc).withColumn("early", early).withColumn("late", ~F.col("early") & (F.col("tc") < done))
        kept.write.mode("overwrite").parquet(self._part("hits", batch_id))
        mine = self.spark.read.schema(kept.schema).parquet(self._part("hits", batch_id))  # from here on the stored rows
        self._count(mine, p, batch_id, now)
        fresh = mine.filter("NOT late AND NOT early").drop("late", "early")
        if p.done is None and p.frontier:
            p.done = fresh.agg(F.min("tc")).first()[0]
        waiting = self.spark.read.schema(fresh.schema).parquet(self._part("open", p.batch)) if self.files.exists("open", f"batch={p.batch}") else None
        hits = fresh if waiting is None else waiting.unionByName(fresh)
        boundary = self._boundary(p, now, last)
        if p.done is not None and boundary is not None and boundary > p.done:
            p.done = self._give_out(hits, boundary, batch_id, p, final=p.mode in ("stopped", "quiet"))
            hits = hits.filter(F.col("tc") >= p.done)
        hits.write.mode("overwrite").parquet(self._part("open", batch_id))
        before, p.batch = p.batch, batch_id
        self._save(p)
        # the batch before can no longer run again
        for name in ("open", "hits"):
            for old in self.files.names(name):
                if int(old.split("=")[1]) < before:
                    self.files.remove(name, old)

    def _count(self, mine: DataFrame, p: Progress, batch_id: int, now: float) -> None:
        """Exact counts of this batch's hits per channel and second of raw time; moves the frontier."""
        t = F.col("ts_ps")
        c = mine.groupBy("slot", ((t - F.pmod(t, F.lit(SECOND))) / SECOND).cast("long").alias("sec")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"), F.count_if("early").alias("early")
        )
        self._counts.add(c.withColumn("epoch", F.lit(p.epoch)), batch_id)
        new = mine.groupBy("board", F.expr("ch div 2").alias("couple")).agg(F.max("ts_ps").alias("t"), F.count_if("late").alias("late")).collect()
        for r in new:
            k = f"{r['board']}/{r['couple']}"
            if k not in p.frontier or r["t"] > p.frontier[k][0]:
                p.frontier[k] = [r["t"], now]
        if new:
            p.newest_sec = max([p.newest_sec or 0, *(r["t"] // SECOND for r in new)])
        late = sum(r["late"] for r in new)
        p.late_log = [x for x in p.late_log if now - x[0] < 60] + ([[now, late]] if late else [])

    def _boundary(self, p: Progress, now: float, last: bool) -> int | None:
        """Where bunches may be final up to; sets the mode (waiting, running, paused, quiet, stopped) and its text.

        A couple holds the boundary back at its newest hit while that came within the longer of the two spans. A run that
        has stopped, or has been silent for ``hold_s``, is final up to its newest hit once all that is written is taken.
        """
        s, margin = self.s, max(self.s.margin, p.window)
        couples = [(k.split("/")[0], t, now - seen) for k, (t, seen) in p.frontier.items()]
        silence = min((age for *_, age in couples), default=0.0)
        absent = sorted({str(b) for b in s.boards} - {board for board, *_ in couples})
        behind = 0 if last else self.backlog()
        p.mode = (
            "waiting" if not couples
            else "stopped" if last or self.stopped() and not behind
            else "running" if behind and not absent
            else "quiet" if silence >= s.hold_s
            else "waiting" if absent
            else "running" if silence < s.stall_s
            else "paused"
        )
        p.status = {
            "waiting": f"nothing from {'boards ' + ', '.join(absent) if couples else 'any board'} so far",
            "stopped": "the run has ended",
            "quiet": f"silent for {silence:.0f} s",
            "running": f"falling behind: {behind} not taken yet" if behind else "taking data",
            "paused": f"{silence:.0f} s without data, perhaps a pause",
        }[p.mode]
        if p.mode == "waiting":
            return None
        if p.mode in ("stopped", "quiet"):
            return max(t for _, t, _ in couples) + margin + 1
        holding = [t for _, t, age in couples if behind or age < max(s.hold_s, s.stall_s)]
        return min(holding) - margin

    def _give_out(self, hits: DataFrame, boundary: int, batch_id: int, p: Progress, final: bool) -> int:
        """Writes the bunches that are closed at the boundary; returns the first time not given out."""
        if self.s.rf_slot is not None:
            hits = hits.filter(F.col("slot") != self.s.rf_slot)
        hits = hits.withColumn("run", F.lit(0)).withColumnsRenamed({"ts_ps": "raw_ts_ps", "tc": "ts_ps"})
        cells = cut(bunch_cells(hits, p.window), "bunches")  # used twice below
        still_open = None if final else first_open(cells, boundary, p.window)
        closed = hits if still_open is None else hits.filter(F.col("ts_ps") < still_open)
        out = with_bunches(closed, cells, p.window).withColumn("epoch", F.lit(p.epoch))
        out.write.mode("overwrite").parquet(self._part("bunched", batch_id))
        if p.reference is not None:
            # no wider than the window: a pair never lies in two bunches, so never in two batches
            width = min(self.s.dt_width or p.window, p.window)
            mine = self.spark.read.schema(out.schema).parquet(self._part("bunched", batch_id))
            dt = time_to_reference(mine, p.reference, width, self.s.dt_bins)
            self._dt.add(dt.select(F.lit(p.epoch).alias("epoch"), F.lit(p.ref_epoch).alias("ref_epoch"), "slot", "bin", "n"), batch_id)
        return boundary if still_open is None else min(still_open, boundary)

    def skip_what_is_there(self, newest: int) -> None:
        """A start in the middle of a run: hits before this time that arrive later count as early."""
        p = self.progress()
        p.early_before, p.done = newest, newest
        self._save(p)

    def finish(self) -> None:
        """End of the run: everything on disk is given out."""
        p = self.progress()
        none = self.spark.read.parquet(self._part("open", p.batch)).filter(F.lit(False)).drop("tc")
        self.batch(none, p.batch + 1, last=True)

    # results
    def bunched_hits(self, epoch: int | None = None) -> DataFrame:
        """Hits of the bunches given out since the last clear or change of window, with ``bunch_t0``."""
        return self.spark.read.parquet(f"{self.folder}/bunched").filter(F.col("epoch") == (self.progress().epoch if epoch is None else epoch))

    def totals(self, epoch: int | None = None) -> DataFrame:
        """Hits, late and early hits per channel over the whole run, or of one epoch."""
        c = self._counts.read()
        c = c if epoch is None else c.filter(F.col("epoch") == epoch)
        return c.groupBy("slot").agg(*[F.sum(x).alias(x) for x in ("n", "late", "early")])

    def rates(self, whole_run: bool = False) -> DataFrame:
        """Hits per channel and second, from the first whole second after the last clear."""
        c, start = self._counts.read(), self.progress().clear_sec
        c = c if whole_run or start is None else c.filter(F.col("sec") >= start)
        return c.groupBy("slot", "sec").agg(F.sum("n").alias("n"))

    def times_to_reference(self) -> DataFrame:
        """(slot, bin, n) since the last clear and the last change of the reference."""
        p = self.progress()
        return self._dt.read().filter((F.col("epoch") == p.epoch) & (F.col("ref_epoch") == p.ref_epoch)).select("slot", "bin", "n")

    def late_last_minute(self) -> int:
        p, now = self.progress(), self.clock()
        return int(sum(n for t, n in p.late_log if now - t < 60))


def start(stream: DataFrame, run: LiveRun, checkpoint: str, every: str | None = "1 second"):
    """The query: every second, or (``every`` None) all there is and stop, the way a finished run is read."""
    w = stream.writeStream.foreachBatch(run.batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def run_finished(stop_time: str | None, newest_change: float, now: float) -> bool:
    """A stop is recorded, or nothing was written for five minutes."""
    return stop_time is not None or now - newest_change >= FINISHED_QUIET_S


def finished_kind(spark: SparkSession, run_file: str, data: str, now: float) -> str | None:
    """How the end of a run is known: "stopped" (its run file holds a stop), "guess" (no stop, and no file of the data
    folder written for five minutes), None: not over."""
    from beamloom.sources.records import run_files

    try:
        stopped = run_files(spark, run_file).agg(F.max(F.col("stop").isNotNull())).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stopped = False
    if stopped:
        return "stopped"
    f = Files(spark, data)
    written = [s.getModificationTime() / 1000 for s in f.fs.listStatus(f.at())] if f.exists() else []
    return "guess" if written and run_finished(None, max(written), now) else None


class SlowControl:
    """Readings against limit rules, with the history that the rules look back on.

    ``channels``, ``rules`` and ``modes`` are tables, or functions that give them anew for every batch, so limits, spans and modes may change while
    the query runs. The history is one version per batch, written whole and pruned: of each input an hour, or the longest span of its
    change rules, and a minute. So a batch reads one history, however many batches came before.
    """

    def __init__(self, folder: str, channels, rules, modes=None, keep_s: int = 3600, within_s: int = 600):
        self.folder, self.tables = folder, (channels, rules, modes)
        self.keep_s, self.within_s = keep_s, within_s

    def batch(self, df: DataFrame, batch_id: int) -> None:
        from beamloom.functions.hitcols import linear_value
        from beamloom.operators import limits as L

        spark = df.sparkSession
        channels, rules, modes = (x() if callable(x) else x for x in self.tables)
        if modes is not None:
            rules = L.rules_in_force(rules, modes)
        c = channels.select("input", "scale", "offset", "connected")
        tc_open = F.when(F.col("input").startswith("tc"), F.lit(L.TC_OPEN))
        v = linear_value(F.col("raw"), F.col("scale"), F.col("offset"), tc_open)
        fresh = df.join(c, "input").withColumn("value", F.when(F.col("connected"), v)).select("t", "input", "value", F.lit(batch_id).cast("long").alias("came"))
        files = Files(spark, self.folder)
        before = [b for x in files.names("history") if (b := int(x.split("=")[1])) < batch_id]
        if before:
            fresh = spark.read.schema(fresh.schema).parquet(f"{self.folder}/history/batch={max(before)}").unionByName(fresh)
        span = rules.filter("op = 'change'").select("input", (F.col("within_s") if "within_s" in rules.columns else F.lit(self.within_s)).alias("w"))
        keep = span.groupBy("input").agg(((F.greatest(F.max("w"), F.lit(self.keep_s)) + 60) * 1000).cast("long").alias("keep"))
        newest = fresh.groupBy("input").agg(F.max("t").alias("newest"))
        kept = fresh.join(newest, "input").join(keep, "input", "left").filter(F.col("t") > F.col("newest") - F.coalesce("keep", F.lit((self.keep_s + 60) * 1000)))
        kept.select("t", "input", "value", "came").write.mode("overwrite").parquet(f"{self.folder}/history/batch={batch_id}")
        history = spark.read.schema(fresh.schema).parquet(f"{self.folder}/history/batch={batch_id}")
        changed = L.rule_changes(history, rules, within_s=self.within_s).filter(F.col("came") == batch_id).drop("came")
        levels = L.evaluate(changed, channels.select("input", "lo", "hi", "safety"), rules)
        levels.write.mode("overwrite").parquet(f"{self.folder}/levels/batch={batch_id}")
        for old in before:
            if old != max(before):
                files.remove("history", f"batch={old}")
