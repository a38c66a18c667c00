"""Stored histograms: what they count and in which bins is kept beside the counts, and counts add up.

One store holds many histograms of one shape, (slot, x, y, n). Each has a *spec*, written once: what x and y are. Counts come
as parts, one per batch, each written whole under its number (``SumStore``): a batch that runs again replaces its part, and parts merge
into a base whose size is that of the histograms. Stores with the same specs add up.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.functions.binning import q_edges
from beamloom.operators.hist import merge_parts, outside_totals, rebin
from beamloom.streaming.state import Numbered, SumStore

SHAPE = "hist string, slot int, x long, y long, n long"


class HistStore:
    def __init__(self, spark: SparkSession, folder: str, parts: int = 16):
        self.spark, self.folder = spark, folder
        self._specs = Numbered(spark, f"{folder}/specs")
        self._sums = SumStore(spark, f"{folder}/sums", SHAPE, ("n",), parts)

    def specs(self) -> dict[str, dict]:
        return {d["hist"]: d["spec"] for _, d in self._specs.after(-1)}

    def define(self, hist: str, **spec) -> None:
        """A histogram's bins; the same again is nothing new, others under one name are refused: their counts wouldn't add up."""
        spec, known = json.loads(json.dumps(spec)), self.specs()
        if hist not in known:
            self._specs.append({"hist": hist, "spec": spec})
        elif known[hist] != spec:
            raise ValueError(f"{hist} is stored with other bins: {known[hist]}, not {spec}")

    def add(self, batch: int, tables: dict[str, tuple]) -> None:
        """One batch's counts: hist -> (table, column of x, column of y or None). Every histogram must be defined."""
        missing = set(tables) - set(self.specs())
        if missing:
            raise ValueError(f"not defined: {sorted(missing)}")
        rows = None
        for hist, (df, x, y) in tables.items():
            part = df.select(F.lit(hist).alias("hist"), F.col("slot").cast("int"), F.col(x).cast("long").alias("x"), (F.col(y) if y else F.lit(0)).cast("long").alias("y"), F.col("n").cast("long"))
            rows = part if rows is None else rows.unionByName(part)
        if rows is not None:
            self._sums.add(rows, batch)

    def read(self, hist: str, slot: int | None = None) -> DataFrame:
        """(slot, x, y, n); the filters reach the scan of the store."""
        h = self._sums.read().filter(F.col("hist") == hist)
        return (h if slot is None else h.filter(F.col("slot") == slot)).drop("hist")

    def merged(self, hist: str, *others: "HistStore") -> DataFrame:
        """The counts of several stores together; refused if their bins differ."""
        spec = self.specs().get(hist)
        if any(o.specs().get(hist) != spec for o in others):
            raise ValueError(f"{hist} has different bins")
        return merge_parts(self.read(hist), *[o.read(hist) for o in others])


def channel_tabs(store: HistStore, slot: int, lo: int, hi: int, bins: int, log: bool = False, light: bool = False, known_until: int | None = None) -> DataFrame:
    """What one channel's view shows, from stored histograms: (tab, x, y, n).

    ``q``: the spectrum in the view's range and bins; ``q_total``: all counts, zero charge, saturated, outside the view (x = 0 to 3);
    ``iat`` and ``dt``: times since the hit before and to the reference; ``rate``: hits per second, up to the last second known
    whole; ``psd``: the map's columns that overlap the range, and unless ``light`` ``psd_out``: hits without a place in it.
    """
    edges = q_edges(lo, hi, bins, log)
    spectrum = store.read("q", slot).select("slot", F.col("x").cast("int").alias("qlong"), "n")
    q = rebin(spectrum, edges).select(F.lit("q").alias("tab"), F.col("bin").cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "n")
    total = outside_totals(spectrum, edges[0], edges[-1])
    numbers = F.array(*[F.struct(F.lit(i).cast("long").alias("x"), F.col(c).cast("long").alias("n")) for i, c in enumerate(("total", "zero", "saturated", "outside"))])
    out = q.unionByName(total.select(F.explode(numbers).alias("t")).select(F.lit("q_total").alias("tab"), "t.x", F.lit(0).cast("long").alias("y"), "t.n"))
    for tab in ("iat", "dt", "rate"):
        h = store.read(tab, slot)
        h = h.filter(F.col("x") < known_until) if tab == "rate" and known_until is not None else h
        out = out.unionByName(h.select(F.lit(tab).alias("tab"), "x", "y", "n"))
    if light:
        return out
    columns = store.specs()["psd"]["x_edges"]
    seen = [i for i, (a, b) in enumerate(zip(columns, columns[1:])) if b > edges[0] and a < edges[-1]]
    psd = store.read("psd", slot).filter(F.col("x").between(seen[0], seen[-1])) if seen else store.read("psd", slot).limit(0)
    return out.unionByName(psd.select(F.lit("psd").alias("tab"), "x", "y", "n")).unionByName(store.read("psd_out", slot).select(F.lit("psd_out").alias("tab"), "x", "y", "n"))
