"""Filter interaction audit: what each filter removes in every order of application, and its Shapley share.

A document's *mask* holds the filters that it fails. The states of the lattice are the sets of filters applied so far; an
edge adds one filter to a state and removes the documents that fail it and none of the state's. Forward and backward path
counts say how many orders reach a state and how many leave it, so an edge lies on forward x backward orders: its
removals weighted by them and summed per filter are the Shapley numbers, and the steps of every order are read from the
same edges. Documents are counted per part and mask before anything else, so the lattice never sees a document.

Defined cases: a null text is empty; a null part is the empty string; the parts of an empty table are none. Repeated rows
count each. Rows with a null id are never copies of another and make none; of rows with one id and one text all or none
are copies. A document is good (toxic) if any of its label rows says so; label rows without a document or with a null id play no part. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from beamloom.session import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that need only the text, by letter."""
    w = words(text)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(w) < 200,
        "B": 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = "E", id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask, good, toxic, n: documents per part, set of failed filters and labels.

    ``filters`` are conditions over a column ``text``, in the order of the mask's bits; ``copies`` adds a last one that a
    text fails if a smaller id has the same text anywhere. Rows that share a text meet only in sums; what is joined is
    the one smallest id of each text, by text and id, so no text gathers its rows in one task.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), t.alias("text"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    mask = sum(bits, F.lit(0)).cast("int")
    seen = d.select("id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    seen = cut(seen.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")), "audit-texts")
    marked = seen.filter("id IS NOT NULL")
    if copies is not None:
        low = marked.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        bit = F.when(F.col("first").isNull(), 1 << len(filters)).otherwise(0)
        marked = marked.join(low, ["digest", "id"], "left").withColumn("mask", (F.col("mask") + bit).cast("int"))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = marked.join(known.filter("id IS NOT NULL"), "id", "left").select("part", "mask", "n", "good", "toxic")
    without = seen.filter("id IS NULL").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    flat = marked.unionByName(without).select("part", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return flat.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def paths(n: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty one, and orders that lead from it to the full one."""
    forward, backward = [0] * (1 << n), [0] * (1 << n)
    forward[0] = backward[-1] = 1
    for s in range(1 << n):
        for f in range(n):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(range(1 << n)):
        for f in range(n):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return forward, backward


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """One row per part, filter_order and step, from the counts of ``masks``; letters name the mask's bits.

    The tables joined to the counts come from the filters alone (5 filters: 80 edges, 405 pairs of edge and mask, 600 steps)
    and are broadcast: n filters have n * 3**(n - 1) pairs and n * n! steps.
    """
    n = len(letters)
    if not 1 <= n <= 8:
        raise ValueError("1 to 8 filters")
    spark = counted.sparkSession
    forward, backward = paths(n)
    edges = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    assert sum(forward[s] * backward[s | 1 << f] for s, f in edges) == n * forward[-1] and len(edges) == n * sum(comb(n - 1, k) for k in range(n))
    removing = [(m, s, f) for m in range(1 << n) for s, f in edges if m >> f & 1 and not m & s]
    steps = [
        ("".join(order), i + 1, sum(1 << letters.index(x) for x in order[:i]), letters.index(x)) for order in permutations(letters) for i, x in enumerate(order)
    ]
    counted = cut(counted, "audit-counts")
    totals = counted.groupBy("part").agg(F.sum("n").alias("total"))
    pairs = F.broadcast(spark.createDataFrame(removing, "mask int, state int, filter int"))
    taken = counted.join(pairs, "mask").groupBy("part", "state", "filter").agg(
        F.sum("n").alias("removed"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good_lost"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic_lost"),
    )
    weighted = [(s, f, forward[s] * backward[s | 1 << f]) for s, f in edges]
    every = totals.select("part", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in weighted])).alias("e")).select("part", "e.*")
    lattice = every.join(taken, ["part", "state", "filter"], "left").select("part", "state", "filter", "orders", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("removed", "good_lost", "toxic_lost")])
    lattice = cut(lattice, "audit-lattice")
    alone = F.lit((1 << n) - 1).bitwiseXOR(F.element_at(F.array(*[F.lit(1 << f) for f in range(n)]), F.col("filter") + 1))
    of_filter = lattice.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("state") == alone, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    read = lattice.join(F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")), ["state", "filter"])
    read = read.join(of_filter, ["part", "filter"]).join(totals, "part")
    so_far = F.sum("removed").over(W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return read.select(
        "part", "filter_order", "step", (F.col("total") - so_far).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
