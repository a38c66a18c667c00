"""Benchmark decontamination: containment search by size-partitioned MinHash; DataFrame functions only.

A test item is found in a document if the document holds at least 80 % of the item's distinct shingles of five words.
Shingle hashes are one random order. Items are partitioned by size into classes [u/2, u); the MinHash sketch of an item
is the m = floor(u/5) + 1 smallest hashes of its shingles. A document that lacks all of them lacks more than a fifth of the
item's shingles, so every document that holds an item meets it through its sketch, whatever the document's length, and a
longer document needs no longer sketch. Documents are partitioned too: one with fewer shingles than 80 % of a class's
smallest item meets no item of the class. Whoever meets is verified by counting all shared shingles.

Words are runs of characters other than 0x20 and 0x09-0x0D, in lower case. A text with fewer than five words has one
shingle, all its words; one without words has none. So an item of fewer words is found only in documents that consist
of it, and an empty item nowhere. Rows with a null id are searched like others. Repeated rows count once. Extra columns
are not read; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.session import cut

WORDS = 5
PERCENT = 80
#: Rows (hash, item) of a side that are broadcast, at most (about 40 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles of a text in reading order, repeats included."""

    def of(w: Column) -> Column:
        last = F.size(w) - WORDS
        full = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        short = F.array(F.aggregate(w, F.size(w).cast("long"), lambda s, x: F.xxhash64(s, x)))
        return F.when(last >= 0, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))

    # the words' hashes are bound to a name, or they would be made again for every shingle
    return F.get(F.transform(F.array(F.transform(words(text), lambda w: F.xxhash64(w))), of), F.lit(0))


def with_shingles(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """The kept columns and ``h``, the hashes of the text's shingles."""
    return df.select(*keep, shingle_hashes(text).alias("h"))


def items_of(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """item, q (number of distinct shingles) and their sorted hashes; items without words are left out."""
    i = with_shingles(benchmark, F.col(f"`{text}`"), F.col(f"`{id}`").alias("item"))
    return i.select("item", F.array_sort(F.array_distinct("h")).alias("h")).distinct().withColumn("q", F.size("h")).filter("q > 0")


def sketches(items: DataFrame) -> DataFrame:
    """h (one row per hash of a sketch) and ``least``: shingles that a document needs to hold any item of the class."""
    sized = items.select("h", F.expr("shiftleft(1, length(bin(q)))").alias("u"))
    m = F.floor(F.col("u") * (100 - PERCENT) / 100).cast("int") + 1
    return sized.select(F.explode(F.slice("h", 1, m)).alias("h"), F.ceil(F.col("u") / 2 * PERCENT / 100).cast("int").alias("least")).groupBy("h").agg(F.min("least").alias("least"))


def bounded(side: DataFrame) -> DataFrame:
    """The side, to be broadcast if it is within BROADCAST_ROWS."""
    side = cut(side, "benchmark-side")
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def find(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item, item_shingles, shared, and ``mark``, a hash of the document's text: one row per document and item in it."""
    items = cut(items_of(benchmark, item, item_text), "benchmark-items")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(F.col(f"`{id}`").alias("id"), body.alias("text"), F.xxhash64(body).alias("mark"))

    hashes = with_shingles(d, F.col("text"), F.col("mark")).select("mark", F.size("h").alias("n"), F.explode("h").alias("h"))
    met = hashes.join(bounded(sketches(items)), "h").filter("n >= least").select("mark").distinct()
    met = bounded(met)

    own = with_shingles(d.join(met, "mark", "left_semi"), F.col("text"), F.col("id"), F.col("mark"))
    own = own.select("id", "mark", F.explode(F.array_distinct("h")).alias("h")).distinct()
    shared = own.join(bounded(items.select("item", "q", F.explode("h").alias("h"))), "h").groupBy("id", "mark", "item", "q").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(F.col("shared") * 100 >= F.col("q") * PERCENT).select(F.col("id").alias(id), F.col("item").alias(item), F.col("q").alias("item_shingles"), "shared", "mark")


def unused(name: str, df: DataFrame) -> str:
    """The name, lengthened until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clean(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, that hold no item."""
    own, mark = unused("__id", docs), unused("__mark", docs)
    marks = found.select(F.col(id).alias(own), F.col("mark").alias(mark)).distinct()
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.join(marks, F.col(f"`{id}`").eqNullSafe(F.col(own)) & (F.xxhash64(body) == F.col(mark)), "left_anti")
