"""Rendezvous hashing of record keys over weighted shards; DataFrame functions only.

For each key and shard a hash gives a number u in (0, 1); the shard with the least -ln(u) / weight gets the record. A
shard gets keys in proportion to its weight, and one more shard takes keys only into itself: the others' numbers stay.

A null key is one key of its own. Equal keys always share a shard. Extra columns pass through; a column named like an
added one is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beamloom.session import cut

#: Bits of a hash that are used, as hexadecimal digits: exact in a double.
DIGITS = 13


def _number(text: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("long")


def _key_text(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def distance(key: Column, shard: Column, weight: Column) -> Column:
    """The least one wins."""
    u = (_number(F.concat(_key_text(key), F.lit("#"), shard.cast("string")).cast("binary"), 1, DIGITS) + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return -F.log(u) / weight


def assign(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None, out: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """All columns and ``out``, the shard of 0..len(weights) - 1; no shuffle.

    With ``grown_weight`` also ``grown``, the shard once a further one of that weight is added.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    k, w = F.col(f"`{key}`"), F.array(*[F.lit(float(x)) for x in weights])
    marks = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(distance(k, s, F.get(w, s)).alias("d"), s.alias("s")))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, grown, "__best")]
    best = df.select(*kept, F.array_min(marks).alias("__best"))
    found = best.withColumn(out, F.col("__best.s"))
    if grown_weight is not None:
        new = distance(k, F.lit(len(weights)), F.lit(float(grown_weight)))
        found = found.withColumn(grown, F.when(new < F.col("__best.d"), F.lit(len(weights))).otherwise(F.col("__best.s")))
    return found.drop("__best")


def number(df: DataFrame, shard: str, key: str, order: Sequence[str], n_shards: int, digits: int = 2, out: str = "slot") -> DataFrame:
    """The columns ``shard``, ``key`` and ``order``, and ``out``, gapless numbers from 0 within each shard.

    A shard is numbered in 16**digits ranges of the key's hash side by side, so no shard is ever sorted in one task. Rows
    that agree in all these columns are counted before the shuffle and laid out again afterwards, so one key may hold any
    share of the rows.
    """
    columns = list(dict.fromkeys([shard, key, *order]))
    part = _number(F.concat(_key_text(F.col(key)), F.lit("#slot")).cast("binary"), 1, digits).cast("int")
    groups = cut(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__part", part), "shard-groups")
    ends = groups.groupBy(shard, "__part").agg(F.sum("__n").alias("__rows"))
    # n_shards * 16**digits rows at most
    starts = ends.select(shard, "__part", (F.sum("__rows").over(W.partitionBy(shard).orderBy("__part")) - F.col("__rows")).alias("__start"))
    within = W.partitionBy(shard, "__part").orderBy(*[F.col(c).asc_nulls_first() for c in columns if c != shard])
    placed = groups.withColumn("__own", F.sum("__n").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n"))
    if n_shards * 16**digits <= 1_000_000:
        starts = F.broadcast(starts)
    first = F.col("__start") + F.col("__own")
    return placed.join(starts, [shard, "__part"]).select(*columns, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(out))
