"""The given tables read as detector data, each adapter stated once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

US_PER_S = 1_000_000
RUN_US = 7 * 86_400 * US_PER_S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a hit stream. One microsecond stands for one picosecond unit of ``ts_ps``; a run is a week."""
    e = read(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int")
    slot = (F.col("user_id") % 48).cast("int")
    q = F.pmod(F.floor(F.col("value") * 100), F.lit(65536)).cast("int")
    base = e.select(
        F.col("event_id").alias("pos"), t.alias("ts_ps"), slot.alias("slot"), q.alias("qlong"), k.alias("k"), "event_type"
    )
    return base.select(
        F.expr(f"cast(ts_ps div {RUN_US} as int)").alias("run"),
        (F.lit(1000) + F.expr("slot div 16")).cast("int").alias("serial"),
        F.expr("cast(slot div 16 as int)").alias("board"),
        (F.col("slot") % 16).cast("int").alias("ch"),
        "slot", "ts_ps", "qlong",
        F.expr("cast(qlong * k div 100 as int)").alias("qshort"),
        (F.col("event_type") == "error").alias("pur"),
        F.expr("cast(k % 64 as int)").alias("flags"),
        F.expr("cast(pos % 8388608 as int)").alias("agg"),
        F.lit(0).alias("file_index"),
        "pos",
    )


HITS_SQL = f"""hits AS (
  SELECT CAST(epoch_us(ts) // {RUN_US} AS INT) AS run, CAST(1000 + (user_id % 48) // 16 AS INT) AS serial,
    CAST((user_id % 48) // 16 AS INT) AS board, CAST((user_id % 48) % 16 AS INT) AS ch, CAST(user_id % 48 AS INT) AS slot,
    epoch_us(ts) AS ts_ps, CAST(floor(value * 100) AS BIGINT) % 65536 AS qlong,
    (CAST(floor(value * 100) AS BIGINT) % 65536) * CAST(props->>'$.k' AS INT) // 100 AS qshort,
    event_type = 'error' AS pur, CAST(props->>'$.k' AS INT) % 64 AS flags, event_id AS pos
  FROM events)"""


def as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as built events: an order is an event, a line a hit."""
    l = read(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("ev"), F.col("l_linenumber").alias("ch"),
        F.col("l_quantity").alias("e"), F.col("l_extendedprice").alias("e2"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        # several lines may share order and number; this makes the order of hits total
        (
            F.col("l_linenumber").cast("long") * 100_000_000_000_000_000
            + F.round(F.col("l_extendedprice") * 100).cast("long") * 1_000_000_000
            + F.col("l_partkey") % 100_000 * 10_000
            + F.col("l_suppkey") % 10_000
        ).alias("pos"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)").alias("t"),
    )


EVENTS_SQL = """evs AS (
  SELECT l_orderkey AS ev, l_linenumber AS ch, l_quantity AS e, l_extendedprice AS e2, l_partkey AS part, l_suppkey AS supp,
    CAST(l_linenumber AS BIGINT) * 100000000000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) * 1000000000 + l_partkey % 100000 * 10000 + l_suppkey % 10000 AS pos, epoch_us(l_shipdate) AS t
  FROM lineitem)"""
