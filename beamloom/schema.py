"""Schemas of the tables that cross module borders. Times are LONG picoseconds (``ts_ps``)."""

from pyspark.sql import types as T

PS_PER_S = 1_000_000_000_000
AGG_COUNTER_MOD = 1 << 23

HITS = T.StructType(
    [
        T.StructField("run", T.IntegerType()),
        T.StructField("serial", T.IntegerType()),
        T.StructField("ch", T.IntegerType()),
        T.StructField("ts_ps", T.LongType()),
        T.StructField("qlong", T.IntegerType()),
        T.StructField("qshort", T.IntegerType()),
        T.StructField("pur", T.BooleanType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("agg", T.IntegerType()),
        T.StructField("file_index", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("fine_ps", T.IntegerType()),
    ]
)

TRACES = T.StructType(
    [T.StructField(c, T.ArrayType(T.ShortType())) for c in ("wf1", "wf2")]
    + [T.StructField(c, T.ArrayType(T.BooleanType())) for c in ("dw1", "dw2", "dw3", "dw4")]
)

AGGS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("run", T.IntegerType()),
        T.StructField("serial", T.IntegerType()),
        T.StructField("file_index", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ev_start", T.LongType()),
        T.StructField("nev", T.IntegerType()),
        T.StructField("couple", T.IntegerType()),
        T.StructField("wpe", T.IntegerType()),
        T.StructField("counter", T.IntegerType()),
        T.StructField("t_first", T.LongType()),
        T.StructField("t_last", T.LongType()),
        T.StructField("words", T.LongType()),
        T.StructField("fmt", T.LongType()),
        T.StructField("agg_pos", T.LongType()),
    ]
)

CABLING = T.StructType(
    [
        T.StructField("serial", T.IntegerType()),
        T.StructField("channel", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("plane", T.IntegerType()),
        T.StructField("ch", T.IntegerType()),
    ]
)
