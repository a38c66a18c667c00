"""Tables and texts written out of hits, events and summaries."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_hits(hits: DataFrame, drop_pur: bool = False) -> DataFrame:
    """Single-hit table (bd, ch, e, e_t in ns)."""
    h = hits.filter(~F.col("pur")) if drop_pur else hits
    return h.select(F.col("board").alias("bd"), "ch", F.col("qlong").alias("e"), F.expr("ts_ps div 1000").alias("e_t"))


def line_protocol(measure: str, tags: dict[str, str], value: Column) -> Column:
    """``measure,Tag=x,... value=v`` text; tag values are column names."""
    parts = [F.lit(measure)]
    for t, c in tags.items():
        parts += [F.lit(f",{t}="), F.col(c).cast("string")]
    return F.concat(*parts, F.lit(" value="), value.cast("string"))


def rate_lines(rates: DataFrame, board: str = "board", ch: str = "ch", rate: str = "rate") -> DataFrame:
    """Trigger rates of an interval, one line per channel."""
    return rates.select(line_protocol("TrigRate", {"Bd": board, "Ch": ch}, F.format_string("%.6f", F.col(rate))).alias("value"))


def cut_lines(rates: DataFrame) -> DataFrame:
    return rates.select(line_protocol("Cut", {"name": "cut"}, F.format_string("%.6f", F.col("rate"))).alias("value"))


def trace_rows(hits: DataFrame, keys: list[str], dual: bool = False) -> DataFrame:
    """One row per sample; in dual-trace data the analog samples stand on every second row."""
    if dual:
        pairs = F.arrays_zip("wf1", "wf2", F.transform(F.sequence(F.lit(0), F.size("wf1") - 1), lambda i: F.get(F.col("dw1"), i * 2)).alias("dw1a"))
        x = hits.select(*keys, F.posexplode(pairs).alias("i", "s"))
        return x.select(*keys, (F.col("i") * 2).alias("sample"), F.col("s.wf1").alias("wf1"), F.col("s.wf2").alias("wf2"))
    x = hits.select(*keys, F.posexplode("wf1").alias("sample", "wf1"))
    return x


def registers_text(image: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Register values with their names, as written beside a run."""
    return image.join(dictionary.select("index", "name"), "index").select(
        "board", "name", F.format_string("0x%08X", F.col("value")).alias("hex"), "value"
    )


def manifest(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, sha256, bytes, missing) of the analysis files of a run. ``files`` as read by binaryFile."""
    f = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    return wanted.join(f, "source", "left").withColumn("missing", F.col("sha256").isNull())


def plain_json(document) -> str:
    """The document as JSON; NaN and infinities, which JSON lacks, are written as their names in quotes."""
    return json.dumps(json.loads(json.dumps(document), parse_constant=str))


def run_summaries(parts: dict[str, DataFrame], key: str = "run") -> DataFrame:
    """One JSON document per run from small per-run aggregates; each part becomes a list in the document."""
    out = None
    for name, df in parts.items():
        cols = [c for c in df.columns if c != key]
        p = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = p if out is None else out.join(p, key, "full_outer")
    body = F.struct(F.lit("run-summary").alias("format"), F.lit(1).alias("version"), F.col(key), *[F.col(n) for n in parts])
    return out.select(key, F.to_json(body).alias("doc"))


def write_whole(path: str, doc: dict) -> None:
    """A small document, whole or not at all: written beside, then renamed."""
    tmp = f"{path}.part"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(plain_json(doc))
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)
