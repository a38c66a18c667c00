"""Side files of runs and of the experiment, read into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamloom.schema import CABLING

# Layout of a run-log row, size of a settings image, name of the expectation format.
STAMP = r"\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}:\d{2}"
RUN_ROW = rf"^(\d+),({STAMP}),(.*?)(?:,({STAMP}),(.*))?$"
COMMENT_HEAD = r"^(Start|Stop) Comment:\s*"
IMAGE_BYTES = 8192

RUN_FILE = (
    """format string, run int, prefix string, folder string,
    start struct<time: string, comment: string>,
    stop struct<time: string, run_ms: bigint, comment: string, problems: array<string>,
      clock: struct<unlocked: array<string>, lost_since_last_check: array<string>>>,
    clock struct<start: struct<unlocked: array<string>, lost_since_last_check: array<string>>>,
    led struct<enabled: boolean, delay_s: double, hold_s: double, events: array<struct<what: string, command: string, sent: string,
      run_ms: bigint, answered: string, reply: string, ok: boolean, switched: boolean, error: string>>>,
    boards array<struct<serial: int, model: string, dpp: string, channels: int, registers: map<string, string>>>"""
)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(run, start, start_comment, stop, stop_comment): the last row of a run counts; comments may hold commas."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_path").alias("file"))
    m = lines.filter(F.col("value").rlike(RUN_ROW))

    def part(i: int):
        return F.regexp_extract("value", RUN_ROW, i)

    rows = m.select(
        part(1).cast("int").alias("run"), part(2).alias("start"), F.regexp_replace(part(3), COMMENT_HEAD, "").alias("start_comment"),
        part(4).alias("stop"), F.regexp_replace(part(5), COMMENT_HEAD, "").alias("stop_comment"), "line",
    )
    last = rows.groupBy("run").agg(F.max_by(F.struct("start", "start_comment", "stop", "stop_comment"), "line").alias("r"))
    return last.select("run", "r.*")


def with_run_record(files: DataFrame, logs: DataFrame) -> DataFrame:
    """Files (path, run) with the record from the log in the file's folder, else in the folder above.

    ``logs``: run records with the folder of their log (``folder``)."""
    here = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    f = files.withColumn("_f0", here).withColumn("_f1", F.regexp_extract("_f0", r"^(.*)/[^/]+$", 1))
    cols = [c for c in logs.columns if c not in ("run", "folder")]
    a = logs.select("run", F.col("folder").alias("_f0"), F.struct(*cols).alias("_a"))
    b = logs.select("run", F.col("folder").alias("_f1"), F.struct(*cols).alias("_b"))
    j = f.join(a, ["run", "_f0"], "left").join(b, ["run", "_f1"], "left")
    return j.select(*files.columns, F.coalesce("_a", "_b").alias("_r")).select(*files.columns, "_r.*")


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per run file; a run without a stop is unfinished."""
    return spark.read.schema(RUN_FILE).option("multiLine", True).json(path)


def run_boards(runs: DataFrame) -> DataFrame:
    return runs.select("run", F.explode("boards").alias("b")).select("run", "b.serial", "b.model", "b.dpp", "b.channels")


def run_registers(runs: DataFrame) -> DataFrame:
    return runs.select("run", F.explode("boards").alias("b")).select("run", "b.serial", F.explode("b.registers").alias("name", "value"))


def run_led_events(runs: DataFrame) -> DataFrame:
    return runs.select("run", F.explode("led.events").alias("e")).select("run", "e.*")


def run_clock(runs: DataFrame) -> DataFrame:
    """The arrays the clock state is judged by."""
    return runs.select(
        "run",
        F.col("clock").isNotNull().alias("recorded"),
        F.col("clock.start.unlocked").alias("start_unlocked"),
        F.col("clock.start.lost_since_last_check").alias("start_lost"),
        F.col("stop.clock.unlocked").alias("stop_unlocked"),
        F.col("stop.clock.lost_since_last_check").alias("stop_lost"),
    )


def cabling(spark: SparkSession, path: str) -> DataFrame:
    c = spark.read.schema(CABLING).option("header", True).csv(path)
    return c.select("serial", "channel", F.trim("kind").alias("kind"), F.coalesce("plane", F.lit(-1)).alias("plane"), F.coalesce("ch", F.lit(0)).alias("ch"))


def per_channel(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Gains or time offsets per (serial, channel); the last row of a channel counts."""
    header = spark.read.option("header", True).csv(path).select(F.col("serial").cast("int"), F.col("channel").cast("int"), F.col(column).cast("double"))
    return header.withColumn("_i", F.monotonically_increasing_id()).groupBy("serial", "channel").agg(F.max_by(column, "_i").alias(column))


def momentum_map(spark: SparkSession, path: str, setting: str, min_n: int = 5) -> DataFrame:
    """Map rows of a setting; the count of calibration tracks may be missing as a column or in a row."""
    m = spark.read.option("header", True).csv(path)
    n = F.col("n_cal").cast("int") if "n_cal" in m.columns else F.lit(None).cast("int")
    rows = m.filter(F.col("setting") == setting).select(
        *[F.col(c).cast("int") for c in ("ch0", "ch1", "ch2")], F.col("p_mev").cast("double"), F.col("sigma_mev").cast("double"), n.alias("n_cal")
    )
    return rows.filter(F.col("n_cal").isNull() | (F.col("n_cal") >= min_n))


def channel_table(spark: SparkSession, path: str, setting: str) -> DataFrame:
    schema = "setting string, plane int, ch int, gang_width int, a_lo_mm double, a_hi_mm double"
    return spark.read.schema(schema).option("header", True).csv(path).filter(F.col("setting") == setting).drop("setting")


def settings_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, value) of settings images; files of another size are refused (left out)."""
    f = spark.read.format("binaryFile").load(path).filter(F.col("length") == IMAGE_BYTES)
    h = f.select("path", F.hex("content").alias("_h"))

    def byte(i, k: int):
        return F.substring(F.col("_h"), i * 8 + 1 + 2 * k, F.lit(2))

    def word(i):
        return F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("long")

    return h.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(IMAGE_BYTES // 4 - 1)), word)).alias("index", "value"))


def refused_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter(F.col("length") != IMAGE_BYTES).select("path", "length")


def cut_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(cut, points) of a cut file: a title line with ``======``, ``x,y`` lines, an end line with ``#==``."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("l"))
    body = F.slice("l", 1, F.greatest(F.array_position(F.transform("l", lambda x: x.contains("#==")), True) - 1, F.lit(0)).cast("int"))
    lines = t.select("file", F.when(F.array_contains(F.transform("l", lambda x: x.contains("#==")), True), body).otherwise(F.col("l")).alias("l"))
    x = lines.select("file", F.posexplode("l").alias("i", "s"))
    head = F.col("s").contains("======")
    w = Window.partitionBy("file").orderBy("i")
    named = x.withColumns({"at": F.max(F.when(head, F.col("i"))).over(w), "cut": F.last(F.when(head, F.regexp_replace("s", r"^\S+\s", "")), True).over(w)})
    j = named.filter(F.col("s").rlike(r"^[^,]+,[^,]+$") & ~head & F.col("at").isNotNull())
    p = F.struct(
        "i", F.trim(F.split("s", ",")[0]).cast("float").cast("double").alias("x"), F.trim(F.split("s", ",")[1]).cast("float").cast("double").alias("y")
    )
    g = j.groupBy("file", "at", "cut").agg(F.array_sort(F.collect_list(p)).alias("_p"))
    return g.select("cut", F.transform("_p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


def expectation(spark: SparkSession, path: str, wanted_format: str) -> tuple[DataFrame, DataFrame]:
    """(channel shares, momentum bins) of a published expectation; another format, or a missing block, gives no rows."""
    schema = """format string, settings map<string, string>, map map<string, string>,
      planes map<string, struct<plane: int, n_channels: int, share: array<double>, x_lo_mm: array<double>, x_hi_mm: array<double>>>,
      momentum struct<bin_edges_MeV: array<double>, read_with_finder_map: struct<per_beam_particle: array<double>, by_kind: map<string, array<double>>>>"""
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    d = d.filter((F.col("format") == wanted_format) & F.col("settings").isNotNull() & F.col("map").isNotNull() & F.col("planes").isNotNull())
    pl = d.select(F.explode("planes").alias("name", "p")).select("name", "p.plane", F.posexplode(F.arrays_zip("p.share", "p.x_lo_mm", "p.x_hi_mm")).alias("i", "z"))
    shares = pl.select("name", "plane", (F.col("i") + 1).alias("ch"), F.col("z.share").alias("share"), F.col("z.x_lo_mm").alias("x_lo_mm"), F.col("z.x_hi_mm").alias("x_hi_mm"))
    m = d.select("momentum.bin_edges_MeV", F.col("momentum.read_with_finder_map").alias("r"))
    mom = m.select(F.posexplode("r.per_beam_particle").alias("bin", "n"), F.col("r.by_kind").alias("k"), F.col("bin_edges_MeV").alias("e"))
    mom = mom.select("bin", F.get("e", F.col("bin")).alias("lo"), F.get("e", F.col("bin") + 1).alias("hi"), "n", F.coalesce(F.get(F.col("k")["e-"], F.col("bin")), F.lit(0.0)).alias("n_electron"))
    return shares, mom


LIMITS = """channels array<struct<id: string, name: string, grp: string, source: string, scale: double, offset: double, unit: string,
  digits: int, range: array<double>, connected: boolean, rules: array<struct<at_or_above: double, above: double, below: double,
  change: double, within_s: int, level: string, when: map<string, string>>>>>, modes map<string, struct<value: string>>"""


def limits(spark: SparkSession, path: str, defaults: str | None = None) -> DataFrame:
    """The limits document; where it cannot be read (no rows, or a corrupt document) the defaults file is used."""
    def load(p: str) -> DataFrame:
        d = spark.read.schema(LIMITS).option("multiLine", True).option("mode", "DROPMALFORMED").json(p)
        return d.filter(F.col("channels").isNotNull())

    d = load(path)
    return load(defaults) if defaults and d.isEmpty() else d


def limit_channels(doc: DataFrame) -> DataFrame:
    c = doc.select(F.explode("channels").alias("c"))
    safety = F.exists(F.coalesce("c.rules", F.array()), lambda r: r["level"].isin("warn", "bad", "critical"))
    return c.select(
        F.regexp_replace("c.source", r"^plc\.", "").alias("input"), "c.id", "c.name", F.col("c.grp").alias("grp"), F.coalesce("c.scale", F.lit(1.0)).alias("scale"),
        F.coalesce("c.offset", F.lit(0.0)).alias("offset"), F.get("c.range", F.lit(0)).alias("lo"), F.get("c.range", F.lit(1)).alias("hi"),
        F.coalesce("c.connected", F.lit(True)).alias("connected"), F.coalesce(safety, F.lit(False)).alias("safety"),
    )


def limit_rules(doc: DataFrame) -> DataFrame:
    r = doc.select(F.explode("channels").alias("c")).select(F.regexp_replace("c.source", r"^plc\.", "").alias("input"), "c.id", F.posexplode("c.rules").alias("i", "r"))
    op = F.when(F.col("r.at_or_above").isNotNull(), "at_or_above").when(F.col("r.above").isNotNull(), "above").when(F.col("r.below").isNotNull(), "below").otherwise("change")
    lim = F.coalesce("r.at_or_above", "r.above", "r.below", "r.change")
    return r.select(
        F.concat_ws("#", "id", "i").alias("rule"), "input", op.alias("op"), lim.alias("limit"), "r.within_s", "r.level",
        F.coalesce("r.when", F.create_map().cast("map<string,string>")).alias("when"),
    )


def modes(doc: DataFrame) -> DataFrame:
    return doc.select(F.explode("modes").alias("mode", "m")).select("mode", F.col("m.value").alias("present"))


def slow_control_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as they are dropped into a folder: one JSON object per line (t, input, raw)."""
    return spark.readStream.schema("t bigint, input string, raw double").json(folder)


def control_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of flat control documents; the lists of boards become one key per board."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "map<string,string>").alias("m"))
    kv = d.select("path", F.explode("m").alias("key", "value"))
    lists = kv.filter(F.col("value").startswith("[")).select("path", "key", F.explode(F.from_json("value", "array<string>")).alias("v"))
    maps = kv.filter(F.col("value").startswith("{")).select("path", "key", F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    return (
        kv.filter(~F.col("value").rlike(r"^[\[{]"))
        .unionByName(lists.select("path", F.concat("key", F.lit("."), "v").alias("key"), F.lit("yes").alias("value")))
        .unionByName(maps.select("path", F.concat("key", F.lit("."), "k").alias("key"), F.col("v").alias("value")))
    )
