"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local work; on a cluster the submitting side sets master and sizes."""
    b = (
        SparkSession.builder.master(master)
        .appName("beamloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Written tables that other tasks read again live here, so that a lost executor never loses them.
    Only where ``spark.checkpoint.dir`` is unset (tests on one machine) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


#: With it, a query's shuffle files go when it ends; without it, when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: computed once, and safe from lost executors.

    What was shuffled for it is freed at once. ``discard`` deletes the table itself.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` has written, when nothing that is still to run reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.cut_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
