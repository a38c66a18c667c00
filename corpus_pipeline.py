"""A corpus pipeline of four stages over ``documents``; each stage's rows are written and read again by the next one.

All but the last return the columns of their documents, extra ones included, whatever their names. A null text is an empty one
for every stage. Ids are whole numbers or null; others end the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.llm import bpe, decontaminate, partenum, quality
from beamloom.llm.queries import bpe_files
from beamloom.session import cut, discard


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 1/2 or more, learnt from the labelled ones among them that are not held out."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = decontaminate.unused("__score", docs)
    return quality.score(docs, model, out=score).filter(f"{score} >= 0.5").drop(score)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id; rows without an id stay.

    Rows that share an id and are equal in all columns are one document; those that differ all stay, unless their own text
    links to another document. Of the texts of one id, one counts under the id and the others after all ids.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    several = rows.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("count"), F.min("mark").alias("low"), F.max("mark").alias("high")).filter("count > 1")
    repeated = partenum.broadcast_ids(several.select("id", "low", "high"))
    texts = rows.join(repeated.filter("low < high"), "id").filter("mark > low").select("id", "mark").distinct()
    top = rows.agg(F.max("id")).first()[0] or 0
    texts = partenum.broadcast_ids(texts.withColumn("later", F.lit(top) + 1 + F.monotonically_increasing_id()))
    keyed = rows.join(texts, ["id", "mark"], "left").withColumn("key", F.coalesce("later", "id"))
    found = partenum.classes(keyed.select("key", "text"), "key")
    others = partenum.broadcast_ids(found.filter("component_id < key").select("key").distinct())
    kept = keyed.join(others, "key", "left_anti").select("row", "id")
    of_many = repeated.select("id")
    return kept.join(of_many, "id", "left_anti").select("row.*").unionByName(kept.join(of_many, "id", "left_semi").select("row").distinct().select("row.*"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source, the ids of the text, their number, and whether they decode to the text's very bytes."""
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    back = bpe.encode_and_decode(docs.select(*kept, F.coalesce("text", F.lit("")).alias("text")), *bpe_files())
    return back.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", keep_clean),
    ("byte-level BPE", encode_texts),
]

#: The classifier and the encoding can't be said in SQL; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted, and what it shuffled freed, when the next one has written its own."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(*before)
        before = [docs]
    return docs
