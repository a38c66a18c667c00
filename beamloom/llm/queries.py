"""The named queries of this folder: each applies one operator to its whole table and derives the asked columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.llm import audit, boilerplate, bpe, chat, decontaminate, merkle, partenum, quality, sharding, tokens, topk, urlgraph, warc
from beamloom.llm.sql import audit_sql, decontaminate_sql, merkle_sql, sharding_sql, topk_sql, warc_sql
from beamloom.plans.adapters import read
from beamloom.plans.catalogue import Catalogue
from beamloom.session import cut, scratch_dir

C = Catalogue()


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; only the queries that need one ask for the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_files() -> tuple[str, str]:
    """File of ranks and pattern of the byte-level BPE."""
    import public_tokenizers

    return tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@C.query("op1_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@C.query("op4_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(read(spark, sf_dir, "documents").select("doc_id", "text"), *bpe_files()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@C.query("op3_topk", topk_sql())
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", "rank", "vec_id", "score")


SHARDS = [1.0] * 24


@C.query("op6_sharding", sharding_sql())
def sharding_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = sharding.assign(docs, "doc_id", SHARDS, grown_weight=1.0)
    numbered = sharding.number(placed, "shard", "doc_id", ["size", "text_crc32", "grown_shard"], len(SHARDS))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@C.query("op8_warc", warc_sql())
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = scratch_dir(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), archive)
    return pages_of(warc.assemble(warc.read(spark, archive)))


def pages_of(captures: DataFrame) -> DataFrame:
    """Pages with the digests of the bytes read; fails if a record is cut or damaged, or its response is missing."""
    key = F.regexp_extract(F.decode("metadata.payload", "UTF-8"), r"key: (-?\d+)", 1)
    flat = captures.select(
        "record_id", "type", "refers_to", F.when(key != "", key.cast("long")).alias("page_id"), "payload_bytes", "payload_digest", "stated_digest", (F.col("complete") & F.coalesce("metadata.complete", F.lit(True)) & F.coalesce("request.complete", F.lit(True))).alias("complete")
    )
    flat = cut(flat, "captures")
    proved = warc.proved("complete", "stated_digest", "payload_digest", "record_id").alias("payload_digest")
    responses = flat.filter("type = 'response'").select("record_id", "page_id", "payload_bytes", proved)
    stored = responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("first"), F.max("payload_bytes").alias("full"), F.min("payload_digest").alias("of_first"))
    again = flat.filter("type = 'revisit'").join(stored, "refers_to", "left")
    again = again.select("page_id", F.col("full").alias("payload_bytes"), warc.proved("complete", "stated_digest", "of_first", "record_id").alias("payload_digest"), F.col("type").alias("record_type"), F.col("first").alias("refers_to"))
    first = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again)


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@C.query("op9_url_filters", urlgraph.judge_sql(RULES))
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(read(spark, sf_dir, "pages"), RULES)


@C.query("op10_chat")
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(read(spark, sf_dir, "conversations"))


@C.query("op2_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.classes(read(spark, sf_dir, "documents"))


@C.query("op5_quality")
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@C.query("op7_decontaminate", decontaminate_sql())
def benchmark_items_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "item_shingles", "shared")


@C.query("op11_filter_audit", audit_sql())
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = audit.text_filters(F.col("text"))
    return audit.audit(audit.masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), filters), "".join(filters) + "E")


@C.query("op12_merkle", merkle_sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    row = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    small = F.translate("text", audit.UPPER, audit.UPPER.lower())
    tampered = F.when(changed, F.unhex(merkle.leaf_digest([F.col(c) for c in row[:-1]] + [small])))
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest([F.col(c) for c in row]).alias("leaf"), tampered.alias("tampered"))
    found = merkle.manifest(leaves, "lang", "doc_id", carried=["tampered"])
    folded = merkle.fold(F.coalesce(F.lower(F.hex("tampered")), "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@C.query("op13_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
