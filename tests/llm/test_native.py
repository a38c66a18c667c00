"""Sharding and decontamination."""

import zlib

from pyspark.sql import functions as F

from beamloom.llm import decontaminate, sharding
from tests.llm.data import documents, frame, words
from tests.llm.test_jaccard import plain_set


def test_shards_follow_weights_and_only_the_new_one_takes(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("clash"))
    got = sharding.assign(keys, "doc_id", [1.0, 2.0, 1.0], grown_weight=4.0).collect()
    share = [sum(r.shard == s for r in got) / len(got) for s in range(3)]
    assert abs(share[0] - 0.25) < 0.02 and abs(share[1] - 0.5) < 0.02
    assert all(r.grown_shard in (3, r.shard) for r in got)
    assert abs(sum(r.grown_shard == 3 for r in got) / len(got) - 0.5) < 0.02
    same = {r.doc_id: r.grown_shard for r in got}
    again = sharding.assign(keys, "doc_id", [1.0, 2.0, 1.0, 4.0]).collect()
    assert all(same[r.doc_id] == r.shard for r in again)


def test_slots_are_gapless_with_a_hot_key(spark):
    rows = documents() + [(7, "hot")] * 3000
    df = frame(spark, rows).select("doc_id", "shard", F.octet_length("text").alias("size"))
    got = sharding.number(sharding.assign(df, "doc_id", [1.0] * 4), "shard", "doc_id", ["size"], 4).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))
    for key in {r.doc_id for r in got}:
        assert len({r.shard for r in got if r.doc_id == key}) == 1
    empty = frame(spark, []).select("doc_id", "shard", F.lit(1).alias("size"))
    assert sharding.number(sharding.assign(empty, "doc_id", [1.0]), "shard", "doc_id", ["size"], 1).count() == 0


def test_items_found_as_by_brute_force(spark):
    items = [(1, words(20, 900)), (2, words(9, 901)), (3, "one two three four"), (4, "one two three four five"), (5, None), (6, ""), (7, words(120, 1)), (None, words(15, 902)), (8, words(40, 903)), (1, words(20, 900))]
    eight = words(40, 903).split(" ")
    docs = documents() + [
        (101, words(5000, 3) + " " + words(20, 900).upper() + "\n" + words(3000, 4)), (102, words(9, 901)), (103, "x " + " ".join(eight[:33]) + " y"), (104, "x " + " ".join(eight[:30]) + " y"), (105, words(15, 902) + " tail"), (101, "clean " + words(50, 5)),
    ]
    got = decontaminate.find(frame(spark, docs), frame(spark, items, "item_id long, text string")).select("doc_id", "item_id", "item_shingles", "shared")
    want = set()
    for i, t in docs:
        a = {tuple(x.lower() for x in s) for s in plain_set(t)}
        for k, u in items:
            b = {tuple(x.lower() for x in s) for s in plain_set(u)}
            if b and 100 * len(a & b) >= 80 * len(b):
                want.add((i, k, len(b), len(a & b)))
    assert {tuple(r) for r in got.collect()} == want
    assert {(103, 8), (101, 1), (105, None)} <= {(a, b) for a, b, _, _ in want} and (104, 8) not in {(a, b) for a, b, _, _ in want}


def test_clean_takes_only_the_texts_that_hold_an_item(spark):
    docs = frame(spark, [(1, "a b c d e f"), (1, "kept text of that id"), (None, "a b c d e f"), (2, None), (3, "")])
    bench = spark.createDataFrame([(9, "a b c d e f")], "item_id long, text string")
    left = decontaminate.clean(docs, decontaminate.find(docs, bench))
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == [(1, "kept text of that id"), (2, None), (3, "")]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, decontaminate.find(docs, none)).count() == 5
    assert decontaminate.find(frame(spark, []), bench).count() == 0


def test_no_item_needs_a_longer_sketch():
    for q in range(1, 3000):
        u = 1 << q.bit_length()
        assert u // 5 + 1 > q // 5 and -(-u * 2 // 5) <= -(-4 * q // 5)


def test_crc_of_the_query(spark):
    assert spark.range(1).select(F.crc32(F.lit("añ").cast("binary")).alias("c")).first().c == zlib.crc32("añ".encode())
