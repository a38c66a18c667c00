"""WARC archives, URL filters and transcripts."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from beamloom.llm import chat, urlgraph, warc
from beamloom.llm.queries import RULES, pages_of
from beamloom.session import scratch_dir


def test_archive_round_trip(spark):
    big = "<p>é</p>" * 40
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5
    rows = [(5, "http://a.org/x", big), (3, "http://b.org", big), (4, None, big), (1, "u\r\nv", tricky), (2, "", None), (6, "http://c", "short"), (7, "http://d", "short"), (None, "http://e", big), (None, "http://f", "n" * 200), (8, "://", "z" * 1_000_000), (3, "http://b.org", big)]
    path = scratch_dir(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")), path)
    records = warc.read(spark, path)
    assert {(r.type, r["count"]) for r in records.groupBy("type").count().collect()} >= {("request", 11), ("metadata", 11)}
    assert records.filter("NOT complete").count() == 0
    got = warc.assemble(records).select("type", "uri", "payload", F.decode("metadata.payload", "UTF-8").alias("m"), F.col("request.record_id").isNotNull().alias("r"), "stated_digest").collect()
    assert len(got) == len(rows) and all(r.r for r in got)
    want = sorted(("revisit" if h == big and i != 3 else "response", "" if i is None else f"key: {i}\r\n", "" if h == big and i != 3 else h or "", "sha256:" + hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((r.type, r.m, r.payload.decode(), r.stated_digest) for r in got) == want
    assert "u%0D%0Av" in {r.uri for r in got}


def test_empty_archive_and_damage(spark):
    path = scratch_dir(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read(spark, path)).count() == 0
    cut = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 10\r\n\r\nabc"
    assert [(r[0], r[6], r[7]) for r in warc.records_of(cut)] == [("metadata", False, 3)]


def test_damaged_payloads_do_not_pass(spark):
    path = scratch_dir(spark, "warc-test")
    warc.write(spark.createDataFrame([(1, "http://a", "p" * 200), (2, "http://b", "p" * 200), (3, "http://c", "short")], "page_id long, url string, html string"), path)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect()).encode()

    def got(data):
        rows = spark.createDataFrame(list(warc.records_of(data)), warc.RECORD)
        return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in pages_of(warc.assemble(rows)).collect())

    long, short = (hashlib.sha256(x).hexdigest() for x in (b"p" * 200, b"short"))
    assert got(text) == [(1, 200, long, "response"), (2, 200, long, "revisit"), (3, 5, short, "response")]
    at, kind = text.index(b"short"), b"WARC-Type: response"
    gone = text.rindex(kind, 0, text.index(b"p" * 200))
    for bad in (text.replace(b"p" * 200, b"p" * 199 + b"q"), text.replace(b"\r\n\r\nshort", b"\r\n\r\nshirt"), text[: at + 2], text[:gone] + b"WARC-Type: resource" + text[gone + len(kind) :]):
        with pytest.raises(PySparkException, match="damaged record"):
            got(bad)


def plain_ranks(edges, seeds, rounds):
    out = {}
    for a, _ in edges:
        out[a] = out.get(a, 0) + 1
    start = {h: 10**12 // len(seeds) for h in seeds}
    rank = dict(start)
    for _ in range(rounds):
        new = {h: r * 15 // 100 for h, r in start.items()}
        for a, b in edges:
            if a in rank:
                new[b] = new.get(b, 0) + rank[a] * 85 // (100 * out[a])
        rank = new
    return rank


def test_ranks_and_verdicts(spark):
    link = lambda *hosts: "".join(f'<a class=x HREF = "https://{h}/p">' for h in hosts)
    rows = [
        (1, "http://good.org/a", link("near.net", "Near.NET", "good.org")), (2, "http://bad.com/de/x", link("other.net")), (3, "http://farm.net/", link("bad.com")), (4, "http://near.net/q", None),
        (5, "HTTP://FARM.net?x=://y", link("bad.com")), (6, None, link("bad.com")), (7, "no host", ""), (8, "http://www.example.org/es/1", ""), (9, "http://example.org/en/12", ""), (10, "http://x.org", ""), (11, "http://é.ORG/", ""), (None, "http://sub.bad.com/fr/1#f", ""), (3, "http://farm.net/", link("bad.com")),
    ]
    got = sorted(map(tuple, urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")), RULES).collect()), key=repr)
    verdicts = {(r[0], r[3], r[4]) for r in got}
    assert verdicts == {
        (1, "org/", "allow"), (2, "com/de/", "block"), (3, None, "block"), (4, None, "allow"), (5, None, "block"), (6, None, "allow"), (7, None, "allow"), (8, "example.org/es/", "block"), (9, "example.org/en/1", "block"), (10, None, "allow"), (11, "org/", "allow"), (None, "com/fr/", "allow"),
    }
    assert len(got) == len(rows)
    edges = [("good.org", "near.net"), ("bad.com", "other.net"), ("farm.net", "bad.com")]
    trust = plain_ranks(edges, ["good.org", "é.org", "sub.bad.com"], 6)
    distrust = plain_ranks([(b, a) for a, b in edges], ["bad.com", "www.example.org", "example.org"], 6)
    assert all(r[5] == trust.get(r[1], 0) and r[6] == distrust.get(r[1], 0) for r in got)
    assert urlgraph.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_far_hosts_and_those_behind_hubs_are_judged(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">' for h in hosts)
    chain = [(i, f"http://c{i}.net/", link(f"c{i + 1}.net" if i < 14 else "bad.com")) for i in range(15)]
    # each hub hands its distrust to 200 hosts, of which one is the next hub: 200**6 is above 10**12
    hubs = [(1000 * k + i, f"http://h{k}x{i}.net/", link(f"h{k - 1}x0.net" if k > 1 else "bad.com")) for k in range(1, 8) for i in range(200)]
    rows = [(90000, "http://bad.com/de/", ""), *chain, *hubs]
    got = {r.page_id: r for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert len(got) == len(rows) and {r.verdict for r in got.values()} == {"block"}
    assert abs(got[0].distrust - 10**12 * 0.15 * 0.85**15 / 201) < 1


def test_ranks_of_a_loop_come_near_their_fixed_point(spark):
    edges = spark.createDataFrame([("trust", "a", "b"), ("trust", "b", "a")], "kind string, src string, dst string")
    got = {r.host: int(r["rank"]) / urlgraph.SCALE / urlgraph.FINE for r in urlgraph.spread(edges, edges.filter("src = 'a'").select("kind", F.col("src").alias("host")), tolerance=100).collect()}
    a = 0.15 / (1 - 0.85**2)
    assert 0.93 * a < got["a"] <= a and 0.93 * 0.85 * a < got["b"] <= 0.85 * a


def test_hosts_and_paths_of_odd_urls(spark):
    rows = [("a://B.c?x/y", "b.c", ""), ("x://h#f/p", "h", ""), ("s://h/p/q?r#s", "h", "/p/q"), ("://", "", ""), ("a:b://c://d/e", "c:", "//d/e"), (None, "", ""), ("s://h/a\nb?c", "h", "/a\nb")]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string").select("url", F.coalesce(urlgraph.host_of(F.col("url")), F.lit("")).alias("h"), F.coalesce(urlgraph.path_of(F.col("url")), F.lit("")).alias("p"))
    assert [tuple(r) for r in df.collect()] == rows


def score_of(codes, path):
    s = chat.START[path[0]] + chat.EVIDENCE[codes[0]][path[0]]
    return s + sum(chat.STEPS[c][a, b] for c, a, b in zip(codes[1:], path, path[1:]))


def test_viterbi_in_chunks_is_the_best_of_all_paths():
    r = random.Random(1)
    for _ in range(60):
        codes = [r.randrange(len(chat.STEPS)) for _ in range(7)]
        best = max(score_of(codes, p) for p in itertools.product(range(3), repeat=7))
        assert score_of(codes, chat.decoded(codes, None, None)) == best
        cut = r.randint(1, 6)
        a, b = codes[:cut], codes[cut:]
        first = chat.START + chat.EVIDENCE[a[0]]
        for c in a[1:]:
            first = (first[:, None] + chat.STEPS[c]).max(axis=0)
        last = chat.ends(first.tolist(), [chat.product(b)])
        assert score_of(codes, chat.decoded(a, None, last[0]) + chat.decoded(b, last[0], last[1])) == best


def test_transcripts(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, None, "User: what is it?\nmore of it\nAssistant: a thing.\n### Human\nand that?"), (1, 2, "bot", "<|assistant|> yes"), (2, 0, "human", None), (2, 1, "strange", "an answer to that"), (2, 1, "strange", "an answer to that"), (None, 0, "user", "alone"), (None, 0, "user", "alone too"), (3, None, None, ""), (4, 5, "assistant", "first said\r\nsecond"),
    ]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"chunk": F.lit("c"), "conv": F.lit("c"), "lines": F.lit(1)})).collect()
    turns = sorted(((r.conv_id, r.turn, r.part, r.role, r.text) for r in got if r.conv_id in (1, 2)), key=repr)
    assert turns == [
        (1, 0, 0, "system", "Be kind."), (1, 1, 0, "user", "what is it?\nmore of it"), (1, 1, 1, "assistant", "a thing."), (1, 1, 2, "user", "\nand that?"), (1, 2, 0, "assistant", "yes"), (2, 0, 0, "user", ""), (2, 1, 0, "assistant", "an answer to that"),
    ]
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>" for r in got)
    assert sum(r.conv_id is None for r in got) == 2 and {(r.role, r.text) for r in got if r.conv_id == 4} == {("assistant", "first said\nsecond")}
    assert chat.parse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversation_in_chunks_keeps_its_roles(spark):
    rows = [(1, i, (None, "user", "assistant")[0 if i % 5 else 1 + i % 2], f"line {i}" + ("?" if i % 2 == 0 else ".")) for i in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r.turn, r.part): r.role for r in chat.parse(table).collect()}
    parts = {(r.turn, r.part): r.role for r in chat.parse(table, chunk=16).collect()}
    seen = {r.turn: [x.code for x in r.lines] for r in table.select("turn", F.transform(F.split("text", "\n"), lambda x, i: F.struct(chat._seen(x, i, F.coalesce("role", F.lit(""))).alias("code"))).alias("lines")).collect()}
    codes = [c for i in range(300) for c in seen[i]]
    place = lambda got: [chat.ROLES.index(got[i, 0]) for i in range(300)]
    assert score_of(codes, place(whole)) == score_of(codes, place(parts)) == int(np.max(score_of(codes, chat.decoded(codes, None, None))))


def test_long_rows_keep_their_stated_roles(spark):
    kinds = {"short": "x = 1", "middle": "m" * 100, "long": "l" * 300, "blank": "", "question": "is it so?", "mixed": "l" * 300 + "\n\nwhy?\n"}
    rows = [(3 * k + j, t, r, "\n".join([kind] * n)) for k, (n, kind) in enumerate(itertools.product((1, 5, 12, 30, 400), kinds.values())) for j, r in enumerate(("user", "assistant", "system")) for t, r, kind, n in [(0, "user", "and now?", 1), (1, r, kind, n), (2, "assistant" if r == "user" else "user", "so be it", 1)][1 if r != "assistant" else 0 :]]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.part, r.role, r.text) for r in got) == sorted((c, t, 0, r, x) for c, t, r, x in rows)


def test_markers_stay_where_no_turn_begins(spark):
    said = ["the choice\nAnswer: 42\nso it is", "a list\nModel: X100", "pick\nA: first option", "**Answer:** 1\n[bot] 2"]
    rows = [(i, t, r, x) for i, text in enumerate(said) for t, r, x in [(0, "user", "A: first, or B?"), (1, "assistant", text), (2, "user", "thanks")]]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in got) == sorted((*r[:3], r[3].removeprefix("**Answer:** ")) for r in rows)


def test_rows_without_ids_are_each_a_conversation(spark):
    rows = [(None, 0, "user", "same"), (None, 0, "user", "same"), (None, 0, "x", None), (None, 0, None, "x")]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.text for r in got) == ["", "same", "same", "x"]


def test_equal_turns_fall_into_chunks(spark):
    rows = [(1, t, None, f"line {i:03d}") for i in range(100) for t in (None, 7)] + [(2, 1, None, "line")]
    table = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartitionByRange(4, F.col("turn").asc_nulls_first(), "text").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "text")
    got = chat.numbered(table.filter("conv = 1").withColumn("at", F.monotonically_increasing_id()), 16).orderBy("at").select("text", "chunk").collect()
    assert [r.text for r in got] == [f"line {i:03d}" for i in range(100)] * 2 and [r.chunk for r in got] == [i // 16 for i in range(200)]
    frame = table.withColumnRenamed("conv", "conv_id")
    assert {(r.turn, r.text) for r in chat.parse(frame, chunk=16).collect() if r.conv_id == 1} == {(t, x) for _, t, _, x in rows[:-1]}
