"""Ordered pairs of channels, folded over events, against all pairs in plain Python."""

import random
from collections import Counter

from beamloom.operators import joins as J


def test_pairs_of_events_of_any_size(spark):
    r = random.Random(8)
    rows = [(e, i, r.randrange(-1, 6)) for e in range(40) for i in range(r.choice([1, 2, 3, 60]))] + [(99, i, r.randrange(3)) for i in range(500)]
    r.shuffle(rows)
    want = Counter()
    events = {}
    for e, i, c in sorted(rows):
        for x in events.setdefault(e, []):
            want[x, c] += 1
        events[e].append(c)
    df = spark.createDataFrame(rows, "ev long, pos int, ch int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size, limit in (("7", 10**6), ("10000", 10**6), ("10000", 100)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = J.coincidence_matrix(df, "ev", "pos", event_hits=limit)
        assert got.schema["ch_x"].dataType.simpleString() == "int"
        assert {(x.ch_x, x.ch_y): x.n for x in got.collect()} == dict(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert J.coincidence_matrix(df.limit(0), "ev", "pos").count() == 0
