import math
import random

import pytest
from pyspark.sql import functions as F

from beamloom.llm import topk


def plain(rows, k):
    v = sorted({(i, tuple(math.floor(256 * x) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)})
    out = []
    for i, q in v:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in v if (j, c) != (i, q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, k=5):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"no": F.lit("x"), "v": F.lit("y"), "rank": F.lit(1)})
    return sorted(map(tuple, topk.search(table, F.col("vec_id") % 50 == 0, k).collect()))


def vectors(n, dims, seed):
    r = random.Random(seed)
    return [(i, [r.choice([-1, -0.5, 0, 0.25, 1, r.uniform(-1, 1)]) for _ in range(dims)]) for i in range(n)]


def as_float(rows):
    import struct

    return [(i, None if e is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in e]) for i, e in rows]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rows = as_float(vectors(400, 7, 1))
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(250)] + [rows[50], rows[7], (None, hot), (5000, None), (5050, [None] * 7), (5100, [math.nan] + [0.0] * 6), (5150, [math.inf] * 7), (5200, [0.5, 0.5]), (5250, []), (50, hot)]
    assert search(spark, rows) == plain(rows, 5)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = as_float([(50 * i, [0.1 * i, -1.0]) for i in range(n)])
    assert search(spark, rows) == plain(rows, 5)


def test_large_components_are_exact_as_longs(spark):
    rows = [(0, [3e6, 1.0]), (1, [2e6, -7.0]), (2, [2e6, -6.0]), (3, [-4e6, 5.0])]
    assert search(spark, rows) == plain(rows, 5)


@pytest.mark.parametrize("spread", [1, 3])
def test_only_scores_that_reach_the_cutoff_leave_a_pair_of_blocks(spark, monkeypatch, spread):
    """Of 80,000 pairs, thousands have a partial score that is sent; few reach the cutoff."""
    for name, value in (("LEAST_BLOCK", 300), ("SPREAD", spread), ("QUERY_BLOCK", 16), ("QUERIES_AT_ONCE", 5), ("PAIRS_AT_ONCE", 50)):
        monkeypatch.setattr(topk, name, value, raising=False)
    written, cut = {}, topk.cut

    def seen(df, name):
        written[name] = cut(df, name)
        written[name].n_rows = written[name].count()
        return written[name]

    monkeypatch.setattr(topk, "cut", seen)
    r = random.Random(8)
    rows = as_float([(i, [r.gauss(0, 0.25) for _ in range(20)]) for i in range(2000)])
    assert search(spark, rows) == plain(rows, 5)
    of_pairs = {name: table.n_rows for name, table in written.items() if name not in ("topk-rows", "topk-vectors", "topk-blocks", "topk-cutoffs")}
    assert of_pairs and max(of_pairs.values()) <= 40 * 40


@pytest.mark.parametrize("most", [100, 5000, 10**6, 10**8])
def test_parts_of_any_size(most):
    """Slices' parts, as floats, doubles or longs, against all scores."""
    import numpy as np

    g = np.random.default_rng(most % 97)
    q, c = g.integers(-most, most, (7, 9)), g.integers(-most, most, (300, 9))
    all_scores = q @ c.T
    t = np.sort(all_scores, axis=1)[:, -6].copy()
    t[3] = topk.NO_CUTOFF
    x, y, score = topk.reaching(q, c, t)
    want = np.nonzero(all_scores >= t[:, None])
    assert [tuple(v) for v in zip(x, y)] == [tuple(v) for v in zip(*want)] and (score == all_scores[want]).all()
