import zlib

import duckdb
import numpy as np
import pyarrow as pa

from beamloom.llm import quality
from beamloom.llm.queries import line_quality
from tests.llm.data import documents, frame

SF = "/root/testdata/sf0.01"


def test_forward_backward_is_the_sum_over_all_labelings():
    r = np.random.default_rng(2)
    text = np.repeat([0, 1, 2], [1, 4, 3])
    u, trans = r.normal(size=8), r.normal(size=(2, 2))
    p, pairs = quality.marginals(u, trans, text)
    inner = [i for i in range(7) if text[i] == text[i + 1]]
    for t in range(3):
        at = np.flatnonzero(text == t)
        total, one, two = 0.0, np.zeros(len(at)), np.zeros((len(at) - 1, 2, 2))
        for bits in range(1 << len(at)):
            y = [bits >> k & 1 for k in range(len(at))]
            w = np.exp(sum(u[a] * v for a, v in zip(at, y)) + sum(trans[y[k], y[k + 1]] for k in range(len(at) - 1)))
            total += w
            one += w * np.array(y)
            for k in range(len(at) - 1):
                two[k, y[k], y[k + 1]] += w
        assert np.allclose(p[at], one / total)
        for k in range(len(at) - 1):
            assert np.allclose(pairs[inner.index(at[k])], two[k] / total)


def test_scores_do_not_depend_on_the_size_of_blocks(monkeypatch):
    from beamloom.llm import shingles

    indented = "\n".join("    " * (i % 4) + f"word{i} word{i} more words!! of line {i}\t" for i in range(16))
    awkward = ["a b\nc d\n\ne!! e!! e!!\n", indented, "\n\n  \n" + indented + "\n \n", "x y\n" * 300, "one line of words words words and no end " * 200, " \n\t\n"]
    texts = pa.array([t for _, t in documents() if t] + awkward, pa.string())
    r = np.random.default_rng(1)
    model = quality.Model(r.normal(size=quality.FEATURES) / 4, r.normal(size=(2, 2)), 0.5)
    whole = model.scores(texts, 1 << 24)
    alone = np.concatenate([model.scores(texts[i : i + 1], 1 << 24) for i in range(len(texts))])
    assert np.abs(alone - whole).max() < 1e-9
    for size in (9, 64, 1000, 1 << 15):
        monkeypatch.setattr(shingles, "CHUNK_BYTES", max(8, size // 2))
        assert np.abs(model.scores(texts, size) - whole).max() < 1e-9, size


def test_sample_is_bounded_in_lines(spark):
    docs = spark.createDataFrame([(i, "a line\n" * (i % 7 + 1)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda texts, y: seen.append((texts, y)) or fit(texts, y)
    try:
        quality.train(docs, labels, lines=20)
    finally:
        quality.fit = fit
    texts, y = seen[0]
    assert {0, 1} == set(y) and all(10 < sum(t.count("\n") + 1 for t, v in zip(texts, y) if v == k) <= 20 for k in (0, 1))


def test_awkward_rows_get_scores(spark):
    model = quality.fit(["a good line here.\nand one more.", "BAD!! BAD!! BAD!!"], [1, 0])
    out = quality.score(frame(spark, documents()), model, out="score").collect()
    assert len(out) == len(documents()) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if not (r.text or "").strip()} == {0.5}
    assert quality.score(frame(spark, []), model).count() == 0


def test_without_labels(spark):
    docs = frame(spark, documents())
    model = quality.train(docs, spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}


def test_held_out_accuracy_and_labels_kept_out(spark):
    got = {r.doc_id: r for r in line_quality(spark, SF).collect()}
    told = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    apart = [(got[i].predicted, q) for i, q in told if got[i].held_out]
    assert sum(p == q for p, q in apart) / len(apart) >= 0.97
    assert sum(p for p, q in apart if q == 1) / sum(q for _, q in apart) >= 0.98
