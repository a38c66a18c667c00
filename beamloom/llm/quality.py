"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. A line's features are shares of kinds of characters, shapes of words, repeated words and
repeated lines, its own and in short also those of the lines before and after it; two labels in a row have a weight too.
Forward-backward gives each line's probability of being good, and a document's quality is their mean weighted by the
lines' lengths. Training takes documents' labels as the labels of all their lines.

Defined cases. A null text, or one without words, has no lines and gets the share of good documents among the training
rows (1/2 without any). Only what the text holds is an input. Conflicting labels of one document leave it out of the
training; with no labelled rows all scores are 1/2. Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamloom.llm.memory import frugal
from beamloom.llm.shingles import SPACE, chunks, pieces, word_hashes

#: Training rows of each label, the longest text that is a training row (bytes), and lines of all rows of a label: the
#: bounds of the sample. A line's features take about 1,000 bytes.
TRAIN_ROWS = 2000
TRAIN_BYTES = 1 << 16
TRAIN_LINES = 150_000
#: Bytes of text whose lines are counted at once.
BLOCK_BYTES = 1 << 17

#: Kinds of bytes: space, lower case, upper case, digit, beyond ASCII, sentence marks, !, |, other marks.
KIND = np.full(256, 8)
KIND[128:] = 4
KIND[np.flatnonzero(SPACE)] = 0
KIND[ord("a") : ord("z") + 1] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3
KIND[list(b".,;:'\"()?-")] = 5
KIND[ord("!")] = 6
KIND[ord("|")] = 7
KINDS = 9
SHAPES = KINDS * KINDS
#: Columns of counts: bytes, words, bytes of each kind, words of each shape (kinds of first and last byte), words of one
#: byte, words like the one before, like the one before that.
COUNTS = 2 + KINDS + SHAPES + 3
OWN = KINDS + SHAPES + 3 + 3
NEAR = KINDS + 3
FEATURES = 1 + OWN + 2 * (NEAR + 1)


def line_counts(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each line of the texts data[edges[i]:edges[i + 1]], a hash of its words, and the text it is of."""
    breaks = data == 0x0A
    first = np.zeros(len(data) + 1, bool)
    first[1:] = breaks
    first[edges[:-1]] = True
    starts = np.flatnonzero(first[:-1])
    n = len(starts)
    line = np.cumsum(first[:-1]) - 1
    kind = KIND[data]
    counts = np.zeros((n, COUNTS))
    counts[:, 0] = np.diff(np.append(starts, len(data)))
    counts[:, 2 : 2 + KINDS] = np.bincount(line * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    word = kind > 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends[:-1] &= ~word[1:] | first[1:-1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    of = line[a]
    counts[:, 1] = np.bincount(of, minlength=n)
    counts[:, 2 + KINDS : 2 + KINDS + SHAPES] = np.bincount(of * SHAPES + kind[a] * KINDS + kind[b], minlength=n * SHAPES).reshape(n, SHAPES)
    counts[:, -3] = np.bincount(of[a == b], minlength=n)
    words, _ = word_hashes(data, edges)
    for back, column in ((1, -2), (2, -1)):
        same = (words[back:] == words[:-back]) & (of[back:] == of[:-back])
        counts[:, column] = np.bincount(of[back:][same], minlength=n)
    mark = np.zeros(n, np.uint64)
    if len(a):
        at = np.searchsorted(of, np.arange(n + 1))
        place = np.concatenate([[np.uint64(0)], np.cumsum(words)])
        mark = place[at[1:]] - place[at[:-1]]
    return counts, mark, np.searchsorted(edges, starts, side="right") - 1


def line_blocks(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """A text in blocks of whole lines, of about ``size`` bytes; a longer line is a block of its own."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            breaks = np.flatnonzero(data[at:end] == 0x0A)
            if len(breaks):
                end = at + int(breaks[-1]) + 1
            else:
                while end < len(data):
                    breaks = np.flatnonzero(data[end : end + size] == 0x0A)
                    end = end + int(breaks[0]) + 1 if len(breaks) else min(end + size, len(data))
                    if len(breaks):
                        break
        yield at, end
        at = end


def long_line_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and hash of one line, which is looked at piece by piece; only its words' hashes are held at once."""
    counts = np.zeros((1, COUNTS))
    for a, b in pieces(data):
        counts += line_counts(data[a:b], np.array([0, b - a]))[0].sum(axis=0)
    words, _ = word_hashes(data, np.array([0, len(data)]))
    counts[0, -2], counts[0, -1] = (words[1:] == words[:-1]).sum(), (words[2:] == words[:-2]).sum()
    return counts, words.sum(keepdims=True, dtype=np.uint64)


def long_text_lines(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts and hashes of the lines with a word of one text, block by block; the same lines whatever the size of blocks."""
    for a, b in line_blocks(data, size):
        if b - a > size:
            c, m = long_line_counts(data[a:b])
        else:
            c, m, _ = line_counts(data[a:b], np.array([0, b - a]))
        full = c[:, 1] > 0
        if full.any():
            yield c[full], m[full]


def lines_of(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For runs of texts: counts, hash and text (numbered from 0) of each line with a word, and the number of texts."""
    for _, data, edges in chunks(texts, size):
        if len(edges) == 2:
            found = list(long_text_lines(data, size)) or [(np.zeros((0, COUNTS)), np.zeros(0, np.uint64))]
            c, m = (np.concatenate(x) for x in zip(*found))
            yield c, m, np.zeros(len(c), np.int64), 1
        else:
            c, m, text = line_counts(data, edges)
            full = c[:, 1] > 0
            yield c[full], m[full], text[full], len(edges) - 1


def _shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A line's own features but its repeats, and those that its neighbours see."""
    size, words = counts[:, :1], np.maximum(1, counts[:, 1:2])
    kinds = counts[:, 2 : 2 + KINDS] / size
    repeats = counts[:, -3:] / words
    own = np.concatenate([kinds, counts[:, 2 + KINDS : -3] / words, repeats, np.log1p(size) / 10, np.log1p(words) / 8], axis=1)
    return own, np.concatenate([kinds, repeats, np.ones((len(counts), 1))], axis=1)


def features(counts: np.ndarray, marks: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Feature matrix of lines in reading order: 1, a line's own, whether it is repeated, the line before, the line after."""
    n = len(counts)
    own, near = _shares(counts)
    order = np.lexsort((marks, text))
    same = (marks[order][1:] == marks[order][:-1]) & (text[order][1:] == text[order][:-1])
    again = np.zeros(n)
    again[order[1:]] = same
    again[order[:-1]] = np.maximum(again[order[:-1]], same)
    x = np.zeros((n, FEATURES))
    x[:, 0] = 1
    x[:, 1 : 1 + OWN] = np.concatenate([own, again[:, None]], axis=1)
    joined = text[1:] == text[:-1]
    at = 1 + OWN
    x[1:, at : at + NEAR + 1] = near[:-1] * joined[:, None]
    x[:-1, at + NEAR + 1 :] = near[1:] * joined[:, None]
    return x


def long_text_score(data: np.ndarray, size: int, weights: np.ndarray, trans: np.ndarray) -> float | None:
    """The score of one text, of which each line is only a score, a length and a hash (20 bytes) beyond its block.

    The features are linear, so what a line adds to its neighbours' scores is added as it comes; the chain is a walk
    forward that keeps one number a line, and one back.
    """
    at = 1 + OWN
    u, marks, sizes = [], [], []
    carried = 0.0  # what the line before adds
    for counts, m in long_text_lines(data, size):
        own, near = _shares(counts)
        score = weights[0] + own @ weights[1:OWN]
        ahead, back = near @ weights[at : at + NEAR + 1], near @ weights[at + NEAR + 1 :]
        score[1:] += ahead[:-1]
        score[:-1] += back[1:]
        if u:
            score[0] += carried
            u[-1][-1] += back[0]
        carried = ahead[-1]
        u.append(score)
        marks.append(m)
        sizes.append(counts[:, 0].astype(np.int32 if len(data) < 1 << 31 else np.int64))
    if not u:
        return None
    total, lengths = np.concatenate(u), np.concatenate(sizes)
    mark = np.concatenate(marks)
    del u, marks, sizes
    ordered = np.sort(mark)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if len(twice):
        for lo in range(0, len(mark), 1 << 18):
            part = mark[lo : lo + (1 << 18)]
            total[lo : lo + (1 << 18)] += weights[OWN] * (twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part)
    return _walk(total, lengths, trans)


def _walk(u: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> float:
    """Mean probability of label 1 over one chain, weighted by lengths; log-odds only, in blocks of Python numbers."""
    from math import exp, log

    (e00, e01), (e10, e11) = np.exp(trans - trans.max()).tolist()
    block, n = 1 << 18, len(u)
    ahead = np.empty(n)
    odds = None
    for lo in range(0, n, block):
        got = []
        for x in u[lo : lo + block].tolist():
            if odds is not None:
                e = exp(min(max(odds, -500.0), 500.0))
                x += log((e01 + e11 * e) / (e00 + e10 * e))
            odds = x
            got.append(x)
        ahead[lo : lo + block] = got
    behind, mass, whole = 0.0, 0.0, float(lengths.sum(dtype=np.int64))
    for lo in range((n - 1) // block * block, -1, -block):
        for x, a, size in zip(u[lo : lo + block].tolist()[::-1], ahead[lo : lo + block].tolist()[::-1], lengths[lo : lo + block].tolist()[::-1]):
            mass += size / (1.0 + exp(min(max(-(a + behind), -500.0), 500.0)))
            e = exp(min(max(behind + x, -500.0), 500.0))
            behind = log((e10 + e11 * e) / (e00 + e01 * e))
    return mass / whole


def marginals(u: np.ndarray, trans: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 of each line, and of each pair of labels of a line (row) and the next one of its text.

    u: score of label 1 over label 0. All chains of the batch take each step together.
    """
    n = len(u)
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if n else np.empty(0, np.int64)
    length = np.diff(np.append(starts, n))
    starts = starts[order := np.argsort(-length, kind="stable")]
    active = np.searchsorted(-length[order], -np.arange(1, (length.max() if n else 0) + 1), side="right")
    ahead = np.zeros((n, 2))
    behind = np.zeros((n, 2))
    for t, k in enumerate(active):
        at = starts[:k] + t
        if t:
            before = ahead[at - 1]
            ahead[at] = np.logaddexp(before[:, :1] + trans[0], before[:, 1:] + trans[1])
        ahead[at, 1] += u[at]
        ahead[at] -= ahead[at].max(axis=1, keepdims=True)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        after = behind[at].copy()
        after[:, 1] += u[at]
        got = np.logaddexp(trans[:, 0] + after[:, :1], trans[:, 1] + after[:, 1:])
        behind[at - 1] = got - got.max(axis=1, keepdims=True)
    both = ahead + behind
    p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.flatnonzero(text[1:] == text[:-1]) if n > 1 else np.empty(0, np.int64)
    nxt = behind[inner + 1].copy()
    nxt[:, 1] += u[inner + 1]
    pairs = ahead[inner][:, :, None] + trans + nxt[:, None, :]
    pairs = np.exp(pairs - pairs.max(axis=(1, 2), keepdims=True))
    return p, pairs / pairs.sum(axis=(1, 2), keepdims=True)


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    prior: float

    def scores(self, texts: pa.Array, size: int = BLOCK_BYTES) -> np.ndarray:
        out = []
        for _, data, edges in chunks(texts, size):
            n = len(edges) - 1
            score = np.full(n, self.prior)
            out.append(score)
            if n == 1 and len(data) > size:
                got = long_text_score(data, size, self.weights, self.trans)
                score[0] = self.prior if got is None else got
                continue
            counts, marks, text = line_counts(data, edges)
            full = counts[:, 1] > 0
            counts, marks, text = counts[full], marks[full], text[full]
            if len(text):
                p, _ = marginals(features(counts, marks, text) @ self.weights, self.trans, text)
                whole = np.bincount(text, counts[:, 0], n)
                share = np.bincount(text, counts[:, 0] * p, n)
                score[whole > 0] = share[whole > 0] / whole[whole > 0]
        return np.clip(np.concatenate(out), 0, 1) if out else np.empty(0)


def fit(texts: list[str], labels: list[int], rounds: int = 150, rate: float = 0.08, ridge: float = 1e-4) -> Model:
    """Gradient ascent (Adam) on the likelihood of the lines' labels; every document weighs the same."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), float(y.mean()) if len(y) else 0.5)
    parts, base = [], 0
    for counts, marks, text, n in lines_of(pa.array(texts, pa.large_string()), BLOCK_BYTES):
        parts.append((features(counts, marks, text), text + base))
        base += n
    x, text = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    inner = text[1:] == text[:-1]
    weight = (1 / np.maximum(1, np.bincount(text, minlength=len(y))))[text] / len(y)
    want = y[text]
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (weight[1:] * inner * (1 - want[1:])).sum(), (weight[1:] * inner * want[1:]).sum()
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        p, pairs = marginals(x @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2), text)
        g = np.concatenate([x.T @ (weight * (want - p)), (seen - (weight[1:][inner][:, None, None] * pairs).sum(axis=0)).ravel()]) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), float(y.mean()))


def held_out(key: Column) -> Column:
    """Rows whose crc32 of the key's text leaves 1 when divided by 3; labels are never learnt from them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, longest: int = TRAIN_BYTES, lines: int = TRAIN_LINES) -> Model:
    """A model of at most ``rows`` training rows of each label, those with the smallest hashes of their keys that have ``lines`` lines together.

    The sample is bounded by 2 * rows * longest bytes and 2 * lines lines, whatever the tables' sizes; it alone comes to the driver.
    """
    told = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    told = told.filter(~held_out(F.col("k"))).groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"))
    counted = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("lines")
    short = texts.filter(F.octet_length("text") <= longest).select("k", counted).groupBy("k").agg(F.max("lines").alias("lines"))
    usable = told.join(short, "k").select("k", "lines", "y", F.xxhash64("k").alias("h"))
    chosen = []
    for y in (0, 1):
        left = lines
        for r in usable.filter(F.col("y") == y).orderBy("h", "k").limit(rows).collect():
            if r.lines <= left:
                left -= r.lines
                chosen.append((r.k, y))
    chosen = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("k", texts.schema["k"].dataType), T.StructField("y", T.IntegerType())]))
    sample = texts.filter(F.octet_length("text") <= longest).join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    got = sorted(sample.select(F.xxhash64("k").alias("h"), "k", "text", "y").collect())
    return fit([r.text for r in got], [r.y for r in got])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns and ``out``, the probability-like quality of the whole text; one pass, no shuffle."""
    kept = [c for c in docs.columns if c != out]
    names = kept if text in kept else [*kept, text]  # a text that the score takes the place of is sent along
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField(out, T.DoubleType(), False)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                got = model.scores(part.column(names.index(text)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(got, pa.float64())], names=schema.names)

    return rows.mapInArrow(frugal(run), schema)
