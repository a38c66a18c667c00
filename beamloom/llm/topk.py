"""Exact top-k search by inner product, with a uniform threshold in three phases.

The dimensions are split into SLICES slices; a score is the sum of one partial score of each slice.

1. Each slice reports its best partial scores of every query. The exact scores of what was reported give a cutoff t:
   the k-th best row can't be below it.
2. The cutoff goes to all slices with the query. A row whose score reaches t has a partial score of at least t / SLICES
   somewhere, so each slice sends only what reaches that.
3. Rows sent by all slices have their score. For the others the missing parts are below t / SLICES; those that could
   still reach t are resolved from the vectors.

Vectors are compared in blocks: a block of queries meets each block of candidates once, as two matrices with the columns of
all slices. So what slices send of a pair of blocks is put together, and resolved, where it is made: what leaves a task are
scores that reach the cutoff, not every part that does its share (these grow as queries times rows). Equal vectors are one
candidate that carries its smallest ids (as many as a result can need), so copies cost nothing.

Defined cases. Vectors that are null, hold a null or non-finite component, or have a null id take no part. Shorter
vectors count as filled up with zeros. Repeated rows (same id and vector) count once; the same id with another vector is
a candidate of its own. Components are whole numbers; beyond the range of long they are its ends, and sums wrap as long
does. Equal scores go to the smaller id. With fewer candidates than k, all are returned; a query alone gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beamloom.llm.memory import frugal
from beamloom.session import cut, discard

SLICES = 2
#: Candidates of a block, at most and, if there are fewer than SPREAD such blocks, at least. Queries are sent once to a group of
#: blocks: SPREAD groups, or more if a group would hold more than SPREAD blocks.
BLOCK = 8192
LEAST_BLOCK = 1024
SPREAD = 64
#: Queries of a block, and those of them that are multiplied at once.
QUERY_BLOCK = 2048
QUERIES_AT_ONCE = 256
#: Pairs that are resolved at once.
PAIRS_AT_ONCE = 100_000
#: Instead of a cutoff, for queries that have none.
NO_CUTOFF = -(2**63)

PACKED = "block int, ids binary, cutoffs binary, kind string, matrix binary"

Matrix = np.ndarray


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as long; null where a component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))
    return F.when(usable, whole)


def _pack(vectors: DataFrame, dims: int, size: int) -> DataFrame:
    """Vectors (no, v, t) as matrices of the narrowest whole numbers: one row per partition and run of ``size`` vectors."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        for b in parts:
            for at in range(0, b.num_rows, size):
                no, v, t = b.slice(at, size).columns
                long = np.diff(v.offsets.to_numpy())
                full = np.zeros((len(no), dims), np.int64)
                full[np.repeat(np.arange(len(no)), long), np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)] = v.flatten().to_numpy()
                kind = next(k for k in ("int16", "int32", "int64") if full.min(initial=0) >= np.iinfo(k).min and full.max(initial=0) <= np.iinfo(k).max)
                row = (block, no.to_numpy().tobytes(), t.to_numpy().tobytes(), kind, full.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()))], names=["block", "ids", "cutoffs", "kind", "matrix"])

    return vectors.select("no", "v", "t").mapInArrow(frugal(run), PACKED)


def products(a: Matrix, b: Matrix) -> Matrix:
    """All inner products of the rows: as floats or doubles where these are exact, else as longs."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def slices(m: Matrix) -> list[Matrix]:
    """The columns of each slice."""
    width = -(-m.shape[1] // SLICES)
    return [m[:, s * width : (s + 1) * width] for s in range(SLICES)]


def dots(a: Matrix, b: Matrix, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows a[x] and b[y], as longs."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        out[part] = np.einsum("ij,ij->i", a[x[part]].astype(np.int64), b[y[part]].astype(np.int64))
    return out


def best(q: Matrix, c: Matrix, want: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Phase 1 in a pair of blocks: slice, and rows of q and c with its ``want`` best partial scores of each query."""
    for s, (a, b) in enumerate(zip(slices(q), slices(c))):
        p = products(a, b)
        m = min(want, p.shape[1])
        y = np.argpartition(p, p.shape[1] - m, axis=1)[:, p.shape[1] - m :].ravel()
        x = np.repeat(np.arange(len(p)), m)
        yield s, x, y, p[x, y].astype(np.int64)


def reaching(q: Matrix, c: Matrix, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 in a pair of blocks: rows of q and c whose score reaches the query's cutoff, and the score."""
    share = np.where(t == NO_CUTOFF, NO_CUTOFF, -(-t // SLICES))
    parts = [products(a, b) for a, b in zip(slices(q), slices(c))]
    sent = [p >= share.astype(p.dtype)[:, None] for p in parts]
    x, y = np.nonzero(np.logical_or.reduce(sent))
    score, missing = np.zeros(len(x), np.int64), np.full(len(x), SLICES)
    for p, has in zip(parts, sent):
        has = has[x, y]
        score[has] += p[x[has], y[has]].astype(np.int64)
        missing -= has
    # a part that was not sent is below its share
    possible = (t[x] == NO_CUTOFF) | (missing == 0) | (score >= t[x] - missing * (share[x] - 1))
    x, y, score = x[possible], y[possible], score[possible]
    for a, b, has in zip(slices(q), slices(c), sent):
        lacks = np.flatnonzero(~has[x, y])
        score[lacks] += dots(a, b, x[lacks], y[lacks])
    enough = score >= t[x]
    return x[enough], y[enough], score[enough]


def _meet(queries: DataFrame, blocks: DataFrame, n_groups: int, dims: int, found: str, keep: Callable) -> DataFrame:
    """Each block of queries with each block of candidates; keep(queries, cutoffs, candidates) yields rows of them, and columns."""
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"), F.col("ids").alias("q_ids"), F.col("cutoffs").alias("q_cutoffs"), F.col("kind").alias("q_kind"), F.col("matrix").alias("q_matrix"))
    pairs = sent.join(blocks, "group").select("q_ids", "q_cutoffs", "q_kind", "q_matrix", "ids", "kind", "matrix")
    names = [x.split(" ")[0] for x in found.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                q, t, q_kind, qm, c, kind, cm = (np.frombuffer(x.as_buffer(), np.int64) if k in (0, 1, 4) else x.as_py() if k in (2, 5) else x.as_buffer() for k, x in enumerate(col[i] for col in b.columns))
                qm, cm = np.frombuffer(qm, q_kind).reshape(len(q), dims), np.frombuffer(cm, kind).reshape(len(c), dims)
                for at in range(0, len(q), QUERIES_AT_ONCE):
                    part = slice(at, at + QUERIES_AT_ONCE)
                    for x, y, *columns in keep(qm[part], t[part], cm):
                        for k in range(0, len(x), PAIRS_AT_ONCE):
                            some = slice(k, k + PAIRS_AT_ONCE)
                            yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (q[part][x], c[y], *columns)], names=names)

    return pairs.mapInArrow(frugal(run), found)


def search(table: DataFrame, is_query: Column, k: int, id: str = "vec_id", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score: the k best other rows of each row that is a query."""
    rows = table.select(F.col(f"`{id}`").cast("long").alias("id"), scaled(F.col(f"`{vector}`"), factor).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = cut(rows.groupBy("id", "v").agg(F.max("is_query").alias("is_query")), "topk-rows")
    firsts = rows.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    asked = rows.filter("is_query").select("v").distinct().withColumn("asked", F.lit(True))
    vectors = firsts.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).join(asked, "v", "left")
    vectors = cut(vectors.select(F.monotonically_increasing_id().alias("no"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "topk-vectors")
    size = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(F.col("asked"), 1))).first()
    n, dims, n_asked = size[0], max(1, size[1]), size[2]

    block = min(BLOCK, max(LEAST_BLOCK, -(-n // SPREAD)))
    n_blocks = max(1, -(-n // block))
    none = F.lit(NO_CUTOFF).cast("long")
    packed = cut(_pack(vectors.withColumn("t", none).repartition(n_blocks), dims, 2 * block), "topk-blocks")
    n_groups = min(n_blocks, max(SPREAD, -(-n_blocks // SPREAD)))
    blocks = packed.select((F.col("block") % n_groups).alias("group"), "ids", "kind", "matrix")
    asking = vectors.filter("asked").select("no", "v")
    q_parts = max(1, -(-n_asked // QUERY_BLOCK))
    want = k + 1

    def report(q: Matrix, _: np.ndarray, c: Matrix) -> Iterator[tuple]:
        for s, x, y, p in best(q, c, want):
            yield x, y, np.full(len(x), s, np.int32), p, dots(q, c, x, y)

    def send(q: Matrix, t: np.ndarray, c: Matrix) -> Iterator[tuple]:
        yield reaching(q, c, t)

    order = W.partitionBy("q", "slice").orderBy(F.col("p").desc(), "c")
    local = _meet(_pack(asking.withColumn("t", none).repartition(q_parts), dims, QUERY_BLOCK), blocks, n_groups, dims, "q long, c long, slice int, p long, score long", report)
    local = local.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= want).select("q", "c", "score").distinct()
    ranked = local.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "c")))
    cutoffs = cut(ranked.filter(F.col("r") == want).select(F.col("q").alias("no"), F.col("score").alias("t")), "topk-cutoffs")

    again = asking.join(cutoffs, "no", "left").withColumn("t", F.coalesce("t", none))
    exact = cut(_meet(_pack(again.repartition(q_parts), dims, QUERY_BLOCK), blocks, n_groups, dims, "q long, c long, score long", send), "topk-scores")
    discard(packed, cutoffs)

    entries = exact.join(vectors.select(F.col("no").alias("c"), "ids"), "c").select("q", "c", "score", F.explode("ids").alias("id"))
    entries = entries.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "id", "c"))).filter(F.col("r") <= want)
    own = rows.filter("is_query").select(F.col("id").alias("query_id"), "v").join(vectors.filter("asked").select(F.col("no").alias("q"), "v"), "v").select("query_id", "q")
    lists = own.join(entries, "q").filter((F.col("query_id") != F.col("id")) | (F.col("q") != F.col("c")))
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "id", "c"))
    return lists.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")
