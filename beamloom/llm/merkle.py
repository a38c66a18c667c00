"""Merkle manifest of a table: trees of digests per group, one tree over the groups' roots, and a proof for every row.

H is the lower-case hex SHA-256 of its inputs, digests written as hex text. Nodes of a level are numbered within their group;
a run is ``FAN`` consecutive ones. Every level is made of equijoins of nodes with the computed numbers of their siblings:
the node of slot zero meets the nodes of slots 1 to 7 (number + 1 to number + 7), and the slot-zero rows, now holding the
whole run, emit the parents. So a level shuffles every node once, and no task holds more than a run.

Proofs come down the same tables: the path of a node is its own siblings, left and right ones apart, before the path of its parent.

Defined cases: a field that is null is written ``-``. Leaves ascend by id, a null id first, rows of one id by leaf digest; rows equal in
both are interchangeable. A null group is a group of its own before all others. A group of one row has that leaf as its root;
a last run of one node is hashed like any other. An empty table has no rows and no root. Extra columns are not read,
whatever their names. Only numbers of levels and of partitions come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beamloom.session import cut

FAN = 8


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(digests: Sequence[Column]) -> Column:
    """H of a run; slots that are not there are null."""
    return F.unhex(F.sha2(F.concat(*[F.coalesce(_hex(d), F.lit("")) for d in digests]).cast("binary"), 256))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The rows with ``idx`` (from 0) and ``n`` (rows) within their ``grp``, in that order; no group is sorted in one task.

    Rows are dealt by ranges of (grp, order) and numbered within their partition; each partition's first number per group
    comes from the counts before it: a table of one row per partition and per group.
    """
    keys = ["grp", *order]
    # rows equal in all of the order are told apart by their place, so that ranges can cut between them
    placed = cut(rows.withColumn("at", F.monotonically_increasing_id()), name)
    n = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = placed.repartitionByRange(n, *keys, "at").sortWithinPartitions(*keys, "at").withColumn("mid", F.monotonically_increasing_id())
    ranged = cut(ranged.drop("at").withColumn("pid", F.shiftright("mid", 33)), f"{name}-ranged")
    pieces = cut(ranged.groupBy("grp", "pid").agg(F.min("mid").alias("lo"), F.count(F.lit(1)).alias("rows")), f"{name}-pieces")
    before = W.partitionBy("grp").orderBy("pid")
    starts = pieces.select("grp", "pid", "lo", (F.sum("rows").over(before.rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")).alias("start"), F.sum("rows").over(W.partitionBy("grp")).alias("n"))
    return ranged.join(starts, ["grp", "pid"]).select(*rows.columns, (F.col("mid") - F.col("lo") + F.col("start")).alias("idx"), "n")


def runs(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """grp, idx (of the parent), n (nodes of this level), parent, and ``slots``: the run's nodes as structs, by slot.

    One equijoin per slot offset; the keys of all are group and the number of the slot-zero node, so each table is dealt once.
    """
    slot = F.col("idx") % FAN
    node = F.struct("digest", *carried)
    run = nodes.filter(slot == 0).select("grp", "idx", "n", node.alias("s0"))
    for k in range(1, FAN):
        sibling = nodes.filter(slot == k).select("grp", (F.col("idx") - k).alias("idx"), node.alias(f"s{k}"))
        run = run.join(sibling, ["grp", "idx"], "left")
    slots = [f"s{k}" for k in range(FAN)]
    return run.select("grp", F.expr(f"idx div {FAN}").alias("idx"), "n", _parent([F.col(f"{s}.digest") for s in slots]).alias("parent"), F.array(*slots).alias("slots"))


def beside(slots: Column, k: Column) -> Column:
    """The siblings of slot k as hex text: those left of it and those right of it."""
    text = lambda part: F.concat_ws("", F.transform(part, lambda s: _hex(s["digest"])))
    return F.struct(text(F.slice(slots, 1, k)).alias("left"), text(F.slice(slots, k + 2, FAN)).alias("right"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """H of all siblings, level by level."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))).cast("binary"), 256)


NO_PATH = "array<struct<left:string,right:string>>"


def forest(nodes: DataFrame, carried: Sequence[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of runs, lowest first, and the groups' roots (grp, digest)."""
    levels, tops = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.filter("n = 1").select("grp", "digest"))
        if most <= 1:
            break
        level = cut(runs(nodes.filter("n > 1"), carried), f"{name}-level{len(levels)}")
        levels.append(level)
        nodes = level.select("grp", "idx", F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.col("parent").alias("digest"))
        most, carried = -(-most // FAN), ()
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return levels, roots


def spread(levels: list[DataFrame], nodes: DataFrame, roots: DataFrame, carried: Sequence[str], name: str) -> DataFrame:
    """Every node of the lowest level with what it carries, its path, and its group's ``subroot``.

    ``roots`` holds grp, subroot and the path above it. Paths go down level by level to the runs, each kept once for its
    eight nodes; only here, at the end, does every node get its own.
    """
    lone = nodes.filter("n = 1").join(roots, "grp").select("grp", "digest", *carried, "path", "subroot")
    paths = None
    for i in reversed(range(len(levels))):
        # the parents of this level: roots of their groups, or nodes of the level above
        parents = levels[i].filter(f"n <= {FAN}").select("grp", "idx").join(roots, "grp").select("grp", "idx", "path", "subroot")
        if paths is not None:
            parents = parents.unionByName(paths)
        below = levels[i].select("grp", "idx", "slots").join(parents, ["grp", "idx"]).select("grp", "idx", "slots", "path", "subroot", F.posexplode("slots").alias("k", "node"))
        below = below.filter("node IS NOT NULL").withColumn("path", F.concat(F.array(beside(F.col("slots"), F.col("k"))), F.col("path")))
        if i == 0:
            return lone.unionByName(below.select("grp", "node.digest", *[f"node.{c}" for c in carried], "path", "subroot"))
        paths = cut(below.select("grp", (F.col("idx") * FAN + F.col("k")).alias("idx"), "path", "subroot"), f"{name}-paths{i}")
    return lone


def manifest(leaves: DataFrame, group: str, id: str, digest: str = "leaf", carried: Sequence[str] = ()) -> DataFrame:
    """id, carried columns, leaf, subroot, root (hex) and ``path``, the siblings from the leaf up to the root.

    ``leaves`` has one row per leaf with its digest as hex text.
    """
    cols = {f"c{i}": c for i, c in enumerate(carried)}
    key = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")))
    rows = leaves.select(key.alias("grp"), F.col(f"`{id}`").alias("id"), F.unhex(F.col(f"`{digest}`")).alias("digest"), *[F.col(f"`{c}`").alias(x) for x, c in cols.items()])
    kept = ["id", *cols]
    nodes = cut(numbered(rows, ["id", "digest"], "leaves"), "merkle-leaves")
    levels, subroots = forest(nodes, kept, "merkle")
    # the tree over the groups is one group of its own
    tops = cut(numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), ["of"], "subroots"), "merkle-tops")
    upper, root = forest(tops, ["of"], "merkle-top")
    start = root.select("grp", F.array().cast(NO_PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"))
    above = spread(upper, tops, start, ["of"], "merkle-top").select(F.col("of").alias("grp"), "path", F.col("digest").alias("subroot"))
    top = root.select(_hex(F.col("digest"))).first()
    found = spread(levels, nodes, cut(above, "merkle-above"), kept, "merkle")
    return found.select(
        F.col("id").alias(id), *[F.col(x).alias(c) for x, c in cols.items()], _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(top[0] if top else None).cast("string").alias("root"), "path"
    )
