"""Filter interaction audit and Merkle manifest against plain Python."""

import hashlib
import itertools
import re

from pyspark.sql import functions as F

from beamloom.llm import audit, merkle
from tests.llm.data import documents, words


def fails(text, id, low):
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    return {
        k
        for k, bad in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": id is not None and id > low[text],
        }.items()
        if bad
    }


def plain_audit(rows, labels):
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    parts = {}
    for i, t, s in rows:
        good, toxic = ({x[k] for x in labels if x[0] == i is not None} for k in (1, 2))
        parts.setdefault(s or "", []).append((fails(t or "", i, low), 1 in good, 1 in toxic))
    out = []
    for part, docs in parts.items():
        total, some = {}, []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                hit = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                all_of = [d for d in docs if f in d[0]]
                total[f] = total.get(f, 0) + len(hit)
                some.append([part, "".join(order), step + 1, len(left), len(hit), len(all_of) - len(hit), sum(d[0] == {f} for d in all_of), sum(d[1] for d in hit), sum(d[2] for d in hit)])
        out += [(*r, total[r[1][r[2] - 1]]) for r in some]
    return out


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def run_audit(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("id", "part", "mask", "digest", "n", "first", "good", "quality", "filter", "state"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    filters = audit.text_filters(F.col("text"))
    counted = audit.masks(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")), filters)
    return audit.audit(counted, "".join(filters) + "E").select(*COLUMNS)


def test_audit_of_awkward_rows(spark):
    rows = [(i, t, ("web", "news", None, "")[k % 4]) for k, (i, t) in enumerate(documents())]
    rows += [(200 + i, words(230, 5), "web") for i in range(30)] + [(None, words(230, 5), "news")] * 3 + [(300, "A$ B", "web"), (300, "A$ B", "news"), (301, "A$ B", "web"), (302, " ".join(["Same"] * 300), "none else")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (201, 1, 1), (300, 1, 0), (301, 0, 1), (999, 1, 1), (None, 1, 1)]
    got = sorted(tuple(r) for r in run_audit(spark, rows, labels).collect())
    assert got == sorted(plain_audit(rows, labels))
    assert {r[0] for r in got} == {"", "web", "news", "none else"} and len(got) == 4 * 600


def test_audit_of_nothing(spark):
    assert run_audit(spark, [], []).count() == 0
    got = run_audit(spark, [(None, None, None)], []).collect()
    assert len(got) == 600 and {(r.step, r.kept) for r in got if r.filter_order[0] == "A"} == {(i, 0) for i in range(1, 6)}


def test_paths_of_the_lattice():
    forward, backward = audit.paths(5)
    assert forward[-1] == backward[0] == 120 and all(forward[s] * backward[s] * len(list(itertools.combinations(range(5), s.bit_count()))) == 120 for s in range(32))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """(id, leaf, subroot, root, proof) by lists; rows are (id, lang, leaf)."""

    def climb(level, k, path):
        while len(level) > 1:
            at = k // 8 * 8
            path += [(x if j < k else "", x if j > k else "") for j, x in enumerate(level[at : at + 8], at) if j != k]
            level, k = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], k // 8
        return level[0]

    groups = {}
    for i, lang, leaf in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort()
    subroots = [climb([x[2] for x in groups[g]], 0, []) for g in order]
    out = []
    for gi, g in enumerate(order):
        for k, (has, i, leaf) in enumerate(groups[g]):
            path = []
            climb([x[2] for x in groups[g]], k, path)
            root = climb(subroots, gi, path)
            out.append((i if has else None, leaf, subroots[gi], root, h(*[a + b for a, b in path])))
    return out


def run_manifest(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumn("changed", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("x").cast("binary"), 256)))
    for c in ("idx", "grp", "digest", "n", "at", "mid", "pid", "path", "c0"):
        df = df.withColumn(c, F.lit("clash"))
    return merkle.manifest(df, "lang", "doc_id", carried=["changed"])


def test_manifest_of_many_shapes(spark):
    rows = [(i * 7 % 1000, lang, h(lang or "-", str(i))) for lang, n in {"en": 600, "de": 64, "fr": 65, "es": 8, "it": 1, "": 9, None: 3, "é": 2, "z": 1, "Z": 513}.items() for i in range(n)]
    rows += [(5, "en", h("same"))] * 40 + [(None, "de", h("none")), (None, "de", h("none")), (None, None, h("a"))]
    found = run_manifest(spark, rows)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), merkle.fold(F.col("leaf"), F.col("path")).alias("again"), merkle.fold(F.coalesce("changed", "leaf"), F.col("path")).alias("other"), "changed").collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(plain_manifest(rows), key=repr)
    assert all(r.again == r.root and (r.other == r.root) == (r.changed is None) for r in got)


def test_manifest_of_one_group_one_row_and_nothing(spark):
    for rows in ([(i, "en", h(str(i))) for i in range(20)], [(1, None, h("only"))], [(1, "a", h("1")), (2, "b", h("2"))]):
        got = run_manifest(spark, rows).select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path"))).collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(plain_manifest(rows), key=repr)
    assert run_manifest(spark, []).count() == 0


def test_fields_of_a_leaf(spark):
    got = spark.createDataFrame([(1, None, "é:"), (None, "", "a")], "a long, b string, c string").select(merkle.leaf_digest([F.col("a"), F.col("b"), F.col("c")])).collect()
    assert [r[0] for r in got] == [h("1:1", "-", "3:é:"), h("-", "0:", "1:a")]
