"""URL filters: rules where they fit, else trust and distrust that spread over the links between hosts.

Trust is a personalised PageRank from the hosts that rules mostly allow, along links; distrust is one from the hosts that
rules mostly block, against them: who links to a blocked host is suspect, who is linked from a trusted host is not. A
host is blocked if more than ``threshold`` per cent of its trust and distrust together is distrust.

Ranks are whole numbers (decimals of FINE to each 10**-12 of a kind's seeds, divided with the rest dropped), so sums have
one result in any order and the same verdicts come out of every run. A share that would vanish is one unit, so each host
that a seed reaches is judged. Ranks are computed until a round changes none by more than its TOLERANCE-th part; the
number of rounds grows with the longest way from a seed. Verdicts are taken from the full ranks; ``trust`` and
``distrust`` give them in whole shares of 10**12, so they can be 0 for a host far from all seeds. Defined cases: a null URL, or one without ``://``, has an empty host and path;
such pages fit no rule, have no links and are allowed, and so are hosts that neither rank reaches. A null html has no
links. Repeated rows are judged alike, and count as further pages of their host. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.session import cut

SCALE = 10**12
#: Units of rank to one share of SCALE.
FINE = 10**18
#: A rank is final once a round adds no more to it than its TOLERANCE-th part.
TOLERANCE = 10**6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F, F
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = text.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(kind))
    return text, verdict


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct pairs (src, dst) of different hosts that a page of src links to; copies of a link count once."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\shref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1)))
    edges = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(found).alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
    return edges.filter("src <> dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, damping: int = 85, tolerance: int = TOLERANCE) -> DataFrame:
    """Rank of each (kind, host) that its kind's seeds reach, in units of 1 / (SCALE * FINE).

    edges: kind, src, dst; seeds: kind, host. Each step is one join and one sum that combines before the shuffle; a step's
    ranks are written, so that plans stay short and a lost executor costs one step. Ranks begin at what the seeds keep, so
    they only grow, and steps end when no rank grows by more than 1 / ``tolerance`` of itself; a host newly reached does.
    """
    out = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("n"))
    edges = cut(edges.join(out, ["kind", "src"]), "graph-edges")
    total = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    whole = "decimal(38, 0)"
    kept = F.expr(f"cast(cast({SCALE} div n as {whole}) * {FINE * (100 - damping) // 100} as {whole})")
    start = cut(seeds.join(total, "kind").select("kind", "host", kept.alias("rank")), "graph-seeds")
    none = F.lit(0).cast(whole)
    share = F.expr(f"cast(greatest(floor(cast(rank * {damping} as {whole}) / cast(100 * n as decimal(20, 0))), 1) as {whole})")
    ranks = start
    while True:
        moved = ranks.join(edges, (ranks["kind"] == edges["kind"]) & (ranks["host"] == edges["src"])).select(edges["kind"], edges["dst"].alias("host"), share.alias("rank"), none.alias("old"))
        before = ranks.select("kind", "host", none.alias("rank"), F.col("rank").alias("old"))
        sums = start.withColumn("old", none).unionByName(moved).unionByName(before).groupBy("kind", "host").agg(F.sum("rank").cast(whole).alias("rank"), F.sum("old").cast(whole).alias("old"))
        grown = F.col("rank") - F.col("old") > F.floor(F.col("rank") / tolerance)
        ranks = cut(sums.select("kind", "host", "rank", grown.alias("grown")), "graph-ranks")
        if not ranks.filter("grown").limit(1).count():
            return ranks.drop("grown")
        ranks = ranks.drop("grown")


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", html: str = "html", threshold: int = 50) -> DataFrame:
    """key, host, path, rule, verdict, and the trust and distrust of the host."""
    u = F.col(f"`{url}`")
    p = pages.select(F.col(f"`{key}`").alias(key), host_of(u).alias("host"), path_of(u).alias("path"), F.col(f"`{html}`").alias("__html"))
    p = p.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = p.select(key, "host", "path", rule.alias("rule"), said.alias("said"))
    balance = judged.filter("host <> '' AND said IS NOT NULL").groupBy("host").agg(F.sum(F.when(F.col("said") == "block", -1).otherwise(1)).alias("b"))
    seeds = balance.filter("b <> 0").select(F.when(F.col("b") > 0, F.lit("trust")).otherwise(F.lit("distrust")).alias("kind"), "host")
    pairs = cut(links(p, "__html"), "graph-links")
    edges = pairs.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(pairs.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    ranks = spread(edges, seeds)
    rank = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0)).cast("decimal(38, 0)")
    hosts = ranks.groupBy("host").agg(rank("trust").alias("t"), rank("distrust").alias("d"))
    shares = lambda c: F.floor(F.col(c) / F.lit(FINE)).cast("long")
    bad = F.col("d") * 100 > (F.col("t") + F.col("d")) * threshold
    hosts = hosts.select("host", shares("t").alias("trust"), shares("d").alias("distrust"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")).alias("method"))
    told = judged.join(hosts, "host", "left")
    verdict = F.coalesce("said", "method", F.lit("allow"))
    return told.select(key, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))


def judge_sql(rules: Sequence[Rule], rounds: int = 6, threshold: int = 50, damping: int = 85) -> str:
    """The same in SQL over ``pages``, as far as ``rounds`` steps on whole shares of SCALE are enough: where no link leads on, as in the given pages."""
    host = "CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
    path = "CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda i: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p, k)[i]}'" for k, h, p in ordered) + " END"
    steps = ["r0 AS (SELECT kind, host, rank FROM start)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS (SELECT kind, host, CAST(sum(rank) AS BIGINT) AS rank FROM (SELECT kind, host, rank * {100 - damping} // 100 AS rank FROM start"
            f" UNION ALL SELECT e.kind, e.dst, r.rank * {damping} // (100 * e.n) FROM r{i} r JOIN edges e ON r.kind = e.kind AND r.host = e.src) GROUP BY ALL)"
        )
    return f"""WITH p AS (SELECT page_id, {host} AS host, {path} AS path, html FROM pages),
  judged AS (SELECT page_id, host, path, {case(0)} AS rule, {case(1)} AS said FROM p),
  balance AS (SELECT host, sum(CASE said WHEN 'block' THEN -1 ELSE 1 END) AS b FROM judged WHERE host <> '' AND said IS NOT NULL GROUP BY host),
  seeds AS (SELECT CASE WHEN b > 0 THEN 'trust' ELSE 'distrust' END AS kind, host FROM balance WHERE b <> 0),
  start AS (SELECT kind, host, {SCALE} // count(*) OVER (PARTITION BY kind) AS rank FROM seeds),
  l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1)) AS d FROM p WHERE host <> ''),
  pairs AS (SELECT DISTINCT src, translate(d, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM l),
  both_ways AS (SELECT 'trust' AS kind, src, dst FROM pairs WHERE src <> dst UNION ALL SELECT 'distrust', dst, src FROM pairs WHERE src <> dst),
  edges AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS n FROM both_ways),
  {", ".join(steps)},
  hosts AS (SELECT host, CAST(coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS BIGINT) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust * 100 > (trust + distrust) * {threshold} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM judged LEFT JOIN hosts USING (host)"""
