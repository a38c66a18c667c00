"""Data quality, catalogue and slow-control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamloom.functions import waveform as Wf
from beamloom.operators import limits as L
from beamloom.operators import quality as Q
from beamloom.plans.adapters import HITS_SQL, US_PER_S, as_hits, read
from beamloom.plans.catalogue import Catalogue

C = Catalogue()
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def us(col: str):
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {col})")


GAPS_SQL = """a AS (SELECT CAST(user_id % 3 AS INT) AS serial, event_id AS seq, CAST((event_id * event_id * 21) % 8388608 AS BIGINT) AS counter FROM events),
s AS (SELECT *, (counter - lag(counter) OVER (PARTITION BY serial ORDER BY seq) + 8388608) % 8388608 AS step FROM a),
g AS (SELECT serial, seq, CASE WHEN step BETWEEN 1 AND 1048576 THEN step - 1 ELSE 0 END AS missing, step IS NOT NULL AND NOT (step BETWEEN 1 AND 1048576) AS damage FROM s)"""


def _aggs(spark, sf):
    e = read(spark, sf, "events")
    return e.select((F.col("user_id") % 3).cast("int").alias("serial"), F.col("event_id").alias("seq"), (F.col("event_id") * F.col("event_id") * 21 % 8388608).alias("counter"))


@C.query("counter_gaps", f"WITH {GAPS_SQL} SELECT serial, seq, missing, damage FROM g")
def counter_gaps(spark, sf):
    return Q.counter_gaps(_aggs(spark, sf)).select("serial", "seq", "missing", "damage")


@C.query(
    "gap_totals",
    f"""WITH {GAPS_SQL} SELECT serial, count(*) AS aggregates, count(*) FILTER (missing > 0) AS gaps, CAST(sum(missing) AS BIGINT) AS missing, count(*) FILTER (damage) AS damaged,
    CASE WHEN sum(missing) = 0 THEN 'ok' WHEN sum(missing) <= 3 AND sum(missing) / count(*) < 0.001 THEN 'notice' ELSE 'warn' END AS level FROM g GROUP BY serial""",
)
def gap_totals(spark, sf):
    t = Q.gap_totals(Q.counter_gaps(_aggs(spark, sf)), ["serial"])
    return t.withColumn("level", Q.loss_level(F.col("missing"), F.col("aggregates")))


@C.query(
    "file_summary",
    f"""WITH {HITS_SQL} SELECT serial, count(*) AS n, count(*) FILTER (pur) AS n_pur, count(*) FILTER (flags & 8 <> 0) AS n_1024, count(*) FILTER (flags & 32 <> 0) AS n_lost,
    count(*) FILTER (flags & 16 <> 0) AS n_over, min(ts_ps) AS ts_first, max(ts_ps) AS ts_last, (max(ts_ps) - min(ts_ps)) / 1e6 AS span_s,
    round(count(*) / ((max(ts_ps) - min(ts_ps)) / 1e6), 9) AS rate FROM hits GROUP BY GROUPING SETS ((serial), ())""",
)
def file_summary(spark, sf):
    return Q.file_summary(as_hits(spark, sf), 1e6).withColumn("rate", F.round("rate", 9))


@C.query(
    "health_lines",
    f"""WITH {HITS_SQL}, b AS (SELECT slot AS board, count(*) AS n, max(ts_ps) AS newest, count(*) FILTER (flags = 0) AS missing, count(*) FILTER (flags = 1 AND pur) AS damaged FROM hits GROUP BY slot),
    m AS (SELECT max(newest) AS a FROM b)
    SELECT board, 'warn' AS level, 'silent for ' || (a - newest) || ' while others write' AS text FROM b, m WHERE a - newest > 7200000000
    UNION ALL SELECT board, CASE WHEN missing <= 3 AND missing / n < 0.001 THEN 'notice' ELSE 'warn' END, missing || ' aggregates missing' FROM b WHERE missing > 0
    UNION ALL SELECT board, 'warn', damaged || ' damaged places' FROM b WHERE damaged > 0""",
)
def health_lines(spark, sf):
    b = as_hits(spark, sf).groupBy(F.col("slot").alias("board")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("aggregates"), F.max("ts_ps").alias("newest"),
        F.count_if(F.col("flags") == 0).alias("missing"), F.count_if((F.col("flags") == 1) & F.col("pur")).alias("damaged"), F.lit(0).alias("other"),
    )
    return Q.health_lines(b, 7_200_000_000)


@C.query(
    "problem_episodes",
    r"""WITH s AS (SELECT o_custkey % 500 AS step, 'Digi-' || (o_custkey % 4) || ': ' || CAST(floor(o_totalprice / 1000) AS BIGINT) || ' blocks lost, ' || o_orderpriority AS text FROM orders),
    k AS (SELECT step, 'Digi-' || split_part(split_part(text, '-', 2), ':', 1) || ': # blocks lost, ' || regexp_replace(split_part(text, ', ', 2), '^\d', '#') AS kind, max(text) AS text FROM s GROUP BY ALL),
    i AS (SELECT *, CASE WHEN step - lag(step) OVER (PARTITION BY kind ORDER BY step) = 1 THEN 0 ELSE 1 END AS nw FROM k)
    SELECT kind, min(step) AS first, max(step) AS last, count(*) AS steps, CAST(sum(nw) AS BIGINT) AS episodes, arg_max(text, step) AS text FROM i GROUP BY kind""",
)
def problem_episodes(spark, sf):
    o = read(spark, sf, "orders")
    text = F.concat(F.lit("Digi-"), (F.col("o_custkey") % 4).cast("string"), F.lit(": "), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(" blocks lost, "), "o_orderpriority")
    return Q.problem_episodes(o.select((F.col("o_custkey") % 500).alias("step"), text.alias("text")))


@C.query(
    "last_record",
    "SELECT o_custkey AS run, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS comment, max(o_orderkey) AS line FROM orders GROUP BY o_custkey",
)
def last_record(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("comment"), F.col("o_orderkey").alias("line"))
    return Q.last_per_key(o, ["run"], "line")


@C.query("newest_runs", "SELECT o_orderkey AS run, epoch_us(o_orderdate) AS start, o_orderpriority AS comment FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 300")
def newest_runs(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), us("o_orderdate").alias("start"), F.col("o_orderpriority").alias("comment"))
    return o.orderBy(F.desc("start"), F.desc("run")).limit(300)


@C.query(
    "run_catalogue",
    """WITH f AS (SELECT l_orderkey AS run, count(*) AS files, CAST(sum(l_partkey) AS BIGINT) AS bytes, max(epoch_us(l_shipdate)) AS modified FROM lineitem GROUP BY 1)
    SELECT f.*, o_orderpriority AS comment, CASE WHEN o_orderstatus = 'O' OR o_orderstatus IS NULL THEN 'none' WHEN o_orderstatus = 'P' THEN 'stale' ELSE 'incomplete' END AS summary,
      CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS rank FROM f LEFT JOIN orders ON o_orderkey = f.run""",
)
def run_catalogue(spark, sf):
    files = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey").alias("path"), F.col("l_partkey").alias("bytes"), us("l_shipdate").alias("modified")
    )
    o = read(spark, sf, "orders")
    records = o.select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("comment"))
    fp = files.groupBy("run").agg(F.sum(F.xxhash64("path", "bytes").cast("decimal(38,0)")).cast("string").alias("fp"))
    made = o.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("run"), "o_orderstatus").join(fp, "run")
    summaries = made.select("run", F.when(F.col("o_orderstatus") == "P", F.lit("other")).otherwise(F.col("fp")).alias("fingerprint"), F.lit(False).alias("complete"))
    c = Q.run_catalogue(files, records, summaries)
    return Q.summaries_wanted(c).select("run", "files", "bytes", "modified", "comment", "summary", "rank")


@C.query(
    "surviving_summary",
    """WITH a AS (SELECT o_custkey AS run, bool_or(o_orderstatus = 'F') AS complete, CAST(min(o_orderkey) % 2 AS VARCHAR) AS fp, min(o_orderpriority) AS live FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    b AS (SELECT o_custkey AS run, bool_or(o_orderstatus = 'F') AS complete, CAST(min(o_orderkey) % 4 - 1 AS VARCHAR) AS fp, NULL AS live FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
    j AS (SELECT coalesce(a.run, b.run) AS run, a.complete AS ac, b.complete AS bc, a.fp AS af, b.fp AS bf, a.live AS live, b.complete IS NULL OR (coalesce(a.complete, false) AND NOT b.complete AND a.fp IS NOT DISTINCT FROM b.fp) AS k
      FROM a FULL JOIN b ON a.run = b.run)
    SELECT run, CASE WHEN k THEN ac ELSE bc END AS complete, CASE WHEN k THEN 'old' ELSE 'new' END AS kept, live FROM j""",
)
def surviving_summary(spark, sf):
    o = read(spark, sf, "orders")

    def side(half: int, fp, live):
        g = o.filter(F.col("o_orderkey") % 2 == half).groupBy(F.col("o_custkey").alias("run"))
        return g.agg(F.bool_or(F.col("o_orderstatus") == "F").alias("complete"), fp.alias("fingerprint"), live.alias("live"), F.lit("").alias("doc"))

    old = side(0, (F.min("o_orderkey") % 2).cast("string"), F.min("o_orderpriority"))
    new = side(1, (F.min("o_orderkey") % 4 - 1).cast("string"), F.max(F.lit(None).cast("string")))
    return Q.surviving_summary(old, new).select("run", "complete", "kept", "live")


@C.query(
    "completeness",
    """WITH r AS (SELECT DISTINCT l_orderkey AS run, CASE WHEN l_returnflag = 'R' THEN 'counter gaps' WHEN l_quantity > 45 THEN 'tail unread' END AS reason FROM lineitem)
    SELECT run, count(reason) = 0 AS complete, coalesce(string_agg(reason, '; ' ORDER BY reason), '') AS why FROM r GROUP BY run""",
)
def completeness(spark, sf):
    l = read(spark, sf, "lineitem")
    reason = F.when(F.col("l_returnflag") == "R", "counter gaps").when(F.col("l_quantity") > 45, "tail unread")
    rows = l.select(F.col("l_orderkey").alias("run"), reason.alias("reason"))
    c = Q.completeness(rows, rows)
    return c.select("run", "complete", F.array_join("reasons", "; ").alias("why"))


@C.query(
    "cabling_problems",
    """WITH c AS (SELECT o_custkey AS run, o_orderkey AS line, CAST(1000 + o_orderkey % 5 AS INT) AS serial, CAST((o_orderkey // 5) % 9 AS INT) AS channel, CAST((o_orderkey // 7) % 4 AS INT) AS plane, CAST(1 + (o_orderkey // 11) % 6 AS INT) AS ch,
      CASE CAST((o_orderkey // 3) % 8 AS INT) WHEN 0 THEN 'rf' WHEN 1 THEN 'veto' WHEN 2 THEN 'lamp' ELSE 'trk' END AS kind FROM orders),
    p1 AS (SELECT *, CASE WHEN serial = 1004 THEN 'board not open' WHEN channel >= 8 THEN 'no such channel' WHEN kind = 'lamp' THEN 'unknown kind' WHEN kind = 'trk' AND (plane > 2 OR ch > 5) THEN 'not a tracker channel' END AS a FROM c),
    p2 AS (SELECT *, CASE WHEN a IS NULL AND kind = 'trk' AND count(*) FILTER (a IS NULL AND kind = 'trk') OVER (PARTITION BY run, plane, ch, kind = 'trk' ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'plane channel taken' END AS b FROM p1),
    p3 AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL AND kind = 'rf' AND count(*) FILTER (a IS NULL AND b IS NULL AND kind = 'rf') OVER (PARTITION BY run, kind ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'second rf' END AS d FROM p2),
    p4 AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL AND d IS NULL AND count(*) FILTER (a IS NULL AND b IS NULL AND d IS NULL) OVER (PARTITION BY run, serial, channel ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'given twice' END AS e FROM p3)
    SELECT run, line, coalesce(a, b, d, e) AS problem FROM p4""",
)
def cabling_problems(spark, sf):
    k = F.col("o_orderkey")
    kind = F.expr("element_at(array('rf', 'veto', 'lamp', 'trk', 'trk', 'trk', 'trk', 'trk'), cast((o_orderkey div 3) % 8 as int) + 1)")
    rows = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"), k.alias("line"), (1000 + k % 5).cast("int").alias("serial"), F.expr("cast((o_orderkey div 5) % 9 as int)").alias("channel"),
        F.expr("cast((o_orderkey div 7) % 4 as int)").alias("plane"), F.expr("cast(1 + (o_orderkey div 11) % 6 as int)").alias("ch"), kind.alias("kind"),
    )
    boards = rows.select("run").distinct().select("run", F.explode(F.array(*[F.lit(1000 + i) for i in range(4)])).alias("serial"), F.lit(8).alias("channels"))
    return Q.check_cabling(rows, boards, {0: 5, 1: 5, 2: 5}).select("run", "line", "problem")


@C.query(
    "key_differences",
    """WITH d AS (SELECT epoch_us(l_shipdate) // 2592000000000 AS doc, CAST(l_suppkey AS VARCHAR) AS key, CAST(max(CAST(l_quantity AS INT)) // 10 AS VARCHAR) AS value FROM lineitem GROUP BY 1, 2),
    p AS (SELECT doc, lag(doc) OVER (ORDER BY doc) AS prev FROM (SELECT DISTINCT doc FROM d)),
    k AS (SELECT p.doc, p.prev, keys.key FROM p, (SELECT DISTINCT key FROM d) keys WHERE prev IS NOT NULL)
    SELECT k.doc, k.key, a.value AS before, b.value AS after FROM k LEFT JOIN d a ON a.doc = k.prev AND a.key = k.key LEFT JOIN d b ON b.doc = k.doc AND b.key = k.key
    WHERE (a.key IS NULL) <> (b.key IS NULL) OR a.value IS DISTINCT FROM b.value""",
)
def key_differences(spark, sf):
    l = read(spark, sf, "lineitem").withColumn("t", us("l_shipdate"))
    d = l.groupBy(F.expr("t div 2592000000000").alias("doc"), F.col("l_suppkey").cast("string").alias("key")).agg(F.expr("cast(max(cast(l_quantity as int)) div 10 as string)").alias("value"))
    return Q.key_differences(d, "doc")


@C.query(
    "register_differences",
    """WITH a AS (SELECT ps.supp AS board, ps.part AS idx, ps.v & CASE WHEN ps.part % 3 = 0 THEN 15 ELSE 255 END AS v, ps.half FROM
      (SELECT l_suppkey AS supp, l_partkey % 64 AS part, l_orderkey % 2 AS half, max(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2, 3) ps WHERE ps.part % 5 <> 0),
    l AS (SELECT board, idx, v FROM a WHERE half = 0), r AS (SELECT board, idx, v FROM a WHERE half = 1)
    SELECT board, idx AS "index", 'REG_' || idx AS name, l.v AS before, r.v AS after FROM l FULL JOIN r USING (board, idx) WHERE l.v IS DISTINCT FROM r.v""",
)
def register_differences(spark, sf):
    l = read(spark, sf, "lineitem")
    g = l.groupBy(F.col("l_suppkey").alias("board"), (F.col("l_partkey") % 64).alias("index"), (F.col("l_orderkey") % 2).alias("half")).agg(F.max(F.col("l_quantity").cast("long")).alias("value"))
    known = spark.range(64).filter("id % 5 <> 0")
    names = known.select(F.col("id").alias("index"), F.concat(F.lit("REG_"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 3 == 0, 15).otherwise(255).cast("long").alias("mask"))
    return Q.register_differences(g.filter("half = 0").drop("half"), g.filter("half = 1").drop("half"), names)


@C.query(
    "written_rate",
    """WITH x AS (SELECT o_custkey AS k, o_orderkey AS t, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders)
    SELECT k, t, CASE WHEN bytes - lag(bytes) OVER w >= 0 THEN round((bytes - lag(bytes) OVER w) / (t - lag(t) OVER w), 6) END AS rate FROM x WINDOW w AS (PARTITION BY k ORDER BY t)""",
)
def written_rate(spark, sf):
    x = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("t"), F.floor("o_totalprice").alias("bytes"))
    return Q.written_rate(x, "k").select("k", "t", F.round("rate", 6).alias("rate"))


@C.query(
    "stale_inputs",
    f"""WITH {HITS_SQL}, v AS (SELECT slot, ts_ps, pos, qlong // 8192 AS v, lag(qlong // 8192) OVER (PARTITION BY slot ORDER BY ts_ps, pos) AS p FROM hits), n AS (SELECT max(ts_ps) AS now FROM hits)
    SELECT slot, max(CASE WHEN p IS NULL OR p <> v THEN ts_ps END) AS moved, max(ts_ps) AS newest, any_value(now) - max(CASE WHEN p IS NULL OR p <> v THEN ts_ps END) > 36000000000 AS stale FROM v, n GROUP BY slot""",
)
def stale_inputs(spark, sf):
    h = as_hits(spark, sf).select("slot", "ts_ps", "pos", F.expr("cast(qlong as long) div 8192").alias("v"))
    now = h.agg(F.max("ts_ps")).first()[0]
    return Q.stale_since(h, "slot", "v", now, 36_000_000_000, "ts_ps", "pos")


@C.query("setup_identities", "SELECT p_brand, p_type, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_type\":\"' || p_type || '\"}') AS identity, count(*) AS n FROM part GROUP BY ALL")
def setup_identities(spark, sf):
    p = read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    s = p.select("p_brand", "p_type", F.col("p_brand").alias("kb"), F.col("p_type").alias("kt"), "n")
    return Q.setup_identity(s, ["kb", "kt", "n"]).select(F.col("kb").alias("p_brand"), F.col("kt").alias("p_type"), "identity", "n")


READINGS_SQL = f"r AS (SELECT event_type AS input, epoch_us(ts) // 1000 AS t, CASE WHEN value < 0.5 THEN NULL ELSE value * 2 - 1 END AS value FROM events)"


def readings(spark, sf):
    from beamloom.functions.hitcols import linear_value

    e = read(spark, sf, "events")
    raw = F.when(F.col("value") < 0.5, F.lit(float("nan"))).otherwise(F.col("value"))
    t = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts) div 1000")
    return e.select(F.col("event_type").alias("input"), t.alias("t"), linear_value(raw, F.lit(2.0), F.lit(-1.0)).alias("value"))


def _frame(lo: int, hi: int) -> str:
    return f"OVER (PARTITION BY input ORDER BY t RANGE BETWEEN {hi - 1} PRECEDING AND {lo} PRECEDING)"


@C.query(
    "moving_changes",
    f"""WITH {READINGS_SQL} SELECT input, t, value, round(avg(value) {_frame(0, 4_000_000)} - avg(value) {_frame(10_000_000, 14_000_000)}, 8) AS change_10s,
    round(avg(value) {_frame(0, 12_000_000)} - avg(value) {_frame(60_000_000, 72_000_000)}, 8) AS change_1m,
    round(avg(value) {_frame(0, 60_000_000)} - avg(value) {_frame(600_000_000, 660_000_000)}, 8) AS change_10m FROM r""",
)
def moving_changes(spark, sf):
    # the stream is sparse: one "second" of the rule is a thousand seconds here
    c = L.changes(readings(spark, sf), unit=1_000_000)
    return c.withColumns({f"change_{n}": F.round(f"change_{n}", 8) for n, _, _ in L.INTERVALS})


@C.query(
    "change_over",
    f"""WITH {READINGS_SQL}, v AS (SELECT * FROM r WHERE value IS NOT NULL),
    m AS (SELECT *, avg(value) OVER (PARTITION BY input ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent,
      avg(value) OVER (PARTITION BY input ORDER BY t RANGE BETWEEN CURRENT ROW AND 60000000 FOLLOWING) AS ahead FROM v),
    f AS (SELECT *, min(t) OVER (PARTITION BY input ORDER BY t RANGE BETWEEN 660000000 PRECEDING AND CURRENT ROW) AS t0 FROM m),
    j AS (SELECT f.*, p.ahead AS past FROM f JOIN (SELECT DISTINCT input, t, ahead FROM m) p ON p.input = f.input AND p.t = f.t0)
    SELECT input, t, CASE WHEN t - 60000000 - t0 > 0 THEN round(recent - past, 8) END AS change,
      CASE WHEN t - 60000000 - t0 > 0 THEN least((t - 60000000 - t0) / 1e6, 600) ELSE 0 END AS span_s FROM j""",
)
def change_over(spark, sf):
    c = L.change_over(readings(spark, sf), 600, unit=1_000_000)
    return c.select("input", "t", F.round("change", 8).alias("change"), "span_s")


# (rule, input, limit, level, span in thousands of seconds, begin of its mode)
CHANGE_RULES = [("c1", "click", 40.0, "notice", 600, None), ("c2", "click", 90.0, "bad", 120, None), ("c3", "error", 40.0, "problem", 600, 1_705_000_000_000), ("c4", "view", 60.0, "warn", 600, None)]


def _change_sql() -> str:
    ctes, rules = [], []
    for name, key, limit, level, w, since in CHANGE_RULES:
        early = f" FILTER (t >= {since - 60_000_000})" if since else ""
        ctes.append(f"""{name}f AS (SELECT *, min(t){early} OVER (PARTITION BY input ORDER BY t RANGE BETWEEN {(w + 60) * 1_000_000} PRECEDING AND CURRENT ROW) AS t0 FROM m WHERE input = '{key}'),
    {name} AS (SELECT DISTINCT f.input, f.t, CASE WHEN f.t - 60000000 - t0 > 0 THEN recent - p.ahead END AS change, CASE WHEN f.t - 60000000 - t0 > 0 THEN least((f.t - 60000000 - t0) / 1e6, {w}) ELSE 0 END AS span
      FROM {name}f f LEFT JOIN (SELECT DISTINCT input, t, ahead FROM m) p ON p.input = f.input AND p.t = f.t0)""")
        hit = f"coalesce(abs({name}.change) >= {limit}, false)"
        rules.append((name, hit, limit, level, w))
    rank = {"notice": 3, "problem": 4, "warn": 5, "bad": 6}
    levels = ", ".join(f"CASE WHEN {hit} THEN {rank[level]} ELSE 1 END" for _, hit, _, level, _ in rules)
    said = ", ".join([f"CASE WHEN {hit} THEN 'change {limit} [{level}]' END" for _, hit, limit, level, _ in rules] + [f"CASE WHEN {n}.span < {w} THEN 'change {limit}: only ' || CAST(floor({n}.span) AS BIGINT) || ' s of history' END" for n, _, limit, _, w in rules])
    joins = " ".join(f"LEFT JOIN {n} ON {n}.input = v.input AND {n}.t = v.t" for n, *_ in rules)
    return f"""WITH {READINGS_SQL}, v AS (SELECT * FROM r WHERE value IS NOT NULL),
    m AS (SELECT *, avg(value) OVER (PARTITION BY input ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent,
      avg(value) OVER (PARTITION BY input ORDER BY t RANGE BETWEEN CURRENT ROW AND 60000000 FOLLOWING) AS ahead FROM v), {", ".join(ctes)}
    SELECT v.input, v.t, v.value, CASE greatest(1, {levels}) WHEN 1 THEN 'ok' WHEN 3 THEN 'notice' WHEN 4 THEN 'problem' WHEN 5 THEN 'warn' WHEN 6 THEN 'bad' END AS level,
      list_sort(list_filter([{said}], lambda x: x IS NOT NULL)) AS reasons FROM v {joins}"""


@C.query("change_rules", _change_sql())
def change_rules(spark, sf):
    """Every rule over its own span; one begins with its mode, another's mode is off."""
    rows = [(n, i, "change", limit, level, w, {"beam": "on"} if since else {}) for n, i, limit, level, w, since in CHANGE_RULES] + [("off", "purchase", "change", 0.0, "bad", 600, {"beam": "off"})]
    rules = spark.createDataFrame(rows, "rule string, input string, op string, limit double, level string, within_s int, when map<string, string>")
    modes = spark.createDataFrame([("beam", "on", next(s for *_, s in CHANGE_RULES if s))], "mode string, present string, since long")
    channels = spark.createDataFrame([(i, None, None, False) for i in ("click", "error", "view", "signup", "purchase")], "input string, lo double, hi double, safety boolean")
    r = readings(spark, sf).filter("value IS NOT NULL")
    now = L.rules_in_force(rules, modes)
    return L.evaluate(L.rule_changes(r, now, unit=1_000_000), channels, now).select("input", "t", "value", "level", "reasons")


RULES = [("r1", "click", "above", 300.0, "notice"), ("r2", "click", "at_or_above", 600.0, "warn"), ("r3", "error", "below", 3.0, "bad"), ("r4", "view", "above", 900.0, "critical"), ("r5", "signup", "above", 1.0, "notice")]


def _rules(spark):
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("rule", "input", "op", "limit", "level"))], F.when(F.lit(r[0]) == "r5", F.create_map(F.lit("beam"), F.lit("on"))).otherwise(F.create_map().cast("map<string,string>")).alias("when")) for r in RULES]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


LEVELS_SQL = f"""{READINGS_SQL}, k AS (SELECT *, CASE WHEN value IS NULL THEN CASE WHEN input IN ('click', 'error', 'view') THEN 5 ELSE 2 END ELSE greatest(
    CASE WHEN value > 950 THEN CASE WHEN input IN ('click', 'error', 'view') THEN 5 ELSE 3 END ELSE 1 END,
    CASE WHEN input = 'click' AND value > 300 THEN 3 ELSE 1 END, CASE WHEN input = 'click' AND value >= 600 THEN 5 ELSE 1 END,
    CASE WHEN input = 'error' AND value < 3 THEN 6 ELSE 1 END, CASE WHEN input = 'view' AND value > 900 THEN 7 ELSE 1 END) END AS rk FROM r),
  lv AS (SELECT input, t, value, rk, CASE rk WHEN 1 THEN 'ok' WHEN 2 THEN 'nodata' WHEN 3 THEN 'notice' WHEN 5 THEN 'warn' WHEN 6 THEN 'bad' WHEN 7 THEN 'critical' END AS level FROM k)"""


def _levels(spark, sf):
    rules = _rules(spark)
    modes = spark.range(1).select(F.lit("beam").alias("mode"), F.lit("off").alias("present"))
    channels = rules.groupBy("input").agg(F.lit(-10.0).alias("lo"), F.lit(950.0).alias("hi"), F.bool_or(F.col("level").isin(*L.SAFETY)).alias("safety"))
    inputs = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("click", "error", "view", "signup", "purchase")])).alias("input"))
    channels = inputs.join(channels, "input", "left").na.fill({"lo": -10.0, "hi": 950.0, "safety": False})
    return L.evaluate(readings(spark, sf), channels, L.rules_in_force(rules, modes))


@C.query("limits_eval", f"WITH {LEVELS_SQL} SELECT input, t, value, level FROM lv")
def limits_eval(spark, sf):
    return _levels(spark, sf).select("input", "t", "value", "level")


@C.query("worst_level", f"WITH {LEVELS_SQL} SELECT input, t // 86400000 AS day, arg_max(level, rk) AS worst, max(rk) AS rank, count(*) AS n, count(*) FILTER (rk >= 3) AS n_flagged FROM lv GROUP BY 1, 2")
def worst_level(spark, sf):
    return L.summarize(_levels(spark, sf).withColumn("day", F.expr("t div 86400000")), ["input", "day"])


@C.query(
    "group_line",
    f"WITH {LEVELS_SQL} SELECT input AS grp, arg_max(level, rk) AS worst, min(value) FILTER (t % 10 <> 0) AS low, max(value) FILTER (t % 10 <> 0) AS high, count(value) FILTER (t % 10 <> 0) AS reading, count(*) FILTER (t % 10 = 0) AS unconnected FROM lv GROUP BY 1",
)
def group_line(spark, sf):
    x = _levels(spark, sf).withColumn("connected", F.col("t") % 10 != 0).withColumnRenamed("input", "grp")
    return L.collapse(x)


@C.query(
    "trace_gates",
    """WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0.1) AS g, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings)
    SELECT vec_id, CASE WHEN list_contains(g, true) THEN CAST(list_position(g, true) - 1 AS INT) END AS gate_from,
    CASE WHEN list_contains(g, true) THEN CAST(len(g) - list_position(list_reverse(g), true) + 1 AS INT) END AS gate_to,
    round(list_sum(w[1:8]) / 8, 9) AS base, round(list_sum(w[1:8]) / 8 - 0.05::DOUBLE, 9) AS level FROM d""",
)
def trace_gates(spark, sf):
    e = read(spark, sf, "embeddings")
    wf = F.col("embedding").cast("array<double>")
    a, b = Wf.gate_span(F.transform("embedding", lambda x: x > F.lit(0.1).cast("float")))
    return e.select("vec_id", a.alias("gate_from"), b.alias("gate_to"), F.round(Wf.baseline(wf, 16), 9).alias("base"), F.round(Wf.threshold_level(wf, 16, 0.05, True), 9).alias("level"))


@C.query(
    "line_protocol",
    f"WITH {HITS_SQL} SELECT 'TrigRate,Bd=' || board || ',Ch=' || ch || ' value=' || printf('%.6f', count(*) / 86400.0::DOUBLE) AS value FROM hits GROUP BY board, ch",
)
def line_protocol(spark, sf):
    from beamloom.sources.sinks import rate_lines

    r = as_hits(spark, sf).groupBy("board", "ch").agg((F.count(F.lit(1)) / F.lit(86400.0)).alias("rate"))
    return rate_lines(r)


@C.query(
    "complete_seconds",
    f"""WITH {HITS_SQL}, s AS (SELECT run, board, ts_ps // 3600000000 AS sec, count(*) AS n FROM hits GROUP BY ALL),
    k AS (SELECT run, board, min(nw) AS known FROM (SELECT run, board, ch // 2 AS c, max(ts_ps) AS nw FROM hits GROUP BY ALL) GROUP BY ALL)
    SELECT s.*, CASE WHEN (sec + 1) * 3600000000 <= known THEN n END AS rate FROM s LEFT JOIN k USING (run, board)""",
)
def complete_seconds(spark, sf):
    from beamloom.operators.rates import complete_seconds as done

    h = as_hits(spark, sf)
    sec = h.groupBy("run", "board", F.expr("ts_ps div 3600000000").alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    frontier = h.groupBy("run", "board", F.expr("ch div 2").alias("couple")).agg(F.max("ts_ps").alias("newest"))
    return done(sec, frontier, 3600 * US_PER_S)


@C.query(
    "led_commands",
    """WITH l AS (SELECT o_custkey AS run, o_orderkey AS run_ms, o_orderpriority AS what, o_orderstatus <> 'P' AS ok FROM orders),
    f AS (SELECT run, count(*) AS failed, arg_max(what, run_ms) AS last_what FROM l WHERE NOT ok GROUP BY run) SELECT * FROM f""",
)
def led_commands(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("run_ms"), F.col("o_orderpriority").alias("what"), (F.col("o_orderstatus") != "P").alias("ok"), F.lit("").alias("error"))
    return L.failed_commands(o).drop("last_error")


@C.query(
    "led_on_data_clock",
    f"""WITH {HITS_SQL}, z AS (SELECT min(ts_ps) // 3600000000 AS z FROM hits), r AS (SELECT ts_ps // 3600000000 - z AS sec, count(*) AS n FROM hits, z GROUP BY 1)
    SELECT o_orderkey, CAST(floor(o_orderkey / 1000.0::DOUBLE - 0.5) AS BIGINT) AS sec, n FROM orders LEFT JOIN r ON r.sec = floor(o_orderkey / 1000.0::DOUBLE - 0.5)""",
)
def led_on_data_clock(spark, sf):
    h = as_hits(spark, sf)
    z = h.agg(F.min("ts_ps")).first()[0] // 3_600_000_000
    rates = h.groupBy(F.lit(0).alias("run"), (F.expr("ts_ps div 3600000000") - z).alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    led = read(spark, sf, "orders").select(F.lit(0).alias("run"), "o_orderkey", F.col("o_orderkey").alias("run_ms"))
    return L.commands_on_data_clock(led, rates, 0.5).select("o_orderkey", "sec", "n")
