"""SQL that the named queries must agree with."""

from __future__ import annotations

from beamloom.llm.sharding import DIGITS


def topk_sql() -> str:
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def sharding_sql(n: int = 24) -> str:
    return f"""WITH t(i, c) AS (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT)) FROM range(256) r(i)),
  tab AS (SELECT list(c ORDER BY i) AS tab FROM t),
  d AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32, coalesce('k' || doc_id, 'null') AS k FROM documents, tab),
  m AS (SELECT doc_id, k, i, -ln((CAST('0x' || substr(md5(k || '#' || i), 1, {DIGITS}) AS BIGINT) + 0.5) / {float(16**DIGITS)}) AS far FROM (SELECT DISTINCT doc_id, k FROM d), range({n + 1}) r(i)),
  best AS (SELECT doc_id, CAST(arg_min(i, far) FILTER (i < {n}) AS INT) AS shard, CAST(arg_min(i, far) AS INT) AS grown_shard FROM m GROUP BY doc_id)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(k || '#slot'), 1, 2) AS INT), d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM d JOIN best ON d.doc_id IS NOT DISTINCT FROM best.doc_id"""


def warc_sql() -> str:
    return """WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""


def decontaminate_sql() -> str:
    def sets(table: str, key: str) -> str:
        return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})"""

    return f"""WITH d AS ({sets("documents", "doc_id")}),
  b AS ({sets("benchmark", "item_id")}),
  q AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, CAST(n AS INT) AS item_shingles, count(*) AS shared
FROM d JOIN b USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 80"""


def audit_sql() -> str:
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    names = "abcde"
    apart = " AND ".join(f"{y}.l <> {x}.l" for i, x in enumerate(names) for y in names[:i])
    order = " || ".join(f"{x}.l" for x in names)
    states = ", ".join(f"{' + '.join(f'{x}.b' for x in names[:i]) or 0} AS s{i}" for i in range(5))
    steps = " UNION ALL ".join(f"SELECT filter_order, {i + 1} AS step, s{i} AS before, b{i} AS own FROM o" for i in range(5))
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  low AS (SELECT text, min(doc_id) AS low FROM d GROUP BY text),
  lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n,
      CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > low THEN 16 ELSE 0 END AS mask
    FROM d JOIN low ON d.text = low.text LEFT JOIN lab ON d.doc_id = lab.doc_id GROUP BY ALL),
  f(l, b) AS {letters},
  o AS (SELECT {order} AS filter_order, {states}, {", ".join(f"{x}.b AS b{i}" for i, x in enumerate(names))} FROM {", ".join(f"f {x}" for x in names)} WHERE {apart}),
  s AS ({steps}),
  r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before + own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN mask & own > 0 AND mask & before = 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM m, s GROUP BY part, filter_order, step, own, before)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""


def merkle_sql(levels: int = 7, above: int = 3) -> str:
    """Trees of at most 8**levels leaves in each of at most 8**above groups."""
    field = lambda c, size: f"CASE WHEN {c} IS NULL THEN '-' ELSE {size} || ':' || {c} END"
    fields = lambda text: " || ".join(field(c, f"strlen(CAST({c} AS VARCHAR))") for c in ("doc_id", "source", "lang", "n_chars", text))
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = []

    def tree(start: str, p: str, depth: int) -> None:
        parts.append(f"{p}0 AS (SELECT grp, idx, count(*) OVER (PARTITION BY grp) AS n, digest FROM {start})")
        for i in range(depth):
            w = f"(PARTITION BY grp, idx // 8 ORDER BY idx ROWS BETWEEN"
            parts.append(
                f"{p}s{i} AS (SELECT grp, idx, n > 1 AS more, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, "
                f"CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {p}{i})"
            )
            parts.append(f"{p}{i + 1} AS (SELECT grp, idx // 8 AS idx, (max(n) + 7) // 8 AS n, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest FROM {p}{i} GROUP BY grp, idx // 8)")

    tree("leaf", "n", levels)
    parts.append(f"subs AS (SELECT '' AS grp, grp AS of, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, digest FROM n{levels})")
    tree("subs", "t", above)
    joins = "".join(f" JOIN ns{i} x{i} ON x{i}.grp = leaf.grp AND x{i}.idx = leaf.idx // {8**i}" for i in range(levels)) + " JOIN subs ON subs.of = leaf.grp"
    joins += "".join(f" JOIN ts{i} y{i} ON y{i}.idx = subs.idx // {8**i}" for i in range(above)) + f", t{above} top"
    steps = [f"x{i}" for i in range(levels)] + [f"y{i}" for i in range(above)]
    kept = ", ".join(f"{s}.more AS {s}m, {s}.l AS {s}l, {s}.r AS {s}r" for s in steps)
    folds, last = [], "w"
    for s in steps:
        folds.append(f"f{s} AS (SELECT * REPLACE (CASE WHEN {s}m THEN sha256({s}l || folded || {s}r) ELSE folded END AS folded) FROM {last})")
        last = f"f{s}"
    return f"""WITH t(i, c) AS (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT)) FROM range(256) r(i)),
  tab AS (SELECT list(c ORDER BY i) AS tab FROM t),
  leaf AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '1' || lang END AS grp, sha256({fields("text")}) AS digest,
      CASE WHEN xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 3 = 0
        THEN sha256({fields(small)}) ELSE sha256({fields("text")}) END AS tampered,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM documents, tab),
  {", ".join(parts)},
  w AS (SELECT leaf.doc_id, leaf.digest AS leaf, subs.digest AS subroot, top.digest AS root, leaf.tampered AS folded, {kept} FROM leaf{joins}),
  {", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"{s}l || {s}r" for s in steps)}) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}"""
