"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from seamline.llm.secrets import BASE, RULES

ORACLES: dict[str, str] = {}

ORACLES["op3_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '(?:<[^>]*>|\s)+', ' ', 'g')) AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""

_quoted = lambda s: "'" + s.replace("'", "''") + "'"


def _secrets() -> str:
    parts = []
    for k, rule in enumerate(RULES):
        pattern = _quoted(rule.pattern)
        kept = f"regexp_extract_all(t, {pattern}, {rule.group})"
        parts.append(
            f"""SELECT doc_id, {k} AS place, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, m, g, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id, unnest(found) AS m, unnest(kept) AS g, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS found, {kept} AS kept, string_split_regex(t, {pattern}) AS gaps FROM d) WHERE len(found) > 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE length(g) >= {rule.least}"""
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    line = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
s AS (SELECT doc_id, {counts}, string_agg({line}, ',' ORDER BY s, place) FILTER (WHERE kind IN ({base})) AS base, string_agg({line}, ',' ORDER BY s, place) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)"""


ORACLES["op4_secret_scans"] = _secrets()

ORACLES["op9_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sh),
x AS (SELECT doc_id, unnest(s) AS g FROM sh),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""

ORACLES["op6_url_filters"] = r"""
WITH p AS (
  SELECT page_id, url,
    CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM p
), r(verdict, r_host, r_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('allow', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT h.page_id, h.host, h.path, r.r_host || r.r_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(r_host) DESC NULLS LAST, length(r_path) DESC) AS k
  FROM h LEFT JOIN r ON (h.host = r_host OR ends_with(h.host, '.' || r_host)) AND starts_with(h.path, r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

ORACLES["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT w.doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, ks[step] AS own, ks[1:step - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS hit, list_bool_or(list_transform(earlier, lambda j: fails[j])) AS gone, len(list_filter(fails, lambda b: b)) AS many FROM m, steps),
s AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT coalesce(gone, false)), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT coalesce(gone, false)), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE hit AND many = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE hit AND NOT coalesce(gone, false)), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT coalesce(gone, false)), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM s
"""

ORACLES["op13_hard_negatives"] = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
q AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT q.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY q.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM q JOIN p ON p.anchor_id = q.anchor_id AND NOT p.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
