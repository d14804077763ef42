"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
 bw AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
 iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 12))) AS s FROM bw WHERE len(w) > 0)),
 ks AS (SELECT DISTINCT k FROM iw),
 win AS (SELECT doc_id, k, s, array_to_string(w[s + 1 : s + k], ' ') AS g
         FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM dw, ks WHERE len(w) >= k)),
 hit AS (SELECT doc_id, win.k, s, item_id FROM win JOIN iw USING (k, g)),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, k, s FROM hit)) GROUP BY doc_id),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id),
 bt AS (SELECT DISTINCT item_id, unnest(w) AS t FROM bw),
 rt AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY n, t) AS no FROM bt JOIN (SELECT t, count(*) AS n FROM bt GROUP BY t) USING (t) QUALIFY no <= 3),
 dp AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM dw),
 cl AS (SELECT doc_id, item_id, no, p FROM dp JOIN rt USING (t)),
 nr AS (SELECT doc_id, item_id, max(CASE no WHEN 1 THEN 1 END) OVER k AS a, max(CASE no WHEN 2 THEN 1 END) OVER k AS b, max(CASE no WHEN 3 THEN 1 END) OVER k AS c
        FROM cl WINDOW k AS (PARTITION BY doc_id, item_id ORDER BY p RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING)),
 near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr JOIN (SELECT item_id, count(*) AS k FROM rt GROUP BY item_id) USING (item_id)
          WHERE coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) = k GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
 CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""


_ASSIGN = """(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""


def _pairs(kind: int, pattern: str, group: int) -> str:
    """Gaps and matches of a pattern alternate; running lengths give the positions."""
    return rf"""
 SELECT doc_id, source, {kind} AS kind, s + glen AS b, s + glen + len(hit) AS e, value FROM (
  SELECT *, len(gap) AS glen, coalesce(sum(len(gap) + len(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
   SELECT doc_id, source, unnest(range(1, len(h) + 1)) AS i, unnest(g[:len(h)]) AS gap, unnest(h) AS hit, unnest(v) AS value FROM (
    SELECT doc_id, source, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS h, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d)))"""


OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
 a AS ({_pairs(0, _ASSIGN.replace(chr(92) + '"', '"').replace("(?:", "(?:"), 1)}), k AS ({_pairs(1, "AKIA[A-Z0-9]{16,}", 0)}), x AS ({_pairs(2, "[0-9a-f]{24,}", 0)}), r AS ({_pairs(3, "[A-Za-z0-9+/_-]{20,}", 0)}),
 base AS (SELECT * FROM a WHERE len(value) >= 6 UNION ALL SELECT * FROM k UNION ALL SELECT * FROM x),
 bare AS (SELECT * FROM r WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = r.doc_id AND base.b < r.e AND r.b < base.e)),
 cand AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
 own AS (SELECT value FROM cand GROUP BY value HAVING count(DISTINCT source) < 3 AND count(DISTINCT (source, coalesce(CAST(doc_id AS VARCHAR), ''))) < 50),
 spans AS (SELECT * FROM base UNION ALL SELECT * FROM bare WHERE value IN (FROM own)),
 lst AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
  string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, kind) FILTER (WHERE kind < 3) AS bs,
  string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, kind) AS al FROM spans GROUP BY doc_id),
 live AS (SELECT doc_id, count(DISTINCT value) AS n FROM cand WHERE value IN (FROM own) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
 sha256(coalesce(bs, '')) AS base_sha256, coalesce(al, '') AS spans, CAST(coalesce(n, 0) AS BIGINT) AS n_live
FROM d LEFT JOIN lst USING (doc_id) LEFT JOIN live USING (doc_id)
"""


# the tables hold no tool calls; a message of JSON with calls or results is left to the tests
OP4 = """
SELECT conv_id, turn, turn AS place, 0 AS depth, coalesce(role, '') AS role, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_errors, CAST(NULL AS VARCHAR) AS link,
 '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, '')) AS VARCHAR) || '}' AS json
FROM conversations
"""

OP11 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
 l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * len(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS m FROM w LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
 o AS (SELECT '' AS o UNION ALL SELECT o || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)),
 st AS (SELECT o AS filter_order, k AS step, CAST(pow(2, instr('ABCDE', o[k]) - 1) AS INTEGER) AS bit,
  CAST(list_sum(list_transform(range(1, k), lambda i: pow(2, instr('ABCDE', o[i]) - 1))) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE len(o) = 5),
 r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN m & (coalesce(before, 0) + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & coalesce(before, 0) = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN m & coalesce(before, 0) <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN m & coalesce(before, 0) = 0 AND m & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & coalesce(before, 0) = 0 AND m & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, st GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


OP13 = """
WITH q AS (SELECT sale_id, client_id, CAST(floor(epoch(sold_at) / 900) * 900 AS BIGINT) AS b, CAST(coalesce(floor(100 * total + 0.5), 0) AS BIGINT) AS c FROM sales WHERE sold_at IS NOT NULL),
 l AS (SELECT sale_id, CAST(floor(epoch(max(shipped_at)) / 900) * 900 AS BIGINT) AS e FROM sale_lines GROUP BY sale_id),
 h AS (SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id),
 o AS (SELECT coalesce(nation_id, -1) AS nation_id, b, e, c FROM q LEFT JOIN l USING (sale_id) LEFT JOIN h USING (client_id) WHERE e IS NULL OR e > b),
 a AS (SELECT * FROM o UNION ALL SELECT -2, b, e, c FROM o),
 x AS (SELECT nation_id, b AS from_s, 1 AS dn, c AS dc FROM a UNION ALL SELECT nation_id, e, -1, -c FROM a WHERE e IS NOT NULL),
 g AS (SELECT nation_id, from_s, sum(dn) AS dn, sum(dc) AS dc FROM x GROUP BY ALL HAVING sum(dn) <> 0 OR sum(dc) <> 0),
 r AS (SELECT nation_id, from_s, lead(from_s) OVER w AS to_s, sum(dn) OVER w AS n_open, sum(dc) OVER w AS open_cents FROM g WINDOW w AS (PARTITION BY nation_id ORDER BY from_s))
SELECT CAST(nation_id AS INTEGER) AS nation_id, from_s, to_s, CAST(n_open AS BIGINT) AS n_open, CAST(open_cents AS BIGINT) AS open_cents,
 CAST(max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s) AS BIGINT) AS high_open, n_open = max(n_open) OVER (PARTITION BY nation_id) AS is_peak FROM r
"""

SQL = {"op2_decontaminate": OP2, "op3_secret_scan": OP3, "op4_chat": OP4, "op11_filter_audit": OP11, "op13_concurrency": OP13}
