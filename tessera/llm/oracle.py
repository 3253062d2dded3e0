"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from tessera.llm import url_filter
from tessera.llm.common import LOWER, UPPER

_FOLD = f"translate({{}}, '{UPPER}', '{LOWER}')"
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CHAT = """
WITH t AS (
  SELECT conv_id, coalesce('#' || conv_id, '') c, turn, coalesce(turn, 4611686018427387904) o,
         coalesce(role, 'unknown') speaker, coalesce(text, '') body FROM conversations),
v AS (SELECT DISTINCT c, speaker AS view FROM t WHERE speaker <> 'system'),
s AS (
  SELECT conv_id, c, view, turn, o, speaker, body, (speaker = view)::INT mask,
         CASE WHEN speaker = view THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
         CASE WHEN speaker <> view AND speaker <> 'system' THEN speaker END AS name
  FROM t JOIN v USING (c)),
g AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) || body || '<|im_end|>' || chr(10) AS segment FROM s),
e AS (
  SELECT *, (sum(length(segment)) OVER (PARTITION BY c, view ORDER BY o, speaker, body ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM g)
SELECT conv_id, view, turn, role, name, segment, mask, upto - length(segment) AS start, upto AS "end" FROM e
"""

_CONTAMINATION = f"""
WITH w AS (SELECT item_id, {_WORDS.format('text')} a FROM benchmark WHERE text IS NOT NULL),
i AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') item, n, array_to_string(a[k:k + n - 1], ' ') win
  FROM (SELECT item_id, a, least(10, len(a)) n, unnest(range(1, len(a) - least(10, len(a)) + 2)) k FROM w WHERE len(a) > 0)),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} a FROM documents),
l AS (SELECT DISTINCT n FROM i),
x AS (
  SELECT doc_id, k, n, array_to_string(a[k:k + n - 1], ' ') win
  FROM (SELECT doc_id, a, n, unnest(range(1, len(a) - n + 2)) k FROM d, l WHERE len(a) >= n)),
m AS (SELECT doc_id, k, x.n, item FROM x JOIN i ON x.win = i.win AND x.n = i.n),
h AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) p FROM m) GROUP BY 1),
j AS (
  SELECT doc_id, count(*) n_items, sha256(string_agg(item, ',' ORDER BY item)) digest
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(a)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       coalesce(digest, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)
"""

_EXACT = f"""
WITH d AS (SELECT doc_id, {_FOLD.format("coalesce(text, '')")} t FROM documents),
g AS (SELECT t, max(doc_id) keep_id, count(*) group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) text_sha256
FROM d JOIN g ON d.t = g.t
"""

def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _tags(tag: str, wanted: str, at: str) -> str:
    quoted = [x.replace("'", "''") for x in (tag, wanted, at)]
    return (f"list_transform(list_filter(regexp_extract_all(html, '{quoted[0]}'), lambda x: regexp_matches(x, '{quoted[1]}')), "
            f"lambda x: regexp_extract(x, '{quoted[2]}', 1))")


def url_verdicts(rules: list[tuple[str, str]]) -> str:
    """The closure over alias links by recursion; dots are folded one at a time."""
    values = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for v, r in rules)
    return rf"""
WITH RECURSIVE rules(rule_host, rule_path, rule, says) AS (VALUES {values}),
l AS (
  SELECT DISTINCT url a, {_host('url')} host, {_path('url')} path, regexp_replace(unnest(list_concat(
    {_tags(url_filter.LINK, url_filter.IS_CANONICAL, url_filter.HREF)},
    {_tags(url_filter.META, url_filter.IS_REFRESH, url_filter.TARGET)})), '&amp;', '&', 'gi') link
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
e AS (
  SELECT a, CASE WHEN link = '' OR link LIKE '#%' THEN NULL WHEN regexp_matches(link, '(?i)^https?://') THEN link
      WHEN link LIKE '//%' THEN 'x:' || link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN link LIKE '/%' THEN 'x://' || host || link WHEN link LIKE '?%' THEN 'x://' || host || path || link
      ELSE 'x://' || host || CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || link END b FROM l),
u AS (
  SELECT url, {_host('url')} host, {_path('url')} path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') query
  FROM (SELECT url FROM pages UNION SELECT a FROM e UNION SELECT b FROM e) WHERE url IS NOT NULL),
f AS (
  SELECT url, host, CASE WHEN path = '' THEN '/' ELSE path END path, query, 0 step FROM u
  UNION ALL
  SELECT url, host, CASE WHEN regexp_matches(path, '/\.(/|$)') THEN regexp_replace(path, '/\.(/|$)', '/')
      WHEN regexp_matches(path, '^/\.\.(/|$)') THEN regexp_replace(path, '^/\.\.(/|$)', '/')
      ELSE regexp_replace(path, '/[^/]*/\.\.(/|$)', '/') END, query, step + 1
  FROM f WHERE regexp_matches(path, '/\.\.?(/|$)')),
n AS (SELECT url, arg_max(path, step) path, any_value(host) host, CASE WHEN any_value(host) <> '' THEN any_value(host) || arg_max(path, step) || any_value(query) END node
      FROM f GROUP BY url),
m AS (
  SELECT u.url, arg_min(rule, (-length(rule), says, rule)) rule, arg_min(says, (-length(rule), says, rule)) says
  FROM u JOIN rules ON ('.' || u.host) LIKE ('%.' || rule_host) AND starts_with(u.path, rule_path) WHERE u.host <> '' GROUP BY u.url),
g AS (
  SELECT x.node a, y.node b FROM e JOIN n x ON x.url = e.a JOIN n y ON y.url = e.b WHERE x.node IS NOT NULL AND y.node IS NOT NULL),
d AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
r(node, other) AS (SELECT node, node FROM n WHERE node IS NOT NULL UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.other),
c AS (SELECT r.node, min(m.says) says FROM r JOIN n ON n.node = r.other JOIN m ON m.url = n.url GROUP BY r.node)
SELECT page_id, {_host('p.url')} host, {_path('p.url')} path, m.rule, coalesce(m.says, c.says, 'allow') verdict
FROM pages p LEFT JOIN m ON m.url = p.url LEFT JOIN n ON n.url = p.url LEFT JOIN c ON c.node = n.node
"""


_MIX = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END g,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size FROM documents),
o AS (SELECT *, ('0x' || substr(md5(concat_ws(':', doc_id, size)), 1, 15))::BIGINT o FROM d),
p AS (SELECT *, (sum(size) OVER (PARTITION BY g ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT place FROM o),
s AS (SELECT g, sum(size)::BIGINT source_size FROM d GROUP BY g),
w AS (SELECT g, source_size, [5, 2, 1][((row_number() OVER (ORDER BY g) - 1) % 3 + 1)::INT] w, 3 * source_size cap FROM s),
v AS (
  SELECT a.g, a.w, a.cap, ((SELECT sum(source_size) FROM s) - coalesce(sum(b.cap) FILTER (stopped), 0)) /
         sum(b.w) FILTER (NOT stopped) AS level
  FROM w a, LATERAL (SELECT *, (cap / w, g) < (a.cap / a.w, a.g) stopped FROM w) b GROUP BY ALL),
l AS (SELECT max(level) level FROM v WHERE level * w <= cap),
t AS (SELECT g, source_size, coalesce(least(level * w, cap), cap)::DOUBLE target FROM w, l),
x AS (SELECT *, row_number() OVER (ORDER BY target - floor(target) DESC, g) turn, round(sum(target - floor(target)) OVER ()) spare FROM t),
y AS (SELECT g, source_size, target, (floor(target) + (turn <= spare)::INT)::BIGINT goal FROM x)
SELECT doc_id, size, source_size, target,
       size * (goal // greatest(source_size, 1)) + greatest(least(goal % greatest(source_size, 1) - place, size), 0) taken
FROM p JOIN y USING (g)
"""

_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') t, coalesce(source, '') part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') a FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic FROM labels GROUP BY 1),
e AS (SELECT t, min(doc_id) low FROM t GROUP BY 1),
r AS (
  SELECT part, len(a) < 200 AS fa, 100 * len(list_distinct(a)) < 50 * len(a) AS fb,
         100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 2 * length(w.t) AS fc,
         regexp_matches(w.t, '[#$%&*|]') AS fd, coalesce(w.doc_id > low, false) AS fe,
         coalesce(good, false) good, coalesce(toxic, false) toxic
  FROM w JOIN e ON w.t = e.t LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, concat(CASE WHEN fa THEN 'A' END, CASE WHEN fb THEN 'B' END, CASE WHEN fc THEN 'C' END,
                          CASE WHEN fd THEN 'D' END, CASE WHEN fe THEN 'E' END) fails, good, toxic, count(*) n
      FROM r GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) step, substr(filter_order, step, 1) letter, left(filter_order, step - 1) before
      FROM o, range(1, 6) x(step)),
x AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) hit,
         before <> '' AND regexp_matches(fails, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') gone
  FROM m, s),
g AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT removed,
         coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT redundant,
         coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT unique_fails,
         coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0)::BIGINT good_lost,
         coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0)::BIGINT toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT shapley FROM g
"""

_NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id anchor_id, b.vec_id other, a.label = b.label same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other positive_id, score positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other negative_id, positive_score, score negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""

LLM_ORACLE: dict[str, str] = {
    "op2_url_filter": url_verdicts([("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]),
    "op3_mixing": _MIX,
    "op4_chat": _CHAT,
    "op6_decontaminate": _CONTAMINATION,
    "op9_exact_dedup": _EXACT,
    "op12_filter_audit": _AUDIT,
    "op13_hard_negatives": _NEGATIVES,
}
