"""SQL that gives the rows of the queries, where SQL can express them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

OP3 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4])) END AS shingles
  FROM w),
t AS MATERIALIZED (SELECT doc_id, md5(array_to_string(unnest(shingles), chr(31))) AS k FROM s),
n AS MATERIALIZED (SELECT doc_id, len(shingles) AS n FROM s),
f AS MATERIALIZED (SELECT k FROM t GROUP BY k HAVING count(*) > 1),
t2 AS MATERIALIZED (SELECT doc_id, k FROM t SEMI JOIN f USING (k)),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM t2 a JOIN t2 b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""

# The same with the links of each document counted.
OP3_LINKS = OP3.replace(
    "SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2",
    "SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM e WHERE e.a = n.doc_id) AS n_links FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2",
)

OP5 = f"""
WITH t AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256, {_FOLDED} AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY folded)
"""

OP8 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS MATERIALIZED (SELECT k, min(doc_id) AS d FROM g GROUP BY k HAVING count(DISTINCT doc_id) > 1),
c AS MATERIALIZED (
  SELECT DISTINCT doc_id, i + o AS p FROM (SELECT g.doc_id, g.i FROM g JOIN m USING (k) WHERE m.d < g.doc_id), range(0, 13) t(o)),
r AS MATERIALIZED (SELECT doc_id, count(*) AS n, list(p) AS ps FROM c GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""
WITH f AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
d AS MATERIALIZED (
  SELECT f.part,
    [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text),
     regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
c AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS MATERIALIZED (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS fs FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT fs, array_to_string(list_transform(fs, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
r AS MATERIALIZED (
  SELECT part, filter_order, step, fs[step] AS f,
    sum(n) FILTER (NOT fails[fs[step]] AND NOT earlier) AS kept, sum(n) FILTER (fails[fs[step]] AND NOT earlier) AS removed,
    sum(n) FILTER (fails[fs[step]] AND earlier) AS redundant,
    sum(n) FILTER (fails[fs[step]] AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails,
    sum(good) FILTER (fails[fs[step]] AND NOT earlier) AS good_lost, sum(toxic) FILTER (fails[fs[step]] AND NOT earlier) AS toxic_lost
  FROM (SELECT *, len(list_filter(fs[:step - 1], lambda i: fails[i])) > 0 AS earlier FROM c, s) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""

OP13 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS terms FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
t AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf, 50 + (50 * n * docs) // terms AS m
  FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) SEMI JOIN q USING (term), s GROUP BY doc_id, term, n, docs, terms),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""


def op12(hostile: str) -> str:
    """Digests of the given turns; only the written length depends on the template."""
    import re

    from .chat_format import Template

    t = Template()
    places = "|".join(re.escape(s[0]) + r"\\*" + re.escape(s[1:]) for s in t.signs())
    signs = " ".join(f"WHEN '{role}' THEN {len(a + b)}" for role, (a, b) in t.roles.items())
    known = ", ".join(f"'{r}'" for r in t.roles)
    escapes = lambda c: f"len({c}) + len(regexp_extract_all({c}, '{places}'))"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{hostile}'), (-1, 1, 'assistant', '{hostile}'))),
s AS (
  SELECT *, CASE WHEN role IN ({known}) THEN CASE role {signs} END ELSE {len(''.join(t.named))} + {escapes('role')} END + {escapes('text')} AS written FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  (coalesce(sum(len(text)) FILTER (role = 'assistant'), 0))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(t.start)} + sum(written))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


def _op1() -> str:
    """The rounds of the walk unrolled; every step rounds down to whole numbers as the query does."""
    from . import url_filter as u

    fits = []
    for verdict, rule in u.ranked_rules(u.RULES):
        domain, _, rest = rule.partition("/")
        fits.append((f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{rest}')", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    url = "'^.*?://([^/?#]*)([^?#]*)'"
    fold = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    link = u.LINK.replace("'", "''")
    parts = [f"""
WITH p AS MATERIALIZED (
  SELECT page_id, {fold(f"coalesce(regexp_extract(url, {url}, 1, 's'), '')")} AS host, coalesce(regexp_extract(url, {url}, 2, 's'), '') AS path, html FROM pages),
j AS MATERIALIZED (SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS by_rule FROM p),
h AS MATERIALIZED (SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked FROM j GROUP BY host),
l AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {fold("x")}))) AS dst FROM p),
l2 AS (SELECT src, dst, count(*) AS w FROM l WHERE src <> '' AND src <> dst GROUP BY src, dst),
t AS (SELECT c.src, c.dst, 1 AS w FROM (SELECT host AS src, regexp_extract(host, '^[^.]+\\.(.+)$', 1) AS dst FROM h WHERE host <> '') c JOIN h ON h.host = c.dst WHERE h.host <> ''),
e AS (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT * FROM l2 UNION ALL SELECT * FROM t UNION ALL SELECT dst, src, w FROM t) GROUP BY src, dst),
f0 AS (SELECT 'trust' AS walk, src, dst, w FROM e UNION ALL SELECT 'distrust', dst, src, w FROM e),
f AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY walk, src) AS total FROM f0),
s0 AS (SELECT host, CASE WHEN allowed > 0 AND blocked = 0 THEN 'trust' WHEN 2 * blocked >= n THEN 'distrust' END AS walk FROM h WHERE host <> ''),
m0 AS MATERIALIZED (SELECT walk, host, floor({u.TOTAL_MASS!r} / count(*) OVER (PARTITION BY walk)) AS mass FROM s0 WHERE walk IS NOT NULL)"""]
    for k in range(1, u.ROUNDS + 1):
        parts.append(f"""m{k} AS MATERIALIZED (SELECT walk, host, sum(mass) AS mass FROM (
  SELECT f.walk, f.dst AS host, floor(floor(m.mass * f.w / f.total) * {u.DAMPING!r}::DOUBLE) AS mass FROM f JOIN m{k - 1} m ON m.walk = f.walk AND m.host = f.src
  UNION ALL SELECT walk, host, floor(mass * (1 - {u.DAMPING!r}::DOUBLE)) FROM m0) GROUP BY walk, host)""")
    parts.append(f"x AS (SELECT host, sum(CASE WHEN walk = 'trust' THEN mass ELSE 0 END) AS trust, sum(CASE WHEN walk = 'distrust' THEN mass ELSE 0 END) AS distrust FROM m{u.ROUNDS} GROUP BY host)")
    return ",\n".join(parts) + """
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN x USING (host)
"""


SQL = {
    "op1_url_filter": _op1(), "op3_ngram_jaccard_join": OP3, "op3_ngram_jaccard_links": OP3_LINKS, "op5_exact_dedup": OP5, "op8_substring_dedup": OP8,
    "op11_filter_audit": OP11, "op13_lexical_search": OP13,
}
