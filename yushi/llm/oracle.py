"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others are compared with brute force in tests/llm: alignment (2), the convex dual and its rounding (4), compressed sizes (8), tokens (10).
"""

from __future__ import annotations

from yushi.llm import collocations, licenses, quality, urls

SPACE = r"\x20\x09-\x0D"


def _op1() -> str:
    bits = " + ".join(f"CASE WHEN {c} THEN {quality.BIT[r]} ELSE 0 END" for r, c in quality.RULES)
    count = lambda cls: f"length(regexp_replace(t, '[^{cls}]', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, CASE WHEN lead(x, 4) OVER o IS NULL THEN NULL ELSE concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) END AS gram
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS starts FROM g),
c AS (SELECT doc_id, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM s),
r AS (SELECT doc_id, sum(inside) AS n FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count('#*$%&|<>')} AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
             {count('A-Z')} AS n_upper, {count('a-z')} AS n_lower, {count('!')} AS n_exclaim, {count('!-/:-@[-`{-~')} AS n_marks
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
l AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & {quality.mask('base')}) <> 0 AS base_failed, (fail_bits & {quality.mask('base') | quality.mask()}) = 0 AS kept FROM l
"""


def _op3() -> str:
    rows, idf, other = licenses.weights()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({k}, {quote(n)}, {quote(x)}, {w!r}, {idf[x]!r})" for k, n, x, w in rows)
    cue = " OR ".join(f"contains(lower(line), {quote(c)})" for c in licenses.CUES)
    return rf"""
WITH templates(k, license, term, w, idf) AS (VALUES {table}),
idf AS (SELECT DISTINCT term, CAST(idf AS DOUBLE) AS idf FROM templates),
files AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CAST(doc_id // 1000 AS VARCHAR) AS dir, text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM files),
said AS (SELECT doc_id, n, line FROM lines WHERE {cue}),
terms AS (SELECT doc_id, n, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM said),
tf AS (SELECT doc_id, n, t.term, count(*) * coalesce(any_value(idf.idf), {other!r}) AS w FROM terms t LEFT JOIN idf ON t.term = idf.term GROUP BY ALL),
norm AS (SELECT doc_id, n, sqrt(sum(w * w)) AS norm FROM tf GROUP BY ALL),
dots AS (SELECT tf.doc_id, tf.n, t.license, t.k, sum(tf.w * CAST(t.w AS DOUBLE)) AS dot FROM tf JOIN templates t ON tf.term = t.term GROUP BY ALL),
best AS (SELECT doc_id, n, license, round(dot / norm, 6) AS score FROM dots JOIN norm USING (doc_id, n)
         QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY round(dot / norm, 6) DESC, license) = 1),
good AS (SELECT b.*, len(regexp_extract_all(s.line, '[^{SPACE}]+')) AS words FROM best b JOIN said s USING (doc_id, n) WHERE score >= {licenses.LEAST_COSINE}),
own AS (SELECT doc_id, arg_min(license, (-score, license)) AS license, max(score) AS score, sum(words) AS words FROM good GROUP BY doc_id),
scanned AS (SELECT f.doc_id, f.dir, f.dir || '/' || CAST(f.doc_id AS VARCHAR) || '.txt' AS path, o.license, o.score,
                   o.license IS NOT NULL AND o.words >= {licenses.LICENSE_FILE_SHARE} * len(regexp_extract_all(f.text, '[^{SPACE}]+')) AS is_license_file
            FROM files f LEFT JOIN own o ON f.doc_id = o.doc_id),
held AS (SELECT dir AS above, arg_min(license, (-score, license)) AS inherited FROM scanned WHERE is_license_file GROUP BY dir),
dirs AS (SELECT DISTINCT dir FROM scanned),
up AS (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM dirs),
near AS (SELECT dir, inherited, above FROM (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS above FROM up) JOIN held USING (above)
         QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT doc_id, path, license, score, is_license_file, CASE WHEN license IS NULL THEN near.above END AS inherited_from, coalesce(license, near.inherited) AS final_license
FROM scanned LEFT JOIN near USING (dir)
"""


def _op5() -> str:
    rules = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in urls.SITES)
    words = [r for r in urls.RULES if r.on == "url"]
    found = " ".join(f"WHEN regexp_matches(low, '{_re2(r)}') THEN '{r.name}'" for r in words)
    return rf"""
WITH rules(verdict, rule_host, rule_path, rule) AS (VALUES {rules}),
p AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
             CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
fit AS (SELECT page_id, rule, verdict FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1),
w AS (SELECT page_id, CASE {found} END AS pattern FROM p)
SELECT p.page_id, host, path, fit.rule, CASE WHEN fit.rule IS NOT NULL THEN fit.verdict WHEN w.pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN fit.rule IS NULL THEN w.pattern END AS pattern
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN w USING (page_id)
"""


def _re2(rule: urls.Rule) -> str:
    return rule.pattern.replace("(?<![0-9a-z])", "(^|[^0-9a-z])").replace("(?![0-9a-z])", "($|[^0-9a-z])")


_OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d WHERE n >= 100)),
again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
mark AS (SELECT doc_id, p, CASE WHEN p <= lag(p + 100) OVER o THEN 0 ELSE 1 END AS opens FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM mark) GROUP BY doc_id, run),
edge AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
gone AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS tail FROM runs GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS h FROM edge e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(gone.removed, 0) AS BIGINT) AS n_removed, coalesce(gone.spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, '') || substr(d.h, 2 * coalesce(gone.tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_OP7 = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.n, k.line, often.key IS NULL OR often.last = k.doc_id AS stays FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE stays), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*))),
walk(doc_id, to_id) AS (SELECT a, b FROM links UNION SELECT w.doc_id, l.b FROM walk w JOIN links l ON l.a = w.to_id),
low AS (SELECT doc_id, min(to_id) AS low FROM walk GROUP BY doc_id),
deg AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(low.low, d.doc_id)) AS class_id, coalesce(deg.n, 0) AS n_links
FROM d LEFT JOIN low ON d.doc_id = low.doc_id LEFT JOIN deg ON d.doc_id = deg.doc_id
"""

def _op12() -> str:
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, len(g) AS k, g FROM (
  SELECT lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i:i])) AS g FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) FROM w)),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= {collocations.LEAST}),
cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM cand),
scores AS (SELECT c.lang, c.k, c.g, c.a, c.cut, x.a AS l, y.a AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.cut + 1:c.k]),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_pairs AS (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS g FROM cand WHERE k = 3),
gone AS (SELECT DISTINCT c.lang, c.g FROM cand c JOIN inner_pairs p ON p.lang = c.lang AND p.g = c.g WHERE c.k = 2 AND 100 * p.a >= {collocations.SHARE} * c.a),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, CAST(b.score AS BIGINT) AS score FROM best b ANTI JOIN gone o ON o.lang = b.lang AND o.g = b.g)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {collocations.FIRST}
"""


ORACLE_SQL = {
    "op1_quality_rules": _op1(),
    "op3_license_scan": _op3(),
    "op5_url_filter": _op5(),
    "op6_repeated_substrings": _OP6,
    "op7_line_dedup": _OP7,
    "op9_jaccard_join": _OP9,
    "op12_collocations": _op12(),
}
