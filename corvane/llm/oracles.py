"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from corvane.llm import credentials, mixing
from corvane.llm.hosts import RULES

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h FROM p),
g AS (SELECT h, n, max(page_id) AS response FROM d GROUP BY h, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM d JOIN g USING (h, n)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, p.k, i, item_id FROM places p JOIN win ON p.s = win.s AND p.k = win.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""

OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT edges.b, reach.r FROM reach JOIN edges ON edges.a = reach.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def _cases(column: int) -> str:
    lines = []
    for text, says in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = text.partition("/")
        lines.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}') THEN '{(text, says)[column]}'")
    return "CASE " + " ".join(lines) + " END"


def _level(units: str, name: str, up: str, up_key: str) -> str:
    """Common table expressions of one level: its prior strength, then its posterior."""
    return f"""
{name}_p AS (SELECT u.*, x.mean AS prior FROM {units} u JOIN {up} x ON x.{up_key} = u.{up_key}),
{name}_m AS (SELECT sum(CASE WHEN n > 0 THEN n * pow(good / n - prior, 2) END) AS gap, sum(CASE WHEN n > 0 THEN prior * (1 - prior) END) AS v, sum(CASE WHEN n > 0 THEN n * prior * (1 - prior) END) AS nv FROM {name}_p),
{name}_s AS (SELECT round(least(greatest(CASE WHEN nv > v AND gap > v THEN (nv - v) / (gap - v) - 1 ELSE 1000.0 END, 2.0), 1000.0), 9) AS m FROM {name}_m),
{name}_x AS (SELECT {name}_p.*, (good + m * prior) / (n + m) AS mean, n + m AS t FROM {name}_p, {name}_s)"""


OP5 = f"""
WITH parts AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
g AS (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id),
c AS (SELECT host, coalesce(sum(good), 0) AS good, count(good) AS n FROM h LEFT JOIN g ON g.doc_id = h.page_id GROUP BY host),
l AS (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS a FROM c),
k AS (SELECT *, CASE WHEN len(a) > 2 AND length(a[-1]) = 2 AND a[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS z FROM l),
hosts AS (SELECT host, good, n, array_to_string(a[greatest(len(a) - z, 1) :], '.') AS domain, array_to_string(a[greatest(len(a) - z + 1, 1) :], '.') AS suffix FROM k),
domains AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, 1 AS one, sum(good) AS good, sum(n) AS n FROM domains GROUP BY suffix),
whole AS (SELECT 1 AS one, (sum(good) + 1) / (sum(n) + 2) AS mean FROM suffixes),
{_level("suffixes", "s", "whole", "one")},{_level("domains", "d", "s_x", "suffix")},{_level("hosts", "o", "d_x", "domain")}
SELECT page_id, h.host, path, {_cases(0)} AS rule,
  coalesce({_cases(1)}, CASE WHEN round(least(mean + 1.645 * sqrt(mean * (1 - mean) / (t + 1)), 1.0), 9) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN (SELECT host AS known, mean, t FROM o_x) x ON x.known = h.host
""".replace("SELECT page_id, h.host", "SELECT page_id, h.host AS host")

#: Words taken of each document; the water level is searched by trying each number of sources at their limit.


def _time_sql(share: str) -> str:
    """Inversion of the schedule of a source's turn."""
    real = lambda x: f"{float(x)!r}e0"
    cases = []
    for k, knots in enumerate(mixing.SCHEDULES):
        want, done, pieces = f"({share} * {real(mixing.integral(knots))})", 0.0, ""
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            piece, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
            rest = f"greatest({want} - {real(done)}, 0e0)"
            x = f"2e0 * {rest} / ({real(w0)} + sqrt(greatest({real(w0 * w0)} + {real(2 * slope)} * {rest}, 0e0)))"
            pieces += f" WHEN {want} <= {real(done + piece * (1 + 1e-12))} THEN {real(t0)} + least({x}, {real(t1 - t0)})"
            done += piece
        cases.append(f"WHEN turn = {k} THEN CASE{pieces} ELSE {real(knots[-1][0])} END")
    return f"CASE {' '.join(cases)} END"


OP7 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn, [5.0, 2.0, 1.0][CAST(turn AS INT) + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS r FROM w),
lv AS (SELECT k.r AS k, (sum(o.source_size) - coalesce(sum(o.cap) FILTER (o.r < k.r), 0)) / sum(o.w) FILTER (o.r >= k.r) AS level, any_value(k.cap / k.w) AS own FROM o, o k GROUP BY k.r),
l AS (SELECT level FROM lv WHERE own > level ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, turn, round(least(cap, w * coalesce((SELECT level FROM l), 1e300)), 6) AS target FROM w),
a AS (SELECT d.*, source_size, target, turn, CAST(round(target) AS BIGINT) AS goal,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN goal // source_size * size + greatest(0, least(size, goal % source_size - ahead)) ELSE 0 END AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN round({time}, 9) END AS position
FROM a
""".replace("{time}", _time_sql("(CAST(ahead AS DOUBLE) / target)"))


OP11 = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.l = b.l AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM r a JOIN r b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INT) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s QUALIFY rank <= 3
"""


def _either(pattern: str) -> str:
    """The pattern of words without regard to the case of its ASCII letters."""
    return "".join(f"[{c.upper()}{c}]" if c.islower() else c for c in pattern)


def _found_sql(kind: str, pattern: str, sure: str = "true") -> str:
    """Spans of a kind: matches stand between the pieces that the pattern splits a text into."""
    return f"""SELECT r, {credentials.KINDS.index(kind)} AS k, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n, m[i] AS x, t
  FROM (SELECT r, t, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, t, string_split_regex(t, $${pattern}$$) AS g, regexp_extract_all(t, $${pattern}$$) AS m, regexp_extract_all(t, $${pattern}$$, {2 if kind == "assign" else 0}) AS v FROM d)) WHERE {sure}"""


_WORDY = {n: x.replace("password|passwd|secret|token|api_?key", _either("password|passwd|secret|token|api_?key")).replace("user|username|login|client_?id", _either("user|username|login|client_?id")) for n, x in (("assign", credentials.ASSIGN), ("login", credentials.LOGIN))}
_AHEAD = "NOT regexp_matches(substr(t, a, least(a, 1)), '[{0}]')"
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_found_sql("assign", _WORDY["assign"], "length(v[i]) >= 6")} UNION ALL {_found_sql("access", credentials.ACCESS, "length(m[i]) >= 20")} UNION ALL {_found_sql("hex", credentials.HEX, "length(m[i]) >= 24")}),
keys AS ({_found_sql("key", credentials.KEY)}),
weak AS (SELECT * FROM keys WHERE regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = keys.r AND b.a < keys.a + keys.n AND b.a + b.n > keys.a)
  UNION ALL {_found_sql("login", _WORDY["login"])} UNION ALL SELECT * FROM ({_found_sql("address", credentials.ADDRESS)}) WHERE {_AHEAD.format("A-Za-z0-9._%+-")} UNION ALL SELECT * FROM ({_found_sql("endpoint", credentials.ENDPOINT)}) WHERE {_AHEAD.format("A-Za-z0-9+")}),
spans AS (SELECT r, k, a, n, len(regexp_extract_all(left(t, a), $$\n[ \t\r]*\n$$)) AS scope FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
near AS (SELECT x.*, coalesce(bool_or(y.k IN (0, 2, 3)), false) AS secret, coalesce(bool_or(y.k IN (1, 4, 5)), false) AS identifier FROM (SELECT * FROM spans WHERE k >= 3) x LEFT JOIN spans y ON y.r = x.r AND y.scope = x.scope AND abs(y.a - x.a) <= {credentials.REACH} GROUP BY ALL),
kept AS (SELECT r, k, a, n FROM spans WHERE k < 3 UNION ALL SELECT r, k, a, n FROM near WHERE CASE k WHEN 3 THEN identifier WHEN 6 THEN identifier AND secret ELSE secret END),
named AS (SELECT *, ['assign', 'access', 'hex', 'key', 'login', 'address', 'endpoint'][k + 1] || ':' || a || ':' || (a + n) AS s FROM kept),
o AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(s, ',' ORDER BY a, k) FILTER (k < 3) AS b, string_agg(s, ',' ORDER BY a, k) AS e FROM named GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(e, '') AS spans FROM d LEFT JOIN o USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op2_decontamination": OP2, "op4_near_dedup": OP4, "op5_url_filter": OP5, "op7_mixing": OP7, "op11_hard_negatives": OP11, "op12_credentials": OP12}
