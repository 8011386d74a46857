"""DuckDB SQL of operators 11 to 13, from the definitions of their queries."""

from __future__ import annotations

from .secret_scan import BASE, RULES, Rule


def _bump(state: str, cost: int, letter: str) -> str:
    """A state is six digits of cost and the letters, so that the least text is the best."""
    return f"(lpad(CAST(CAST(left({state}, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({state}, 7) || '{letter}')"


def _close(source: str, rest: str) -> str:
    for _ in range(2):
        u = f"least(u, {_bump('b', 3, 'I')}, {_bump('s', 3, 'I')}, {_bump('a', 3, 'I')})"
        source = f"SELECT {rest}, b, s, {u} AS u, least(a, {_bump('u', 3, 'I')}) AS a FROM ({source})"
    return source


def _moves(target: str) -> str:
    """What a row can do to reach user or assistant: be kept, get the role, be deleted."""
    letter, before = ("u", ("b", "s", "a")) if target == "u" else ("a", ("u",))
    stay = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"
    kept = [f"CASE WHEN fault IN (0, 3) AND r.initial = '{letter}' THEN " + _bump(f"d.{x}", 0, "K").replace("+ 0", f"+ {stay}") + " END" for x in before]
    given = [f"CASE WHEN fault IN (0, 3) AND r.initial <> '{letter}' THEN " + _bump(f"d.{x}", 3, "R").replace("+ 3", f"+ 3 + {stay}") + " END" for x in before]
    return f"least({', '.join([_bump(f'd.{target}', 4, 'D'), *kept, *given])})"


_SPACE = r"[\x20\x09-\x0D]"
_FIRST = _close("SELECT c, n, 0 AS k, '000000' AS b, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM counted", "c, n, k")
_SYSTEM = "CASE WHEN fault IN (0, 3) AND r.initial = 's' THEN " + _bump("d.b", 0, "K").replace("+ 0", "+ CASE WHEN fault = 3 THEN 3 ELSE 0 END") + " END"
_NEXT = _close(
    f"SELECT d.c, d.n, d.k + 1 AS k, {_bump('d.b', 4, 'D')} AS b, least({_bump('d.s', 4, 'D')}, {_SYSTEM}) AS s, {_moves('u')} AS u, {_moves('a')} AS a FROM dp d JOIN faults r ON r.c IS NOT DISTINCT FROM d.c AND r.k = d.k + 1",
    "c, n, k",
)

OP11_SQL = rf"""
WITH RECURSIVE
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE kind <> 0)),
-- a conversation by a number, so that a null conv_id is one too
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
repeats AS (
  SELECT c, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST) > 1 AS again
  FROM damaged d JOIN ids i ON d.conv_id IS NOT DISTINCT FROM i.conv_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), again) AS k FROM repeats),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?]{_SPACE}*\z') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY c ORDER BY k) || initial AS pair
  FROM ordered),
counted AS (
  SELECT c, count(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN faults USING (c) GROUP BY c),
dp AS ({_FIRST} UNION ALL {_NEXT}),
audits AS (SELECT c, CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit FROM (SELECT c, least(b, a) AS best FROM dp WHERE k = n)),
letters AS (SELECT c, i, substr(audit, i, 1) AS letter FROM (SELECT c, audit, unnest(range(1, len(audit) + 1)) AS i FROM audits)),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS k, count(*) FILTER (letter <> 'D') OVER w AS p FROM letters WINDOW w AS (PARTITION BY c ORDER BY i)),
kept AS (SELECT l.c, l.i, l.p, l.letter, f.role, f.initial, CASE WHEN l.letter = 'I' THEN '' ELSE f.text END AS text FROM placed l LEFT JOIN faults f ON f.c = l.c AND f.k = l.k WHERE l.letter <> 'D'),
started AS (SELECT c, max(CASE WHEN p = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) AS shift FROM kept GROUP BY c),
repaired AS (
  SELECT c, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - 1 - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS digest
  FROM kept JOIN started USING (c) GROUP BY c)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM ids JOIN counted USING (c) JOIN audits USING (c) LEFT JOIN repaired USING (c)
"""


def _in_sql(rule: Rule) -> str:
    """The expression for an engine that folds letters beyond ASCII: each letter as a class."""
    pattern = rule.pattern
    if rule.either_case:
        words, rest = pattern.split(")", 1)
        pattern = "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in words) + ")" + rest
    return pattern.replace("'", "''")


def _found(n: int, rule: Rule) -> str:
    p = _in_sql(rule)
    return f"""
SELECT doc_id, {n} AS n, '{rule.kind}' AS kind, start, start + len(found) AS stop FROM (
  SELECT doc_id, found, chars, CAST(coalesce(list_sum(list_transform(parts[1:k], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(matches[1:k - 1], lambda x: len(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, parts, matches, unnest(matches) AS found, unnest(list_transform(groups, lambda x: len(x))) AS chars, unnest(range(1, len(matches) + 1)) AS k FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}') AS matches, regexp_extract_all(t, '{p}', {rule.group}) AS groups, string_split_regex(t, '{p}') AS parts FROM texts))) WHERE chars >= {rule.least}"""


_BASE_KINDS = ", ".join(f"'{r.kind}'" for r in BASE)

OP12_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_found(n, r) for n, r in enumerate(RULES))}),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) FILTER (kind IN ({_BASE_KINDS})) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""

_DISTANCE = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: CAST(z[1] - z[2] AS HUGEINT) * (z[1] - z[2])))"


def _rounds(rounds: int) -> str:
    out = []
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, d * 8 + c) AS c, min(d) AS d FROM (SELECT p.r, c.c, {_DISTANCE} AS d FROM p, c{n} c) GROUP BY r)")
        if n < rounds:
            out.append(f"""m{n} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT a.c, p.x, unnest(range(1, 65)) AS i FROM a{n} a JOIN p USING (r)) GROUP BY c, i) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (c))""")
    return ",\n".join(out)


OP13_SQL = f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM p ORDER BY h, x LIMIT 8)),
{_rounds(10)}
SELECT vec_id, CAST(a10.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a10.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM a10 JOIN p USING (r) JOIN c10 ON c10.c = a10.c
"""
