"""SQL that the queries are checked against."""

WORDS = r"len(regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+'))"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (
  SELECT doc_id, source, {WORDS.format('text')} AS size,
         CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 2 * source_size AS cap,
         row_number() OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST) AS rank,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
         sum(weight) OVER () AS weights
  FROM s
), l AS (
  SELECT *, (budget - CAST(coalesce(sum(cap) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(weights - coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * level THEN CAST(cap AS DOUBLE)
              ELSE weight * (SELECT arg_min(level, rank) FROM l WHERE cap > weight * level) END AS target
  FROM l
), k AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS copies FROM t
), h AS (
  SELECT d.*, k.source_size, k.target, k.copies, k.target - k.copies * k.source_size AS rest,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
         CAST(sum(size) OVER (PARTITION BY d.source, hash) AS BIGINT) AS same
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN 2 * upto - same <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM h
"""

OP2 = f"""
WITH d AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""



def _with(value: str, cost: str, letter: str) -> str:
    """A state's value (12 digits of cost, then the audit) after an edit."""
    return f"lpad(CAST(CAST(substr({value}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({value}, 13) || '{letter}'"


def _closed(names: str) -> str:
    """v0..v3 of a layer after inserts."""
    due = ", ".join(_with(f"{names}{s}", "5", "I") for s in (0, 1, 3))
    return f"""SELECT * EXCLUDE (w2, w3), w2 AS x2, least(w3, {_with('w2', '5', 'I')}) AS x3
      FROM (SELECT *, least({names}2, {due}) AS w2, {names}3 AS w3 FROM n)"""


_USER = ", ".join(f"CASE WHEN fault IN (0, 3) THEN {_with(v, f'{c} + 5 * CAST(fault = 3 AS INT)', x)} END" if x == "R" else
                  f"CASE WHEN fault IN (0, 3) AND kind = 'u' THEN {_with(v, '5 * CAST(fault = 3 AS INT)', x)} END"
                  for v in ("v0", "v1", "x3") for x, c in (("K", 0), ("R", 1)))
_ASSISTANT = f"""CASE WHEN fault IN (0, 3) THEN {_with('x2', '1 + 5 * CAST(fault = 3 AS INT)', 'R')} END,
  CASE WHEN fault IN (0, 3) AND kind = 'a' THEN {_with('x2', '5 * CAST(fault = 3 AS INT)', 'K')} END"""

OP11 = f"""
WITH RECURSIVE bits(byte, k, v) AS (
  SELECT b, 0, CAST(b AS BIGINT) FROM range(256) x(b)
  UNION ALL SELECT byte, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY byte) AS steps FROM bits WHERE k = 8
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS was_role, coalesce(text, ' ') AS was_text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) FOR x IN string_split(
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
           lambda a, x: xor(a >> 8, steps[1 + CAST(xor(a, x) & 255 AS INT)])), CAST(4294967295 AS BIGINT)) % 20 AS damage
  FROM conversations, crc
), c AS (
  SELECT conv_id, turn, was_role, md5(was_text) AS tie, copy, CASE WHEN damage = 4 THEN 'user' ELSE was_role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(was_text, '.!?', '') ELSE was_text END AS text
  FROM d, LATERAL (SELECT unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy) WHERE damage <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, was_role, tie, copy) AS i FROM c
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
         substr(role, 1, 1) AS kind, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM o
), t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before || kind NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
  FROM f GROUP BY conv_id
), n(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM t
  UNION ALL
  SELECT n.conv_id, f.i, {_with('v0', '2', 'D')},
         least({_with('v1', '2', 'D')}, CASE WHEN fault IN (0, 3) AND kind = 's' THEN {_with('v0', '5 * CAST(fault = 3 AS INT)', 'K')} END),
         least({_with('x2', '2', 'D')}, {_USER}), least({_with('x3', '2', 'D')}, {_ASSISTANT})
  FROM ({_closed('v')}) n JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i + 1
), e AS (
  SELECT conv_id, least(v0, x3) AS v FROM ({_closed('v')}) JOIN t USING (conv_id) WHERE i = rows
), a AS (
  SELECT conv_id, CAST(substr(v, 1, 12) AS BIGINT) AS cost, substr(v, 13) AS audit FROM e
), l AS (
  SELECT conv_id, p, substr(audit, p, 1) AS edit, p - len(replace(substr(audit, 1, p), 'I', '')) AS inserts
  FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS p FROM a)
), r AS (
  SELECT l.conv_id, p, edit, kind, role, text, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS q,
         first_value(edit || coalesce(kind, '')) OVER (PARTITION BY l.conv_id ORDER BY p) = 'Ks' AS opened
  FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.p - l.inserts AND edit <> 'I' WHERE edit <> 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - CAST(opened AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS repaired_sha256
  FROM r GROUP BY conv_id
)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM g.conv_id
"""

# The patterns of the kinds, as the definition has them.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"\p{L}[\p{L}\p{N}]*"
_FOUND = " UNION ALL ".join(
    f"SELECT row, {no} AS no, '{k}' AS kind, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}')"
    for no, (k, p) in enumerate(_PATTERNS.items()))


def _terms(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{_TERM}'), lambda w: {LOWER.format('w')})"



OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  SELECT row, no, kind, i, found[i] AS found, gaps[i] AS before, gaps[i + 1] AS after
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM ({_FOUND}))
), p AS (
  SELECT *, sum(length(before) + length(found)) OVER (PARTITION BY row, kind ORDER BY i) AS stop, regexp_replace(found, '[^0-9]', '', 'g') AS digits FROM m
), b AS (
  SELECT row, no, kind, CAST(stop - length(found) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
         CASE WHEN kind IN ('card', 'phone') THEN digits ELSE {LOWER.format('found')} END AS entity,
         list_concat(({_terms('before')})[-8:], ({_terms('after')})[:8]) AS near
  FROM p WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(found, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(right(x, 3) AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
         CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(digits), k, 1) AS INT) ELSE 2 * CAST(substr(reverse(digits), k, 1) AS INT)
              - 9 * CAST(CAST(substr(reverse(digits), k, 1) AS INT) > 4 AS INT) END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15 ELSE true END
), e AS (
  SELECT kind, entity, count(DISTINCT row) AS n_entity FROM b GROUP BY kind, entity
), q AS (
  SELECT word, kind, entity, count(DISTINCT row) AS n_pair
  FROM (SELECT row, kind, entity, near, unnest(list_distinct(near)) AS word FROM b) GROUP BY word, kind, entity HAVING count(DISTINCT near) >= 2
), w AS (
  SELECT row, unnest(list_distinct({_terms('text')})) AS word FROM d
), c AS (
  SELECT word, count(*) AS n_word FROM w SEMI JOIN q USING (word) GROUP BY word
), r AS (
  SELECT word, CASE WHEN min(round(log2(n_word / n_pair), 9)) <= 1 THEN 'remove' ELSE 'generalise' END AS kind
  FROM q JOIN e USING (kind, entity) JOIN c USING (word)
  WHERE round(log2(CAST((SELECT count(*) FROM d) AS DOUBLE) * n_pair / (n_word * n_entity)), 9) >= 4 GROUP BY word HAVING min(round(log2(n_word / n_pair), 9)) <= 3
), t AS (
  SELECT row, i, found[i] AS found, length(gaps[i]) AS gap
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT row, regexp_extract_all(text, '{_TERM}') AS found, string_split_regex(text, '{_TERM}') AS gaps FROM d SEMI JOIN (SELECT row FROM w JOIN r USING (word)) x USING (row)))
), o AS (
  SELECT row, {LOWER.format('found')} AS word, stop - length(found) AS start, stop
  FROM (SELECT *, sum(gap + length(found)) OVER (PARTITION BY row ORDER BY i) AS stop FROM t)
), s AS (
  SELECT row, no, kind, start, stop FROM b
  UNION ALL
  SELECT row, CASE kind WHEN 'remove' THEN 4 ELSE 5 END, kind, CAST(start AS BIGINT), CAST(stop AS BIGINT) FROM o JOIN r USING (word)
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.row = o.row AND b.start <= o.start AND o.start < b.stop)
), g AS (
  SELECT row, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*_PATTERNS, 'remove', 'generalise'))},
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY no, start) FILTER (no < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY no, start) AS spans
  FROM s GROUP BY row
)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*_PATTERNS, 'remove', 'generalise'))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""

ORACLE = {"op1_mix": OP1, "op2_exact_dedup": OP2, "op11_repair": OP11, "op13_personal": OP13}
