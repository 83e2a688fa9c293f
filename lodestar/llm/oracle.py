"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

WARC = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(OCTET_LENGTH(ENCODE(payload)) AS BIGINT) AS payload_bytes, SHA256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest AS digest, MIN(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON payload_digest = digest AND payload_bytes >= 100
"""

#: Sizes of marks: a block begins with '<turn ROLE>' and a line feed and ends with '</turn>' and one; '<part/>' stands between its texts.
CHAT = r"""
WITH t AS (
 SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
b AS (SELECT *, COALESCE(role <> LAG(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), TRUE) AS begins FROM t),
s AS (SELECT *, LENGTH(text) + LENGTH(REGEXP_REPLACE(text, '<(\\*)(/?turn|part)', '<\\\1\2', 'g')) - LENGTH(text)
 + CASE WHEN begins THEN LENGTH('<turn >') + 1 + LENGTH('</turn>') + 1 + LENGTH(REPLACE(REPLACE(REPLACE(role, '\', '\\'), '>', '\g'), CHR(10), '\n')) ELSE LENGTH('<part/>') END AS chars FROM b)
SELECT conv_id, COUNT(*) AS n_turns, SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(COALESCE(SUM(LENGTH(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 SHA256(COALESCE(STRING_AGG(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(SUM(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def _found(kind: str, rank: int, pattern: str, least: int, groups: int) -> str:
    """Spans of one kind: the text is marked as the operator marks it, cut at the marks, and the lengths are summed up."""
    marks = "".join(f"\\{g + 1}' || CHR(2) || '" for g in range(groups))
    replacement = f"CHR(1) || '{marks}'"
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, pos AS start, pos + own AS stop FROM (
 SELECT doc_id, i, own, size, CAST(SUM(whole) OVER (PARTITION BY doc_id ORDER BY i) - whole AS BIGINT) AS pos FROM (
  SELECT doc_id, i, LENGTH(REPLACE(piece, CHR(2), '')) AS whole, LENGTH(STRING_SPLIT(piece, CHR(2))[{groups}]) AS size, {' + '.join(f"LENGTH(STRING_SPLIT(piece, CHR(2))[{g + 1}])" for g in range(groups))} AS own FROM (
   SELECT doc_id, UNNEST(pieces) AS piece, GENERATE_SUBSCRIPTS(pieces, 1) AS i FROM (
    SELECT doc_id, STRING_SPLIT(REGEXP_REPLACE(text, '{pattern}', {replacement}, 'g'), CHR(1)) AS pieces FROM d)))) WHERE i > 1 AND size >= {least}"""


def secrets(strong: dict, weak: dict, role: dict, needs: dict, scope: int) -> str:
    """The scan's patterns, with lookarounds left out: runs are whole either way, and the mixed run is tested afterwards.

    DuckDB's case-insensitive patterns also fold the long s and the Kelvin sign, which the operator's don't.
    """
    d = "d AS (SELECT doc_id, TRANSLATE(COALESCE(text, ''), CHR(1) || CHR(2), CHR(3) || CHR(3)) AS text FROM documents)"
    kinds = [*strong, *weak]
    parts = []
    for k, (pattern, groups, least, _) in (strong | weak).items():
        if k == "hex":
            pattern = "([0-9a-f]{24,})"
        if k == "opaque":
            continue
        parts.append(_found(k, kinds.index(k), pattern, least, groups))
    cases = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in role.items())
    enough = " OR ".join("(role = '" + r + "' AND " + " AND ".join(f"BOOL_OR(o_role = '{n}')" for n in ns) + ")" for r, ns in needs.items())
    opaque = """SELECT doc_id, %d AS rank, 'opaque' AS kind, start, stop FROM (SELECT doc_id, pos AS start, pos + LENGTH(piece) AS stop, piece FROM (
 SELECT doc_id, i, piece, CAST(SUM(LENGTH(piece)) OVER (PARTITION BY doc_id ORDER BY i) - LENGTH(piece) AS BIGINT) AS pos FROM (
  SELECT doc_id, UNNEST(pieces) AS piece, GENERATE_SUBSCRIPTS(pieces, 1) AS i FROM (
   SELECT doc_id, STRING_SPLIT(REGEXP_REPLACE(text, '([A-Za-z0-9+/_-]+={0,2})', CHR(1) || '\\1' || CHR(1), 'g'), CHR(1)) AS pieces FROM d))) WHERE i %% 2 = 0)
 WHERE REGEXP_MATCHES(piece, '^[A-Za-z0-9+/_-]{20,}={0,2}$') AND REGEXP_MATCHES(piece, '[0-9]') AND REGEXP_MATCHES(piece, '[a-z]') AND REGEXP_MATCHES(piece, '[A-Z]')""" % kinds.index("opaque")
    return f"""WITH {d}, parts AS ({' UNION ALL '.join([*parts, opaque])}),
r AS (SELECT *, CASE kind {cases} END AS role FROM parts),
near AS (SELECT w.doc_id, w.rank, w.kind, w.start, w.stop FROM (SELECT * FROM r WHERE rank >= {len(strong)}) w JOIN (SELECT doc_id, start AS o_start, stop AS o_stop, role AS o_role FROM r) o
 ON w.doc_id = o.doc_id AND GREATEST(w.start, o_start) - LEAST(w.stop, o_stop) BETWEEN 0 AND {scope} AND role <> o_role GROUP BY w.doc_id, w.rank, w.kind, w.start, w.stop, role HAVING {enough}),
a AS (SELECT doc_id, rank, kind, start, stop FROM r WHERE rank < {len(strong)} UNION ALL SELECT * FROM near)
SELECT d.doc_id, {', '.join(f"COUNT(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in strong)},
 SHA256(COALESCE(STRING_AGG(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(strong)}), '')) AS base_sha256,
 COALESCE(STRING_AGG(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id GROUP BY d.doc_id"""
