"""DuckDB SQL for the corpus queries that SQL can express.

Decontamination (2), packing (3), license alignment (4), the seeded shuffle (5), the trained classifier (7) and HTML extraction (10) have none;
tests/llm holds them against brute force, invariants, held-out accuracy or an independent parser.
"""

from __future__ import annotations

from wearcurve.llm import quality, secrets
from wearcurve.llm.common import WORD


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secret_scan() -> str:
    parts = []
    for k, (kind, pattern, group, least, role, strong) in enumerate(secrets.KINDS):
        p = _text(pattern)
        more = "AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')" if kind == "blob" else ""
        parts.append(
            f"SELECT doc_id, s, s + length(w) AS e, '{kind}' AS kind, '{role}' AS role, {strong} AS strong, {k} AS rank FROM (SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS s FROM ("
            f"SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS w, unnest(g[1:len(m)]) AS g, unnest(v) AS v FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, regexp_split_to_array(text, {p}) AS g FROM d))) WHERE length(v) >= {least} {more}"
        )
    other = lambda roles: f"EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = p.doc_id AND q.role IN ({roles}) AND abs(q.s - p.s) <= {secrets.SCOPE} AND (q.e <= p.s OR p.e <= q.s))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), parts AS ({" UNION ALL ".join(parts)}),
      kept AS (SELECT *, kind || ':' || s::BIGINT || ':' || e::BIGINT AS told FROM parts p WHERE strong OR (role = 'identifier' AND {other("'secret'")}) OR (role = 'secret' AND {other("'identifier', 'endpoint'")})
        OR (role = 'endpoint' AND {other("'secret'")} AND {other("'identifier'")}))
      SELECT d.doc_id, count(k.kind) FILTER (WHERE kind = 'assign') AS n_assign, count(k.kind) FILTER (WHERE kind = 'access') AS n_access, count(k.kind) FILTER (WHERE kind = 'hex') AS n_hex,
        sha256(coalesce(string_agg(told, ',' ORDER BY s, rank) FILTER (WHERE strong), '')) AS base_sha256, coalesce(string_agg(told, ',' ORDER BY s, rank), '') AS spans
      FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""


def _quality_rules() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality.RULES.values()))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_text(WORD)}) AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_text(WORD)})) AS ls FROM documents),
      win AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + {quality.WINDOW}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - {quality.WINDOW - 1})) AS i FROM d WHERE len(ws) > {quality.WINDOW})),
      twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
      again AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range({quality.WINDOW})) AS j) GROUP BY doc_id),
      m AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_upper, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters FROM d LEFT JOIN again a ON a.doc_id = d.doc_id),
      f AS (SELECT *, ({bits})::BIGINT AS failed_bits FROM (SELECT *, word_chars - n_symbols AS n_letters_checked FROM m))
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {quality.policy_mask("base")}) <> 0 AS base_failed, (failed_bits & {quality.policy_mask("v1")}) = 0 AS kept, failed_bits FROM f"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_text(WORD)}) AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
  k AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
  SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n ON n.doc_id = k.doc_id"""

#: base32 of a hex digest: 32 groups of 5 of its 160 bits.
_NIBBLES = "list_transform(range(40), lambda i: strpos('0123456789abcdef', h[i + 1]) - 1)"
_BIT = "((n[(5 * i + {k}) // 4 + 1] >> (3 - (5 * i + {k}) % 4)) & 1)"
_BASE32 = "array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[" + " + ".join(f"{16 >> k} * {_BIT.format(k=k)}" for k in range(5)) + " + 1]), '')"
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h FROM p), n AS (SELECT *, {_NIBBLES} AS n, max(page_id) OVER (PARTITION BY h) AS last FROM h)
  SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM n"""

ORACLES: dict[str, str] = {"op1_secret_scan": _secret_scan(), "op6_quality_rules": _quality_rules(), "op8_warc": _WARC, "op9_minhash_dedup": _MINHASH}
