"""SQL for the span operators: matches with their code-point offsets, from the pieces between matches."""

from __future__ import annotations

from geoquarry.llm import pii, secrets


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _matches(kind: str, order: int, pattern: str, source: str, key: str, keep: str = "true") -> str:
    """key, kind, place, s, e, v: leftmost matches that do not overlap, kept where ``keep`` holds of v."""
    return (
        f"SELECT {key}, '{kind}' AS kind, {order} AS place, s, s + length(v) AS e, v FROM (SELECT {key}, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s "
        f"FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(text, '{_q(pattern)}') AS m, regexp_split_to_array(text, '{_q(pattern)}') AS g FROM {source}))) WHERE {keep}"
    )


def secrets_sql() -> str:
    parts = []
    for k, r in enumerate(secrets.RULES):
        pattern = f"(?i:{r.prefix})" + r.pattern.removeprefix(r.prefix) if r.prefix else r.pattern
        value = f"length(v) - length(regexp_extract(v, '^{_q(f'(?i:{r.prefix})')}'))" if r.prefix else "octet_length(encode(v))"
        parts.append(_matches(r.kind, k, pattern, "d", "doc_id", f"{value} >= {r.least}"))
    base = f"FILTER (place < {secrets.BASE})"
    line = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.RULES[: secrets.BASE])
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({' UNION ALL '.join(parts)}), "
        f"c AS (SELECT doc_id, {counts}, string_agg({line}, ',' ORDER BY s, place) {base} AS base, string_agg({line}, ',' ORDER BY s, place) AS spans FROM a GROUP BY 1) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.RULES[: secrets.BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c ON c.doc_id = d.doc_id"
    )


#: The fixed base patterns as they are defined, without the guards that Java needs.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN substr({_DIGITS}, length({_DIGITS}) - i, 1)::INT ELSE substr({_DIGITS}, length({_DIGITS}) - i, 1)::INT * 2 - CASE WHEN substr({_DIGITS}, length({_DIGITS}) - i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_KEEP = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def pii_sql() -> str:
    terms = "regexp_extract_all(lower(text), '\\p{L}{3,}')"
    line = "kind || ':' || s || ':' || e"
    clear = "NOT EXISTS (SELECT 1 FROM b WHERE b.text = r.text AND b.s < r.e AND r.s < b.e)"
    return (
        f"WITH d AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents), real AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), "
        f"b AS ({' UNION ALL '.join(_matches(k, i, p, 'd', 'text', _KEEP[k]) for i, (k, p) in enumerate(BASE.items()))}), "
        f"held AS (SELECT DISTINCT text FROM b), "
        f"free AS (SELECT text, s, e, lower(v) AS term, row_number() OVER (PARTITION BY text ORDER BY s) AS rn FROM ({_matches('term', len(BASE), r'\p{L}{3,}', 'held', 'text')}) r WHERE {clear}), "
        f"spot AS (SELECT b.text, kind || ':' || lower(b.v) AS entity, b.s, b.e, count(f.rn) AS r FROM b LEFT JOIN free f ON f.text = b.text AND f.e <= b.s GROUP BY ALL), "
        f"near AS (SELECT DISTINCT spot.text, entity, term FROM spot JOIN free f ON f.text = spot.text AND f.rn BETWEEN r - {pii.WINDOW - 1} AND r + {pii.WINDOW}), "
        f"ne AS (SELECT entity, count(DISTINCT text) AS n_e FROM spot GROUP BY 1), "
        f"net AS (SELECT entity, term, count(*) AS n_et FROM near GROUP BY 1, 2), "
        f"nt AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct({terms})) AS term FROM real) GROUP BY 1), "
        f"tell AS (SELECT entity, term FROM net JOIN ne USING (entity) JOIN nt USING (term) WHERE 1 + log2(n_et / (n_t + 1)) / greatest(log2((SELECT count(*) FROM real) / n_e), 1e-9) >= {pii.GENERALISE}), "
        f"own AS (SELECT DISTINCT text, term FROM tell JOIN (SELECT DISTINCT text, entity FROM spot) USING (entity)), "
        f"told AS (SELECT r.* FROM ({_matches('term', len(BASE), r'\p{L}{3,}', '(SELECT DISTINCT text FROM own)', 'text')}) r JOIN own ON own.text = r.text AND own.term = lower(r.v) WHERE {clear}), "
        f"a AS (SELECT * FROM b UNION ALL SELECT * FROM told), "
        f"c AS (SELECT text, {', '.join(f'count(*) FILTER (kind = {k!r}) AS n_{k}' for k in BASE)}, string_agg({line}, ',' ORDER BY place, s) FILTER (kind <> 'term') AS base, string_agg({line}, ',' ORDER BY place, s) AS spans FROM a GROUP BY 1) "
        f"SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN c ON c.text = coalesce(documents.text, '')"
    )
