"""DuckDB SQL for the span queries, from the same tables of kinds.

Lookarounds are said otherwise here, since DuckDB's patterns have none: neighbouring characters are tested by place.
"""

from __future__ import annotations

from . import pii, secret_scan


def _hits(kind: str, pattern: str, test: str = "true") -> str:
    """doc_id, t, kind, hit, s, e of a pattern's matches that pass a test; places from 0, the end exclusive."""
    pattern = pattern.replace("'", "''")
    return f"""(SELECT doc_id, t, '{kind}' AS kind, hit, s, s + length(hit) AS e FROM (
    SELECT doc_id, t, hits[i] AS hit, CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps FROM d), unnest(range(1, len(hits) + 1)) u(i))
  WHERE {test})"""


def _apart(letters: str) -> str:
    """The characters beside a match are none of these."""
    return f"NOT (s > 0 AND regexp_matches(substr(t, CAST(s AS BIGINT), 1), '[{letters}]')) AND NOT regexp_matches(substr(t, CAST(s AS BIGINT) + length(hit) + 1, 1), '[{letters}]')"


def _digest(spans: str, base: tuple[str, ...], kinds: tuple[str, ...], more: str = "") -> str:
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {j}" for j, k in enumerate(kinds)) + " END"
    told = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)
    names = ", ".join(f"'{k}'" for k in base)
    return f"""SELECT doc_id, {counts}, sha256(coalesce(string_agg({told}, ',' ORDER BY s, {rank}) FILTER (WHERE kind IN ({names})), '')) AS base_sha256,
  coalesce(string_agg({told}, ',' ORDER BY s, {rank}), '') AS spans{more}
FROM (SELECT d.doc_id, {spans}.* EXCLUDE (doc_id) FROM d LEFT JOIN {spans} USING (doc_id)) GROUP BY doc_id"""


DOCS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"


def _pii() -> str:
    octet = "0*(?:1?[0-9]{1,2}|2[0-4][0-9]|25[0-5])"
    found = [
        _hits("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        _hits("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
        _hits("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 14 AND 19"),
        _hits("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        _hits("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _apart("A-Za-z0-9")),
        _hits("ssn", r"[0-9-]+", "regexp_full_match(hit, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
    ]
    luhn = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN CAST(reverse({DIGITS})[i] AS INT) * (2 - i % 2) > 9 THEN CAST(reverse({DIGITS})[i] AS INT) * (2 - i % 2) - 9 ELSE CAST(reverse({DIGITS})[i] AS INT) * (2 - i % 2) END)) % 10 = 0"
    compact = "replace(hit, ' ', '')"
    moved = f"substr({compact}, 5) || substr({compact}, 1, 4)"
    values = f"list_transform(string_split({moved}, ''), lambda c: CAST(CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS BIGINT))"
    mod97 = f"list_reduce({values}, lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97, CAST(0 AS BIGINT)) = 1"
    confirmed = {
        "ip": rf"regexp_full_match(hit, '{octet}(?:\.{octet}){{3}}')",
        "card": luhn,
        "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
        "iban": f"length({compact}) BETWEEN 15 AND 34 AND {mod97}",
    }
    test = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in confirmed.items()) + " ELSE true END"
    near = "lower(right(substr(t, CAST(p AS BIGINT) + 1, CAST(s - p AS BIGINT)), {n}) || ' ' || left(substr(t, CAST(e AS BIGINT) + 1, CAST(q - e AS BIGINT)), {n}))".replace("{n}", str(pii.NEAR))
    context = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_matches({near}, '{v}')" for k, v in pii.CONTEXT.items()) + " END"
    first = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pii.SCORES.items()) + " END"
    base = ", ".join(f"'{k}'" for k in pii.BASE)
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {j}" for j, k in enumerate(pii.KINDS)) + " END"
    return f"""{DOCS},
a AS ({" UNION ALL ".join(f"SELECT * FROM {x}" for x in found)}),
b AS (SELECT *, coalesce(lag(e) OVER w, 0) AS p, coalesce(lead(s) OVER w, length(t)) AS q FROM a WINDOW w AS (PARTITION BY doc_id, kind ORDER BY s)),
c AS (SELECT *, CAST(round(least(1.0, {first} + CASE WHEN {context} THEN {pii.BONUS} ELSE 0 END), 2) AS DOUBLE) AS score FROM b WHERE {test}),
f AS (SELECT * FROM c WHERE kind IN ({base}) OR score >= {pii.THRESHOLD})
{_digest("f", pii.BASE, pii.KINDS, f", coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, {rank}), '') AS scores")}"""


def _secrets() -> str:
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    quoted = assign.replace("'", "''")
    found = [
        _hits("assign", assign, f"length(regexp_extract(hit, '{quoted}', 2)) >= 6"),
        _hits("access", "AKIA[A-Z0-9]+", "length(hit) >= 20"),
        _hits("hex", "[0-9a-f]{24,}"),
        _hits("github", "gh[pousr]_[A-Za-z0-9]{36,}", _apart("A-Za-z0-9")),
        _hits("slack", "xox[abprs]-[A-Za-z0-9-]{20,}", _apart("A-Za-z0-9")),
        _hits("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", _apart("A-Za-z0-9_-")),
        _hits("pem", "-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----"),
    ]
    rules = secret_scan.RULES
    return f"""{DOCS}, f AS ({" UNION ALL ".join(f"SELECT * FROM {x}" for x in found)})
{_digest("f", tuple(r.kind for r in rules if r.base), tuple(r.kind for r in rules))}"""


PII_SQL, SECRETS_SQL = _pii(), _secrets()
