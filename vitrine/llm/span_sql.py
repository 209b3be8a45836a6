"""Reference SQL for the operators that find spans.

The patterns are the plain ones, searched by another engine, without what the operators add
to keep long texts linear.
"""

from __future__ import annotations

DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
LUHN = f"""(list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda k:
    CASE WHEN k % 2 = 1 THEN substr(reverse({DIGITS}), k, 1)::INT
         WHEN substr(reverse({DIGITS}), k, 1)::INT > 4 THEN substr(reverse({DIGITS}), k, 1)::INT * 2 - 9
         ELSE substr(reverse({DIGITS}), k, 1)::INT * 2 END)) % 10 = 0)"""
MOD_97 = """(list_reduce(list_transform(string_split(array_to_string(list_transform(
    string_split(substr(value, 5) || substr(value, 1, 4), ''),
    lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''),
    lambda d: d::INT), lambda a, b: (a * 10 + b) % 97) = 1)"""
IP = """list_bool_and(list_transform(string_split(value, '.'), lambda x:
    length(ltrim(x, '0')) < 4 AND right('000' || x, 3)::INT <= 255))"""


def spans(kinds: list[tuple[str, str, str]]) -> str:
    """CTEs ``docs`` and ``spans`` (r, place, kind, value, start, stop) from (kind, pattern, test)."""
    cuts = []
    for place, (kind, pattern, _) in enumerate(kinds, 1):
        quoted = pattern.replace("'", "''")
        cuts.append(
            f"SELECT r, {place} AS place, '{kind}' AS kind, string_split(replace(regexp_replace("
            f"text, '{quoted}', chr(1) || '\\0' || chr(2), 'g'), chr(2), chr(1)), chr(1)) AS p "
            f"FROM docs WHERE regexp_matches(text, '{quoted}')"
        )
    tests = " ".join(f"WHEN '{kind}' THEN {test}" for kind, _, test in kinds)
    return f"""docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang,
         translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS text
  FROM documents
), cut AS ({" UNION ALL ".join(cuts)}
), matches AS (
  SELECT r, place, kind, p, unnest(range(1, len(p) // 2 + 1)) AS i FROM cut
), placed AS (
  SELECT r, place, kind, p[2 * i] AS value,
         list_sum(list_transform(p[1:2 * i - 1], lambda x: length(x)))::BIGINT AS start
  FROM matches
), spans AS (
  SELECT *, start + length(value) AS stop, kind || ':' || start || ':' || (start + length(value)) AS span
  FROM placed WHERE CASE kind {tests} END
)"""


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", IP),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({DIGITS}) BETWEEN 13 AND 19 THEN {LUHN} ELSE false END"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", f"CASE WHEN length(value) BETWEEN 15 AND 34 THEN {MOD_97} ELSE false END"),
    ("ssn", r"[0-9]+-[0-9]+-[0-9]+", r"regexp_full_match(value, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
]

PII_SQL = f"""
WITH {spans(PII)}, scored AS (
  SELECT s.* FROM spans s JOIN docs d USING (r)
  WHERE kind <> 'ssn' OR regexp_matches(
    lower(substr(text, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0))),
    'ssn|social security|taxpayer')
), summed AS (
  SELECT r, string_agg(span, ',' ORDER BY place, start) AS spans,
         string_agg(span, ',' ORDER BY place, start) FILTER (place <= 4) AS base,
         {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))}
  FROM scored GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone"))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (r)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BEARER = r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]+)"
ASSIGNED = "regexp_extract(value, '{}', 2)".format(ASSIGN.replace("'", "''"))
BORNE = f"regexp_extract(value, '{BEARER}', 1)"

SECRETS = [
    ("assign", ASSIGN, f"length({ASSIGNED}) >= 12"),
    ("access", r"AKIA[A-Z0-9]+", "length(value) >= 18"),
    ("hex", r"[0-9a-f]+", "length(value) >= 16"),
    ("bearer", BEARER, f"length({BORNE}) >= 20"),
]

SECRETS_SQL = f"""
WITH {spans(SECRETS)}, candidates AS (
  SELECT s.*, coalesce(d.source, '') AS owner,
         CASE kind WHEN 'assign' THEN {ASSIGNED} WHEN 'bearer' THEN {BORNE} ELSE value END AS secret
  FROM spans s JOIN docs d USING (r)
), owned AS (
  SELECT secret, count(DISTINCT owner) AS n_owners FROM candidates GROUP BY secret
), judged AS (
  SELECT c.*, CASE WHEN n_owners >= 3 THEN 'example'
                   WHEN regexp_matches(secret, '[0-9]') AND len(list_distinct(string_split(secret, ''))) >= 8
                   THEN 'live' ELSE 'weak' END AS verdict
  FROM candidates c JOIN owned USING (secret)
), summed AS (
  SELECT r, string_agg(span, ',' ORDER BY start, place) AS spans,
         string_agg(span, ',' ORDER BY start, place) FILTER (place <= 3) AS base,
         count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example,
         {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))}
  FROM judged WHERE place <= 3 OR verdict = 'live' GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("assign", "access", "hex", "live", "example"))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (r)
"""
