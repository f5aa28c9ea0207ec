"""DuckDB SQL for the operations that SQL can express."""

from __future__ import annotations

from wardline.llm import pii, quality, secrets, spelling

SQL: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_OVER = " AND ".join(
    f"({name} {op} {under} * {float(bound)!r})"
    for r in quality.RULES
    for name, under in [[x.strip() for x in r.measure.split("/")]]
    for op, bound in ((">=", r.low), ("<=", r.high))
    if bound is not None
)
_FAILED = ", ".join(
    "CASE WHEN NOT ("
    + " AND ".join(
        f"({name} {op} {under} * {float(bound)!r})"
        for name, under in [[x.strip() for x in r.measure.split("/")]]
        for op, bound in ((">=", r.low), ("<=", r.high))
        if bound is not None
    )
    + f") THEN '{r.name}' END"
    for r in quality.RULES
)
SQL["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls
  FROM d
), p AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w
), win AS (
  SELECT doc_id, pos, CASE WHEN pos + 4 <= n THEN word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o
         || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS win
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) >= 2 AS hit FROM win
), cover AS (
  SELECT doc_id, max(hit::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c
  FROM twice
), rep AS (
  SELECT doc_id, sum(c) AS n FROM cover GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
         coalesce(rep.n, 0)::bigint AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP})))::bigint AS n_stop_words,
         len(ls)::bigint AS n_lines, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       concat_ws(',', {_FAILED}) AS failed_rules,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_OVER} AS kept
FROM m
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: str, pattern: str, rank: int) -> str:
    """Rows (doc_id, rank, kind, start_at, end_at, match) of one pattern."""
    p = _quoted(pattern)
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, match,
         (gaps + before)::bigint AS start_at, (gaps + before + length(match))::bigint AS end_at
  FROM (
    SELECT doc_id, unnest(ms) AS match,
           unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda x: length(x))))) AS gaps,
           unnest(list_transform(range(1, len(ms) + 1),
                  lambda i: coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS before
    FROM (
      SELECT doc_id, regexp_extract_all(t, {p}) AS ms, regexp_split_to_array(t, {p}) AS gs
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, {p})
    )
  )"""


_PARTS = " UNION ALL ".join(_found(k, p.replace(r"\x20", " "), i) for i, (k, (p, _, _)) in enumerate(secrets.KINDS.items()))
_ROLES = " ".join(f"WHEN '{k}' THEN '{role}'" for k, (_, role, _) in secrets.KINDS.items())
_ASSIGN = _quoted(secrets.ASSIGN.replace(r"\x20", " "))
_STRONG = ", ".join(f"'{k}'" for k in secrets.BASE)
SQL["op3_secret_scans"] = f"""
WITH found AS ({_PARTS}
), parts AS (
  SELECT *, CASE kind {_ROLES} END AS role, kind || ':' || start_at || ':' || end_at AS one FROM found
  WHERE kind <> 'assign' OR length(regexp_extract(match, {_ASSIGN}, 2)) >= 8
), kept AS (
  SELECT * FROM parts p WHERE kind IN ({_STRONG}) OR EXISTS (
    SELECT 1 FROM parts s WHERE s.doc_id = p.doc_id AND s.kind IN ({_STRONG}) AND s.role <> p.role
    AND abs(s.start_at - p.start_at) <= {secrets.SCOPE})
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(one, ',' ORDER BY start_at, rank) FILTER (kind IN ({_STRONG})) AS base,
         string_agg(one, ',' ORDER BY start_at, rank) AS spans
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""

_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": pii.IBAN.replace(r"\x20", " "),
    "national_id": pii.NATIONAL,
}
_PII_PARTS = " UNION ALL ".join(_found(k, p, i) for i, (k, p) in enumerate(_PII.items()))
_SCORES = " ".join(f"WHEN '{k}' THEN {score}" for k, (_, score, _) in pii.KINDS.items())
_NEAR = " ".join(f"WHEN '{k}' THEN '{words}'" for k, (_, _, words) in pii.KINDS.items())
_BASE = ", ".join(f"'{k}'" for k in pii.BASE)
_LUHN = """(list_sum(list_transform(range(1, len(digits) + 1), lambda i: CASE
    WHEN (len(digits) - i) % 2 = 0 THEN digits[i]::int
    WHEN digits[i]::int > 4 THEN digits[i]::int * 2 - 9 ELSE digits[i]::int * 2 END)) % 10 = 0)"""
_MOD97 = """(list_reduce(list_transform(string_split(plain[5:] || plain[1:4], ''),
    lambda x: CASE WHEN x >= 'A' THEN 100 + ascii(x) - 55 ELSE ascii(x) - 48 END::bigint),
    lambda a, x: CASE WHEN x >= 100 THEN (a * 100 + x - 100) % 97 ELSE (a * 10 + x) % 97 END, 0::bigint) = 1)"""
SQL["op6_pii"] = f"""
WITH found AS ({_PII_PARTS}
), cleaned AS (
  SELECT *, regexp_replace(match, '[^0-9]', '', 'g') AS digits, replace(match, ' ', '') AS plain FROM found
), valid AS (
  SELECT * FROM cleaned WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(match, '.'), lambda x: x::hugeint > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND {_LUHN}
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND {_MOD97}
    ELSE true END
), scored AS (
  SELECT v.*, kind || ':' || start_at || ':' || end_at AS one,
         CASE kind {_SCORES} END + CASE WHEN regexp_matches(lower(substring(d.text,
           (greatest(start_at - {pii.CONTEXT}, 0) + 1)::bigint, (start_at - greatest(start_at - {pii.CONTEXT}, 0))::bigint)),
           CASE kind {_NEAR} END) THEN {pii.BONUS} ELSE 0 END AS score
  FROM valid v JOIN documents d ON d.doc_id = v.doc_id
), per AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
         string_agg(one, ',' ORDER BY rank, start_at) FILTER (kind IN ({_BASE})) AS base,
         string_agg(one, ',' ORDER BY rank, start_at) AS spans, count(*) FILTER (score >= 90) AS n_confident
  FROM scored WHERE kind IN ({_BASE}) OR score >= {pii.REPORTED} GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_confident, 0) AS n_confident
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""

SQL["op10_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

# CRC-32 by half bytes, low half first; its table of 16 follows from the polynomial.
_CRC_TABLE = "list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, x: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)))"
_HALVES = """list_transform(range(len(h)), lambda i: instr('0123456789ABCDEF', h[2 * (i // 2) + if(i % 2 = 0, 2, 1)]) - 1)"""

SQL["op11_spelling_groups"] = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS tab),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '{spelling.RUN}')), '{spelling.UPPER}', '{spelling.LOWER}') AS run
  FROM documents
), each AS (SELECT run, hex(doc_id || ':' || run) AS h, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, {_HALVES}), lambda s, x: xor(s >> 4, tab[(xor(s, x) & 15) + 1])), 4294967295) AS h
  FROM each, t
), thin AS (
  SELECT CASE WHEN h % {spelling.THIN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
  FROM hashed
), words AS (
  SELECT word, sum(c)::bigint AS n FROM thin WHERE length(word) >= {spelling.LEAST_LENGTH}
  GROUP BY word HAVING sum(c) >= {spelling.LEAST_COUNT}
), holes AS (
  SELECT word, n, left(word, i) || '?' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS less
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {spelling.RATIO} * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= {spelling.RATIO} * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, form, word AS at FROM forms
  UNION ALL SELECT c.word, f.form, f.word FROM chain c JOIN forms f ON c.form = f.word
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
