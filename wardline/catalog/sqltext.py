"""Pieces of SQL text shared by the check queries."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}+')"


def sentences(x: str) -> str:
    marked = f"regexp_replace(translate({x}, '*#', ''), '([。.])', '\\1' || chr(1), 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: length(s) > 5)"


def in_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def weight(x: str, lexicon: dict[str, int]) -> str:
    by: dict[int, list[str]] = {}
    for w, n in lexicon.items():
        by.setdefault(n, []).append(w)
    cases = " ".join(f"WHEN t IN {in_list(ws)} THEN {n}" for n, ws in sorted(by.items()))
    return (
        f"CAST(coalesce(list_sum(list_transform({tokens(f'lower({x})')}, "
        f"lambda t: CASE {cases} ELSE 0 END)), 0) AS BIGINT)"
    )


def p(w: str) -> str:
    return f"({w} / ({w} + 100.0::DOUBLE))"


def sentence_ctes(source: str, ids: str, text: str, lexicon: dict[str, int]) -> str:
    """CTEs sent0 (array), sent (one row per sentence with weight, p, label, score)."""
    return f"""
sent0 AS (SELECT {ids}, {sentences(text)} AS ss FROM {source}),
sent1 AS (SELECT {ids}, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM sent0),
sent2 AS (SELECT *, {weight('sentence', lexicon)} AS w FROM sent1),
sent AS (SELECT *, CASE WHEN pp >= 0.5 THEN 'LABEL_0' ELSE 'LABEL_1' END AS label,
         CASE WHEN pp >= 0.5 THEN pp ELSE 1 - pp END AS score,
         CASE WHEN pp >= 0.5 THEN pp ELSE 1 - (1 - pp) END AS p
         FROM (SELECT *, {p('w')} AS pp FROM sent2))"""


STATE = {
    "guardrail": "CASE WHEN label = 'LABEL_0' AND p >= 0.97 THEN 0 WHEN label = 'LABEL_1' AND p <= 0.04 THEN 1 ELSE 2 END",
    "service": "CASE WHEN label = 'LABEL_0' AND score >= 0.97 THEN 0 WHEN label = 'LABEL_0' AND score > 0.00002 THEN 2 ELSE 1 END",
    "paper": "CASE WHEN p > 0.92 THEN 0 WHEN p > 0.04 THEN 2 ELSE 1 END",
}


def flag(state: str) -> str:
    return f"CASE WHEN bool_or({state} = 0) THEN 0 WHEN bool_or({state} = 2) THEN 2 ELSE 1 END"


def flags_cte(name: str, rule: str, source: str, ids: str) -> str:
    """Flag per row of ``source``; rows without sentences pass."""
    keys = " AND ".join(f"s.{k.strip()} = d.{k.strip()}" for k in ids.split(","))
    cols = ", ".join(f"d.{k.strip()}" for k in ids.split(","))
    return f"""{name} AS (SELECT {cols}, coalesce(min(f.flag), 1) AS flag FROM {source} d LEFT JOIN
 (SELECT {ids}, {flag(STATE[rule])} AS flag FROM sent GROUP BY {ids}) f ON {keys.replace('s.', 'f.')}
 GROUP BY {cols})"""


def word_match(x: str, word: str) -> str:
    """Whole-word, case-sensitive match of a plain keyword."""
    body = f"{SPACE}+".join(word.split())
    return f"regexp_matches({x}, '(^|{OTHER}){body}($|{OTHER})')"


def noise_match(x: str, word: str) -> str:
    """Case-insensitive match with non-word characters allowed between characters."""
    return f"regexp_matches({x}, '(?i)" + f"{OTHER}*".join(word) + "')"


def any_of(parts) -> str:
    return "(" + " OR ".join(parts) + ")"


def window_ctes(source: str, ids: str, text: str, lexicon: dict[str, int]) -> str:
    """CTEs win0..win: one row per token window with its unsafe probability."""
    return f"""
win0 AS (SELECT {ids}, {tokens(text)} AS toks FROM {source}),
win1 AS (SELECT *, len(toks) AS n FROM win0 WHERE len(toks) > 0),
win2 AS (SELECT *, unnest(range(CAST(ceil(greatest(n - 510, 0) / 256.0) AS BIGINT) + 1)) AS window_no FROM win1),
win3 AS (SELECT {ids}, window_no, window_no * 256 AS start,
         array_to_string(toks[window_no * 256 + 1 : window_no * 256 + 510], ' ') AS piece FROM win2),
win4 AS (SELECT *, {weight('piece', lexicon)} AS w FROM win3),
win AS (SELECT * EXCLUDE (piece), CASE WHEN pp >= 0.5 THEN pp ELSE 1 - (1 - pp) END AS p
        FROM (SELECT *, {p('w')} AS pp FROM win4))"""
