"""Keyword patterns as Columns; over literal keywords Catalyst folds them to constants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.rows import let
from wardline.functions.text import NON_WORD, SPACE, WORD, has_cjk, strip

STYLES = ("auto", "characters")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({NON_WORD})", r"\\$1")


def character_pattern(keyword: Column) -> Column:
    """The characters in order, any run of non-word characters allowed in between."""
    chars = F.filter(F.split(keyword, ""), lambda c: F.length(c) > 0)
    return F.array_join(F.transform(chars, escape), f"{NON_WORD}*")


def _edge(char: Column, inside: str) -> Column:
    """A word boundary next to ``char``: the side beyond it must be of the other kind."""
    beyond_word, beyond_other = {
        "start": (f"(?<!{WORD})", f"(?<={WORD})"),
        "end": (f"(?!{WORD})", f"(?={WORD})"),
    }[inside]
    return F.when(F.regexp_like(char, F.lit(WORD)), F.lit(beyond_word)).otherwise(F.lit(beyond_other))


def word_pattern(keyword: Column) -> Column:
    """Whole words with any white space between them; NULL for a blank keyword."""
    k = strip(keyword)
    parts = F.filter(F.split(k, f"{SPACE}+"), lambda p: F.length(p) > 0)
    body = F.array_join(F.transform(parts, escape), f"{SPACE}+")
    whole = F.concat(_edge(F.left(k, F.lit(1)), "start"), body, _edge(F.right(k, F.lit(1)), "end"))
    return F.when(F.length(k) > 0, whole)


def uses_characters(keyword: Column, style: str) -> Column:
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    return has_cjk(keyword) if style == "auto" else F.lit(True)


def keyword_pattern(keyword: Column, style: str = "auto", ignore_case: bool = False) -> Column:
    """Pattern of a keyword: noise tolerant for CJK, whole words otherwise (``auto``),
    or noise tolerant for all (``characters``). Blank keywords give NULL."""
    body = (
        F.when(has_cjk(keyword), character_pattern(keyword)).otherwise(word_pattern(keyword))
        if style == "auto"
        else character_pattern(keyword)
    )
    flag = "(?iu)" if ignore_case else ""
    return F.when(F.length(strip(keyword)) > 0, F.concat(F.lit(flag), body))


def folded(text: Column) -> Column:
    """Lower-case word characters only: what noise and case cannot change."""
    return fold_case(F.regexp_replace(text, f"{NON_WORD}+", ""))


def fold_case(text: Column) -> Column:
    """One form for all characters that case-insensitive matching takes for the same; through
    upper case, which also joins long s and s, dotless i and i."""
    upper = F.replace(F.upper(text), F.lit("İ"), F.lit("I"))
    return F.replace(F.lower(upper), F.lit("ς"), F.lit("σ"))


def contains_any(text: Column, needles: Sequence[Column]) -> Column:
    """Whether the text holds one of the needles. Plain substring search costs a fraction of
    a pattern, so this goes first wherever a pattern implies a substring."""
    return let(text, lambda t: reduce(or_, [F.contains(t, n) for n in needles]))


def may_match(text: Column, keywords: Sequence[str], style: str, ignore_case: bool) -> Column:
    """False only where none of the keywords can match: a word style keyword needs its first
    word in the text, a noise tolerant one its word characters in a row once noise is gone."""
    if style == "auto" and not any("\u4e00" <= c <= "\u9fff" for k in keywords for c in k):
        first = [F.lit(k.split()[0]) for k in keywords]
        return contains_any(fold_case(text), [fold_case(f) for f in first]) if ignore_case else contains_any(text, first)
    return contains_any(folded(text), [folded(F.lit(k)) for k in keywords])
