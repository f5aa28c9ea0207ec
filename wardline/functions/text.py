"""Text scalars: every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes are spelled out because the shorthand ones differ between engines.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # the characters of SPACE
CJK = "[一-鿿]"
TOKEN = f"({WORD}+)"


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (plain ``trim`` only knows the blank)."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def has_cjk(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(CJK)), F.lit(False))


def drop_noise(text: Column) -> Column:
    """Remove the two decoration characters ``*`` and ``#``."""
    return F.translate(text, "*#", "")


def sentences(text: Column, min_length: int = 5) -> Column:
    """Sentences ending at a CJK or Latin full stop, stripped, longer than ``min_length``."""
    parts = F.transform(F.split(drop_noise(text), r"(?<=[。.])"), strip)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda s: F.length(s) > min_length)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def lower_tokens(text: Column) -> Column:
    return tokens(F.lower(text))


def lines(text: Column, min_length: int = 10) -> Column:
    """Stripped lines longer than ``min_length`` characters."""
    parts = F.transform(F.split(strip(text), "\n"), strip)
    return F.filter(parts, lambda s: F.length(s) > min_length)


def character_windows(text: Column, size: int = 512) -> Column:
    """Consecutive pieces of at most ``size`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def window_starts(n: Column, size: int = 510, stride: int = 256) -> Column:
    """Start offsets of overlapping windows over ``n`` tokens; the last one reaches the end."""
    steps = F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(stride)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), steps), lambda i: i * stride)
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def token_windows(toks: Column, size: int = 510, stride: int = 256) -> Column:
    """Texts of the overlapping token windows."""
    starts = window_starts(F.size(toks), size, stride)
    return F.transform(starts, lambda s: F.array_join(F.slice(toks, s + 1, size), " "))


def token_estimate(text: Column) -> Column:
    """Characters when the text holds any CJK, else 1.3 per white-space separated word."""
    words = F.regexp_count(text, F.lit(f"[^\\t-\\r\\x{{1c}}-\\x{{20}}\\x{{85}}\\p{{Z}}]+"))
    return F.when(has_cjk(text), F.length(text)).otherwise(F.floor(words * F.lit(1.3))).cast("bigint")


def drop_leading_pair(text: Column) -> Column:
    """Remove one word character plus one space from the start, then strip."""
    return strip(F.regexp_replace(text, f"^{WORD}{SPACE}", ""))


def fixed_length(toks: Column, length: int = 256, pad: str = "[PAD]") -> Column:
    """Truncate or right-pad a token array to ``length`` entries."""
    padded = F.concat(toks, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(toks), F.lit(0))))
    return F.slice(padded, 1, length)
