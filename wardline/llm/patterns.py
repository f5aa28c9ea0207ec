"""Where a pattern matches, as Spark expressions: spans in code points, without user functions.

``split`` and ``regexp_extract_all`` run the same leftmost non-overlapping search, so the
pieces between matches and the matches interleave to the whole text, and running lengths
are the positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"
#: Everything that separates words: blank, tab, newline, vertical tab, form feed, carriage return.
BLANKS = r"[ \t-\r]+"


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of every match; empty for null texts. ``pattern`` must
    not match the empty string."""
    pieces = F.arrays_zip(
        F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    )

    def step(acc: Column, piece: Column) -> Column:
        start = acc["pos"] + F.char_length(piece["gap"])
        end = start + F.char_length(piece["match"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["match"].alias("match"))
        return F.when(
            piece["match"].isNotNull(),
            F.struct(end.alias("pos"), F.array_append(acc["found"], span).alias("found")),
        ).otherwise(acc)

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("found"))
    found = F.aggregate(pieces, begin, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def named(found: Column, kind: str, rank: int) -> Column:
    """Spans with their kind and its place in the list of kinds, ready for sorting."""
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def listed(found: Column) -> Column:
    """Named spans in their array's order as ``kind:start:end`` joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")
