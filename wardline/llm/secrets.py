"""Secret scans with multipart credential linking.

Strong parts - assigned secrets, access identifiers, long hexadecimal strings - are always
reported. Weak candidates - account names, bearer tokens, endpoints - are reported only
where a part of another role, strong or weak, has at most ``SCOPE`` code points between its
end and their start or the other way round.

The linking is an interval join of exploded parts: all parts stand in the bins of scope width
that they touch, reduced to the outermost positions of each (row, bin, role), so a text full
of secrets adds a bounded number of rows per bin and no pairs are made.

Null texts count as empty. Every input row has its own result, repeated or null ids
included: rows are told apart by a number written down with the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.patterns import SPAN, listed, named, spans
from wardline.session import materialise

SCOPE = 200
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: kind -> (pattern, role, strong); in the order in which kinds are listed.
KINDS = {
    "assign": (ASSIGN, "secret", True),
    "access": (r"AKIA[A-Z0-9]{12,}", "id", True),
    "hex": (r"[0-9a-f]{32,}", "secret", True),
    "account": (
        r"""([Uu]ser|[Uu]sername|[Ll]ogin|[Aa]ccount|[Cc]lient_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
        "id",
        False,
    ),
    "bearer": (r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{16,}", "secret", False),
    "endpoint": (r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", "endpoint", False),
}
BASE = [k for k, (_, _, strong) in KINDS.items() if strong]
WEAK = [k for k, (_, _, strong) in KINDS.items() if not strong]
NAMED = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _parts(text, kind: str):
    found = spans(text, KINDS[kind][0])
    if kind == "assign":
        found = F.filter(found, lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8)
    return named(found, kind, list(KINDS).index(kind))


def _role(kind):
    out = F.lit(None).cast("string")
    for k, (_, role, _) in KINDS.items():
        out = F.when(kind == k, F.lit(role)).otherwise(out)
    return out


def linked_candidates(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(_row, linked)``: per row the weak spans with a part of another role at most ``scope``
    code points away, from the end of the one to the start of the other.

    ``parts`` has ``_row``, ``_base`` and ``_weak`` (arrays of named spans).
    """
    bins = lambda c, wide: F.sequence(
        F.floor((F.col(f"{c}.start") - wide) / scope), F.floor((F.col(f"{c}.end") + wide) / scope)
    )
    one = lambda c, wide: (
        parts.filter(F.size("_weak") > 0)
        .select("_row", F.explode(c).alias("p"))
        .select("_row", "p", _role(F.col("p.kind")).alias("role"), F.explode(bins("p", wide)).alias("at"))
    )
    others = (
        one(F.concat("_base", "_weak"), 0)
        .groupBy("_row", F.col("role").alias("other"), "at")
        .agg(F.min("p.start").alias("first"), F.max("p.end").alias("last"))
    )
    # outermost positions of two parts never enclose a weak span's surroundings: these are wider than a bin
    near = (
        (F.col("other") != F.col("role"))
        & (F.col("first") <= F.col("p.end") + scope)
        & (F.col("last") >= F.col("p.start") - scope)
    )
    hits = one("_weak", scope).join(others, ["_row", "at"]).filter(near).select("_row", "p").distinct()
    return hits.groupBy("_row").agg(F.collect_list("p").cast(NAMED).alias("linked"))


def scan_secrets(docs: DataFrame, text: str = "text", keep_text: bool = True, scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans``: arrays of (start, rank, end, kind)
    sorted by start, then kind. ``keep_text=False`` leaves the text out of the result.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    gather = lambda kinds: F.concat(*[_parts(source, k) for k in kinds])
    found = docs.withColumns({"_base": F.array_sort(gather(BASE)), "_weak": gather(WEAK)})
    found = found.withColumn("_row", F.monotonically_increasing_id())
    parts = materialise(found if keep_text else found.drop(text), "secrets")
    links = linked_candidates(parts.select("_row", "_base", "_weak"), scope)
    bare = parts.filter(F.size("_weak") == 0).withColumn("linked", F.array().cast(NAMED))
    some = parts.filter(F.size("_weak") > 0).join(links, "_row", "left").select(*bare.columns)
    joined = bare.unionByName(some)
    every = F.array_sort(F.concat("_base", F.coalesce("linked", F.array().cast(NAMED))))
    return joined.withColumns({"base_spans": F.col("_base"), "secret_spans": every}).drop(
        "_base", "_weak", "_row", "linked"
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of scanned rows, next to ``doc_id``."""
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans"),
    )


def redact(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Scanned rows with each run of overlapping or touching spans replaced by ``mark``."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.substr(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = (s["start"] > acc["at"]) | (F.size(acc["out"]) == 0)
        more = F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col(text), acc["at"] + 1))
    clean = F.when(F.size("secret_spans") == 0, F.col(text)).otherwise(
        F.aggregate("secret_spans", begin, step, done)
    )
    return found.withColumn(text, clean)


__all__ = ["SPAN", "digests", "linked_candidates", "redact", "scan_secrets"]
