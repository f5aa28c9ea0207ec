"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All in Spark expressions on the row itself: no shuffle, so hot sources and repeated rows
change nothing. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.patterns import listed, spans

CONTEXT = 40
REPORTED = 50
#: Patterns in the order in which kinds are listed. Possessive loops and the looks behind change
#: no match; they keep long runs of letters or digits linear and off the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?"
NATIONAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: kind -> (pattern, score in percent of a confirmed span, words nearby that add BONUS)
BONUS = 30
KINDS = {
    "email": (EMAIL, 60, "mail|contact|address|write"),
    "ip": (IP, 50, "ip|host|server|address"),
    "card": (CARD, 70, "card|visa|credit|payment"),
    "phone": (PHONE, 60, "phone|tel|call|mobile|fax"),
    "iban": (IBAN, 70, "iban|account|bank|transfer"),
    "national_id": (NATIONAL, 30, "ssn|social security|tax id|national"),
}
BASE = ["email", "ip", "card", "phone"]


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """True when an account number, its first four signs moved to the end and letters read
    as 10 to 35, leaves 1 on division by 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))

    def step(acc: Column, sign: Column) -> Column:
        value = F.ascii(sign)
        return F.when(value >= 65, (acc * 100 + value - 55) % 97).otherwise((acc * 10 + value - 48) % 97)

    rest = F.aggregate(F.array_remove(F.split(turned, ""), ""), F.lit(0), step)
    return F.char_length(plain).between(15, 34) & (rest == 1)


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
        return F.forall(F.split(match, r"\."), lambda x: x.rlike(part))
    if kind == "card":
        return F.char_length(digits(match)).between(13, 19) & _luhn(digits(match))
    if kind == "phone":
        return F.char_length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def _of_kind(source: Column, kind: str, rank: int) -> Column:
    pattern, score, words = KINDS[kind]

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.lower(F.substr(source, begin + 1, s["start"] - begin)).rlike(words)
        return F.struct(
            F.lit(rank).alias("rank"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            (F.lit(score) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0))).alias("score"),
        )

    valid = F.filter(spans(source, pattern), lambda s: confirmed(kind, s["match"]))
    every = F.transform(valid, scored)
    return every if kind in BASE else F.filter(every, lambda s: s["score"] >= REPORTED)


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_spans``: (start, rank, end, kind, score) sorted by kind, then start.

    Confirmed spans scoring ``REPORTED`` or more are kept; those of the four base kinds
    always are.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    found = []
    for rank, kind in enumerate(KINDS):
        found.append(_of_kind(source, kind, rank))
    # a one-row generator: later filters and projections don't search the text again
    return docs.drop("pii_spans").select("*", F.explode(F.array(F.concat(*found))).alias("pii_spans"))


def digests(found: DataFrame) -> DataFrame:
    number = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(BASE))
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"),
        F.size(F.filter("pii_spans", lambda s: s["score"] >= 90)).cast("bigint").alias("n_confident"),
    )


__all__ = ["digests", "mod97", "personal_data"]
