"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` names a measure and its bounds; ``quality_rules`` turns the table into columns,
all in one projection of built-in functions. Null texts have no words and fail. A row's
verdict depends on that row alone, so repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.patterns import BLANKS

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the languages served, lower case.
STOP_WORDS = sorted(
    set(
        "the of and to in is that for it was on with as by at from this be are or an a "
        "der die das und ist nicht von zu den mit sich auf im ein eine dem als auch es für "
        "le la les de des et est un une que dans pour pas qui sur au du en "
        "el los las y por con para no se del lo su como".split()
    )
)


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are ratios of whole counts, compared without division by ``compiled``.
RULES = (
    Rule("word_length", "word_chars / n_words", 2, 20),
    Rule("symbols", "n_symbols / n_words", None, 0.3),
    Rule("stop_words", "n_stop_words / n_words", 0.01, None),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
)


RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines",
    "base_failed", "failed_rules", "kept",
)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.array_remove(F.split(text, BLANKS), ""), F.array().cast("array<string>"))


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that the text holds at least twice.

    Hashes only show that no window repeats; where one might, the windows themselves are
    sorted and neighbours compared.
    """
    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    windows = F.transform(
        starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("w"), i.alias("i"))
    )

    def repeated(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["w"] == F.get(s, j)["w"]
        hit = lambda i: F.when(same(i, i - 1) | same(i, i + 1), F.get(s, i)["i"])
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), hit), lambda i: i.isNotNull())

    # the one-element array binds the sorted windows to a name, so they are sorted once
    found = F.get(F.transform(F.array(F.array_sort(windows)), repeated), F.lit(0))
    covered = F.aggregate(
        F.array_sort(found),
        F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    once = F.get(
        F.transform(F.array(hashes), lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)
    )
    return F.when((F.size(words) < width) | once, F.lit(0)).otherwise(covered).cast("bigint")


def compiled(rules=RULES) -> tuple[Column, Column]:
    """(all rules hold, names of the rules that fail) over the count columns."""

    def holds(rule: Rule) -> Column:
        over, under = (F.col(x.strip()) for x in rule.measure.split("/"))
        ok = F.lit(True)
        if rule.low is not None:
            ok = ok & (over >= under * F.lit(float(rule.low)))
        if rule.high is not None:
            ok = ok & (over <= under * F.lit(float(rule.high)))
        return ok

    checks = [(r.name, holds(r)) for r in rules]
    passed = F.lit(True)
    for _, ok in checks:
        passed = passed & ok
    return passed, F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in checks])


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed_rules`` and ``kept``.

    Columns of ``docs`` that bear a result's name are replaced by the result.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(source, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def measured(words: Column) -> Column:
        stop = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(source, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            repeated_window_words(words).alias("n_repeat_words"),
            F.size(stop).cast("bigint").alias("n_stop_words"),
        )

    def counted_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        )

    # ``transform`` binds words and lines to names; the one-row generators keep later filters from
    # being pushed below, where they would compute the counts again
    counted = docs.drop(*[c for c in docs.columns if c in RESULTS])
    counted = counted.select("*", F.inline(F.transform(F.array(words_of(source)), measured)))
    counted = counted.select("*", F.inline(F.transform(F.array(lines), counted_lines)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passed, names = compiled(rules)
    return counted.withColumns({"base_failed": failed, "failed_rules": names, "kept": ~failed & passed})
