"""Request validation and data-quality roll-ups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import RequestLimits


def violations(limits: RequestLimits = RequestLimits(), columns: list[str] | None = None) -> Column:
    """Names of the request fields out of range; missing optional fields are fine, but a
    session is required when context is switched on."""
    checks = []
    for name, (low, high) in limits.ranges.items():
        if columns is not None and name not in columns:
            continue
        c = F.col(name)
        bad = F.isnan(c.cast("double"))
        if low is not None:
            bad = bad | (c < low)
        if high is not None:
            bad = bad | (c > high)
        checks.append(F.when(bad, F.lit(name)))
    no_session = F.coalesce(F.col("session_id").cast("string"), F.lit("")) == ""
    checks.append(F.when(F.coalesce("enable_context", F.lit(False)) & no_session, F.lit("session_id")))
    return F.array_compact(F.array(*checks))


def split_valid(requests: DataFrame, limits: RequestLimits = RequestLimits()) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) requests; the rejected ones say why."""
    checked = requests.withColumn("violations", violations(limits, requests.columns))
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)


def check(df: DataFrame, name: str, bad: Column | None = None, severity: str = "error") -> DataFrame:
    """One row (name, n_rows, n_bad, status): empty data is a warning, bad rows have ``severity``."""
    failing = F.count_if(F.coalesce(bad, F.lit(False))) if bad is not None else F.lit(0).cast("bigint")
    counted = df.agg(F.count("*").alias("n_rows"), failing.alias("n_bad"))
    status = F.when(F.col("n_bad") > 0, severity).when(F.col("n_rows") == 0, "warning").otherwise("pass")
    return counted.select(F.lit(name).alias("name"), "n_rows", "n_bad", status.alias("status"))


def duplicates(df: DataFrame, key: list[str], name: str, severity: str = "warning") -> DataFrame:
    """One row: how many keys occur more than once."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return check(per_key, name, F.col("_n") > 1, severity)


@dataclass(frozen=True)
class Constraint:
    """A condition that marks a bad row, as SQL; unknown counts as good."""

    name: str
    bad: str
    severity: str = "error"


def source_checks(df: DataFrame, source: str, constraints: list[Constraint], key: list[str] | None = None) -> DataFrame:
    """(source, name, n_rows, n_bad, status) for every constraint, from one aggregation over the
    source. ``key``: also how many keys occur more than once; rows are then summed up by key first,
    within each task before they are shuffled, so a key of any share of the rows does no harm."""
    bad = {f"_bad_{i}": F.count_if(F.coalesce(F.expr(c.bad), F.lit(False))) for i, c in enumerate(constraints)}
    sums = [F.count("*").alias("_rows"), *[c.alias(n) for n, c in bad.items()]]
    if key:
        per_key = df.groupBy(*key).agg(*sums)
        again = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("_rows", *bad)]
        total = per_key.agg(*again, F.count_if(F.col("_rows") > 1).alias("_repeated"))
        constraints = [*constraints, Constraint("repeated", "false", "warning")]
    else:
        total = df.agg(*sums)
    counts = [*bad, "_repeated"] if key else list(bad)
    rows = F.array(*[
        F.struct(F.lit(c.name).alias("name"), F.col("_rows").alias("n_rows"), F.col(n).alias("n_bad"), F.lit(c.severity).alias("_severity"))
        for c, n in zip(constraints, counts, strict=True)
    ])
    status = F.when(F.col("n_bad") > 0, F.col("_severity")).when(F.col("n_rows") == 0, "warning").otherwise("pass")
    return total.select(F.inline(rows)).select(F.lit(source).alias("source"), "name", "n_rows", "n_bad", status.alias("status"))


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def quality_summary(checks: DataFrame) -> DataFrame:
    """Counts per status and the worst of them."""
    rank = F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)
    worst = F.max(rank)
    return checks.agg(
        F.count_if(F.col("status") == "pass").alias("n_pass"),
        F.count_if(F.col("status") == "warning").alias("n_warning"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.when(worst == 2, "error").when(worst == 1, "warning").otherwise("pass").alias("overall"),
    )
