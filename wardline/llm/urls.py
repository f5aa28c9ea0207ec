"""URL filter: path rules decide what they fit, gradient-boosted trees on lexical features the rest.

A rule is a verdict, a host and the beginning of a path; it fits its host and all subdomains, and
the longest that fits wins (of equally long ones, the first listed). The URLs that rules fit are
the labelled ones: trees are trained on them and judge all others. Features are lengths, depth,
digit ratio, entropy, parameter counts and statistics of suffixes - the share of blocked among
labelled URLs of the same top-level label, domain, file ending and directory. For a URL that trees
are fitted to they are taken of the other ``FOLDS - 1`` folds of labelled URLs, so they tell the
trees nothing of its own label.

Statistics cover all labelled URLs and every key of them. Keys with one in ``FREQUENT`` of them or
more, so at most ``FREQUENT`` of each kind, are broadcast; URLs with any other key are joined
with theirs, dealt over ``SALTS`` tasks a key. Trees are fitted to the
``FIT_ROWS`` labelled URLs of smallest digest, in one task, so results repeat exactly.

A URL that is null or has no ``://`` has an empty host and path and fits no rule; like an empty
one it is judged by its features. Without labelled URLs, or with one label only, the rest get
that label, or ``allow``. Rows that repeat are judged alike; columns named as a result are
replaced, all others stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.store import written

RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
#: Labelled URLs that the trees are fitted to, at most.
FIT_ROWS = 10_000
#: Keys with a smaller share of the labelled URLs are joined, others broadcast.
FREQUENT = 4_096
SALTS = 16
FOLDS = 5
#: Labelled URLs of average label that each statistic is mixed with.
SMOOTHING = 4.0
TREES, DEPTH, BINS, STEP, SEED = 20, 4, 64, 0.2, 17
RESULTS = ("host", "path", "rule", "verdict", "score")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matched(rules, of: int) -> Column:
    """The rule (``of`` 1) or the verdict (0) of the longest rule that fits ``host`` and ``path``."""
    longest = sorted(rules, key=lambda r: -len(r[1]))
    cases = F.lit(None).cast("string")
    for rule in reversed(longest):
        host, slash, path = rule[1].partition("/")
        named = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        cases = F.when(named & F.col("path").startswith(slash + path), F.lit(rule[of])).otherwise(cases)
    return cases


def entropy(text: Column) -> Column:
    """Bits a character, from the sorted characters' runs."""
    start = F.struct(F.lit("").alias("of"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    bits = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(state, c):
        same = state["of"] == c
        return F.struct(
            c.alias("of"), F.when(same, state["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, state["sum"]).otherwise(state["sum"] + bits(state["run"])).alias("sum"),
        )

    size = F.length(text)
    runs = lambda state: F.log2(size) - (state["sum"] + bits(state["run"])) / size
    return F.when(size > 0, F.aggregate(F.array_sort(F.split(text, "")), start, step, runs)).otherwise(F.lit(0.0))


def lexical() -> dict[str, Column]:
    """Features of the columns ``url``, ``host`` and ``path``; the URL is never null here."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    size = F.length(url)
    share = lambda pattern: F.regexp_count(url, F.lit(pattern)) / F.greatest(size, F.lit(1))
    found = {
        "length": size,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "labels": F.regexp_count(host, F.lit(r"[^.]+")),
        "depth": F.regexp_count(path, F.lit("/")),
        "parameters": F.regexp_count(url, F.lit(r"[?&][^?&#=]*=")),
        "fragment": url.contains("#"),
        "encrypted": F.substring(url, 1, 8) == "https://",
        "digits": share("[0-9]"),
        "host_digits": F.regexp_count(host, F.lit("[0-9]")),
        "last_digits": F.length(F.regexp_extract(path, r"([0-9]*)(\.[A-Za-z0-9]+)?\z", 1)),
        "symbols": share("[^A-Za-z0-9]"),
        "capitals": share("[A-Z]"),
        "entropy": entropy(url),
    }
    return {k: c.cast("double") for k, c in found.items()}


def keys() -> dict[str, Column]:
    """What statistics are kept of."""
    return {
        "top": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
        "ending": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})\z", 1),
        "directory": F.regexp_extract("path", r"\A/([^/]*)", 1),
    }


def fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame) -> tuple[DataFrame, float]:
    """``(kind, key, fold, n, blocked, common)`` of all keys - each fold's sums, and those of all
    under the fold null; ``common`` marks the keys to broadcast - and the blocked share of all
    labelled URLs."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys().items()]))
    sums = [F.sum(c).alias(c) for c in ("n", "blocked")]
    folds = labelled.select(each.alias("of"), fold().alias("fold"), F.lit(1).alias("n"), "blocked")
    folds = written(folds.groupBy("of.kind", "of.key", "fold").agg(*sums), "suffixes")
    total, blocked = folds.filter(F.col("kind") == next(iter(keys()))).agg(*sums).first()
    whole = folds.groupBy("kind", "key").agg(*sums)
    common = F.col("n") * FREQUENT >= (total or 0)
    parts = folds.join(whole.select("kind", "key", common.alias("common")), ["kind", "key"])
    every = whole.select("kind", "key", F.lit(None).cast("int").alias("fold"), "n", "blocked", common.alias("common"))
    return written(every.unionByName(parts), "statistics"), blocked / total if total else 0.0


def with_statistics(urls: DataFrame, statistics: DataFrame, average: float, own: bool) -> DataFrame:
    """``urls`` with a column for each kind of key. ``own``: the rows are part of the statistics,
    which then are taken of the other folds."""
    for kind, key in keys().items():
        mine = statistics.filter(F.col("kind") == kind)
        # a row a key: its sums, and those of each fold
        per_key = mine.groupBy("key", "common").agg(
            F.sum(F.when(F.col("fold").isNull(), F.col("n"))).alias("n"),
            F.sum(F.when(F.col("fold").isNull(), F.col("blocked"))).alias("blocked"),
            *[F.sum(F.when(F.col("fold") == i, F.col(c))).alias(f"{c}_{i}") for i in range(FOLDS) for c in ("n", "blocked")],
        )
        values = F.struct("n", "blocked", *[f"{c}_{i}" for i in range(FOLDS) for c in ("n", "blocked")])
        frequent = per_key.filter("common").select(F.col("key").alias("of"), values.alias("of_common"))
        rare = per_key.filter("NOT common").select(
            F.col("key").alias("in"), values.alias("of_rare"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("in_salt")
        )
        joined = urls.join(F.broadcast(frequent), key == F.col("of"), "left")
        # URLs that have their values already find no match, so they may go anywhere
        spread = F.when(F.col("of").isNull(), F.pmod(F.xxhash64("url"), F.lit(SALTS))).otherwise(SALTS + F.abs(F.xxhash64("url") % (1 << 40)))
        joined = joined.withColumns({"_key": key, "_salt": spread.cast("bigint")})
        joined = joined.join(rare, (F.col("_key") == F.col("in")) & (F.col("_salt") == F.col("in_salt")), "left")
        found = F.coalesce("of_common", "of_rare")
        n, blocked = found["n"], found["blocked"]
        if own:
            of_fold = lambda c: F.coalesce(
                *[F.when(fold() == i, found[f"{c}_{i}"]) for i in range(FOLDS)], F.lit(0)
            )
            n, blocked = n - of_fold("n"), blocked - of_fold("blocked")
        share = (blocked + SMOOTHING * average) / (n + SMOOTHING)
        urls = joined.select(*urls.columns, F.coalesce(share, F.lit(average)).alias(kind))
    return urls


def assembled(urls: DataFrame) -> DataFrame:
    features = lexical()
    plain = urls.withColumns({f"x_{k}": c for k, c in features.items()})
    columns = [*[f"x_{k}" for k in features], *keys()]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(plain).drop(*columns)


def fitted(labelled: DataFrame, statistics: DataFrame, average: float, rows: int = FIT_ROWS):
    """Trees fitted to a bounded sample of ``labelled``, or the only label that it has."""
    sample = labelled.withColumn("digest", F.xxhash64("url")).orderBy("digest", "url").limit(rows)
    rising = assembled(with_statistics(sample, statistics, average, True)).select(
        "digest", "features", F.col("blocked").cast("double").alias("label")
    )
    # bounded rows in one sorted partition: sums, and so the trees, come out the same each time
    chosen = written(rising.coalesce(1).sortWithinPartitions("digest", "label"), "labelled")
    labels = [r[0] for r in chosen.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=STEP, seed=SEED)
    return trees.fit(chosen.coalesce(1))


def scored(urls: DataFrame, model, statistics: DataFrame, average: float) -> DataFrame:
    """``urls`` with ``score``, the model's probability of ``block``."""
    if isinstance(model, float):
        return urls.withColumn("score", F.lit(model))
    judged = model.transform(assembled(with_statistics(urls, statistics, average, False)))
    return judged.withColumn("score", vector_to_array("probability")[1])


def url_filter(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """All rows and columns of ``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score``."""
    given = F.coalesce(F.col(url), F.lit(""))
    placed = pages.select(F.struct("*").alias("row"), given.alias("url"), host_of(given).alias("host"), path_of(given).alias("path"))
    ruled = placed.withColumns({"rule": matched(rules, 1), "ruled": matched(rules, 0)})
    labelled = ruled.filter("rule IS NOT NULL").select(
        "url", "host", "path", (F.col("ruled") == "block").cast("bigint").alias("blocked")
    )
    statistics, average = suffix_statistics(labelled)
    model = fitted(labelled, statistics, average)
    judged = scored(ruled, model, statistics, average)
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in RESULTS]
    return judged.select(*kept, "host", "path", "rule", verdict.alias("verdict"), "score")
