"""Keyword and category matching.

No text is compared with every keyword of a long list. Three exact ways, by list size:

* a handful of keywords is tested in the row with constant patterns;
* up to a checked number of keywords go to the tasks as one search automaton, which finds
  the keywords contained in a text in a single pass, also within the row;
* beyond that - or without the automaton library - each keyword is filed under one *anchor*
  that any text it matches must contain, texts are exploded to their distinct anchors, and
  the two meet in an equi-join. Of the anchors it could have, a keyword takes the one that the
  fewest texts of a bounded sample contain; anchors that are frequent even so are split, their
  texts dealt over as many parts as their share of the sample asks for.

The last two yield candidates, which the keyword's pattern then verifies - unless the candidate
settles it: a keyword of one word matches the texts that have it as a token, and one of word
characters, noise and case aside, those whose folded form contains it. Either way a
(text, keyword) pair arises once and needs no de-duplication. A keyword that a token settles has
the token itself as its anchor, so its hits come from narrow rows and never meet the text again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.patterns import fold_case, folded, keyword_pattern, may_match, uses_characters
from wardline.functions.rows import explode_values
from wardline.functions.text import NON_WORD, WORD, tokens
from wardline.session import broadcast_within, is_small, materialise

try:
    import ahocorasick
except ImportError:  # the anchor join takes over
    ahocorasick = None

INLINE_LIMIT = 24
BROADCAST_KEYWORDS = 200_000
GRAM = 4
#: Texts whose anchors are counted to choose each keyword's, and parts of an anchor that all have.
SKETCH_TEXTS = 2_000
HOT_PARTS = 64
#: Texts of a batch that are Python objects at the same time.
TEXTS_AT_ONCE = 128


def keyword_frame(spark: SparkSession, keywords: Sequence[str], list_name: str = "keywords") -> DataFrame:
    return spark.createDataFrame(
        [(list_name, k) for k in dict.fromkeys(keywords)], "list_name string, keyword string"
    )


def compile_keywords(keywords: DataFrame, style: str = "auto", ignore_case: bool = False) -> DataFrame:
    """Distinct keywords with pattern, folded core and anchor; blank ones are dropped."""
    k = F.col("keyword")
    core = folded(k)
    by_characters = uses_characters(k, style)
    gram = F.least(F.length(core), F.lit(GRAM))
    starts = F.sequence(F.lit(1), F.length(core) - gram + 1)
    anchors = (
        F.when(F.length(core) == 0, F.array(F.concat(F.lit("s:"), F.substring(F.regexp_replace(k, r"^\s+", ""), 1, 1))))
        .when(by_characters, F.transform(starts, lambda i: F.concat(F.lit("g:"), F.substring(core, i, gram))))
        .otherwise(F.transform(tokens(k), lambda t: F.concat(F.lit("w:"), fold_case(t))))
    )
    one_word = F.regexp_like(k, F.lit(f"^{WORD}+$"))
    same_length = F.length(core) == F.length(k)  # else a character of it folds to several
    settled = F.when(one_word & same_length & by_characters & F.lit(ignore_case), "folded").when(
        one_word & ~by_characters & F.lit(not ignore_case), "token"
    )
    return (
        keywords.where(k.isNotNull())
        .dropDuplicates([c for c in keywords.columns if c != "list_name"])
        .withColumn("pattern", keyword_pattern(k, style, ignore_case))
        .where(F.col("pattern").isNotNull())
        .withColumns({"core": core, "settled": settled})
        .withColumn("anchors", F.when(F.col("settled") == "token", F.array(F.concat(F.lit("t:"), k))).otherwise(F.array_distinct(anchors)))
    )


def _anchor_kinds(compiled: DataFrame) -> list[tuple[str, int]]:
    """Which kinds of anchor the list uses - at most two plus one per gram length."""
    first = F.get("anchors", F.lit(0))
    kind = F.left(first, F.lit(1))
    size = F.when(kind == "g", F.length(first) - 2).otherwise(0)
    return sorted((r[0], r[1]) for r in compiled.select(kind, size).distinct().collect())


def text_anchors(text: Column, folded_text: Column, kinds: Sequence[tuple[str, int]]) -> Column:
    """Distinct anchors of a text, of the given kinds only."""

    def tagged(tag: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.concat(F.lit(tag), v))

    parts = []
    for kind, size in kinds:
        if kind == "t":
            parts.append(tagged("t:", tokens(text)))
        elif kind == "w":
            parts.append(tagged("w:", F.transform(tokens(text), fold_case)))
        elif kind == "s":
            parts.append(tagged("s:", F.regexp_extract_all(text, F.lit(f"({NON_WORD})"), F.lit(1))))
        else:  # a look-ahead finds every overlapping gram in one pass
            parts.append(tagged("g:", F.regexp_extract_all(folded_text, F.lit(f"(?=(.{{{size}}}))"), F.lit(1))))
    return F.concat(*parts)


def _candidates(rows: Sequence) -> Callable[[Column, Column, Column], Column]:
    """UDF over folded texts, whether folding kept their length, and their tokens: (keyword, pattern)
    of the keywords that the text may match, without a pattern where it is certain. Keywords
    of symbols only have no core to look for and always are candidates."""
    words = {r["keyword"] for r in rows if r["settled"] == "token"}
    by_core: dict[str, list] = {}
    for r in rows:
        if r["settled"] != "token":
            open_one = {"keyword": r["keyword"], "pattern": r["pattern"]}
            sure = {"keyword": r["keyword"], "pattern": None} if r["settled"] else open_one
            by_core.setdefault(r["core"], []).append((open_one, sure))
    always = [c for c, _ in by_core.pop("", [])]

    candidate = pa.struct([("keyword", pa.string()), ("pattern", pa.string())])

    @F.arrow_udf("array<struct<keyword:string,pattern:string>>")
    def find(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        search = ahocorasick.Automaton()
        for core in by_core:
            search.add_word(core, core)
        if by_core:
            search.make_automaton()
        for texts, same_length, tokens_of in batches:
            found = []
            for low in range(0, len(texts), TEXTS_AT_ONCE):  # few texts at a time leave Arrow
                part = [c.slice(low, TEXTS_AT_ONCE).to_pylist() for c in (texts, same_length, tokens_of)]
                rows = []
                for text, same, own in zip(*part, strict=True):
                    cores = {core for _, core in search.iter(text)} if by_core and text else ()
                    of_cores = [c[1 if same else 0] for core in sorted(cores) for c in by_core[core]]
                    rows.append(always + of_cores + [{"keyword": w, "pattern": None} for w in sorted(words.intersection(own))])
                found.append(pa.array(rows, pa.list_(candidate)))
            yield pa.concat_arrays(found) if found else pa.array([], pa.list_(candidate))

    return find


def _verified(text: str, candidates: str) -> Column:
    sure = lambda c: c["pattern"].isNull() | F.regexp_like(F.col(text), c["pattern"])
    return F.transform(F.filter(candidates, sure), lambda c: c["keyword"])


def _with_matches(
    df: DataFrame, rows: Sequence, text: str, out: str, style: str, ignore_case: bool, inline_limit: int
) -> DataFrame:
    """Add the matching keywords as an array, without leaving the row."""
    none = F.array().cast("array<string>")
    if not rows:
        return df.withColumn(out, none)
    if len(rows) <= inline_limit:
        return df.withColumn(out, matched_column(F.col(text), [r["keyword"] for r in rows], style, ignore_case))
    bare = F.regexp_replace(F.col(text), f"{NON_WORD}+", "")
    # where folding made a character several (sharp s), one of them alone is no match
    same_length = F.coalesce(F.length(fold_case(bare)) == F.length(bare), F.lit(False))
    own = tokens(F.col(text)) if any(r["settled"] == "token" for r in rows) else none
    find = _candidates(rows)
    held = df.withColumn("_candidates", find(F.coalesce(fold_case(bare), F.lit("")), same_length, F.coalesce(own, none)))
    return held.withColumn(out, F.coalesce(_verified(text, "_candidates"), none)).drop("_candidates")


def _filed(compiled: DataFrame, body: DataFrame, anchors: Column) -> DataFrame:
    """``compiled`` with ``anchor``, the rarest a keyword could have, and ``parts``, into how many
    its texts are dealt."""
    sample = body.limit(SKETCH_TEXTS)
    n = max(1, sample.count())
    could = compiled.select("keyword", F.explode("anchors").alias("anchor"))
    seen = explode_values(sample, [], anchors, "anchor").join(could.select("anchor").distinct(), "anchor", "left_semi")
    could = could.join(seen.groupBy("anchor").agg(F.count("*").alias("texts")), "anchor", "left")
    rarest = could.groupBy("keyword").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "anchor")).alias("_best"))
    parts = F.greatest(F.ceil(F.col("_best.texts") * HOT_PARTS / n), F.lit(1)).cast("int")
    return compiled.join(rarest, "keyword").withColumns({"anchor": F.col("_best.anchor"), "parts": parts}).drop("_best", "anchors")


def _by_anchors(body: DataFrame, compiled: DataFrame, ids: Sequence[str], small: bool) -> DataFrame:
    """Hits by anchor. Keywords that a token settles are found on narrow rows alone; only for the
    others candidates meet the text again."""
    found = []
    for sure in (True, False):
        some = compiled.where((F.coalesce("settled", F.lit("")) == "token") == sure)
        kinds = _anchor_kinds(some)
        if kinds:
            found.append(_anchored(body, some, ids, text_anchors(F.col("_text"), F.col("_folded"), kinds), small, sure))
    if not found:
        found = [_anchored(body, compiled, ids, F.array().cast("array<string>"), small, True)]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _anchored(body: DataFrame, compiled: DataFrame, ids: Sequence[str], anchors: Column, small: bool, sure: bool) -> DataFrame:
    filed = _filed(compiled, body, anchors)
    texts = [] if sure else ["_text", "_folded"]
    if small:
        hits = explode_values(body, [*ids, *texts], anchors, "anchor").join(F.broadcast(filed), "anchor")
    else:  # shuffle narrow rows only, fetch the text again for the candidates
        filed = materialise(filed, "filed")
        hot = filed.where("parts > 1").select("anchor", F.col("parts").alias("_parts")).distinct()
        rows = explode_values(body, ids, anchors, "anchor").join(broadcast_within(hot, BROADCAST_KEYWORDS), "anchor", "left")
        dealt = F.pmod(F.xxhash64(*ids), F.coalesce("_parts", F.lit(1))).cast("int")
        every = filed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        hits = rows.withColumn("_part", dealt).drop("_parts").join(every, ["anchor", "_part"]).join(body.select(*ids, *texts), list(ids))
    if not sure:
        hits = hits.where(F.contains(F.col("_folded"), F.col("core")) & F.expr("_text rlike pattern"))
    return hits.drop("_text", "_folded")


def _rows_within(compiled: DataFrame, limit: int) -> list | None:
    """The compiled keywords, unless there are more than ``limit``."""
    rows = compiled.select("keyword", "pattern", "core", "settled").distinct().limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def keyword_hits(
    texts: DataFrame,
    keywords: DataFrame,
    ids: Sequence[str],
    text: str = "text",
    style: str = "auto",
    ignore_case: bool = False,
    inline_limit: int = INLINE_LIMIT,
    broadcast_rows: int = BROADCAST_KEYWORDS,
    use_automaton: bool = ahocorasick is not None,
) -> DataFrame:
    """One row per (text, matching keyword), with any further columns of ``keywords``."""
    compiled = compile_keywords(keywords, style, ignore_case)
    extra = [c for c in keywords.columns if c not in ("keyword", "list_name")]
    out = [*ids, "keyword", *extra]
    rows = _rows_within(compiled, broadcast_rows if use_automaton else inline_limit)
    if rows is not None:
        body = texts.select(*ids, F.col(text).alias("_text"))
        hits = explode_values(_with_matches(body, rows, "_text", "_found", style, ignore_case, inline_limit), ids, F.col("_found"), "keyword")
        if extra:
            hits = hits.join(broadcast_within(compiled.select("keyword", *extra), BROADCAST_KEYWORDS), "keyword")
        return hits.select(*out)
    body = texts.select(*ids, F.col(text).alias("_text"), folded(F.col(text)).alias("_folded"))
    return _by_anchors(body, compiled, ids, is_small(compiled, broadcast_rows)).select(*out)


def any_pattern(keywords: Sequence[str], style: str, ignore_case: bool) -> Column:
    """One constant alternation of all patterns."""
    parts = [
        F.concat(F.lit("(?:"), keyword_pattern(F.lit(k), style, ignore_case), F.lit(")")) for k in keywords
    ]
    return F.concat_ws("|", *parts)


def _present(keywords: Sequence[str]) -> list[str]:
    return sorted({k for k in keywords if k and k.strip()})


def matched_column(text: Column, keywords: Sequence[str], style: str = "auto", ignore_case: bool = False) -> Column:
    """Sorted matching keywords of a short list, as a row-local expression."""
    kws = _present(keywords)
    none = F.array().cast("array<string>")
    if not kws:
        return none
    each = [
        F.when(F.regexp_like(text, keyword_pattern(F.lit(k), style, ignore_case)), F.lit(k)) for k in kws
    ]
    return F.when(may_match(text, kws, style, ignore_case), F.array_compact(F.array(*each))).otherwise(none)


def matched_categories_column(text: Column, blacklist: dict[str, Sequence[str]], ignore_case: bool = True) -> Column:
    """Sorted categories with at least one matching sub-keyword, for a short blacklist."""
    cats = {c: _present(subs) for c, subs in sorted(blacklist.items())}
    each = [
        F.when(F.regexp_like(text, any_pattern(subs, "characters", ignore_case)), F.lit(c))
        for c, subs in cats.items()
        if subs
    ]
    none = F.array().cast("array<string>")
    if not each:
        return none
    every = [k for subs in cats.values() for k in subs]
    return F.when(may_match(text, every, "characters", ignore_case), F.array_compact(F.array(*each))).otherwise(none)


def attach_keywords(
    df: DataFrame,
    keywords: Sequence[str] | DataFrame,
    ids: Sequence[str],
    text: str,
    out: str,
    style: str = "auto",
    ignore_case: bool = False,
    broadcast_rows: int = BROADCAST_KEYWORDS,
    use_automaton: bool = ahocorasick is not None,
) -> DataFrame:
    """Add the sorted array of matching keywords; row-local but for very long lists."""
    if not isinstance(keywords, DataFrame):
        if len(keywords) <= INLINE_LIMIT:
            return df.withColumn(out, matched_column(F.col(text), keywords, style, ignore_case))
        keywords = keyword_frame(df.sparkSession, keywords)
    words = keywords.select("keyword")
    rows = _rows_within(compile_keywords(words, style, ignore_case), broadcast_rows) if use_automaton else None
    if rows is not None:
        return _with_matches(df, rows, text, out, style, ignore_case, INLINE_LIMIT).withColumn(out, F.array_sort(out))
    hits = keyword_hits(df, words, ids, text, style, ignore_case, broadcast_rows=broadcast_rows, use_automaton=False)
    per_text = hits.groupBy(*ids).agg(F.array_sort(F.collect_set("keyword")).alias(out))
    return df.join(per_text, list(ids), "left").withColumn(
        out, F.coalesce(out, F.array().cast("array<string>"))
    )


def category_hits(
    texts: DataFrame, blacklist: DataFrame, ids: Sequence[str], text: str = "text", ignore_case: bool = True
) -> DataFrame:
    """Distinct (text, category) rows for a blacklist table (category, sub_keyword)."""
    subs = blacklist.select(F.col("category"), F.col("sub_keyword").alias("keyword"))
    hits = keyword_hits(texts, subs, ids, text, "characters", ignore_case)
    return hits.select(*ids, "category").dropDuplicates()
