"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of five-word shingles; two link when their Jaccard similarity is at
least ``THRESHOLD``. Shingles are ordered by the number of documents that have them. A
document's l-prefix is its first n - ceil(t n) + l shingles in that order: similar documents
share at least l shingles of their l-prefixes. A document starts with l = 1; where the
estimated cost of its candidates (how many documents its prefix shingles meet) is high, the
prefix is lengthened and a partner must share correspondingly more of it before it is
verified. When two documents meet, both sizes are known, which shortens both prefixes, and
what each has alone, the places of the met shingle and a parity bitmap of all shared
shingles bound their similarity.

Shingles of one document alone lead the order and find nobody, so they are never shuffled
as rows (``features``), and a document with more of them than any prefix is long is done.

Shared shingles travel as a few bytes. Different ones may so look equal, which only brings up
more pairs; how many of its own a document loses that way is known and widens all bounds. Of
pairs that pass, the words themselves are compared.

Documents of equal sets (a 128-bit digest of them) form a class that is joined once. Verification
first links documents to hubs - for each, the smallest document that the most of its prefix shingles lead to - and
components of these links; then, of what is left, all pairs of different components that
share enough prefix shingles. A pair inside one component would change nothing, so groups
of thousands of near copies are not expanded.

Null or blank texts have no shingles and link with nothing. Rows that share an id are one
document, with the shingles of all its texts. Rows without an id have a null component. Other
columns play no part; an empty table gives no rows; long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.features import shared_features
from wardline.llm.graph import components
from wardline.llm.store import written
from wardline.llm.words import give_back, shingles

THRESHOLD = 80
WIDTH = 5
LEVELS = (1, 2, 4, 8)
#: Words of the parity bitmap of a document's shared shingles.
BITMAP = 2
#: A prefix is lengthened while its shingles meet more documents than this.
COSTLY = 64


def _overlap(n):
    """ceil(t n): the smallest intersection of similar sets of which one has n members."""
    return F.floor((n * THRESHOLD + 99) / 100)


def shingle_sets(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, alone, lost, sign, sign2, level, tokens)``: set size, the number of shingles that no
    other document has, the level that the document asks for, and the others in joining order -
    rarest first."""
    rows = shared_features(docs, doc, text, shingles)
    alone = (F.col("size") - F.col("lost") - F.size("features")).alias("alone")
    sets = rows.select(
        "doc", F.col("size").alias("n"), alone, "lost", "sign", "sign2", F.col("features").alias("tokens"), "documents"
    )
    reach = F.col("n") - _overlap(F.col("n")) + max(LEVELS)
    near = (F.col("alone") < reach) & (F.size("tokens") > 0)
    kept = F.when(near, F.col("tokens")).otherwise(F.array().cast("array<bigint>"))
    cost = lambda k: F.aggregate(F.slice("documents", 1, _room(k)), F.lit(0).cast("bigint"), lambda a, d: a + d)
    level = F.lit(LEVELS[-1])
    for k in LEVELS[-2::-1]:
        level = F.when(cost(k) <= COSTLY, F.lit(k)).otherwise(level)
    return sets.select("doc", "n", "alone", "lost", "sign", "sign2", F.when(near, level).alias("level"), kept.alias("tokens"))


def profiles(sets: DataFrame) -> DataFrame:
    """``(doc, n, alone, lost, bitmap, level, longest)``: with the shared shingles of the longest prefix."""
    longest = F.slice("tokens", 1, _room(LEVELS[-1]))
    return sets.filter(F.size("tokens") > 0).select("doc", "n", "alone", "lost", bitmap(), "level", longest.alias("longest"))


def _room(level: int):
    """How many shared shingles a prefix of that level has."""
    return F.greatest(F.col("n") - _overlap(F.col("n")) - F.col("alone") + level, F.lit(0)).cast("int")


def prefixes(known: DataFrame) -> DataFrame:
    """``(doc, at, token)``: the shingles of the longest prefixes with their place among the shared
    ones. What belongs to the document stays in ``profiles`` and does not travel with them."""
    return known.select("doc", F.posexplode("longest").alias("at", "token"))


def bitmap():
    """Bits that each shared shingle turns over: bits in which two documents differ are at most
    as many as the shared shingles in which they do."""
    word = (
        "aggregate(tokens, 0L, (s, t) -> s ^ if(pmod(shiftright(t, 46), {n}) = {k}, shiftleft(1L, cast(pmod(shiftright(t, 40), 64) as int)), 0L))"
    )
    return F.array(*[F.expr(word.format(n=BITMAP, k=k)) for k in range(BITMAP)]).alias("bitmap")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that their shared shingles allow to be similar."""
    columns = {"n": "n", "lost": "lost", "t": "tokens"}
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    met = sets.join(ids, "doc", "left_semi")  # most documents are in no pair: theirs need not travel
    side = lambda x: met.select(F.col("doc").alias(x), *[F.col(c).alias(f"{k}_{x}") for k, c in columns.items()])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("t_a", "t_b")) + F.least("lost_a", "lost_b")
    return both.filter(100 * common >= THRESHOLD * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def word_sets(texts) -> set:
    """The shingles of a document's texts as tuples of its words."""
    found = set()
    for text in texts:
        words = (text or "").encode().lower().split()  # bytes: A-Z and the six blanks only
        found.update(zip(*[words[k:] for k in range(WIDTH)], strict=False) if len(words) >= WIDTH else [tuple(words)] if words else [])
    return found


def confirmed(pairs: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Of pairs (a, b) those whose words are similar."""
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    given = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    texts = given.join(ids, "doc", "left_semi").groupBy("doc").agg(F.collect_set("text").alias("texts"))
    side = lambda x: texts.select(F.col("doc").alias(x), F.col("texts").alias(f"texts_{x}"))
    # a hub has many partners: its texts come second, and each partition builds its set once
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def compare(batches):
        import pyarrow as pa

        give_back()
        last, hub = None, set()
        for batch in batches:
            keep = []
            for i, (b, texts_b) in enumerate(zip(batch.column("b").to_pylist(), batch.column("texts_b"), strict=True)):
                if b != last:
                    last, hub = b, word_sets(texts_b.as_py())
                own = word_sets(batch.column("texts_a")[i].as_py())
                common = len(own & hub)
                if 100 * common >= THRESHOLD * (len(own) + len(hub) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            del batch
        hub = None
        give_back(everything=False)

    return both.select("a", "b", "texts_a", "texts_b").mapInArrow(compare, "a bigint, b bigint")


def _needed():
    """The smallest intersection of similar sets of n_a and n_b members."""
    both = F.col("n_a") + F.col("n_b")
    return F.floor((both * THRESHOLD + 99 + THRESHOLD) / (100 + THRESHOLD))


def _differ_little():
    """Whether the documents can have enough in common: they differ in the shingles each has alone
    and at least in as many others as bits of the bitmaps."""
    bits = sum((F.bit_count(F.col("bitmap_a")[k].bitwiseXOR(F.col("bitmap_b")[k])) for k in range(BITMAP)), F.lit(0))
    differ = F.col("alone_a") + F.col("alone_b") + bits
    return F.col("n_a") + F.col("n_b") - differ >= 2 * _needed()


def _may_link():
    """As ``_differ_little``; and in common is at most what lies before the met shingle in the one
    and in the other, and from it on."""
    most = F.least("at_a", "at_b") + F.least(behind("a"), behind("b"))
    return (most >= _needed()) & _differ_little()


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that sizes and bitmaps allow to be similar."""
    columns = ["n", "alone", "bitmap"]
    side = lambda x: known.select(F.col("doc").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_differ_little()).select("a", "b")


def behind(side: str):
    """Shared shingles of a document from the met one on."""
    return F.col(f"n_{side}") - F.col(f"alone_{side}") - F.col(f"at_{side}")


def _asked():
    """How many prefix shingles a pair must share: the level of its document that asks for
    more, but never more than similar sets of their sizes have in common and still show."""
    shown = F.greatest(_needed() - F.col("lost_a") - F.col("lost_b"), F.lit(1))
    return F.least(F.greatest("level_a", "level_b"), shown)


def shared_posts(posts: DataFrame) -> DataFrame:
    """``posts`` of the shingles that several prefixes have, with the smallest document of each."""
    hubs = posts.groupBy("token").agg(F.min("doc").alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return posts.join(hubs, "token")


def hub_pairs(posts: DataFrame) -> DataFrame:
    """For each document one pair: the hub that the most of its prefix shingles name."""
    votes = posts.filter("hub < doc").groupBy("doc", "hub").agg(F.count("*").alias("v"))
    best = votes.groupBy("doc").agg(F.max(F.struct("v", -F.col("hub"))).alias("best"))
    return best.select(F.col("doc").alias("a"), (-F.col("best")["col2"]).alias("b"))


def remaining_pairs(posts: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components that share as many shingles of the pair's prefixes as
    they must. Of two documents, the l-prefix of one is its first n - o + l shingles, where o
    is the intersection that their two sizes need. A pair also goes where what lies behind the
    last shared prefix shingle is too little to reach o."""
    placed = posts.join(labels, F.col("doc") == F.col("node"), "left").select(
        "token", "doc", "at", F.coalesce("component", "doc").alias("component")
    )
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_tokens = mixed.filter("lo < hi").select("token")
    columns = ["doc", "n", "alone", "lost", "bitmap", "level", "at", "component"]
    open_posts = written(placed.join(open_tokens, "token").join(known.drop("longest"), "doc").select("token", *columns), "open")
    x, y = (open_posts.select("token", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "ab")
    later = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_a") < F.col("doc_b")))
    inside = lambda s: behind(s) > _needed() - _asked()
    met = x.join(y, "token").filter(
        later & (F.col("component_a") != F.col("component_b")) & _may_link() & inside("a") & inside("b")
    )
    counted = met.groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).agg(
        F.count("*").alias("shared"), F.max(_asked()).alias("asked"), F.max(_needed()).alias("needed"),
        F.min(F.least(behind("a"), behind("b"))).alias("behind"),
    )
    return counted.filter("shared >= asked and shared + behind - 1 >= needed").select("a", "b")


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n_shingles, component)`` for every id of ``docs``."""
    sets = written(shingle_sets(docs, doc, text), "sets")
    live = sets.filter(F.size("tokens") > 0)
    signed = live.select("doc", "n", "sign", "sign2")
    classes = signed.filter("sign IS NOT NULL").groupBy("n", "sign", "sign2").agg(F.min("doc").alias("class"))
    member = written(
        signed.join(classes, ["n", "sign", "sign2"], "left").select("doc", F.coalesce("class", "doc").alias("class")), "classes"
    )
    heads = member.filter("doc = class").select("doc")
    # made narrow before the join, which is not a semi-join as Spark would move that below
    known = written(profiles(live).join(heads, "doc"), "profiles")
    posts = written(shared_posts(prefixes(known)), "shared")
    few = written(possible(hub_pairs(posts), known), "possible")
    likely = written(verified(few, live), "likely")
    links = written(confirmed(likely, docs, doc, text), "links")
    labels = components(links)
    few = written(remaining_pairs(posts, known, labels), "possible")
    likely = written(verified(few, live), "likely")
    more = written(confirmed(likely, docs, doc, text), "links")
    labels = components(links.unionByName(more)) if more.limit(1).count() else labels
    # a head is the smallest of its class, so the smallest head is the smallest document
    of_class = member.join(labels, F.col("class") == F.col("node"), "left").select(
        "doc", F.coalesce("component", "class").alias("component")
    )
    return sets.select("doc", "n").join(of_class, "doc", "left").select(
        "doc", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "doc").alias("component")
    )


def digests(docs: DataFrame, found: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("doc"), "left").select(
        "doc_id", "n_shingles", F.col("component").alias("component_id")
    )
