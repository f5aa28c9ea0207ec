"""Sharding by a k-d tree over metadata.

A node is split along its widest dimension at a weighted median, weights being the bytes
of the rows; a node that is to become m leaves is split at floor(m/2)/m of its weight, so
any number of leaves comes out even. All nodes of a level are split together: a few
aggregations over narrow rows close in on every node's cut, and only histograms (at most
leaves x bins rows, whatever the input) reach the driver.

Each coordinate is 31 bits of metadata followed by 31 bits of a digest of the row, so rows
with equal metadata - a hot source, thousands of copies - can still be cut anywhere. Rows
equal in everything differ by the number they are written down with.

Null texts weigh their overhead only; null metadata counts as an empty string. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.order import KEY_BITS, block_bits, order_key, sums_before
from wardline.session import materialise

OVERHEAD = 8
LOW_BITS = 31
BINS = 4096
#: A cut is fine enough when its bin holds one row, or at most this share of the node's weight.
FINE = 0.001


@dataclass
class Node:
    """A leaf if it has no children; else rows with ``dimension`` below ``cut`` go to ``low``."""

    number: int
    leaves: int
    dimension: str | None = None
    cut: int | None = None
    low: Node | None = None
    high: Node | None = None


@dataclass
class Search:
    """Closing in on the cut of one node."""

    node: Node
    lo: int
    hi: int
    below: int
    weight: int

    @property
    def target(self) -> float:
        return self.weight * (self.node.leaves // 2) / self.node.leaves

    @property
    def width(self) -> int:
        return -(-(self.hi - self.lo + 1) // BINS)

    def narrow(self, bins: list[tuple[int, int, int]]) -> bool:
        """Take the histogram of the range; True when the cut is set."""
        width, lo, below = self.width, self.lo, self.below
        for b, weight, rows in bins:
            if below + weight >= self.target:
                if width == 1 or rows == 1 or weight <= FINE * self.weight:
                    nearer = self.target - below < weight / 2
                    self.node.cut = lo + (b if nearer else b + 1) * width
                    return True
                self.lo, self.hi, self.below = lo + b * width, min(self.hi, lo + (b + 1) * width - 1), below
                return False
            below += weight
        self.node.cut = self.hi + 1
        return True


def coordinate(value: Column, tie: Column) -> Column:
    """A 62-bit number: 31 bits of the value, then 31 bits of the tie breaker."""
    high = F.least(F.greatest(value.cast("bigint"), F.lit(0)), F.lit(2**LOW_BITS - 1))
    return F.shiftleft(high, LOW_BITS) + F.shiftright(tie, KEY_BITS - LOW_BITS)


def leaves_of(node: Node) -> list[Node]:
    return [node] if node.low is None else leaves_of(node.low) + leaves_of(node.high)


def _small(spark, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of literals: of nodes, so at most as many rows as leaves."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({columns})")


def _value(dims: list[str]) -> Column:
    out = F.lit(None).cast("bigint")
    for d in dims:
        out = F.when(F.col("dimension") == d, F.col(d)).otherwise(out)
    return out


def _widest(rows: DataFrame, open_nodes: dict[int, Node], dims: list[str], span: dict[str, int]) -> list[Search]:
    """Of every node that is to be split, its widest dimension relative to the whole table's."""
    bounds = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
    found = rows.groupBy("node").agg(F.sum("weight").alias("weight"), *bounds).collect()
    out = []
    for r in sorted(found, key=lambda r: r["node"]):
        if node := open_nodes.get(r["node"]):
            wide = {d: (r[f"max_{d}"] >> LOW_BITS) - (r[f"min_{d}"] >> LOW_BITS) for d in dims}
            if not span:
                span.update({d: max(1, w) for d, w in wide.items()})
            node.dimension = max(dims, key=lambda d: wide[d] / span[d])
            out.append(Search(node, r[f"min_{node.dimension}"], r[f"max_{node.dimension}"], 0, r["weight"]))
    return out


def _histograms(rows: DataFrame, searches: list[Search], dims: list[str]) -> dict[int, list[tuple[int, int, int]]]:
    ranges = _small(
        rows.sparkSession, "node, dimension, lo, width",
        [(s.node.number, s.node.dimension, s.lo, s.width) for s in searches],
    )
    valued = rows.join(F.broadcast(ranges), "node").withColumn("_value", _value(dims))
    binned = valued.select("node", "weight", F.expr("(_value - lo) div width").alias("bin"), "_value", "lo")
    inside = binned.filter((F.col("_value") >= F.col("lo")) & (F.col("bin") < BINS))
    out: dict[int, list[tuple[int, int, int]]] = {s.node.number: [] for s in searches}
    for r in inside.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect():
        out[r["node"]].append((r["bin"], r["w"], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def _descend(rows: DataFrame, split: list[Node], dims: list[str]) -> DataFrame:
    """Rows of the split nodes move to the child on their side of the cut."""
    cuts = _small(
        rows.sparkSession, "node, dimension, cut, low, high",
        [(n.number, n.dimension, n.cut, n.low.number, n.high.number) for n in split],
    )
    side = F.when(_value(dims) < F.col("cut"), F.col("low")).otherwise(F.col("high"))
    joined = rows.join(F.broadcast(cuts), "node", "left").withColumn("_next", F.coalesce(side, "node"))
    return joined.drop("node", "dimension", "cut", "low", "high").withColumnRenamed("_next", "node")


def grow(rows: DataFrame, dims: list[str], leaves: int) -> tuple[Node, DataFrame]:
    """The tree over ``rows`` (``weight`` and coordinates) with so many leaves, and the rows
    with the ``node`` of their leaf."""
    root, span = Node(0, leaves), {}
    placed = rows.withColumn("node", F.lit(0))
    open_nodes, count = ({0: root} if leaves > 1 else {}), 1
    while open_nodes and (searches := _widest(placed, open_nodes, dims, span)):
        split = [s.node for s in searches]
        while searches:
            bins = _histograms(placed, searches, dims)
            searches = [s for s in searches if not s.narrow(bins[s.node.number])]
        open_nodes = {}
        for node in split:
            half = node.leaves // 2
            node.low, node.high = Node(count, half), Node(count + 1, node.leaves - half)
            count += 2
            open_nodes |= {n.number: n for n in (node.low, node.high) if n.leaves > 1}
        placed = _descend(placed, split, dims)
    return root, placed


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    keys: tuple[str, ...] = ("doc_id",), text: str = "text", metadata: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """``keys``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0) of each row.

    Give the number of shards, or ``target_bytes`` to have as many leaves as that takes.
    """  # noqa: E501
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    plain = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(F.encode(plain, "UTF-8"))
    tie = order_key(*[F.col(k) for k in keys])
    narrow = docs.select(
        *keys,
        (F.octet_length(plain) + OVERHEAD).cast("bigint").alias("size"),
        crc.alias("text_crc32"),
        tie.alias("tie"),
        *[F.shiftright(F.crc32(F.encode(F.coalesce(F.col(m).cast("string"), F.lit("")), "UTF-8")), 1).alias(f"_m{i}")
          for i, m in enumerate(metadata)],
    ).withColumn("_row", F.monotonically_increasing_id())
    rows = materialise(narrow, "shards")
    values = {"d_size": F.col("size"), "d_text": F.shiftright("text_crc32", 1)}
    values |= {f"d_m{i}": F.col(f"_m{i}") for i in range(len(metadata))}
    points = rows.withColumns({d: coordinate(v, F.col("tie")) for d, v in values.items()})
    points = points.withColumn("weight", F.col("size"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    leaves = shards or max(1, -(-total["b"] // target_bytes))
    root, leafed = grow(points, sorted(values), leaves)
    shard_of = _small(docs.sparkSession, "node, shard", [(x.number, i) for i, x in enumerate(leaves_of(root))])
    placed = leafed.join(F.broadcast(shard_of), "node")
    placed = placed.select(*keys, "size", "text_crc32", "shard", "tie", "_row")
    bits = block_bits(total["n"])
    numbered = sums_before(placed, ["shard"], "tie", ["_row"], F.lit(1), "slot", bits)
    return numbered.select(*keys, "size", "text_crc32", "shard", "slot")


def digests(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
