"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in a fixed pseudo-random order, are cut into blocks of ``block_bytes``.
With a weight of w, block j (from 0) of a source is released at floor(j / w) and due at
ceil((j + 1) / w); at each step the released block with the earliest deadline is placed.
On one sequence this is optimal: whatever the step, no source is a block or more away from
its share until it runs out. The steps of a source that ran out go to released blocks of
the others or stay empty.

Weights are taken as they are, as exact fractions of their sum, so nothing adds up over a
mixture of any length or any number of sources. The schedule has one row per block, not per
row; it is worked out by one task into a table, which rows find by a join. Numbering inside
sources of any size is two-level (``order``).

Null sources count as the source ''. Every row is kept, repeated rows included.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.order import block_bits, order_key, sums_before
from wardline.session import materialise

CYCLE = 1_000
BLOCK_BYTES = 65_536
#: Shares in the mixture are proportional to bytes to this power: small sources gain.
TEMPERATURE = 0.7
PLAN = ["mix_block", "mix_step", "mix_release", "mix_deadline"]
PLAN_ROWS = 50_000


def steps_of(weights: Mapping[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """Weights as about ``cycle`` whole steps, for a schedule that repeats: proportional by largest
    remainder, at least one each (so more than ``cycle`` where sources have less than a step)."""
    names = sorted(weights)
    total = float(sum(weights.values()))
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive")
    exact = {k: cycle * weights[k] / total for k in names}
    steps = {k: max(1, int(exact[k])) for k in names}
    by_rest = sorted(names, key=lambda k: (int(exact[k]) - exact[k], k))
    for k in by_rest[: max(0, cycle - sum(steps.values()))]:
        steps[k] += 1
    return steps


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    if not weights or not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {k: Fraction(w) for k, w in weights.items()}
    common = math.lcm(*[w.denominator for w in exact.values()])
    return {k: int(w * common) for k, w in exact.items()}


def schedule(whole: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """``(source, block, step, release, deadline)`` of all ``blocks``, earliest deadline first
    among released blocks. Sources without blocks count in the shares."""
    total = sum(whole.values())
    names = sorted(k for k, n in blocks.items() if n > 0)
    waiting = [(0, -(-total // whole[k]), k, 0) for k in names]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    step = 0
    while waiting or ready:
        if not ready:
            step = max(step, waiting[0][0])
        while waiting and waiting[0][0] <= step:
            release, due, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (due, name, block, release))
        due, name, block, release = heapq.heappop(ready)
        yield name, block, step, release, due
        if (j := block + 1) < blocks[name]:
            a = whole[name]
            heapq.heappush(waiting, (j * total // a, -(-(j + 1) * total // a), name, j))
        step += 1


def one_cycle(steps: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """``(source, block, step)`` of a schedule in which each source has as many blocks as its weight."""
    return [placed[:3] for placed in schedule(steps, steps)]


def _planned(spark: SparkSession, weights: Mapping[str, float], blocks: Mapping[str, int]) -> DataFrame:
    """The schedule as a table, worked out by one task in batches."""
    whole = whole_weights(weights)
    total = sum(whole.values())
    if any(-(-n * total // whole[k]) >= 2**63 for k, n in blocks.items()):
        raise ValueError("weights too small to number the steps")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), *[pa.int64()] * 4]
        for _ in batches:
            placed = schedule(whole, blocks)
            while some := list(islice(placed, PLAN_ROWS)):
                columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["_source", *PLAN])

    schema = "_source string, " + ", ".join(f"{c} bigint" for c in PLAN)
    return materialise(spark.range(0, 1, 1, 1).mapInArrow(run, schema), "mix-plan")


def byte_weights(docs: DataFrame, text: str = "text", source: str = "source", power: float = TEMPERATURE) -> dict[str, float]:
    """Target weights from the bytes of each source."""
    name = F.coalesce(F.col(source), F.lit(""))
    size = F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint") + 1)
    return {r["s"]: float(r["b"]) ** power for r in docs.groupBy(name.alias("s")).agg(size.alias("b")).collect()}


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, key: str = "doc_id", text: str = "text",
    source: str = "source", block_bytes: int = BLOCK_BYTES, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``mix_block`` (of the source), ``mix_step``, ``mix_release``, ``mix_deadline``
    and ``mix_place`` (the row's place inside its block): the mixture is the order of
    (``mix_step``, ``mix_place``).

    ``weights`` must name every source and be positive; by default they are taken from the bytes.
    """  # noqa: E501
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
    added = docs.withColumns(
        {
            "_source": F.coalesce(F.col(source), F.lit("")),
            "_size": size + 1,
            "_key": order_key(F.col(key)),
            "_row": F.monotonically_increasing_id(),
        }
    )
    rows = materialise(added if keep_text else added.drop(text), "mix")
    per_source = rows.groupBy("_source").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()
    if not per_source:
        weights = {"": 1.0}
    elif weights is None:
        weights = {r["_source"]: float(r["b"]) ** TEMPERATURE for r in per_source}
    if missing := {r["_source"] for r in per_source} - set(weights):
        raise ValueError(f"sources without a weight: {sorted(missing)[:5]}")
    blocks = {r["_source"]: (r["b"] - 1) // int(block_bytes) + 1 for r in per_source}
    plan = _planned(rows.sparkSession, weights, blocks)
    bits = block_bits(sum(r["n"] for r in per_source))
    narrow = rows.select("_row", "_source", "_size", "_key", F.col(key).alias("_id"))
    placed = sums_before(narrow, ["_source"], "_key", ["_id", "_row"], F.col("_size"), "_before", bits)
    turned = placed.select(
        "_row",
        "_source",
        F.expr(f"_before div {int(block_bytes)}").alias("mix_block"),
        F.expr(f"_before % {int(block_bytes)}").alias("mix_place"),
    )
    stepped = turned.join(plan, ["_source", "mix_block"]).select(
        "_row", "mix_block", "mix_place", "mix_release", "mix_deadline", "mix_step"
    )
    return rows.join(stepped, "_row").drop("_row", "_source", "_size", "_key")


def digests(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "source", "mix_block", "mix_step", "mix_place", "mix_release", "mix_deadline")
