"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Each source is a lane of blocks of ``block_rows`` documents.  A target weight of w gives block i of a
lane the release time floor(i/w) and the deadline ceil((i+1)/w); one block is placed in each slot,
always the released block with the earliest deadline.  In every prefix of the schedule each lane is
then less than one block away from its weight times the length of the prefix.

Weights are taken as exact fractions over all blocks, not as slots of a period.  When lanes run out,
the remaining ones share the slots by their weights, and what they are ahead or behind is carried
on; no document is dropped or repeated.  Earliest deadline first is serial, so the order of the blocks
is one pass in the driver over (lane, block) numbers, with a state of one entry for each lane.  It is
kept short by the size of the blocks: ``block_rows`` documents, or more in a corpus that would have
more than about MOST_BLOCKS of them; all else is done on DataFrames.
"""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, table

BLOCK_ROWS = 8
MOST_BLOCKS = 1 << 21  # about as many blocks are scheduled at most; larger corpora have larger blocks
FLATTEN = 0.7  # default target: share of the corpus to this power, which lifts small sources
CHUNK_SLOTS = 250_000  # slots of the schedule that the driver holds
BROADCAST_LANES = 200_000  # names of lanes that go to every task; more are joined by shuffling
RANK_ROWS = 50_000  # rows that are ranked together


def one_period(shares: dict[int, int]) -> dict[int, list[int]]:
    """Slots of each lane's blocks in one period: earliest deadline first among released blocks."""
    period = sum(shares.values())
    released = sorted((i * period // a, lane, i) for lane, a in shares.items() for i in range(a))
    slots: dict[int, list[int]] = {lane: [0] * a for lane, a in shares.items()}
    ready: list[tuple[int, int, int]] = []
    at = 0
    for slot in range(period):
        while at < len(released) and released[at][0] <= slot:
            _, lane, i = released[at]
            heapq.heappush(ready, (-(-(i + 1) * period // shares[lane]), lane, i))
            at += 1
        _, lane, i = heapq.heappop(ready)
        slots[lane][i] = slot
    return slots


def whole_shares(weights: dict[int, float], period: int) -> dict[int, int]:
    """Weights as whole slots of a period, at least one each, by largest remainder."""
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {lane: w / total * spare for lane, w in weights.items()}
    shares = {lane: 1 + math.floor(x) for lane, x in exact.items()}
    for lane in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[: period - sum(shares.values())]:
        shares[lane] += 1
    return shares


def whole_weights(weights: dict[int, float]) -> dict[int, int]:
    """The weights as whole numbers in exactly their ratios: a float is a whole number over a power of two."""
    bad = {lane: w for lane, w in weights.items() if not (math.isfinite(w) and w > 0)}
    if bad:
        raise ValueError(f"weights must be finite and above 0: {sorted(bad.values())[:5]}")
    parts = {lane: float(w).as_integer_ratio() for lane, w in weights.items()}
    over = max(d for _, d in parts.values())
    return {lane: n * (over // d) for lane, (n, d) in parts.items()}


def schedule(blocks: dict[int, int], weights: dict[int, int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(lane, block, release, deadline, slot) in the order of slots.

    In the fluid mix every lane advances at its weight over the weights of the lanes not used up.
    At virtual time v a lane has had min(n, a*v) of its n blocks, and the slots gone are the sum t(v)
    of that over the lanes.  Block i of a lane is due from floor(t(i/a)) to ceil(t((i+1)/a)); the
    fluid mix itself fits all of them, so earliest deadline first does."""
    lanes = sorted((lane for lane, n in blocks.items() if n), key=lambda k: Fraction(blocks[k], weights[k]))
    ends = [(blocks[k], weights[k]) for k in lanes]  # virtual times n/a at which lanes are used up
    gone = [0, *accumulate(n for n, _ in ends)]
    rate = [0, *accumulate(a for _, a in reversed(ends))][::-1]

    def passed(i: int, a: int, at: int) -> int:
        """How many lanes are used up at i/a, known to be ``at`` or more."""
        step = 1
        while at + step <= len(ends) and ends[at + step - 1][0] * a <= i * ends[at + step - 1][1]:
            at, step = at + step, step * 2
        return bisect_left(ends, True, at, min(at + step, len(ends)), key=lambda e: e[0] * a > i * e[1])

    def block(lane: int, i: int, at: int) -> tuple[int, int, int, int, int]:
        a = weights[lane]
        at = passed(i, a, at)
        release = gone[at] + i * rate[at] // a
        at = passed(i + 1, a, at)
        return release, gone[at] - (-(i + 1) * rate[at] // a), lane, i, at

    waiting = [block(lane, 0, 0) for lane in lanes]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int, int]] = []
    for slot in range(gone[-1]):
        while waiting and waiting[0][0] <= slot:
            release, deadline, lane, i, at = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, lane, i, release, at))
        deadline, lane, i, release, at = heapq.heappop(ready)
        yield lane, i, release, deadline, slot
        if i + 1 < blocks[lane]:
            heapq.heappush(waiting, block(lane, i + 1, at))


def written(spark: SparkSession, rows: Iterator[tuple[int, int, int, int, int]]) -> DataFrame:
    """The schedule as a table in the shared folder, written in parts of bounded size."""
    at = f"{shared_dir(spark)}/mix-{uuid.uuid4().hex}"
    names = ["lane", "block", "release", "deadline", "slot"]
    while part := list(islice(rows, CHUNK_SLOTS)):
        chunk = pa.table([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names=names)
        spark.createDataFrame(chunk).write.mode("append").parquet(at)
    return spark.read.parquet(at)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, flatten: float = FLATTEN, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Adds lane_weight (the target's share of all targets), block, release, deadline, slot and position
    to every row of ``docs``.

    ``position`` is the place in the mix (blocks of fewer rows at a lane's end leave gaps).  A lane's
    documents come in a fixed pseudo-random order of doc_id; equal ids are in any order.  Sources
    that ``weights`` doesn't name get the smallest weight named.  Null sources are a lane of their
    own, and so is every other source, however many there are.  An empty table stays empty.
    Columns of docs that have one of the new names are replaced."""
    spark = docs.sparkSession
    new = ["lane", "lane_weight", "block", "release", "deadline", "slot", "position"]
    docs = docs.drop(*new)
    columns = docs.columns
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sizes = docs.groupBy(name.alias("name")).count()
    rows, names = {}, {}
    for i, r in enumerate(sorted(sizes.collect(), key=lambda r: (-r["count"], r["name"]))):
        rows[i], names[i] = r["count"], r["name"]
    total = sum(rows.values())
    if not total:
        return docs.selectExpr("*", "cast(null as double) lane_weight", *[f"cast(null as bigint) {c}" for c in new[2:]])
    block_rows = max(block_rows, -(-total // most_blocks))
    if weights is None:
        target = {i: (n / total) ** flatten for i, n in rows.items()}
    else:
        least = min(weights.values())
        target = {i: float(weights.get(s[1:], least)) for i, s in names.items()}
    share = whole_weights(target)
    whole = sum(share.values())
    slots = written(spark, schedule({i: -(-n // block_rows) for i, n in rows.items()}, share))
    lanes = spark.createDataFrame(pa.table({"name": pa.array(list(names.values()), pa.string()), "lane": pa.array(list(names), pa.int64()), "lane_weight": pa.array([share[i] / whole for i in names], pa.float64())}))

    salts = max(1, math.ceil(total / RANK_ROWS))
    # the user's columns stand in one struct, so none of them can clash with those made here
    docs = docs.select(name.alias("name"), F.col("doc_id").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    keyed = docs.join(F.broadcast(lanes) if len(names) <= BROADCAST_LANES else lanes, "name").drop("name")
    keyed = keyed.withColumn("order", F.xxhash64("doc_id", F.lit(10))).withColumn("salt", (F.shiftrightunsigned("order", 33) * salts / F.lit(1 << 31)).cast("int"))
    ahead = W.partitionBy("lane").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    before = keyed.groupBy("lane", "salt").count().select("lane", "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    within = W.partitionBy("lane", "salt").orderBy(F.shiftrightunsigned("order", 1), "order", "doc_id")
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1).join(before, ["lane", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).withColumn("block", F.expr(f"rank div {block_rows}"))
    placed = ranked.join(slots, ["lane", "block"])
    return placed.select(
        *[F.col(f"row.`{c}`").alias(c) for c in columns],
        "lane_weight",
        "block",
        "release",
        "deadline",
        "slot",
        F.expr(f"slot * {block_rows} + rank % {block_rows}").alias("position"),
    )


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its place in the mix.

    Null sources are a source of their own, repeated rows have places of their own, and an empty table
    gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs)
