"""Best-fit packing of tokenised documents with matching of large items.

Every document is tokenised, closed with an end id and cut into pieces only where it is longer than
the capacity.  What remains to be solved is bin packing of whole lengths up to the capacity, so the
number of pieces of each length says all: the plan is made on that histogram, whose size is the
capacity and doesn't grow with the data.

Plan: pieces above a third of the capacity go at most two to a bin; they are matched greedily,
the largest first, each with the largest other that still fits.  Smaller pieces follow in falling
length, each into the bin with the smallest gap that holds it.  Bins of the same content are one
row with a count.  The pieces then find their places by their rank among the pieces of their
length, which is counted within partitions of the written pieces and by sums over partitions.

Documents that come in an order (a column ``position``, as of a mix) are packed in consecutive ranges
of it, each range by a plan of its own, and the sequences are numbered range by range: the order of
the mix is then the order of the sequences, to within a range.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, parts_of, small_batches, table
from .tokens import Encoder, vocabulary

CAPACITY = 2048
END_ID = 0
RANGE_ROWS = 4096  # places of the mix that are packed together


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """[(number of bins, lengths in them in order of place)] that hold every piece exactly once."""
    left = {n: k for n, k in histogram.items() if k}
    large = sorted(n for n in left if 3 * n > capacity)
    opened: dict[int, list[tuple[int, list[int]]]] = {}  # gap -> bins

    def put(count: int, lengths: list[int]) -> None:
        gap = capacity - sum(lengths)
        opened.setdefault(gap, []).append((count, lengths))

    while large:
        top = large[-1]
        k = bisect_left(large, capacity - top + 1) - 1  # the largest that fits beside it
        if k < 0:
            put(left.pop(top), [top])
        elif large[k] == top:  # pairs of equal length; an odd one looks on
            pairs, odd = divmod(left[top], 2)
            if pairs:
                put(pairs, [top, top])
            if odd:
                left[top] = 1
                if k == 0:
                    put(1, [top])
                else:
                    other = large[k - 1]
                    put(1, [top, other])
                    left[other] -= 1
                    if not left[other]:
                        del left[other]
                        large.remove(other)
            left.pop(top)
        else:
            other = large[k]
            both = min(left[top], left[other])
            put(both, [top, other])
            for n in (top, other):
                left[n] -= both
                if not left[n]:
                    del left[n]
                    large.remove(n)
            continue
        large.remove(top)

    gaps = sorted(opened)
    for n in sorted((n for n in left), reverse=True):
        count = left[n]
        while count:
            k = bisect_left(gaps, n)
            if k == len(gaps):  # no gap is wide enough: new bins, filled with this length alone
                each = capacity // n
                full, rest = divmod(count, each)
                made = [(full, [n] * each)] * bool(full) + [(1, [n] * rest)] * bool(rest)
                count = 0
            else:
                gap = gaps[k]
                bins, lengths = opened[gap].pop()
                if not opened[gap]:
                    del opened[gap]
                    gaps.pop(k)
                # best fit puts pieces of one length into a gap as long as it stays the smallest
                each = min(gap // n, count)
                used = min(bins, count // each)
                made = [(used, lengths + [n] * each)]
                if bins > used:
                    made.append((bins - used, lengths))
                count -= used * each
            for item in made:
                gap = capacity - sum(item[1])
                if gap not in opened:
                    insort(gaps, gap)
                    opened[gap] = []
                opened[gap].append(item)
    return [item for gap in sorted(opened) for item in opened[gap]]


class Places:
    """Where the k-th piece of a length goes: arrays by length, searched by rank."""

    def __init__(self, bins: list[tuple[int, list[int]]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        seen: dict[int, int] = {}
        first = 0
        for count, lengths in bins:
            offset = 0
            for n in lengths:
                start = seen.get(n, 0)
                rows.setdefault(n, []).append((start, first, offset, count))
                seen[n] = start + count
                offset += n
            first += count
        self.of = {n: np.array(r, dtype=np.int64) for n, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        values, first = np.unique(length[order], return_index=True)
        for n, rows in zip(values, np.split(order, first[1:]), strict=True):
            t = self.of[int(n)]
            at = np.searchsorted(t[:, 0], rank[rows], side="right") - 1
            sequence[rows] = t[at, 1] + rank[rows] - t[at, 0]
            offset[rows] = t[at, 2]
        return sequence, offset


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


def _pieces(path: str, capacity: int, end_id: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        count: dict[int, int] = {}
        for batch in (p for b in batches for p in parts_of(b, 1)):
            doc_ids = batch.column(0).to_pylist()
            rows = []
            for doc_id, ids in zip(doc_ids, encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    k = count.get(len(piece), 0)
                    count[len(piece)] = k + 1
                    rows.append((doc_id, n, start, len(piece), zlib.crc32(piece.tobytes()), part, k))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])

    return cut_up


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one: its only id is the end id.  Rows with the same doc_id are packed
    each for itself.  Other columns are ignored; an empty table gives no pieces."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(texts.mapInArrow(_pieces(tokenizer or vocabulary(), capacity, end_id), PIECES))
    counts = cut(pieces.groupBy("part", "length").count())
    # at most one row for each length up to the capacity
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan_bins(histogram, capacity)))
    ahead = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    rank: Column = F.col("k") + F.col("before")
    placed = pieces.join(before, ["part", "length"]).withColumn("at", place("length", rank))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def _pieces_in_order(path: str, capacity: int, end_id: int, range_rows: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in (p for b in batches for p in parts_of(b, 1)):
            rows = []
            for doc_id, position, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, n, start, len(piece), zlib.crc32(piece.tobytes()), position, position // range_rows))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "position", "range"])

    return cut_up


def _pack_range(capacity: int):
    def fill(pieces: pd.DataFrame) -> pd.DataFrame:
        """Bins of one range, numbered by the least position in them."""
        pieces = pieces.sort_values(["position", "piece"], ignore_index=True)
        lengths, counts = np.unique(pieces["length"].to_numpy(), return_counts=True)
        rank = pieces.groupby("length").cumcount().to_numpy()
        bins, offset = Places(plan_bins(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacity)).find(pieces["length"].to_numpy(), rank)
        return pieces.assign(bin=pd.factorize(bins)[0].astype(np.int64), offset=offset)

    return fill


def pack_in_order(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, range_rows: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, position) -> the columns of ``pack``, sequences in the order of position.

    The documents of every ``range_rows`` consecutive positions fill sequences of their own, so those of
    the first ranges are exactly the documents of the first positions; within a range sequences go by
    the least position in them.  Positions are not null and not negative."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("position").cast("long").alias("position"))
    light = "doc_id long, piece int, start long, length long, ids_crc32 long, position long, range long"
    pieces = texts.mapInArrow(_pieces_in_order(tokenizer or vocabulary(), capacity, end_id, range_rows or RANGE_ROWS), light)
    placed = cut(pieces.groupBy("range").applyInPandas(_pack_range(capacity), light + ", bin long, offset long"))
    # one row for each range
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    first = placed.groupBy("range").agg((F.max("bin") + 1).alias("bins")).select("range", F.coalesce(F.sum("bins").over(ahead), F.lit(0)).alias("first"))
    return placed.join(F.broadcast(first), "range").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("bin")).alias("sequence_id"), "offset")


def op6_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document of ``documents`` and their places in sequences.

    Null and empty texts are one piece of the end id alone; repeated rows are packed each for itself;
    an empty table gives no rows."""
    return pack(table(spark, sf_dir, "documents"))
