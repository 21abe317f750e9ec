"""Removal of repeated byte strings by refinement of suffix buckets.

A byte is removed when it lies in a string of LENGTH bytes that also starts anywhere else.  The
suffixes of the corpus are not sorted whole.  As in bucket-pointer refinement they are first put
into buckets by a q-gram, and a bucket is refined by identifiers that its suffixes have at other
offsets; identifiers of 2k bytes are made of two identifiers of k bytes.  Suffixes that are alone
in their bucket leave at once.  The identifiers are hashes of content, equal in every task, so
buckets need no common numbering.

1. *q-gram buckets.*  Every window of LENGTH bytes names an anchor, the least 128-gram of its first
   256.  Anchors that occur once in the corpus rule out all windows that name them.  The others are
   kept in a bit table whose size follows their number; it may let more windows pass, never fewer.
2. *Core.*  A window that passed is put into the bucket of the CORE bytes that begin at the least
   32-gram of its first FINE_SPAN.  Windows next to each other with the same core are one run.
3. *Refinement.*  Runs of a bucket are sorted by the identifier of their whole extent; equal
   neighbours are repeats.  Different runs of one bucket are refined to their windows, which are told
   apart by the bytes to the left and to the right of the core.
4. The covered stretches of each document are united and cut out.

Equality is told by 128 bits of hashes.  A bucket with more than HELD different runs sends its
windows on to be sorted by their own identifiers, so a task holds HELD runs.  Anchors that more than
HOT slices have are not bucketed by their core: each of their windows is a bucket of its own
identifier, so a passage that a third of all documents share is spread over all tasks.  Equal runs
met in one slice are one row before they are shuffled.  Long texts are cut into overlapping slices.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, rows_of, small_batches, table

LENGTH = 400
ANCHOR, SPAN = 128, 256  # q-grams and starts of the first anchors; together below LENGTH
FINE, FINE_SPAN = 32, 128  # q-grams and starts of the cores
CORE = LENGTH - FINE_SPAN + 1
LEAST_BITS, MOST_BITS = 20, 31  # the table of repeated anchors has between 2**20 and 2**31 bits
SLICE = 1 << 19  # bytes that are hashed together
HELD = 512  # different runs of a bucket that a task holds
HOT = 4096  # slices with an anchor beyond which its windows are spread
NONE = -(1 << 63)
PLACE = np.uint64((1 << 22) - 1)  # positions in a slice

_rng = np.random.default_rng(20)
TABLES = _rng.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
BASES = [int(b) * 8 + 5 & (1 << 64) - 1 for b in _rng.integers(0, 2**63, size=2)]
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the FINE- and the ANCHOR-grams at every offset, doubled from those of half the length."""
    h, base, k, fine = TABLES[0][x], BASES[0], 1, None
    while k < ANCHOR:
        h[: len(h) - k] = h[: len(h) - k] * np.uint64(base) + h[k:]
        h[max(0, len(h) - k) :] = 0
        base, k = base * base & (1 << 64) - 1, 2 * k
        if k == FINE:
            fine = h.copy()
    return fine, h


def forward_min(v: np.ndarray, span: int) -> np.ndarray:
    """Least of v[s : s + span] for every s (what lies beyond the end counts as largest)."""
    k, v = 1, v.copy()
    while k < span:
        v[: len(v) - k] = np.minimum(v[: len(v) - k], v[k:])
        k *= 2
    return v


def backward_max(v: np.ndarray, span: int) -> np.ndarray:
    k, v = 1, v.copy()
    while k < span:
        v[k:] = np.maximum(v[k:], v[: len(v) - k].copy())
        k *= 2
    return v


class Slice:
    """Pieces of documents one after the other, with the windows that stay inside one of them."""

    def __init__(self, pieces: list[bytes]):
        self.x = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.end = np.cumsum(size)
        self.first = self.end - size
        left = np.repeat(self.end, size) - np.arange(len(self.x))  # bytes up to the piece's end
        self.valid = left >= LENGTH
        self.fine, anchor = grams(self.x)
        rank = np.maximum(mixed(anchor), np.uint64(1))
        rank[left < ANCHOR] = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.rank = rank
        self.least = np.where(self.valid, forward_min(rank, SPAN), np.uint64(0))

    def anchors(self) -> np.ndarray:
        """Anchors that some window names, once for each of their places."""
        return self.rank[backward_max(self.least, SPAN) == self.rank]

    def runs(self, passed: np.ndarray, alone: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, core) of runs; windows marked in ``alone`` are runs of their own."""
        s = np.flatnonzero(passed)
        if not len(s):
            return s, s, s
        packed = (mixed(self.fine) & ~PLACE) | np.arange(len(self.x), dtype=np.uint64)
        core = (forward_min(packed, FINE_SPAN)[s] & PLACE).astype(np.int64)
        new = np.ones(len(s), dtype=bool)
        new[1:] = (np.diff(s) != 1) | (core[1:] != core[:-1])
        if alone is not None:
            apart = alone[s]
            core[apart] = -1
            new[1:] |= apart[1:] | apart[:-1]
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(s)) - 1
        return s[start], s[stop], core[start]

    def prefixes(self):
        """identifier(i, j) of the bytes from i to j, with either of two bases."""
        n = len(self.x) + 1
        parts = []
        for t, base in zip(TABLES, BASES, strict=True):
            power = np.full(n, base, dtype=np.uint64)
            power[0] = 1
            inverse = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
            inverse[0] = 1
            power, inverse = np.cumprod(power), np.cumprod(inverse)
            total = np.zeros(n, dtype=np.uint64)
            total[1:] = np.cumsum(t[self.x] * power[:-1])
            parts.append((total, inverse))

        def identifier(which: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            total, inverse = parts[which]
            return mixed((total[j] - total[i]) * inverse[i] + (j - i).astype(np.uint64) * MIX)

        return identifier


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list, list[int], list[bytes]]]:
    """(doc, text hash, offset, bytes) of pieces that hold every window once, in slices of bounded size."""
    rows, size = [], 0
    for batch in batches:
        for doc, digest, text in rows_of(batch):
            for at in range(0, len(text) - LENGTH + 1, most):
                piece = text[at : at + most + LENGTH - 1]
                rows.append((doc, digest, at, piece))
                size += len(piece)
                if size >= most:
                    yield tuple(map(list, zip(*rows, strict=True)))
                    rows, size = [], 0
    if rows:
        yield tuple(map(list, zip(*rows, strict=True)))


def _anchors(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, pieces in slices(batches, most):
            value, count = np.unique(Slice(pieces).anchors(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.minimum(count, 2))], names=["anchor", "n"])

    return run


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for bits in batch.column(1).to_pylist():
            b = np.zeros(1 << 15, dtype=np.uint8)
            b[bits] = 1
            out.append(np.packbits(b).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "bytes"])


def bit_table(anchors: DataFrame, bits: int) -> np.ndarray:
    """The packed bits that ``anchors`` (anchor) name, of 2**bits."""
    at = F.col("anchor").bitwiseAND((1 << bits) - 1)
    blocks = anchors.select(F.shiftright(at, 15).alias("block"), at.bitwiseAND(32767).cast("int").alias("bit")).groupBy("block").agg(F.collect_set("bit").alias("bits"))
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    # at most 2**(bits-15) rows of 4 KB
    for row in blocks.mapInArrow(_bytes_of, "block long, bytes binary").toLocalIterator():
        table[row["block"] << 12 : (row["block"] + 1) << 12] = np.frombuffer(row["bytes"], dtype=np.uint8)
    return table


def marked(table: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    place = anchor & np.uint64(len(table) * 8 - 1)
    return ((table[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


RUN = "doc long, digest long, first int, last int, bucket long, extent long, many boolean, left binary, right binary"
NAMES = [c.split()[0] for c in RUN.split(", ")]


def _runs(seen, hot, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with an extent are runs to be compared; rows without are stretches known to repeat,
        and their bucket only spreads them."""
        for doc, digest, offset, pieces in slices(batches, most):
            part = Slice(pieces)
            passed = part.valid & marked(seen.value, part.least)
            s0, s1, a = part.runs(passed, hot and marked(hot.value, part.least))
            if not len(s0):
                continue
            identifier = part.prefixes()
            apart = a < 0
            core0, core1 = np.where(apart, s0, a), np.where(apart, s0 + LENGTH, a + CORE)
            bucket = identifier(0, core0, core1)
            extent = mixed(identifier(0, s0, s1 + LENGTH) ^ mixed(identifier(1, s0, s1 + LENGTH) + (core0 - s0).astype(np.uint64) * MIX) + (s1 - s0).astype(np.uint64))
            _, first, which, count = np.unique(extent, return_index=True, return_inverse=True, return_counts=True)
            many = count[which] > 1
            owner = np.searchsorted(part.end, s0, side="right")
            base = part.first[owner] - np.array(offset, dtype=np.int64)[owner]
            doc_of, digest_of = np.array(doc, dtype=np.int64)[owner], np.array(digest, dtype=np.int64)[owner]
            # stretches that repeat inside this slice, joined where they touch
            i = np.flatnonzero(many)
            if len(i):
                begin, stop = s0[i], s1[i] + LENGTH
                new = np.ones(len(i), dtype=bool)
                new[1:] = (owner[i][1:] != owner[i][:-1]) | (begin[1:] > stop[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(i)) - 1
                h = i[head]
                nothing = pa.nulls(len(h))
                columns = [doc_of[h], digest_of[h], (begin[head] - base[h]).astype(np.int32), (stop[tail] - base[h]).astype(np.int32), bucket[h].view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), nothing.cast(pa.int64()), nothing.cast(pa.bool_()), nothing.cast(pa.binary()), nothing.cast(pa.binary())], names=NAMES)
            # one row for each extent goes on
            k = np.sort(first)
            raw = part.x.tobytes()
            left = [raw[p:q] for p, q in zip(s0[k].tolist(), core0[k].tolist(), strict=True)]
            right = [raw[p:q] for p, q in zip(core1[k].tolist(), (s1[k] + LENGTH).tolist(), strict=True)]
            columns = [doc_of[k], digest_of[k], (s0[k] - base[k]).astype(np.int32), (s1[k] - base[k]).astype(np.int32), bucket[k].view(np.int64), extent[k].view(np.int64), many[k]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=NAMES)

    return run


FOUND = "doc long, digest long, first int, last int, window binary, known boolean"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])
    rows.clear()
    return out


def names_of(row: tuple) -> list[bytes]:
    """Identifiers of a run's windows inside their bucket: the bytes on both sides of the core and where they part."""
    _, _, first, last, _, _, _, left, right = row
    sides = len(left) + len(right) - (last - first)  # bytes of a window outside the core
    n = len(left)
    return [xxhash.xxh3_128_digest(left[i:] + right[: sides - n + i], n - i) for i in range(last - first + 1)]


def _refine(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs sorted by bucket and extent -> stretches that repeat, and windows still to compare."""
        out: list[tuple] = []
        held: list[list] = []  # [run, it has an equal] for the different runs of the bucket
        sent = False  # the bucket is too large: its windows are sent on

        def send() -> None:
            for row, twice in held:
                bucket = row[4].to_bytes(8, "little", signed=True)
                for i, name in enumerate(names_of(row)):
                    out.append((row[0], row[1], row[2] + i, None, xxhash.xxh3_128_digest(name + bucket), twice))
            held.clear()

        def settle() -> None:
            if sent:
                send()
            elif len(held) > 1 and not all(twice for _, twice in held):
                names = [names_of(row) for row, _ in held]
                count = Counter()
                for own, (_, twice) in zip(names, held, strict=True):
                    for name in own:
                        count[name] += 1 + twice
                for own, (row, twice) in zip(names, held, strict=True):
                    if twice:
                        continue
                    begin = None
                    for i, name in enumerate([*own, None]):
                        if name is not None and count[name] > 1:
                            begin = i if begin is None else begin
                        elif begin is not None:
                            out.append((row[0], row[1], row[2] + begin, row[2] + i - 1 + LENGTH, None, None))
                            begin = None
            held.clear()

        at = None
        for batch in batches:
            for row in rows_of(batch, 4096):
                if row[5] is None:
                    out.append((*row[:4], None, None))
                    continue
                if row[4] != at:
                    settle()
                    at, sent = row[4], False
                elif held and row[5] == held[-1][0][5]:
                    first, twice = held[-1]
                    if not twice:
                        held[-1][1] = True
                        out.append((*first[:3], first[3] + LENGTH, None, None))
                    if not row[6]:
                        out.append((*row[:3], row[3] + LENGTH, None, None))
                    continue
                if len(held) >= most:  # the last stays until it is known whether it has an equal
                    last, sent = held.pop(), True
                    send()
                    held.append(last)
                held.append([row, row[6]])
            yield _found(out)
        settle()
        yield _found(out)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by identifier -> stretches of those that have an equal."""
    out: list[tuple] = []
    held = None
    for batch in batches:
        for row in rows_of(batch, 4096):
            same = held is not None and row[4] == held[4]
            if same:
                for r in (held, row):
                    if not r[5]:
                        out.append((r[0], r[1], r[2], r[2] + LENGTH, None, None))
                held = (*row[:5], True)
            else:
                held = row
        yield _found(out)
    yield _found(out)


OUT = "doc long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = []
            for doc, text, spans in rows_of(batch.slice(lo, 256)):
                kept, at, removed, n, upto = [], 0, 0, 0, -1
                for span in sorted((s["first"], s["last"]) for s in spans or ()):
                    if span[0] > upto:
                        n += 1
                        kept.append(text[at : span[0]])
                        removed += span[1] - span[0]
                    else:
                        removed += max(0, span[1] - upto)
                    upto = max(upto, span[1])
                    at = upto
                kept.append(text[at:])
                rows.append((doc, len(text), removed, n, b"".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])


def repeated(texts: DataFrame, slice_bytes: int = SLICE, held: int = HELD, hot: int = HOT) -> DataFrame:
    """``texts`` (doc, digest, bytes) -> doc, digest, first, last: stretches that repeat."""
    spark = texts.sparkSession
    small_batches(spark)
    anchors = cut(texts.mapInArrow(_anchors(slice_bytes), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"))
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * anchors.count()).bit_length()))
    seen = spark.sparkContext.broadcast(bit_table(anchors.select("anchor"), bits))
    frequent = anchors.where(F.col("n") > hot).select("anchor")
    spread = None if frequent.isEmpty() else spark.sparkContext.broadcast(bit_table(frequent, bits))
    runs = texts.mapInArrow(_runs(seen, spread, slice_bytes), RUN)
    stretch = ["doc", "digest", "first", "last"]
    compared = cut(runs.repartition("bucket").sortWithinPartitions("bucket", "extent").mapInArrow(_refine(held), FOUND))
    windows = compared.where("window IS NOT NULL").repartition("window").sortWithinPartitions("window").mapInArrow(_windows, FOUND)
    return compared.where("window IS NULL").select(*stretch).unionByName(windows.select(*stretch))


def remove_repeats(docs: DataFrame, slice_bytes: int = SLICE, held: int = HELD, hot: int = HOT) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary, UTF-8 bytes left).

    Null texts are empty, and so are texts below LENGTH bytes left as they are.  Rows with the same
    doc_id, or without one, count as different documents, so a repeated row of LENGTH bytes or more is
    removed in each of its places.  Texts of any length are cut into slices of ``slice_bytes``.  Other
    columns are ignored; an empty table gives an empty result.  ``held`` and ``hot`` only say how the
    work is spread; the result is the same for all of them."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("bytes"))
    texts = texts.select("doc", F.xxhash64("bytes").alias("digest"), "bytes")
    spans = repeated(texts, slice_bytes, held, hot).groupBy("doc", "digest").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    done = texts.join(spans, ["doc", "digest"], "left").select("doc", "bytes", "spans").mapInArrow(_cut, OUT)
    return done.select(F.when(F.col("doc") != NONE, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op5_bucket_refined_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without the bytes that a LENGTH-byte string elsewhere repeats.

    Null and short texts lose nothing; equal rows lose all; an empty table gives no rows."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
