"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles.  The weight of a shingle is its count in
the document times its idf, ``1 + log2(N / df) / log2(N)``: 2 for a shingle of one document, falling
to 1 for one that every document has.  Documents are counted for all shingles, in a sketch of COUNTERS
counters: the task of a partition counts the documents of each counter, and the counters are added in
slices.  A shingle's df is what its counter has above the mean of all counters.  So a df is too large
or small by about the root of that mean, which is N times the mean number of shingles of a document
over COUNTERS: 20 with 256,000 documents of 330 shingles, so that counts of a few documents are then
uncertain, and next to none in a small table.  A counter is the same for all documents, so an error
changes the weight of a shingle but is no difference between the documents that have it.

Consistent sampling draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) for a shingle and each of the HASHES
samples; with t = floor(ln w / r + b) and ln y = r (t - b), a sample is the (shingle, t) of the
least ln a = ln c - ln y - r.  Two documents have equal samples with the probability of their
weighted Jaccard similarity.  Draws are read from fixed tables by bits of the shingle's hash.

Samples are banded.  In each bucket of equal bands leaders are compared with the members, and a
pair is linked when the weighted Jaccard similarity of the two whole texts is 0.8 or more.  First
the leader is the document that meets most others (mostly the text that copies were made from), or
everyone in a bucket of a few.  Then leaders leave, and buckets whose members are all of one class
close.  In what is left everyone leads.  So at the end any two documents of a bucket have been
compared or are in one class, but a bucket of near copies takes one comparison for each member.
Leaders are compared in blocks, so a member's text moves once for a block and not for each pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts_of, rows_of, small_batches, table
from .links import components

WORDS = 5
SIMILAR = 0.8
RARE = 1 << 32  # N / df beyond which an idf stays; more than documents can be
COUNTERS, SLICES = 1 << 22, 64
TAKEN = 8  # partitions of slices that the driver takes one after the other
BANDS, ROWS = 20, 6
HASHES = BANDS * ROWS
DRAWS = 1 << 14  # rows of the tables of draws; a shingle's hash names its row
SMALL = 16  # members of a bucket that are all leaders at once
BLOCK, LEAD_SHINGLES = 256, 250_000  # leaders that members are compared with together, and about their shingles
CHUNK = 512  # members that are compared with a block of leaders together
GROUP = 1 << 20  # bytes of texts whose words are hashed together
LONG_WORD = 256
MIX = np.uint64(0x9E3779B97F4A7C15)
LETTERS = np.random.default_rng(31).integers(0, 2**64, 256, dtype=np.uint64)
POWERS = np.cumprod(np.full(LONG_WORD, 0xD6E8FEB86659FD93, dtype=np.uint64))
#: bytes that are no letters, digits or parts of other characters become spaces
APART = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def _mixed(s: np.ndarray) -> np.ndarray:
    s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return s ^ (s >> np.uint64(30))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, where they begin): a polynomial of each word's bytes."""
    x = np.frombuffer(data, np.uint8)
    inside = x != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    size = end - begin
    first = np.cumsum(size) - size
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat(LETTERS[x[at]] * POWERS[np.minimum(place, LONG_WORD - 1)], first)
    h = _mixed(h + size.astype(np.uint64) * MIX)
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]])
    return h, begin


def _together(texts: list[bytes]) -> Iterator[np.ndarray]:
    h, begin = _hashed(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    yield from np.split(h, np.searchsorted(begin, ends)[:-1]) if texts else ()


def words_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in their order."""
    held, size = [], 0
    for text in texts:
        data = text.lower().encode("utf-8", "replace").translate(APART)
        if len(data) > GROUP:  # cut at spaces
            yield from _together(held)
            held, size, parts, at = [], 0, [], 0
            while at < len(data):
                end = data.find(b" ", at + GROUP)
                end = len(data) if end < 0 else end
                parts.append(_hashed(data[at:end])[0])
                at = end
            yield np.concatenate(parts)
            continue
        held.append(data)
        size += len(data)
        if size > GROUP:
            yield from _together(held)
            held, size = [], 0
    yield from _together(held)


def all_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles in their order; fewer than WORDS words are one shingle."""
    n = max(1, len(words) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        s = s * MIX + words[i : i + n]
    return _mixed(s)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles as sorted hashes, counts)"""
    return np.unique(all_shingles(words), return_counts=True)


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return 1 + np.log2(np.clip(n_docs / np.maximum(df, 1), 1, RARE)) / np.log2(min(max(n_docs, 2), RARE))


class Weights:
    """The idf of shingles by their document counts; those that aren't named are in one document."""

    def __init__(self, counts: dict[int, int], n_docs: int):
        self.known = np.array(sorted(counts), dtype=np.uint64)
        self.idf = idf(np.array([counts[int(s)] for s in self.known], dtype=np.float64), n_docs)
        self.rest = float(idf(np.ones(1), n_docs)[0])

    def of(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = self.rest * tf
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
            hit = self.known[at] == s
            w[hit] = tf[hit] * self.idf[at[hit]]
        return w


class Counted:
    """The idf of all shingles by a sketch of their document counts, in the slot of each counter."""

    def __init__(self, spark: SparkSession, idf_of: np.ndarray):
        self.idf = spark.sparkContext.broadcast(idf_of)

    def of(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.idf.value[slots(s)] * tf.astype(np.float64)

    def drop(self) -> None:
        self.idf.destroy()


def slots(s: np.ndarray) -> np.ndarray:
    """The counters of shingles, by bits that the rows of draws don't use."""
    return (s >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.intp)


def _ranked(ln_a: np.ndarray, row: np.ndarray) -> np.ndarray:
    """ln a in the order of 17 bits, with the row of the draws in the lower 15."""
    scaled = np.clip((ln_a + np.float32(24)) * np.float32((1 << 17) / 32), 0, (1 << 17) - 1).astype(np.uint32)
    return scaled << np.uint32(15) | row.astype(np.uint32)


@cache
def draws() -> tuple[np.ndarray, ...]:
    """r, ln c, b, and the ranked ln a of weight 2; (DRAWS, HASHES) each."""
    rng = np.random.default_rng(3)
    r, c = (rng.standard_gamma(2, (DRAWS, HASHES), dtype=np.float32) for _ in range(2))
    b = rng.random((DRAWS, HASHES), dtype=np.float32)
    ln_c = np.log(c)
    plain = ln_c - r * (np.floor(np.float32(np.log(2)) / r + b) - b) - r
    return r, ln_c, b, _ranked(plain, np.arange(DRAWS)[:, None])


def bands(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS consistent weighted samples each."""
    r, ln_c, b, plain = draws()
    row = (s & np.uint64(DRAWS - 1)).astype(np.intp)
    owner = np.empty(DRAWS, np.intp)
    order = np.lexsort((-np.arange(len(s)), w))
    owner[row[order]] = order  # of shingles with the same draws, the first of the heaviest: its ln a is the least
    ln_w = np.log(w).astype(np.float32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    usual = row[w == 2.0]
    for lo in range(0, len(usual), 2048):
        np.minimum(least, plain.take(usual[lo : lo + 2048], axis=0).min(axis=0), out=least)
    other = np.flatnonzero(w != 2.0)
    for lo in range(0, len(other), 2048):
        k = row[other[lo : lo + 2048]]
        rr, bb = r[k], b[k]
        ln_a = ln_c[k] - rr * (np.floor(ln_w[other[lo : lo + 2048], None] / rr + bb) - bb) - rr
        np.minimum(least, _ranked(ln_a, k[:, None]).min(axis=0), out=least)
    at = (least & np.uint32(DRAWS - 1)).astype(np.intp)
    shingle, col = owner[at], np.arange(HASHES)
    t = np.floor(ln_w[shingle] / r[at, col] + b[at, col]).astype(np.int64).astype(np.uint64)
    out = (s[shingle] + (t + np.uint64(1)) * MIX) * np.uint64(0x94D049BB133111EB)
    out = (out ^ (out >> np.uint64(31))).reshape(BANDS, ROWS)
    h = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        h = h * MIX + out[:, i]
    return h ^ (h >> np.uint64(32))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each counter in a partition, packed, in slices."""
    count = np.zeros(COUNTERS, np.int32)
    for part in (p for batch in batches for p in parts_of(batch, 0)):
        for words in words_of([t or "" for t in part.column(0).to_pylist()]):
            if len(words):
                count[np.unique(slots(all_shingles(words)))] += 1
    packed = [zlib.compress(c.tobytes(), 1) for c in np.split(count, SLICES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice follow each other; one with their sum for each."""
    at, held = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([held.sum()], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["slice", "total", "counts"])

    for batch in batches:
        for n, packed in rows_of(batch, 64):
            if n != at:
                if at is not None:
                    yield row()
                at, held = n, np.zeros(COUNTERS // SLICES, np.int64)
            held += np.frombuffer(zlib.decompress(packed), np.int32)
    if at is not None:
        yield row()


def _idf(total: int, n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The idf of each counter of a slice, of 4 bytes."""
        for batch in batches:
            for n, counts in rows_of(batch, 1):
                # counts of other shingles in the same counter
                df = np.rint(np.frombuffer(counts, np.int64) - total / COUNTERS)
                packed = idf(df, n_docs).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([packed], pa.binary())], names=["slice", "idf"])

    return run


def weights(texts: DataFrame) -> Counted:
    """Document counts of all shingles over all of ``texts`` (text).

    The counts stay on the executors; the driver takes the idf made from them, a few slices at a time."""
    parts = texts.mapInArrow(_counted, "slice int, counts binary").repartition("slice").sortWithinPartitions("slice")
    counts = cut(parts.mapInArrow(_added, "slice int, total long, counts binary"))
    total, n_docs = counts.agg(F.sum("total")).first()[0] or 0, texts.count()
    known = np.full(COUNTERS, idf(np.zeros(1), n_docs)[0], np.float32)
    size = COUNTERS // SLICES
    # COUNTERS numbers, whatever the size of the table
    for r in counts.select("slice", "counts").coalesce(TAKEN).mapInArrow(_idf(total, n_docs), "slice int, idf binary").toLocalIterator():
        known[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["idf"], np.float32)
    return Counted(texts.sparkSession, known)


SIGNED = "doc_id long, key binary, size long, bands array<long>"


def _signed(known: Weights | Counted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of(batch, 1)):
            texts = part.column(1).to_pylist()
            key, size, band = [], [], []
            for text, words in zip(texts, words_of(texts), strict=True):
                if len(words):
                    s, tf = shingles(words)
                    key.append(xxhash.xxh3_128_digest(words.tobytes()))
                    size.append(len(s))
                    band.append(bands(s, known.of(s, tf)).view(np.int64))
                else:
                    key.append(xxhash.xxh3_128_digest(b"\0" + text.encode("utf-8", "replace")))
                    size.append(0)
                    band.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key, pa.binary()), pa.array(size, pa.int64()), pa.array(band, pa.list_(pa.int64()))], names=[c.split()[0] for c in SIGNED.split(", ")])

    return run


class _Leaders:
    """Shingles of a block of leaders, to be compared with members one after the other."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]]):
        self.node = np.array([n for n, _, _ in rows], dtype=np.int64)
        s = np.concatenate([x for _, x, _ in rows])
        order = np.argsort(s, kind="stable")
        self.s, self.w = s[order], np.concatenate([w for _, _, w in rows])[order]
        self.owner = np.repeat(np.arange(len(rows)), [len(x) for _, x, _ in rows])[order]
        self.total = np.array([w.sum() for _, _, w in rows])
        self.root = list(range(len(rows)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def met(self, s: np.ndarray, w: np.ndarray, similar: float) -> np.ndarray:
        """Leaders with this similarity."""
        low = np.searchsorted(self.s, s)
        n = np.searchsorted(self.s, s, side="right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        least = np.bincount(self.owner[at], np.minimum(self.w[at], np.repeat(w, n)), minlength=len(self.node))
        return np.flatnonzero(least / (self.total + w.sum() - least) >= similar - 1e-12)


def _compared(known: Weights | Counted, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block and chunk follow each other, the leaders first.

        Leaders that one member joins are joined in the task, so links are fewer than rows."""
        at, rows, leaders = None, [], None
        for part in (p for batch in batches for p in parts_of(batch, 5)):
            links = []
            texts = part.column(5).to_pylist()
            for (hub, block, chunk, leads, node), words in zip(rows_of(part.select(range(5)), 4096), words_of(texts), strict=True):
                if (hub, block, chunk) != at:
                    at, rows, leaders = (hub, block, chunk), [], None
                s, tf = shingles(words)
                w = known.of(s, tf)
                if leads:
                    rows.append((node, s, w))
                    continue
                if leaders is None:
                    if not rows:
                        continue
                    leaders = _Leaders(rows)
                found = [i for i in leaders.met(s, w, similar).tolist() if leaders.node[i] != node]
                for k, i in enumerate(found):
                    if k == 0:
                        links.append((node, int(leaders.node[i])))
                    elif (x := leaders.find(found[0])) != (y := leaders.find(i)):
                        leaders.root[y] = x
                        links.append((int(leaders.node[found[0]]), int(leaders.node[i])))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verified(pending: DataFrame, texts: DataFrame, known: Weights | Counted, similar: float) -> DataFrame:
    """``pending`` (band, value, node, shingles, low, leads) -> links (a, b) of members and similar leaders.

    Leaders with the same hub (the foremost document that any of their buckets has) make blocks, so
    the buckets of a group of copies have few blocks in common."""
    bucket = ["band", "value"]
    lead = cut(pending.where("leads").groupBy("node").agg(F.min("low").alias("hub"), F.max("shingles").alias("shingles")))
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("shingles") / LEAD_SHINGLES))
    sizes = cut(lead.groupBy("hub").agg(F.greatest(parts, F.lit(1)).alias("parts")))
    blocks = cut(lead.join(sizes, "hub").select("node", "hub", F.pmod(F.xxhash64("node", F.lit(7)), "parts").alias("part")))
    asked = cut(pending.where("leads").join(blocks, "node").select(*bucket, "hub", "part").distinct())
    wanted = cut(pending.select(*bucket, "node").join(asked, bucket).select("hub", "part", "node").distinct())
    chunks = cut(wanted.groupBy("hub", "part").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")))
    wanted = wanted.join(chunks, ["hub", "part"]).select("hub", "part", F.pmod(F.xxhash64("node", F.lit(9)), "chunks").alias("chunk"), F.lit(False).alias("leads"), "node")
    each = blocks.join(chunks, ["hub", "part"]).select("hub", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("leads"), "node")
    both = cut(wanted.unionByName(each)).join(texts.select(F.col("doc_id").alias("node"), "text"), "node").select("hub", "part", "chunk", "leads", "node", "text")
    ordered = both.repartition("hub", "part", "chunk").sortWithinPartitions("hub", "part", "chunk", F.desc("leads"))
    return ordered.mapInArrow(_compared(known, similar), "a long, b long")


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, class_id: one row for each row, equal for near-duplicates.

    class_id is the least doc_id of the class.  Texts with the same words are alike; texts without
    words are alike when they are equal.  A null text is in a class of its own.  A doc_id stands
    for one document: its rows are in one class.  Rows without doc_id are compared with nothing and
    have no class.  Other columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    known = weights(texts.select("text"))
    signed = cut(texts.mapInArrow(_signed(known), SIGNED))
    distinct = cut(signed.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("size").alias("shingles")))
    members = cut(distinct.select("node", "shingles", F.posexplode("bands").alias("band", "value")))
    bucket = ["band", "value"]
    shared = cut(members.groupBy(*bucket).agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low < high").select(*bucket, "size"))
    pending = cut(members.join(shared, bucket))
    # whoever meets most others leads: the text that the copies were made from
    met = cut(pending.groupBy("node").agg(F.sum("size").alias("met")))
    order = -F.least("met", F.lit(1 << 42)) * (1 << 20) + F.xxhash64("node", F.lit(3)).bitwiseAND(F.lit((1 << 20) - 1))
    pending = cut(pending.drop("size").join(met, "node").withColumn("order", order).drop("met").withColumn("class", F.col("node")))
    roots = spark.createDataFrame([], "node long, root long")
    for all_lead in (False, True):
        held = pending.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("order").alias("low"), F.min("class").alias("c0"), F.max("class").alias("c1"))
        held = cut(held.where("c0 < c1").select(*bucket, "n", "low"))
        if held.isEmpty():
            break
        leads = F.lit(all_lead) | (F.col("n") <= SMALL) | (F.col("order") == F.col("low"))
        pending = cut(pending.join(held, bucket).withColumn("leads", leads).drop("n"))
        found = cut(_verified(pending, texts, known, similar))
        if not found.isEmpty():
            # components of the components that new links join
            at = lambda c: found.select("a", "b").join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
            found = at("a")
            met = components(at("b"))
            moved = roots.join(met.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            roots = cut(moved.unionByName(met))
        # leaders have met all members; whoever is left goes on with its new class
        pending = pending.where("NOT leads").select(*bucket, "node", "shingles", "order")
        pending = cut(pending.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root"))
    known.drop()  # all that reads it is written
    classes = distinct.select("key", F.col("node").alias("class_id"))
    classes = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select("key", F.coalesce("root", "class_id").alias("class_id"))
    named = signed.select("doc_id", "key").join(cut(classes), "key").select("doc_id", "class_id")
    return named.unionByName(rows.where("doc_id IS NULL OR text IS NULL").select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id.

    Of rows with this id the one of the least text stays (then of the least hash of all columns).  Null
    and empty texts are classes as in ``near_classes``.  Rows without doc_id stay, all other columns
    stay as they are, and an empty table stays empty."""
    first = near_classes(docs.where("doc_id IS NOT NULL"), similar).where("doc_id = class_id").groupBy("doc_id").count()
    first = cut(first)
    kept = docs.join(first.where("count = 1").select("doc_id"), "doc_id", "left_semi")
    kept = kept.unionByName(docs.where("doc_id IS NULL"))
    if first.where("count > 1").isEmpty():
        return kept
    # written first: grouped above a join of a union, rows of one id were not brought together
    several = cut(docs.join(first.where("count > 1").select("doc_id"), "doc_id", "left_semi"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = several.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct("text", F.xxhash64(*columns))).alias("row"))
    return kept.unionByName(row.select("row.*"))


def op3_weighted_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and kept for every document: kept marks the one that stays of each class.

    A null text is alone in its class, empty texts are one class, equal rows are one class, and an
    empty table gives no rows."""
    classes = near_classes(table(spark, sf_dir, "documents"))
    return classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))
