"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every distinct vector is hashed into ``tables`` tables; a table's key is the cell
``floor((a.x + b) / width)`` of ``hashes`` Gaussian projections.  A query visits its own cell and
then perturbed cells in the order of estimated success (expected squared distance to the crossed
borders, taken by rank).  Candidates of all tables are merged and ranked by the exact inner product.

Inner product search is reduced to distance search by one more component that brings every stored
vector to the largest norm of its range of norms.  Each range has a scale and cells of its own, and a
query probes the cells of all ranges, so a few long vectors don't press the others together.

A query that finds fewer than k + 1 entries, though there are more, is answered by an exact pass over
all entries in blocks.  The other answers are approximate: a nearer entry may lie in no probed cell.

Cells are spread over tasks in blocks of bounded size; equal vectors are one entry that keeps its
smallest ids, as many as an answer can use, so a vector repeated without end costs no more.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

HASHES, TABLES, WIDTH, PROBES = 4, 4, 1.5, 32
BLOCK_ROWS = 20_000  # rows of one cell that one task holds at most
SHARD_ROWS = 60_000  # index rows of one group of cells
RANGES = 2.0  # ranges of norms for each doubling of the norm
ASKED_ROWS = 2_000  # queries of a block of the exact pass


def probe_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of border ranks to cross, cheapest expected score first; the empty set is the own cell.

    Rank j (from 0) is the j-th nearest of the 2*hashes borders; ranks j and 2*hashes-1-j belong to
    the same projection and never occur together."""
    m = 2 * hashes
    low = [(j * (j + 1)) / (4 * (hashes + 1) * (hashes + 2)) for j in range(1, hashes + 1)]
    high = [1 - j / (hashes + 1) + j * (j + 1) / (4 * (hashes + 1) * (hashes + 2)) for j in range(hashes, 0, -1)]
    cost = low + high
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < probes:
        score, ranks = heapq.heappop(heap)
        if all(m - 1 - r not in ranks for r in ranks):
            found.append(ranks)
        last = ranks[-1]
        if last + 1 < m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*ranks, last + 1)))
    return found


class Hasher:
    """The random projections of all tables; the same seed gives the same cells everywhere."""

    def __init__(self, dim: int, largest: dict[int, float], hashes: int, tables: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.largest, self.hashes, self.tables = largest, hashes, tables
        self.a = rng.normal(size=(dim + 1, tables * hashes)) / width
        self.b = rng.uniform(size=tables * hashes)
        self.mix = rng.integers(1, 2**63, size=hashes, dtype=np.uint64) | np.uint64(1)

    def _key(self, cells: np.ndarray) -> np.ndarray:
        return ((cells.astype(np.int64).astype(np.uint64) + np.uint64(1 << 20)) * self.mix).sum(-1, dtype=np.uint64).view(np.int64)

    def stored(self, x: np.ndarray, span: np.ndarray) -> np.ndarray:
        """(n, tables) keys; span: the range of each vector's norm."""
        x = x / np.array([self.largest[int(r)] for r in span])[:, None]
        y = np.c_[x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))]
        return self._key(np.floor(y @ self.a + self.b).reshape(len(x), self.tables, self.hashes))

    def probes(self, q: np.ndarray, order: list[tuple[int, ...]]) -> np.ndarray:
        """(n, tables, probes) keys."""
        k = self.hashes
        y = np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]
        at = (y @ self.a + self.b).reshape(len(q), self.tables, k)
        cell = np.floor(at)
        inside = at - cell
        rank = np.argsort(np.concatenate([inside, 1 - inside], axis=-1), axis=-1, kind="stable")
        # the mirrored order makes rank j and 2k-1-j the two borders of one projection
        rank[..., k:] = (rank[..., :k][..., ::-1] + k) % (2 * k)
        step = np.zeros((*at.shape[:2], len(order), k))
        row, tab = np.ogrid[: len(q), : self.tables]
        for n, ranks in enumerate(order):
            for r in ranks:
                border = rank[..., r]
                step[row, tab, n, border % k] += np.where(border < k, -1, 1)
        return self._key(cell[:, :, None, :] + step)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _search(k: int):
    def search(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The best k entries of this group of cells for each query that probes it."""
        none = pd.DataFrame({"q": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if stored.empty or asked.empty:
            return none
        x, q = _matrix(stored["embedding"]), _matrix(asked["embedding"])
        cells = asked.groupby(["tab", "cell", "span", "salt"]).indices
        got = []
        for cell, rows in stored.groupby(["tab", "cell", "span", "salt"]).indices.items():
            if (at := cells.get(cell)) is None:
                continue
            ids = stored["v"].to_numpy()[rows]
            order = np.argsort(ids)
            rows, ids = rows[order], ids[order]
            for lo in range(0, len(at), 512):
                part = at[lo : lo + 512]
                score = q[part] @ x[rows].T
                n = min(k, len(rows))
                if n < len(rows):
                    # every entry that ties with the k-th stays, so the smaller id can win
                    keep = score >= np.partition(score, len(rows) - n, axis=1)[:, len(rows) - n, None]
                else:
                    keep = np.ones_like(score, dtype=bool)
                i, j = np.nonzero(keep)
                got.append((asked["q"].to_numpy()[part][i], ids[j], score[i, j]))
        if not got:
            return none
        found = pd.DataFrame({"q": np.concatenate([g[0] for g in got]), "v": np.concatenate([g[1] for g in got]), "score": np.concatenate([g[2] for g in got])})
        found = found.drop_duplicates(["q", "v"]).sort_values(["q", "score", "v"], ascending=[True, False, True])
        return found[found.groupby("q").cumcount() < k]

    return search


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, hashes: int = HASHES, tables: int = TABLES, width: float = WIDTH, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; a query's answer is the k nearest
    found among all other rows by inner product, ties to the smaller vec_id.  Null or zero vectors,
    vectors with null or non-finite components, rows without vec_id and vectors of another length
    than the most frequent one take no part.  Repeated vec_ids count once (the smallest vector).
    Other columns are ignored; an empty table gives an empty answer."""
    spark = vectors.sparkSession
    clean = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
        .where(~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        .withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c * c)))
        .where("norm > 0 AND norm < double('infinity')")
        .withColumn("span", F.floor(F.log2("norm") * RANGES).cast("int"))
    )
    sizes = clean.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0]["dim"]
    # norms are doubles, so there are at most some thousands of ranges
    largest = {r["span"]: r["norm"] * (1 + 1e-12) for r in clean.where(F.size("embedding") == dim).groupBy("span").agg(F.max("norm").alias("norm")).collect()}
    hasher, order = Hasher(dim, largest, hashes, tables, width, seed), probe_order(hashes, probes)

    # one entry for each distinct vector; an answer never needs more than its k + 1 smallest ids
    rows = clean.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min(F.struct("embedding", "span")).alias("least")).select("vec_id", "least.embedding", "least.span")
    rows = cut(rows.withColumn("digest", F.xxhash64("embedding")))
    entries = rows.groupBy("digest", "embedding").agg(F.min("vec_id").alias("v"), F.first("span").alias("span"), F.count("*").alias("copies"))
    entries = cut(entries.select("digest", "v", "embedding", "span", "copies"))
    first = rows.select("vec_id", "digest", "embedding").join(entries.where("copies > 1").select("digest", "embedding", "v"), ["digest", "embedding"]).select("v", "vec_id")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                keys = hasher.stored(_matrix(part["embedding"]), part["span"].to_numpy())
                for t in range(tables):
                    yield pd.DataFrame({"v": part["v"], "tab": np.int32(t), "cell": keys[:, t], "span": part["span"], "embedding": part["embedding"]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lo in range(0, len(part), 256):
                some = part.iloc[lo : lo + 256]
                keys = hasher.probes(_matrix(some["embedding"]), order)
                n = keys.shape[2]
                for t in range(tables):
                    yield pd.DataFrame({"q": np.repeat(some["v"].to_numpy(), n), "tab": np.int32(t), "cell": keys[:, t].ravel(), "embedding": np.repeat(some["embedding"].to_numpy(), n)})

    stored = entries.select("v", "span", "embedding").mapInPandas(index, "v long, tab int, cell long, span int, embedding array<double>")
    # queries with equal vectors share one search
    wanted = rows.where(F.col("vec_id") % every == 0).select("vec_id", "digest", "embedding")
    wanted = wanted.join(entries.select("digest", "embedding", "v"), ["digest", "embedding"]).select("vec_id", "v", "embedding")
    shared = wanted.groupBy("v").agg(F.first("embedding").alias("embedding"))
    asked = shared.mapInPandas(ask, "q long, tab int, cell long, embedding array<double>")

    # cells hold bounded blocks: a cell with more rows is cut by a salt and each part is probed
    n_entries = entries.count()
    shards = max(1, math.ceil(n_entries * tables / SHARD_ROWS))
    salts = stored.groupBy("tab", "cell", "span").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("salts"))
    stored = stored.join(salts, ["tab", "cell", "span"]).withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
    asked = asked.join(salts.select("tab", "cell", (F.col("span") + 0).alias("span"), "salts"), ["tab", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    shard = F.pmod(F.xxhash64("tab", "cell", "span", "salt"), F.lit(shards)).cast("int")
    stored, asked = stored.drop("salts").withColumn("shard", shard), asked.drop("salts").withColumn("shard", shard)
    found = stored.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_search(k + 1), "q long, v long, score double")
    best = found.groupBy("q", "v").agg(F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "v"))).where(F.col("n") <= k + 1)
    best = cut(best.drop("n"))

    # the exact pass for queries whose cells held too little
    enough = best.groupBy("q").count().where(F.col("count") >= min(k + 1, n_entries)).select(F.col("q").alias("v"))
    short = cut(shared.join(enough, "v", "left_anti"))
    n_short = short.count()
    if n_short:
        blocks, groups = math.ceil(n_entries / BLOCK_ROWS), math.ceil(n_short / ASKED_ROWS)
        whole = [F.lit(0).alias(c) for c in ("tab", "cell", "span", "salt")]  # a block is one cell
        block, group = (F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(n)).cast("int") for n in (blocks, groups))
        all_stored = entries.select("v", "embedding", *whole, block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        all_asked = short.select(F.col("v").alias("q"), "embedding", *whole, group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        exact = all_stored.groupBy("block", "group").cogroup(all_asked.groupBy("block", "group")).applyInPandas(_search(k + 1), "q long, v long, score double")
        exact = exact.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "v"))).where(F.col("n") <= k + 1).drop("n")
        best = cut(best.join(short.select(F.col("v").alias("q")), "q", "left_anti").unionByName(exact))

    # entries back to rows: the entry's own id, and the next smallest ids of repeated vectors
    members = first.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    members = members.withColumn("n", F.row_number().over(W.partitionBy("v", "part").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    members = members.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1).select("v", "vec_id")
    single = entries.where("copies = 1").select("v", F.col("v").alias("vec_id"))
    answers = best.join(members.unionByName(single), "v").select("q", "vec_id", "score")
    answers = answers.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    out = wanted.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(answers, "q").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector of ``embeddings`` whose vec_id is divisible by 20.

    Null, zero and non-finite vectors take no part; ties go to the smaller vec_id; an empty table gives
    no rows."""
    return nearest(table(spark, sf_dir, "embeddings"))
